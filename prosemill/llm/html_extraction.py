"""Main text of web pages by a linear-chain conditional random field.

A page is the chain of its leaf blocks.  Features are the tags and attribute
words of all ancestors, the block's own tag, and the shape of its text (length,
links, punctuation, signs).  The field is trained by gradient steps on the
exact likelihood of labelled pages; each page is decoded by Viterbi.

Defined results: a null or empty page, or one without main blocks, has an empty
text; a null id or url is passed on; repeated rows are extracted alike; an
empty table gives an empty result; other columns of the input are ignored.
Very long pages are parsed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import page_samples
from .html_blocks import Block, blocks
from .page_samples import labelled_pages

#: Labelled pages, gradient steps, and the weight of the squared norm.
PAGES, STEPS, RATE, RIDGE = 1000, 120, 0.15, 2e-4
KNOWN_PATHS = 100_000
#: Words that label what is no article, looked for in short blocks.
LABELS = frozenset(page_samples.LABEL_WORDS)


def path_features(path: tuple) -> list[str]:
    out = ["bias"]
    for node in path:
        out.append(f"in:{node.tag}")
        out += [f"at:{w}" for w in node.words]
    if path:
        out.append(f"own:{path[-1].tag}")
        out += [f"own:{path[-1].tag}:{w}" for w in path[-1].words]
    out.append(f"depth:{min(len(path), 8)}")
    return list(dict.fromkeys(out))


def text_features(block: Block) -> list[str]:
    text = block.text
    n = len(text)
    share = block.linked / max(n, 1)
    out = [
        f"size:{n.bit_length()}",
        f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"stops:{min(text.count('. ') + text.count(', '), 4)}",
        f"end:{text[-1] if text[-1] in '.!?:;,' else 'other'}",
    ]
    if block.linked and n < 60:
        out.append("short-link")
    if n < 100:
        out += [f"says:{w}" for w in LABELS.intersection(re.findall(r"[a-z]+", text.lower()))]
    if "©" in text:
        out.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        out.append("bars")
    return out


@dataclass
class Field:
    """Emission weights by feature (of main less other), and the chain's own."""

    weights: dict[str, float]
    moves: np.ndarray  # 2 x 2, from and to
    start: np.ndarray

    def __post_init__(self) -> None:
        self._paths: dict[tuple, float] = {}

    def emission(self, block: Block) -> float:
        w = self.weights
        paths = self._paths
        base = paths.get(block.path)
        if base is None:
            if len(paths) >= KNOWN_PATHS:
                paths.clear()
            base = paths[block.path] = sum(w.get(f, 0.0) for f in path_features(block.path))
        return base + sum(w.get(f, 0.0) for f in text_features(block))

    def decode(self, chain: list[Block]) -> list[bool]:
        """Viterbi: the labels of highest total score."""
        if not chain:
            return []
        (oo, om), (mo, mm) = self.moves.tolist()
        other, main = self.start.tolist()
        main += self.emission(chain[0])
        back: list[tuple[bool, bool]] = []
        for block in chain[1:]:
            e = self.emission(block)
            other_from, main_from = main + mo > other + oo, main + mm >= other + om
            back.append((other_from, main_from))
            other, main = (main + mo if other_from else other + oo), (main + mm if main_from else other + om) + e
        label = main >= other
        labels = [label]
        for other_from, main_from in reversed(back):
            label = main_from if label else other_from
            labels.append(label)
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        chain = blocks(page)
        return "\n".join(b.text for b, keep in zip(chain, self.decode(chain), strict=True) if keep)


def _labels(chain: list[Block], main: list[str]) -> list[int]:
    """Marks the blocks that are the page's main texts, in order."""
    out, at = [], 0
    for b in chain:
        hit = at < len(main) and b.text == " ".join(main[at].split())
        out.append(int(hit))
        at += hit
    return out


def fit(pages: list[tuple[str, list[str]]], steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Field:
    """Maximum likelihood with a squared penalty, by Adam over all pages at once."""
    names: dict[str, int] = {}
    ends, columns, labels, lengths = [], [], [], []
    for page, main in pages:
        chain = blocks(page)
        if not chain:
            continue
        lengths.append(len(chain))
        labels += _labels(chain, main)
        for b in chain:
            for f in path_features(b.path) + text_features(b):
                columns.append(names.setdefault(f, len(names)))
            ends.append(len(columns))
    column = np.array(columns)
    starts = np.array([0, *ends[:-1]])
    of = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
    y = np.array(labels)
    longest, n = max(lengths), len(lengths)
    place = np.full((n, longest), -1)
    at = 0
    for i, k in enumerate(lengths):
        place[i, :k] = np.arange(at, at + k)
        at += k
    real = place >= 0
    gold = np.where(real, y[place], 0)
    w, moves, start = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    gold_moves = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & real[:, 1:]).sum() for j in (0, 1)] for i in (0, 1)], float)
    gold_start = np.bincount(gold[:, 0], minlength=2).astype(float)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, moves, start)]
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, 2))
        e[..., 1] = np.where(real, np.add.reduceat(w[column], starts)[place], 0)
        forward = np.empty((n, longest, 2))
        forward[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            reach = np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1]) + e[:, t]
            forward[:, t] = np.where(real[:, t, None], reach, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        backward = np.zeros((n, longest, 2))
        pair = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            ahead = e[:, t + 1] + backward[:, t + 1]
            both = forward[:, t, :, None] + moves + ahead[:, None, :] - total[:, None, None]
            pair += np.exp(both)[real[:, t + 1]].sum(0)
            reach = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(real[:, t + 1, None], reach, 0)
        chance = np.exp(forward + backward - total[:, None, None])
        p = np.zeros(len(y))
        p[place[real]] = chance[..., 1][real]
        grads = [np.bincount(column, (p - y)[of], len(names)) / n + ridge * w, (pair - gold_moves) / n + ridge * moves, (chance[:, 0].sum(0) - gold_start) / n + ridge * start]
        for value, grad, s in zip((w, moves, start), grads, state, strict=True):
            s[0] += 0.1 * (grad - s[0])
            s[1] += 0.01 * (grad * grad - s[1])
            value -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(w[i]) for f, i in names.items()}, moves, start)


@lru_cache(maxsize=2)
def default_field(pages: int = PAGES, seed: int = 1) -> Field:
    """The field trained on made pages; fitted once in a process."""
    return fit(labelled_pages(pages, seed))


def extract_pages(pages: DataFrame, field: Field | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; no shuffle, and tasks receive only the weights."""
    sent = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                texts = [field.main_text(x) for x in some.column(2).to_pylist()]
                yield pa.record_batch(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
