"""Fill-in-the-middle form of whole texts.

One automaton walks a text and stops at events only: ASCII white space, which
alone changes the class of a character, and the sentinels.  The gap between two
white characters is either empty or the visible part of exactly one unit, so the
number of units, and the place where any one of them ends, follow from the
events' offsets by arithmetic; no unit is ever cut out.  Seeded hashes of the id
choose form and places; prefix, suffix and middle are three slices of the text.

Units: white space with the visible run after it; white space at the end is one.

Defined results: a null or empty text is plain with no units; a null id is
hashed as an empty string; a text that spells a sentinel is plain; repeated rows
each get a row; an empty table gives an empty result; other columns of the input
are ignored (:func:`transform`, :func:`digests`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

WHITE_CHARS = " \t\n\x0b\x0c\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares, in percent, of texts that are rearranged, and of those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
#: Texts of one record batch of outputs.
TEXTS_AT_ONCE = 64


@dataclass
class Events:
    """What the scan of a text has found: ``n`` units, their ends, and whether a sentinel is among the events."""

    n: int
    ends: np.ndarray
    sentinel: bool

    def end(self, rank: int) -> int:
        """Offset after the first ``rank`` units."""
        return int(self.ends[rank - 1]) if rank else 0


_automata: list = []


def automaton():
    """White characters have the value 0, sentinels 1."""
    if not _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for c in WHITE_CHARS:
            made.add_word(c, 0)
        for s in (PREFIX, SUFFIX, MIDDLE):
            made.add_word(s, 1)
        made.make_automaton()
        _automata.append(made)
    return _automata[0]


def events(text: str) -> Events:
    spelled = []

    def white() -> Iterator[int]:
        yield -1
        for place, kind in automaton().iter(text):
            if kind:
                spelled.append(place)
            else:
                yield place
        yield len(text)

    at = np.fromiter(white(), np.int64)
    # A gap of more than nothing holds the visible part of one unit, which ends at the event after it.
    ends = at[1:][np.diff(at) > 1]
    if len(at) > 2 and at[-2] == len(text) - 1:
        ends = np.append(ends, len(text))
    return Events(len(ends), ends, bool(spelled))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four groups of eight digits of the id's digest."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(raw[i : i + 4], "big") for i in range(0, 16, 4))


def rearranged(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, str, int, int | None, int | None]:
    """Output, form, units, and code points of prefix and middle (None if plain)."""
    found = events(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or found.sentinel or h3 % 100 >= rate:
        return text, "plain", found.n, None, None
    first, second = sorted((h1 % (found.n + 1), h2 % (found.n + 1)))
    a, b = found.end(first), found.end(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", "spm", found.n, a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "psm", found.n, a, b - a


def restored(output: str, form: str) -> str:
    """The text, from output and form alone.

    No part holds a sentinel, and none can arise where a part meets one, since
    sentinels begin with a character that is nowhere else in them.
    """
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, form, n, prefix_chars, middle_chars`` and ``output``, the text as a model is to see it."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(i, TEXTS_AT_ONCE)
                rows = [rearranged(t, d, seed, rate, suffix_first) for d, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)]
                output, form, n, prefix, middle = zip(*rows, strict=True)
                yield pa.record_batch(
                    [some.column(0), pa.array(form), *[pa.array(x, pa.int64()) for x in (n, prefix, middle)], pa.array(output)],
                    names=["doc_id", "form", "n", "prefix_chars", "middle_chars", "output"],
                )

    return _texts(docs, id_col, text_col).mapInArrow(change, "doc_id long, form string, n long, prefix_chars long, middle_chars long, output string")


def restore(changed: DataFrame) -> DataFrame:
    """``changed`` with ``restored``, the text that output and form stand for."""
    names = [f for f in changed.schema.fields if f.name != "restored"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", restored string"

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(i, TEXTS_AT_ONCE)
                texts = map(restored, some.column("output").to_pylist(), some.column("form").to_pylist())
                yield some.append_column("restored", pa.array(list(texts), pa.string()))

    return changed.select(*[F.col(f"`{f.name}`") for f in names]).mapInArrow(back, kind)


def digests(docs: DataFrame, **options) -> DataFrame:
    """Every row's form, places, and the digests of its output and of the text rebuilt from that."""
    both = restore(transform(docs, **options))
    return stage(
        both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")),
        "middle",
    )
