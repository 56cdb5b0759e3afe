"""Token counts of whole texts under a public vocabulary file.

A text of up to ``HUGE_CHARS`` is counted at once.  A longer one is cut into
overlapping chunks, which are rows of their own, so one huge document is encoded
by many tasks.  Each chunk is encoded with offsets; neighbours are spliced at a
place in their overlap where both encodings have a token's edge and where the
vocabulary's own rules prove that no token, added token or normalisation can
reach across, whatever stands around (:class:`Rules`).  Documents in which two
neighbours have no such place go round again with wider overlaps, at last as
one chunk.

Rules are known for two kinds of ``.json`` files; texts of other files
(sentencepiece's ``.model`` among them) are encoded whole at any length.

Defined results: a null text is an empty one and has no tokens; a null id stays
null; repeated rows each get a row; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cache, stage, use_cache
from .tokens import vocabulary_path

#: Code points of the longest text that is counted at once, of a chunk and of an overlap.
HUGE_CHARS, CHUNK_CHARS, OVERLAP_CHARS = 65_536, 32_768, 512
#: By how much overlaps grow in each further round.
WIDEN = 8
#: Places offered for a splice: those next to the middle of an overlap.
OFFERED = 8
#: Bytes of text whose words are held at once, distinct words that are remembered, and the longest of them.
BYTES_AT_ONCE, MEMO_WORDS, MEMO_BYTES = 4 << 20, 400_000, 64
#: Digests of texts are broadcast up to this size, and shuffled beyond it.
DIGEST_BYTES, BROADCAST_BYTES = 120, 16 << 20

#: How the two kinds of vocabulary files cut texts before their merges.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

#: Proven for words without their white space: after white space, and where the kind of
#: character changes.  The right-hand character is one that composes with none before it;
#: an apostrophe before a letter may belong to either.
_LETTER, _MARK = "A-Za-z一-龥", "!-&(-/:-@\\[-`{-~、。，！？"
WORD_EDGE = re.compile(rf"(?<=[ \t-\r])(?=[!-~])|(?<=[0-9])(?=['{_LETTER}{_MARK}])|(?<=[{_LETTER}])(?=['0-9{_MARK}])|(?<=[{_MARK}])(?=[0-9{_LETTER}])")
#: Proven for byte-level pieces: a single space between two visible characters begins a piece.
BYTE_EDGE = re.compile(r"(?<=[!-~])(?= [!-~])")


class Rules:
    """A vocabulary file: its library, and the places where its encodings can be spliced.

    For a file that drops white space a word between two white characters has
    the same tokens anywhere: its pattern matches no white space, a white
    character composes with nothing, and added tokens hold none.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.edge: re.Pattern | None = None
        self.by_words = False
        self._memo: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        import json

        from tokenizers import Tokenizer

        library = self.library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self._lengths = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        said = json.loads(library.to_str())
        added = [t.content for t in library.get_added_tokens_decoder().values()]
        plain = all(not re.search(r"\s", a) for a in added)
        plain &= not any(b.startswith(a[i:]) for a in added for b in added for i in range(1, len(a)))
        plain &= not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in library.get_added_tokens_decoder().values())
        self.margin = max([1, *map(len, added)]) + 1
        cut = said["pre_tokenizer"] or {}
        first, steps = (cut.get("pretokenizers") or [{}])[0], (said["normalizer"] or {}).get("normalizers", [])
        words = first.get("pattern") == {"Regex": WORD_PATTERN} and first.get("behavior") == "Removed" and first.get("invert")
        if plain and words and [s["type"] for s in steps] == WORD_NORMALIZERS and steps[1]["pattern"] == {"Regex": r"\s+"}:
            self.edge, self.by_words = WORD_EDGE, True
        elif plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not said["normalizer"]:
            self.edge = BYTE_EDGE

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        return [n for some in _slices(texts) for n in (self._by_words(some) if self.by_words else self._lengths(some))]

    def _by_words(self, texts: list[str]) -> list[int]:
        split = [t.encode().split() for t in texts]  # at ASCII white space
        young, old = self._memo
        missing = set().union(*split).difference(young)
        long = {w for w in missing if len(w) > MEMO_BYTES}
        young.update((w, old[w]) for w in missing if w in old)
        learn = [w for w in missing if w not in young]
        young.update(zip(learn, self._lengths([w.decode() for w in learn]), strict=True))
        out = [sum(map(young.__getitem__, words)) for words in split]
        for w in long:
            del young[w]
        if len(young) > MEMO_WORDS:
            self._memo = ({}, young)
        return out

    def places(self, text: str, start: int, end: int) -> np.ndarray:
        """Proven places between two offsets, those next to their middle."""
        low, high = start + self.margin, end - self.margin
        found = np.array([m.start() for m in self.edge.finditer(text, low, high + 1)], np.int64)
        found = found[(found >= low) & (found <= high)]
        near = np.argsort(np.abs(found - (start + end) // 2), kind="stable")
        return np.sort(found[near[:OFFERED]])

    def chunk(self, text: str, overlap: int, first: bool, last: bool) -> tuple[int, list, list]:
        """Tokens of a chunk, and for its two overlaps the places with the tokens before each."""
        got = self.library.encode(text, add_special_tokens=False)
        offsets = np.array(got.offsets, np.int64).reshape(-1, 2)

        def edges(places: np.ndarray) -> list[tuple[int, int]]:
            ended, begun = np.searchsorted(offsets[:, 1], places, "right"), np.searchsorted(offsets[:, 0], places, "left")
            return [(int(p), int(n)) for p, n, m in zip(places, ended, begun, strict=True) if n == m]

        head = [] if first else edges(self.places(text, 0, overlap))
        tail = [] if last else edges(self.places(text, len(text) - overlap, len(text)))
        return len(offsets), head, tail


def _slices(texts: list[str]) -> Iterator[list[str]]:
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= BYTES_AT_ONCE:
            yield some
            some, held = [], 0
    if some:
        yield some


_rules: dict[str, Rules] = {}
cache("token-counts", _rules.clear)


def rules(path: str) -> Rules:
    """The Python worker's rules for a vocabulary file."""
    use_cache("token-counts")
    if path not in _rules:
        _rules[path] = Rules(path)
    return _rules[path]


@lru_cache(maxsize=8)
def _has_edges(path: str) -> bool:
    return Rules(path).edge is not None


def chunks(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Starts and ends of the chunks of a text of ``n`` code points."""
    step = chunk - overlap
    starts = range(0, max(1, n - overlap), step)
    return [(s, min(n, s + chunk)) for s in starts]


def _spliced(texts: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """``digest, n_tokens`` of texts with a ``digest``; ``n_tokens`` is null where two chunks can't be spliced."""
    piece = "digest string, k long, last boolean, piece string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = chunks(len(text), chunk, overlap)
                for i in range(0, len(whole), 64):
                    some = whole[i : i + 64]
                    yield pa.record_batch(
                        [
                            pa.array([digest] * len(some)),
                            pa.array(range(i, i + len(some)), pa.int64()),
                            pa.array([b == len(text) for _, b in some]),
                            pa.array([text[a:b] for a, b in some]),
                        ],
                        names=["digest", "k", "last", "piece"],
                    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rules(vocabulary)
        place = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
        for batch in batches:
            k, last = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            got = [known.chunk(batch.column(3)[i].as_py(), overlap, k[i] == 0, last[i]) for i in range(len(k))]
            step = chunk - overlap
            heads, tails = ([[{"at": p + i * step, "before": n} for p, n in g[side]] for i, g in zip(k, got, strict=True)] for side in (1, 2))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([g[0] for g in got], pa.int64()), pa.array(heads, place), pa.array(tails, place)],
                names=["digest", "k", "last", "tokens", "head", "tail"],
            )

    # Equal texts have equal chunks: one of each is encoded.
    rows = texts.select("digest", "text").mapInArrow(cut, piece).dropDuplicates(["digest", "k"])
    place = "array<struct<at:long,before:long>>"
    got = rows.mapInArrow(encode, f"digest string, k long, last boolean, tokens long, head {place}, tail {place}")
    got = stage(got, "token-chunks")
    got = got.withColumn("following", F.lead("head").over(Window.partitionBy("digest").orderBy("k")))

    def at(x: Column) -> Column:
        return F.transform(x, lambda s: s["at"])

    def before(x: Column) -> Column:
        return F.get(F.filter(x, lambda s: s["at"] == F.col("cut")), 0)["before"]

    got = got.withColumn("cut", F.get(F.array_intersect(at(F.col("tail")), at(F.col("following"))), 0))
    own = F.when(F.col("last"), F.col("tokens")).otherwise(before(F.col("tail")) - before(F.col("following")))
    failed = F.max(~F.col("last") & F.col("cut").isNull())
    return got.groupBy("digest").agg(F.when(~failed, F.sum(own)).alias("n_tokens"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() * DIGEST_BYTES <= BROADCAST_BYTES else df


def count_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    limit: int = 2048,
    huge_chars: int = HUGE_CHARS,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    huge = F.length("text") > huge_chars if _has_edges(vocabulary) else F.lit(False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rules(vocabulary)
        for batch in batches:
            given = batch.column(2).to_pylist()
            counts = iter(known.counts([t for t in given if t is not None]))
            n = pa.array([None if t is None else next(counts) for t in given], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), n, batch.column(3)], names=["doc_id", "n_bytes", "n_tokens", "digest"])

    given = texts.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(~huge, F.col("text")).alias("text"), F.when(huge, F.sha2("text", 256)).alias("digest"),
    )
    out = stage(given.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, digest string"), "token-counts")
    left = out.filter("digest is not null").select("digest").distinct()
    whole = texts.filter(huge).select(F.sha2("text", 256).alias("digest"), "text")
    chunk, overlap, found = chunk_chars, overlap_chars, []
    while left.take(1):
        some = whole.join(_few(left), "digest", "left_semi") if found else whole
        got = stage(_spliced(some, vocabulary, chunk, overlap), "token-splices")
        found.append(got.filter("n_tokens is not null"))
        left = got.filter("n_tokens is null").select("digest")
        overlap, chunk = overlap * WIDEN, max(chunk, 4 * overlap * WIDEN)
    if found:
        spliced = found[0]
        for more in found[1:]:
            spliced = spliced.unionByName(more)
        spliced = spliced.select("digest", F.col("n_tokens").alias("spliced"))
        out = out.join(_few(spliced), "digest", "left").withColumn("n_tokens", F.coalesce("n_tokens", "spliced"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
