"""Audit of how the sources of a language diverge in their words.

First pass: exact document frequencies of all terms; a language keeps those of
enough documents.  Second pass: an automaton of the kept terms, each between
delimiters, recounts their occurrences in texts whose other characters have
become delimiters.  What it yields are sparse postings (source, term, count):
every kept term has one, as it occurs somewhere, and a source without one has
the smoothed share of a count of 0.

Kept terms may outgrow a Python worker: they are dealt to slices of
``SLICE_BYTES``, and the second pass goes over the texts once a slice.  A slice
is broadcast; its size is what makes the slices.

Postings are combined in each task before they are shuffled, so a source or a
language of any size is spread over all tasks.  Shares are exact integers.
Distances of all pairs of sources are summed from dealt blocks of terms with
``BLOCK_CELLS`` cells at most (a row a source where there are more sources).

Defined results: null texts, languages and sources are empty ones; a group
without kept terms has a size of 0 and is compared like others; a language that
keeps no term gives its pairs with 0 and no terms; ties are ranked by item;
repeated rows count each; rows without an id count like others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, cache, stage, use_cache

LEAST_DOCS, SMOOTHING, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of terms of a slice of the vocabulary; an automaton takes about 60 times as much.
SLICE_BYTES = 3 << 20
#: Distinct terms, or postings, that a task holds before it hands them on.
HELD = 400_000
#: Cells (sources times terms) of a block in which distances are summed.
BLOCK_CELLS = 100_000
#: Counts that are gathered before equal ones are added up.
LOOSE = 2_000_000

#: What is no letter becomes a space and A-Z lose their case; other bytes are parts of characters beyond ASCII.
_LETTERS = bytes(range(0x61, 0x7B))
TABLE = bytes(b if b >= 0x80 or b in _LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normal(text: str) -> bytes:
    return text.encode().translate(TABLE)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``lang, term, n_docs`` of every term of a table with ``lang`` and ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                terms = pa.array(found.keys(), pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.array([lang] * len(found)), terms, pa.array(found.values(), pa.int64())], names=["lang", "term", "n_docs"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[lang].update(set(normal(text).split()))
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    got = docs.select("lang", "text").mapInArrow(count, "lang string, term string, n_docs long")
    return got.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))


_automata: dict[str, tuple] = {}
cache("source-audit", _automata.clear)


def automata(name: str, terms: list[tuple[int, str, str]]) -> dict:
    """The Python worker's automaton of each language, over its terms between spaces."""
    use_cache("source-audit")
    if name not in _automata:
        import ahocorasick

        _automata.clear()
        made: dict[str, ahocorasick.Automaton] = {}
        for number, lang, term in terms:
            if lang not in made:
                made[lang] = ahocorasick.Automaton()
            made[lang].add_word(f" {term} ", number)
        for a in made.values():
            a.make_automaton()
        _automata[name] = made
    return _automata[name]


class Postings:
    """Counts of (group, term) of a task, added up whenever there are many."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self._loose: list[np.ndarray] = []
        self._n = 0
        self._keys, self._counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, lang: str, source: str, terms: list[int]) -> None:
        group = self.groups.setdefault((lang, source), len(self.groups))
        self._loose.append(np.array(terms, np.int64) + (group << 32))
        self._n += len(terms)
        if self._n > LOOSE:
            self._combine()

    def _combine(self) -> None:
        new, counts = np.unique(np.concatenate([np.empty(0, np.int64), *self._loose]), return_counts=True)
        keys, place = np.unique(np.concatenate([self._keys, new]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, np.concatenate([self._counts, counts]))
        self._keys, self._counts, self._loose, self._n = keys, total, [], 0

    def full(self) -> bool:
        return len(self._keys) > HELD or len(self.groups) > HELD

    def take(self) -> pa.RecordBatch:
        self._combine()
        names = list(self.groups)
        group = (self._keys >> 32).astype(np.int32)
        lang, source = (pa.DictionaryArray.from_arrays(pa.array(group), pa.array([n[i] for n in names], pa.string())).dictionary_decode() for i in (0, 1))
        out = pa.record_batch([lang, source, pa.array(self._keys & 0xFFFFFFFF), pa.array(self._counts)], names=["lang", "source", "number", "count"])
        self.__init__()
        return out


def occurrences(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, term, count`` of the kept terms that occur, from a table with ``lang``, ``source`` and ``text``.

    ``kept`` has ``lang, term``.
    """
    spark = docs.sparkSession
    size = kept.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    kept = kept.withColumn("slice", bucket_of(slices, "lang", "term"))
    found = None
    for i in range(slices):
        terms = [(n, r["lang"], r["term"]) for n, r in enumerate(kept.filter(F.col("slice") == i).select("lang", "term").collect())]
        sent, name = spark.sparkContext.broadcast(terms), uuid.uuid4().hex

        def count(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            known = automata(name, sent.value)
            held = Postings()
            for batch in batches:
                for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if lang in known:
                        spaced = f" {normal(text).decode()} "
                        held.add(lang, source, [n for _, n in known[lang].iter(spaced)])
                if held.full():
                    yield held.take()
            yield held.take()

        got = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, number long, count long")
        got = got.groupBy("lang", "source", "number").agg(F.sum("count").alias("count"))
        names = spark.createDataFrame([(n, t) for n, _, t in terms], "number long, term string")
        got = stage(got.join(F.broadcast(names), "number").select("lang", "source", "term", "count"), "audit-postings")
        sent.unpersist()
        found = got if found is None else found.unionByName(got)
    return found


def _share(count: Column, size: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (count + SMOOTHING) / (size + SMOOTHING * terms))``, exactly."""
    top = (count + F.lit(SMOOTHING)).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    bottom = (size + F.lit(SMOOTHING) * terms).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, bottom)


def _distances(shares: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """``lang, source, item, value``: for each pair of sources the sum over all kept terms.

    ``shares`` has ``lang, source, term, p`` of the postings; ``groups`` has
    ``lang, source, p0``; ``blocks`` has ``lang, n_blocks``.
    """
    dealt = shares.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("n_blocks")))
    every = groups.join(blocks, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))

    def block(key: tuple, some: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", ignore_index=True)
        row = pd.Index(sources["source"]).get_indexer(some["source"])
        column, _ = pd.factorize(some["term"])
        n = int(column.max()) + 1 if len(column) else 0
        p = np.repeat(sources["p0"].to_numpy(np.int64)[:, None], n, axis=1)
        p[row, column] = some["p"].to_numpy(np.int64)
        # Row by row, so that no more than the block is held twice.
        sums = np.array([np.abs(p - own).sum(axis=1) for own in p], np.int64).reshape(len(p), len(p))
        of, to = np.nonzero(~np.eye(len(p), dtype=bool))
        names = sources["source"].to_numpy()
        return pd.DataFrame({"lang": key[0], "source": names[of], "item": names[to], "value": sums[of, to]})

    pairs = dealt.select("lang", "block", "source", "term", "p").groupBy("lang", "block")
    sources = every.select("lang", "block", "source", "p0").groupBy("lang", "block")
    got = pairs.cogroup(sources).applyInPandas(block, "lang string, source string, item string, value long")
    return got.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group (see the module)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = stage(document_frequencies(docs).filter(F.col("n_docs") >= least_docs), "audit-terms")
    postings = stage(occurrences(docs, kept), "audit-counts")

    groups = stage(docs.select("lang", "source").distinct(), "audit-groups")
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("count").alias("size"))
    # A row a group; none where its language keeps no term.
    groups = groups.join(sizes, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = stage(groups.select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("terms", F.lit(0)).alias("terms")), "audit-sizes")
    some = groups.filter("terms > 0")
    zero = some.select("lang", "source", _share(F.lit(0), F.col("size"), F.col("terms")).alias("p0"))
    shares = postings.join(some, ["lang", "source"]).select("lang", "source", "term", "count", _share(F.col("count"), F.col("size"), F.col("terms")).alias("p"))

    blocks = some.groupBy("lang").agg(F.count("*").alias("n"), F.max("terms").alias("terms"))
    blocks = blocks.select("lang", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") * F.col("terms") / F.lit(BLOCK_CELLS))).alias("n_blocks"))
    sums = _distances(shares, zero, blocks)
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    whole = postings.groupBy("lang", "term").agg(F.sum("count").alias("all"))
    of = some.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.max("terms").alias("terms"))
    whole = whole.join(of, "lang").select("lang", "term", _share(F.col("all"), F.col("lang_size"), F.col("terms")).alias("q"))
    above = shares.join(whole, ["lang", "term"]).filter("p > q")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(above.withColumn("rank", rank).filter(F.col("rank") <= top))
