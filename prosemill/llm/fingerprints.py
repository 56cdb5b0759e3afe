"""Document fingerprints by consistent weighted sampling.

A text is a bag of words with their counts as weights.  For each of the
``SAMPLES`` positions and each word two gamma(2, 1) values r and c and a uniform
b come from hashes of word and position; with t = floor(ln weight / r + b) the
word of least ln c - r (t - b + 1) is the sample, together with its t.  Two
texts agree in a position with a probability equal to their generalised
Jaccard similarity, so the share of equal positions estimates it.  The gamma
values are looked up among ``LEVELS`` quantiles (of c as many again below the
least), which costs less than taking logarithms; b makes ties as good as
impossible.

All of it is DataFrame expressions.  Texts are shuffled once, into small
ranges of ids of about ``RANGE_BYTES`` and ``MOST_RANGE`` times that at most (but
for one row, or equal rows of one part of the input), where the next text is the
next row: the first row of each range is sent to the range before it too.  Words are counted
and samples taken without another shuffle, since a range holds whole texts.

Defined results: a null text is an empty one; a text without words has an
empty fingerprint, like only another empty one; rows of one id follow each
other by a hash of their texts, and repeated rows each get a row; a row without an id has no
next document, so its edited text is its own first half and ``near_next`` is
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, stage

SAMPLES = 128
LEVELS = 1024
#: Positions of one row of the sampling aggregate: more would make its compiled code too long.
PER_ROW = 4
RANGE_BYTES = 256 << 10
#: A range that holds more than so many times as much is cut again, into parts by quantiles.
MOST_RANGE, SPLIT = 3, 64
#: What a row weighs beside its text.
ROW_BYTES = 64
#: The order of rows: rows of one id follow each other by a hash of their texts.
ORDER = ("doc_id", "hash", "origin")
#: First ids of ranges and cuts are broadcast up to this size, and shuffled beyond it.
FIRST_BYTES, CUT_BYTES, BROADCAST_BYTES = 16, 8 * 64 + 32, 16 << 20
#: Ranges that are put in order at once, and then their groups.
RANGES_AT_ONCE = 4_096
#: Quantiles by which ids are cut before each part is cut evenly.
QUANTILES = 32
ID_BITS = 22


def gamma_quantile(p: float) -> float:
    """Of gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if -math.expm1(-mid) - mid * math.exp(-mid) < p else (low, mid)
    return high


@lru_cache(maxsize=1)
def _tables() -> tuple[Column, Column, Column]:
    """Quantiles of r, the logarithms of those of c, and of those of c below its first level."""
    at = [(i + 0.5) / LEVELS for i in range(LEVELS)]
    wide = [gamma_quantile(p) for p in at]
    deep = [gamma_quantile(p / LEVELS) for p in at]
    values = (wide, [math.log(x) for x in wide], [math.log(x) for x in deep])
    # One literal each, which the optimiser folds into an array.
    return tuple(F.split(F.lit(",".join(f"{x:.6g}" for x in v)), ",").cast("array<double>") for v in values)


def _random(dealt: DataFrame, per_row: int) -> DataFrame:
    """Adds for each position of a row the values that depend on word and position alone.

    They are columns of their own, so that each is looked up once for all weights.
    """
    hashes = {}
    for k in range(per_row):
        position = (F.col("part") * per_row + k).cast("long")
        hashes |= {f"x{k}": F.xxhash64("word", position)}
    dealt = dealt.withColumns(hashes)
    wide, log_wide, log_deep = _tables()
    bits = LEVELS.bit_length() - 1

    def level(x: Column, shift: int) -> Column:
        return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(LEVELS - 1)).cast("int")

    values = {}
    for k in range(per_row):
        x = F.col(f"x{k}")
        c = F.when(level(x, bits) > 0, F.get(log_wide, level(x, bits))).otherwise(F.get(log_deep, level(x, 2 * bits)))
        b = F.shiftrightunsigned(x, 3 * bits).bitwiseAND(F.lit((1 << 30) - 1))
        values |= {f"r{k}": F.get(wide, level(x, 0)), f"c{k}": c, f"b{k}": (b + F.lit(0.5)) / F.lit(float(1 << 30))}
    return dealt.withColumns(values)


def _sample(k: int, weight: Column) -> Column:
    """A long whose least one over the words names the sample in its low bits; ``weight`` is a logarithm."""
    r, c, b, x = (F.col(f"{n}{k}") for n in "rcbx")
    t = F.floor(weight / r + b)
    value = c - r * (t - b + F.lit(1.0))
    # 2^31 steps for each unit; the logarithm stays far within -2^6 and 2^6.
    scaled = F.shiftleft(((F.greatest(value, F.lit(-63.0)) + F.lit(64.0)) * F.lit(float(1 << 31))).cast("long"), ID_BITS)
    name = F.shiftrightunsigned(x, 64 - ID_BITS).bitwiseXOR(t * F.lit(0x9E37)).bitwiseAND(F.lit((1 << ID_BITS) - 1))
    return F.when(weight.isNotNull(), scaled.bitwiseOR(name))


def _word_array(text: Column) -> Column:
    body = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body != "", F.split(body, WHITE))


def signatures(rows: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and a fingerprint (``f0``, ``f1``, ...) of each of the text columns.

    Where ``rows`` are already partitioned by one of the keys nothing is shuffled.
    A row whose texts have no words gives no row.
    """
    sides = [F.struct(F.lit(i).alias("side"), F.col(t).alias("text")) for i, t in enumerate(texts)]
    each = rows.select(*keys, F.explode(F.array(*sides)).alias("of"))
    each = each.select(*keys, F.col("of.side").alias("side"), F.explode(_word_array(F.col("of.text"))).alias("word"))
    counts = [F.count(F.when(F.col("side") == i, 1)).alias(f"w{i}") for i in range(len(texts))]
    counted = each.select(*keys, "side", F.xxhash64("word").alias("word")).groupBy(*keys, "word").agg(*counts)
    weights = [F.when(F.col(f"w{i}") > 0, F.log(f"w{i}")).alias(f"l{i}") for i in range(len(texts))]
    parts = -(-samples // PER_ROW)
    dealt = counted.select(*keys, "word", *weights).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    least = [F.min(_sample(k, F.col(f"l{i}"))).alias(f"m{i}_{k}") for k in range(PER_ROW) for i in range(len(texts))]
    sampled = _random(dealt, PER_ROW).groupBy(*keys, "part").agg(*least)

    def hexes(i: int) -> Column:
        low = F.lit((1 << ID_BITS) - 1)
        return F.concat(*[F.lpad(F.lower(F.hex(F.col(f"m{i}_{k}").bitwiseAND(low))), 6, "0") for k in range(PER_ROW)])

    sampled = sampled.select(*keys, "part", *[hexes(i).alias(f"h{i}") for i in range(len(texts))])

    def joined(i: int) -> Column:
        parts_in_order = F.sort_array(F.collect_list(F.struct("part", F.col(f"h{i}").alias("hex"))))
        return F.array_join(F.transform(parts_in_order, lambda s: s["hex"]), "").alias(f"f{i}")

    whole = [joined(i) for i in range(len(texts))]
    return sampled.groupBy(*keys).agg(*whole)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal positions of two fingerprints; two empty ones are alike."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    # Cut at once: a substring by its place would be sought from the beginning of the text each time.
    equal = F.zip_with(*[F.regexp_extract_all(v, F.lit(".{6}"), F.lit(0)) for v in (x, y)], lambda p, q: p == q)
    return F.when((x == "") | (y == ""), (x == y).cast("double")).otherwise(F.size(F.filter(equal, lambda e: e)) / F.size(equal))


def _cells(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with ``bucket``, ascending in the id, and about how many there are.

    Quantiles cut the ids into parts, and each part is cut evenly into as many
    ranges as its bytes ask for.
    """
    bounds = docs.agg(
        F.count("doc_id"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(1, QUANTILES)], 10_000),
        F.min("doc_id"), F.max("doc_id"),
    ).first()
    n, inner, low, high = bounds
    edges = sorted({low, *inner}) if n else [0]
    ends = [*edges[1:], high + 1 if n else 1]
    part = F.lit(0)
    for e in edges[1:]:
        part = part + (F.col("doc_id") >= e).cast("int")
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNotNull(), part).otherwise(-1))
    held = docs.groupBy("part").agg(F.sum(F.octet_length("text") + ROW_BYTES)).collect()  # a row a part
    held = {r[0]: r[1] for r in held}
    ranges = [max(1, -(-held.get(i, 0) // RANGE_BYTES)) for i in range(len(edges))]
    before = [sum(ranges[:i]) for i in range(len(edges))]

    def of_part(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("part") + 1)

    start, end = of_part(edges), of_part(ends)
    share = (F.col("doc_id") - start).cast("double") / (end - start).cast("double")
    within = F.least(of_part(ranges) - 1, F.floor(share * of_part(ranges)))
    # Rows without an id have no order; they are dealt out by text, and equal ones by where they were read.
    loose = -1 - F.pmod(F.xxhash64("hash", "origin"), F.lit(max(1, -(-held.get(-1, 0) // RANGE_BYTES))))
    bucket = F.when(F.col("part") < 0, loose).otherwise(of_part(before) + within).cast("long")
    return docs.withColumn("bucket", bucket).drop("part"), sum(ranges)


def _ranges(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """As :func:`_cells`, but buckets that hold too much are cut again, into as many ``SPLIT`` parts a round as numbers leave room for.

    A bucket of many ids is cut at their quantiles, one of a single id at those
    of its texts' hashes, and one of equal texts by where they were read.
    """
    docs, n = _cells(docs)
    span = 1
    while n * span * 2 * SPLIT < 1 << 60:
        ordered = docs.filter("bucket >= 0")
        ends = [x for c in ORDER for x in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"))]
        big = ordered.groupBy("bucket").agg(F.sum(F.octet_length("text") + ROW_BYTES).alias("bytes"), *ends)
        cut = F.lit(None).cast("int")
        for i, c in reversed(list(enumerate(ORDER))):
            cut = F.when(F.col(f"low_{c}") < F.col(f"high_{c}"), i).otherwise(cut)
        big = stage(big.filter(F.col("bytes") > MOST_RANGE * RANGE_BYTES).select("bucket", cut.alias("by")).filter("by is not null"), "range-big")
        found = big.count()
        if not found:
            break
        if found * CUT_BYTES <= BROADCAST_BYTES:
            big = F.broadcast(big)
        value = F.coalesce(*[F.when(F.col("by") == i, F.col(c).cast("long")) for i, c in enumerate(ORDER)])
        at = F.percentile_approx(value, [i / SPLIT for i in range(1, SPLIT)], 10_000)
        cuts = stage(ordered.join(big, "bucket").groupBy("bucket", "by").agg(F.array_distinct(at).alias("cuts")), "range-cuts")
        if found * CUT_BYTES <= BROADCAST_BYTES:
            cuts = F.broadcast(cuts)
        docs = docs.join(cuts, "bucket", "left")
        # Rows at a quantile, between two, below and above all: numbers stay in order.
        below = F.size(F.filter("cuts", lambda c: c < value)) + F.size(F.filter("cuts", lambda c: c <= value))
        below = F.when(F.col("by").isNull(), 0).otherwise(below)
        bucket = F.when(F.col("bucket") >= 0, F.col("bucket") * (2 * SPLIT) + below).otherwise(F.col("bucket")).cast("long")
        docs, span = docs.withColumn("bucket", bucket).drop("by", "cuts"), span * 2 * SPLIT
    return docs, n, span


def _guests(docs: DataFrame, n: int, span: int) -> DataFrame:
    """The first row of each range, with the range before it as its ``bucket``; before the first is the last."""
    docs = docs.filter("bucket >= 0")
    least = stage(docs.groupBy("bucket").agg(F.min("doc_id").alias("least")), "range-least").withColumnRenamed("bucket", "of")
    if n * FIRST_BYTES <= BROADCAST_BYTES:
        least = F.broadcast(least)
    some = docs.join(least, (F.col("bucket") == F.col("of")) & (F.col("doc_id") == F.col("least")))
    firsts = some.groupBy("bucket").agg(F.min(F.struct("doc_id", "hash", "text", "origin")).alias("first"))
    firsts = stage(firsts.select("bucket", "first.*").withColumn("group", F.expr(f"bucket div {RANGES_AT_ONCE * span}")), "range-firsts")
    last = F.max("last").over(Window.partitionBy())
    groups = firsts.groupBy("group").agg(F.max("bucket").alias("last"))
    groups = groups.select("group", F.coalesce(F.lag("last").over(Window.orderBy("group")), last).alias("earlier"))
    order = Window.partitionBy("group").orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.col("earlier"))
    return firsts.join(groups, "group").select("doc_id", "text", "hash", "origin", before.alias("bucket"))


def fingerprint_with_edit(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt, n, span = _ranges(texts.withColumns({"hash": F.xxhash64("text"), "origin": F.spark_partition_id()}))
    guests = _guests(dealt, n, span).withColumn("guest", F.lit(True))
    dealt = dealt.withColumn("guest", F.lit(False)).unionByName(guests)
    # Not nullable, so that the join below adds no filter and both sides read one shuffle.
    dealt = dealt.withColumn("bucket", F.coalesce("bucket", F.lit(-1).cast("long")))
    order = Window.partitionBy("bucket").orderBy("guest", *ORDER, "text")
    after = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order))
    rows = dealt.select("bucket", "guest", "doc_id", "text", after.alias("next"), F.row_number().over(order).alias("place"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select(
        "bucket", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), "text",
        F.when(~F.col("guest"), edited).alias("edited"),
    )
    found = signatures(rows, ["bucket", "place"], ["text", "edited"], samples)
    about = rows.select("bucket", "place", "guest", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    out = about.join(found, ["bucket", "place"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("f0", "f1")})
    along = Window.partitionBy("bucket").orderBy("place")
    following = F.when(F.col("doc_id").isNotNull(), F.lead("f0").over(along))
    out = out.withColumn("following", following).filter(~F.col("guest"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("f0").alias("fingerprint"),
        F.col("f1").alias("edited_fingerprint"),
        likeness(F.col("f0"), F.col("f1")).alias("near_edited"),
        F.when(F.col("following").isNotNull(), likeness(F.col("f0"), F.col("following"))).alias("near_next"),
    )
