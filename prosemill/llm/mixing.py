"""Mixing sources to target weights by capped water-filling.

The sources share a total by weight; a source whose share passes ``max_epochs``
times its size is clamped there and its excess goes to the others by weight,
until none is above.  A source's target then becomes whole repetitions of all
its documents plus a fraction: documents are taken in a seeded order until the
rest of the target is used up, the last of them in part.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; rows of size 0 take nothing; rows without an id are ordered by
their text; a repeated row is a document of its own in the plan, and repeated
rows are written as often as their sum of words asks for; an empty table gives an empty result; other columns of the input are
ignored (:func:`mix_documents`) or kept (:func:`repeat_documents`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, buckets_for, free_names, stage, word_count

WEIGHTS = (5, 2, 1)
ROWS_PER_BUCKET = 20_000


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to a table with ``source``, ``source_size`` and ``weight``.

    In order of limit over weight, a source is clamped as long as what is left
    after the limits before it, shared by weight, passes its own.  The running
    sums are those of the (small) source table.
    """
    limit = F.col("source_size") * F.lit(max_epochs)
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    d = sources.withColumn("limit", limit)
    d = d.withColumns({"fixed": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "free": F.sum("weight").over(on)})
    level = (F.lit(float(total)) - F.col("fixed")) / F.col("free")
    first = d.filter(F.col("limit") >= F.col("weight") * level).agg(F.min_by(level, F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source"))).first()[0]
    target = F.col("limit") if first is None else F.least("limit", F.col("weight") * F.lit(first))
    return d.withColumn("target", target).drop("limit", "fixed", "free")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit(""))))))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        order.alias("turn"),
        F.xxhash64(text_col).alias("text_hash"),
    )


def source_targets(
    rows: DataFrame, *, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """``source, source_size, weight, target`` from rows with ``source`` and ``size``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    which = F.pmod(rank, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), which + 1)
    sources = stage(sizes.withColumn("weight", weight.cast("long")), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    return water_fill(sources, share * total, max_epochs)


def mix_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = "mix",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` of every row.

    The seeded order is cut into buckets by its leading digits.  Sums of whole
    buckets say where a source's fraction ends, so only the one bucket in which
    it ends is ordered row by row: a source of any size needs no large task.
    """
    rows = stage(_sized(docs, id_col, text_col, source_col, seed), "mix-rows")
    targets = source_targets(rows, share=share, max_epochs=max_epochs, weights=weights)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = stage(
        targets.withColumn("whole", whole).withColumn("rest", goal - F.col("whole") * F.col("source_size")), "mix-targets"
    )
    digits = 1
    while 16**digits < buckets_for(rows.count(), ROWS_PER_BUCKET) * 4 and digits < 8:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("turn", 1, digits))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    sums = sums.join(
        targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
    ).drop("of")
    plan = sums.select(
        F.col("source").alias("of"), F.col("bucket").alias("b"), "bucket_size", "before",
        "source_size", "target", "whole", "rest",
    )
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
    rest, before, size = F.col("rest"), F.col("before"), F.col("size")
    ends = (before < rest) & (before + F.col("bucket_size") > rest)
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size", "text_hash")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    simple = rows.filter(~ends).withColumn("extra", F.when(before < rest, size).otherwise(0))
    cut = rows.filter(ends).withColumn("at", before + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.withColumn("extra", F.greatest(F.lit(0), F.least(size, rest - F.col("at")))).drop("at")
    return simple.unionByName(cut).select(
        "doc_id",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        (F.col("whole") * size + F.col("extra")).cast("long").alias("taken"),
        "source",
        "text_hash",
    )


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, white space as it is."""
    gaps, found = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    pairs = F.slice(F.arrays_zip(gaps.alias("gap"), found.alias("word")), F.lit(1), n)
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], p["word"])), "")


def repeat_documents(
    docs: DataFrame, taken: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``docs`` as the mix takes them: whole copies, then the first words of a part.

    A document of which nothing is taken is not in the mix.  Rows of one id,
    text and source are one here, with the sum of what is taken of each.
    """
    of_id, of_hash, of_source, size, takes, rows, part = free_names(docs, "of_id", "of_hash", "of_source", "of_size", "takes", "of_rows", "part")
    key = [of_id, of_hash, of_source]
    per = taken.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("source").alias(of_source), "size", "taken")
    per = per.groupBy(*key).agg(F.max("size").alias(size), F.sum("taken").alias(takes), F.count("*").alias(rows))
    per = stage(per.filter(F.col(takes) > 0), "mix-takes")
    wanted = F.col(id_col).eqNullSafe(F.col(of_id)) & (F.xxhash64(text_col) == F.col(of_hash)) & F.col(source_col).cast("string").eqNullSafe(F.col(of_source))
    got = docs.join(per, wanted)
    if per.filter(F.col(rows) > 1).take(1):
        got = got.filter(F.col(rows) == 1).unionByName(got.filter(F.col(rows) > 1).dropDuplicates(key))
    times = (F.col(takes) / F.col(size)).cast("int")
    rest = F.col(takes) - times * F.col(size)
    copies = F.concat(
        F.when(times > 0, F.transform(F.sequence(F.lit(1), times), lambda _: F.lit(0).cast("long"))).otherwise(
            F.array().cast("array<long>")
        ),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")),
    )
    text = F.when(F.col(part) > 0, _first_words(F.col(text_col), F.col(part).cast("int"))).otherwise(F.col(text_col))
    return got.withColumn(part, F.explode(copies)).select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
