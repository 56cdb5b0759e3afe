"""Corpus preparation as five stages over ``documents``.

Each stage reads what its predecessor wrote and returns the columns of
``documents``; the last returns the packed pieces.

Defined results: a row is told by its id and its text, so rows without an id
are judged like others, and rows of one id with different texts each for
themselves; a null or empty text is rejected by the quality rules; of repeated
rows, and of rows of one near-duplicate group, one stays, of one id that of the
least text hash; a null language or source is one of its own; an empty table,
or one of which a stage keeps nothing, gives an empty result; other columns of
the table are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm import mixing, near_duplicates, packing, quality_classifier, quality_rules
from prosemill.llm.common import free_names, fresh_path, remove, stage


#: What tells a row: its id and the hash of its text.
KEY = ["doc_id", "text_hash"]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    judged = quality_rules.quality_rules(docs)
    return _without(docs, judged.filter("not kept"), ["doc_id", "text_hash", "lang", "source"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, and one of repeated rows."""
    judged = stage(near_duplicates.near_duplicates(docs), "judged")
    named, kept = judged.filter("doc_id is not null"), judged.filter("kept")
    # Rows without an id may share a key; it goes if none of them is kept.
    gone = judged.filter("doc_id is null").groupBy(*KEY).agg(F.max("kept").alias("kept")).filter("not kept").select(*KEY)
    crowded = kept.groupBy("component_id").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")).filter("first < last")
    beside = kept.join(crowded, "component_id").filter("text_hash <> first")
    gone = gone.unionByName(named.filter("not kept").select(*KEY)).unionByName(beside.select(*KEY))
    left = _without(docs, gone, KEY)
    repeated = stage(judged.groupBy(*KEY).count().filter("count > 1").select(*KEY), "repeated")
    if not repeated.take(1):
        return left
    hashed, keys, same = _keyed(left, repeated, KEY)
    twice = hashed.join(keys, same, "left_semi").dropDuplicates(["doc_id", hashed.columns[-1]])
    return _as(docs, hashed.join(keys, same, "left_anti").unionByName(twice))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, the last of a source in part."""
    return mixing.repeat_documents(docs, mixing.mix_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, capacity=1024, end_id=2)


def _keyed(docs: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """``docs`` with the hash of the text, ``rows`` under names of their own, and whether their keys are equal or both null."""
    text_hash, *names = free_names(docs, "text_hash", *[f"key_{i}" for i in range(len(key))])
    hashed, rows = docs.withColumn(text_hash, F.xxhash64("text")), rows.select(*key).toDF(*names)
    same = F.lit(True)
    for k, name in zip(key, names, strict=True):
        same = same & F.col(text_hash if k == "text_hash" else k).eqNullSafe(F.col(name))
    return hashed, rows, same


def _as(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def _without(docs: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``docs`` less the rows of some keys; the texts are not shuffled where the keys are few enough to send."""
    gone = stage(gone.select(*key).distinct(), "gone")
    hashed, keys, same = _keyed(docs, gone, key)
    if gone.count() * KEY_BYTES <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    return _as(docs, hashed.join(keys, same, "left_anti"))


#: Keys are broadcast up to this size and shuffled beyond it.
KEY_BYTES, BROADCAST_BYTES = 120, 16 << 20

STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_quality_rules),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: No SQL for the whole: the classifier, the robust distances and the ids of texts can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again.

    What a stage has written is removed once the next one's result is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
