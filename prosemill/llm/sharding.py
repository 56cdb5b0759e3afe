"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

A group (rows of equal text) is indivisible.  Groups are dealt into bounded
partitions; in each, partial partitions into ``shards`` parts are combined,
the two of largest spread first and in opposite order, until one is left.  The
partitions' own results are then combined by the same rule, level by level, so
no task or driver ever holds more than a bounded number of them.

Defined results: a null text counts as empty and groups with empty texts;
repeated rows belong to one group and get slots of their own; an empty table
gives an empty result; a null document id sorts first; other columns of the
input are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, buckets_for, stage

#: Groups that one task combines, and partial partitions at the levels above.
GROUPS_PER_BUCKET = 20_000
PARTIALS_PER_BUCKET = 2_000
ROWS_PER_SLOT_BUCKET = 50_000


def combine(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over rows of ``parts`` (n x k sums).

    Returns the k sums of the last partial partition and, for each row, where
    each of its k parts ended up.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, order, 1))  # kept in descending order
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        rank = np.argsort(-both, kind="stable")
        sums[a] = sums[b] = None
        made.append((a, b, rank))
        sums.append(both[rank])
        heapq.heappush(heap, (-int(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    places: list = [None] * len(sums)
    places[-1] = np.arange(k)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, rank = made[node - n]
        to = np.empty(k, np.int64)
        to[rank] = places[node]
        places[a], places[b] = to, to[::-1]
    final = np.empty((n, k), np.int64)
    for i in range(n):
        final[i, order[i]] = places[i]
    return np.asarray(sums[-1]), final


def balance(groups: DataFrame, shards: int, *, key: str = "key", size: str = "size") -> DataFrame:
    """``key, shard`` for groups of the given sizes (one row a group)."""
    spark = groups.sparkSession
    n = groups.count()
    buckets = buckets_for(n, GROUPS_PER_BUCKET)

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "key"], ascending=[False, True])
        parts = np.zeros((len(frame), shards), np.int64)
        parts[:, 0] = frame["size"]
        sums, places = combine(parts)
        return pd.DataFrame(
            {"key": frame["key"], "node": frame["bucket"], "part": places[:, 0], "sums": [sums.tolist()] * len(frame)}
        )

    dealt = groups.select(F.col(key).alias("key"), F.col(size).alias("size"), bucket_of(buckets, key).alias("bucket"))
    leaves = stage(
        dealt.groupBy("bucket").applyInPandas(first, "key string, node long, part int, sums array<long>"), "leaves"
    )
    nodes = leaves.groupBy("node").agg(F.first("sums").alias("sums"))
    placed = leaves.select("key", "node", "part")

    def above(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        sums, places = combine(np.array(frame["sums"].tolist(), np.int64))
        return pd.DataFrame(
            {"node": frame["node"], "up": frame["up"], "places": places.tolist(), "sums": [sums.tolist()] * len(frame)}
        )

    while buckets > 1:
        buckets = buckets_for(buckets, PARTIALS_PER_BUCKET)
        level = stage(
            nodes.withColumn("up", F.pmod("node", F.lit(buckets)))
            .groupBy("up")
            .applyInPandas(above, "node long, up long, places array<int>, sums array<long>"),
            "level",
        )
        placed = placed.join(level.select("node", "up", "places"), "node").select(
            "key", F.col("up").alias("node"), F.get("places", F.col("part")).alias("part")
        )
        nodes = level.groupBy(F.col("up").alias("node")).agg(F.first("sums").alias("sums"))
    return placed.select("key", F.col("part").cast("int").alias("shard"))


def shard_documents(
    docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16
) -> DataFrame:
    """Every row's shard under the law ``bytes``, and its slot there.

    Columns: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  A
    slot is the rank within the shard by a hash of the id, then the id: counted
    in small buckets whose totals are summed up, so no shard is sorted as one.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
        ),
        "shard-rows",
    )
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    placed = balance(groups, shards)
    slots = buckets_for(rows.count(), ROWS_PER_SLOT_BUCKET * shards) * 4
    put = stage(rows.join(placed, "key").withColumn("sub", bucket_of(slots, "doc_id")), "sharded")
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        put.groupBy("shard", "sub")
        .count()
        .select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("shard", "sub").orderBy("doc_id", "key")
    return put.join(starts, ["shard", "sub"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
