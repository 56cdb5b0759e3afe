"""Best-fit packing of token pieces, certified by lower bounds.

Pieces are dealt into partitions of bounded size and packed there by best-fit
decreasing.  Dual feasible functions give each partition a lower bound for its
number of sequences; where it is met the packing is proved optimal and stays.
Partitions with a gap give up the pieces of their unfilled sequences, which
meet in fewer, larger partitions and are packed again, as long as that saves
sequences.

Defined results: a null text is an empty one and holds the end id alone; a
null document id is kept; repeated rows are packed once each; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, buckets_for, stage
from .tokens import encoder, vocabulary_path

#: Pieces of a partition in the first round; each later round takes four times as many.
PIECES_PER_BUCKET = 16_000
ROUNDS = 4
DOCS_AT_ONCE = 1_000

PIECE = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "key long, length long, bucket long, bin long, load long, offset long, gap long"


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, by two families of dual feasible functions.

    With threshold e: pieces over capacity - e count whole, pieces under e not
    at all.  With k: a size counts as floor((k + 1) size / capacity) / k, and as
    itself where (k + 1) size / capacity is whole.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    number, total = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = total[capacity - e] - np.where(e > 0, total[np.maximum(e - 1, 0)], 0)
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 51):
        times = (k + 1) * size
        # In units of 1 / (k * capacity), so that all is whole numbers.
        value = np.where(times % capacity == 0, k * size, times // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and the load of each bin."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    loads: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r is set where some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        bins[i], offsets[i] = b, loads[b]
        loads[b] += size
        if room > size:
            open_bins[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(loads, np.int64)


def token_pieces(
    docs: DataFrame,
    *,
    capacity: int,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document, staged; ``key`` tells repeated rows apart.

    A document of more than ``capacity`` ids is cut from its end, so that only
    the first piece can be shorter.
    """
    vocabulary = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(i, DOCS_AT_ONCE)
                out: list[tuple] = []
                for doc, ids in zip(some.column(0).to_pylist(), encode.encode(some.column(1).to_pylist()), strict=True):
                    raw = ids + end
                    n = len(raw) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = raw[4 * a : 4 * b]
                        row = (key, doc, piece, a, b - a, zlib.crc32(part))
                        out.append((*row, np.frombuffer(part, "<u4")) if with_ids else row)
                        key += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                columns = zip(*out, strict=True)
                names = ["key", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: len(out[0])]
                )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(texts.mapInArrow(cut, PIECE + ", ids array<int>" * with_ids), "pieces")


def _pack_round(pool: DataFrame, n: int, buckets: int, capacity: int, round_no: int) -> DataFrame:
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        sizes = frame["length"].to_numpy()
        bins, offsets, loads = best_fit_decreasing(sizes, capacity)
        return pd.DataFrame(
            {
                "key": frame["key"],
                "length": sizes,
                "bucket": frame["bucket"],
                "bin": bins,
                "load": loads[bins],
                "offset": offsets,
                "gap": len(loads) - lower_bound(sizes, capacity),
            }
        )

    dealt = pool.withColumn("bucket", bucket_of(buckets, "key", "salt"))
    return stage(dealt.select("key", "length", "bucket").groupBy("bucket").applyInPandas(pack, PACKED), f"packed-{round_no}")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``key, sequence_id, offset`` for pieces of at most ``capacity`` ids."""
    spark = pieces.sparkSession
    whole = pieces.filter(F.col("length") >= capacity).select(
        "key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    pool = pieces.filter(F.col("length") < capacity).select("key", "length")
    n = pool.count()
    each, done = PIECES_PER_BUCKET, [whole]
    if not n:
        return whole
    buckets = buckets_for(n, each)
    current = _pack_round(pool.withColumn("salt", F.lit(0)), n, buckets, capacity, 0)
    for round_no in range(1, ROUNDS + 1):
        loose = (F.col("gap") > 0) & (F.col("load") < capacity)
        row = current.agg(
            F.sum(loose.cast("long")).alias("pieces"), F.sum((loose & (F.col("offset") == 0)).cast("long")).alias("bins")
        ).first()
        each *= 4
        if not row.pieces or buckets == 1:
            break
        buckets = buckets_for(row.pieces, each)
        again = _pack_round(
            current.filter(loose).select("key", "length", F.lit(round_no).alias("salt")), row.pieces, buckets, capacity, round_no
        )
        if again.filter("offset = 0").count() >= row.bins:
            break
        done.append(_numbered(current.filter(~loose), round_no - 1))
        current = again
    done.append(_numbered(current, ROUNDS + 1))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _numbered(packed: DataFrame, round_no: int) -> DataFrame:
    """Sequence numbers that differ between rounds, buckets and bins."""
    number = F.lit(round_no << 56).cast("long") + F.shiftleft(F.col("bucket"), 24) + F.col("bin")
    return packed.select("key", number.alias("sequence_id"), "offset")


def pack_documents(
    docs: DataFrame,
    *,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Every document's pieces with their sequence and offset.

    Columns: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    and, with ``with_ids``, the ``ids`` themselves.
    """
    pieces = token_pieces(
        docs, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, vocabulary=vocabulary, with_ids=with_ids
    )
    placed = pack_pieces(pieces.select("key", "length"), capacity)
    return pieces.join(placed, "key").drop("key")
