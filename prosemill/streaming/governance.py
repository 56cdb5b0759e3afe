"""Duplicate suppression and rate limits over a stream of requests.

``deduplicated`` and the tumbling limits work on batch and streaming frames
alike; ``renewing_limit`` keeps state per key, since each accepted request
renews its window and rejected ones do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DUPLICATE_SECONDS = 3_600
PER_HOUR, PER_DAY = 10, 100


def deduplicated(requests: DataFrame, keys: list[str], time: str, seconds: int = DUPLICATE_SECONDS) -> DataFrame:
    """Streams: rows whose keys did not occur within the window before."""
    return requests.withWatermark(time, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)


def with_duplicates(requests: DataFrame, keys: list[str], time: str, tie: str, seconds: int = DUPLICATE_SECONDS) -> DataFrame:
    """Batch: adds ``duplicate``, true where the row before of the same keys is at most ``seconds`` old."""
    order = Window.partitionBy(*keys).orderBy(time, tie)
    at = F.col(time).cast("timestamp")
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(order))
    return requests.withColumn("duplicate", F.coalesce(gap <= seconds * 1_000_000, F.lit(False)))


def tumbling_counts(requests: DataFrame, key: Column, time: str, width: str, limit: int) -> DataFrame:
    """``key, start, n, rejected``: requests of a key in each window, and how many pass the limit."""
    d = requests.groupBy(key.alias("key"), F.window(time, width).alias("w")).agg(F.count("*").alias("n"))
    return d.select("key", F.col("w.start").alias("start"), "n", F.greatest(F.lit(0).cast("long"), F.col("n") - limit).alias("rejected"))


def decide(times: list[float], start: float | None, count: int, limit: int, seconds: int) -> tuple[list[bool], float | None, int]:
    """Which requests are accepted, given the last accepted time and the count so far.

    The count lapses ``seconds`` after the last accepted request.
    """
    out = []
    for t in times:
        if start is not None and t - start >= seconds:
            start, count = None, 0
        ok = count < limit
        if ok:
            start, count = t, count + 1
        out.append(ok)
    return out, start, count


def renewing_decisions(requests: DataFrame, key: str, time: str, tie: str, limit: int = PER_HOUR, seconds: int = 3_600) -> DataFrame:
    """Batch: ``key, time, tie, accepted`` of stored requests under the renewing limit.

    Each decision depends on those before it, so a key's requests go through
    one task in order of time; they are streamed from the sorted partition, and
    no more than one key's count is held, however many requests it has.
    """
    fields = requests.schema
    kind = ", ".join(f"{c} {fields[c].dataType.simpleString()}" for c in (key, time, tie)) + ", accepted boolean"

    def decided(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, count = None, None, 0
        for frame in frames:
            accepted: list[bool] = []
            for own, rows in frame.groupby(key, sort=False, dropna=False):
                if last is None or not (own == last[0] or (pd.isna(own) and pd.isna(last[0]))):
                    last, start, count = (own,), None, 0
                some, start, count = decide(rows["micros"].tolist(), start, count, limit, seconds * 1_000_000)
                accepted += some
            yield frame.drop(columns="micros").assign(accepted=accepted)

    d = requests.select(key, time, tie, F.unix_micros(F.col(time).cast("timestamp")).alias("micros"))
    return d.repartition(key).sortWithinPartitions(key, "micros", tie).mapInPandas(decided, kind)


def renewing_limit(requests: DataFrame, key: str, time: str, limit: int = PER_HOUR, seconds: int = 3_600) -> DataFrame:
    """Streams: ``key, time, accepted`` under a limit whose window each accepted request renews.

    A key's state is dropped once the watermark is past its last accepted
    request by the window, when it could change no decision any more.
    """
    name = key

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(time)
        accepted, start, count = decide([t.timestamp() for t in rows[time]], start, count, limit, seconds)
        state.update((start, count))
        state.setTimeoutTimestamp(int(max((start + seconds) * 1000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame({name: [k[0]] * len(rows), time: rows[time].to_numpy(), "accepted": accepted})

    kind = requests.schema[key].dataType.simpleString()
    watched = requests.withWatermark(time, f"{seconds} seconds")
    return watched.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, {time} timestamp, accepted boolean", "start double, n long", "append", GroupStateTimeout.EventTimeTimeout
    )
