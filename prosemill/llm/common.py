"""Folders and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: the session's ``spark.checkpoint.dir``.

    Where a local session (as in tests) names none, one is made and set; on a
    cluster that is an error, as a machine's own folder is not shared.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="prosemill-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
        _remove_at_exit(spark, path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it is removed when the program ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that :func:`fresh_path` has named, if it is there."""
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(remove, spark, path)


#: Rows that go to a Python worker at once: whole texts and sets are large.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


_caches: dict[str, Callable[[], None]] = {}


def cache(name: str, clear: Callable[[], None]) -> None:
    """Registers what a Python worker remembers between tasks."""
    _caches[name] = clear


def use_cache(name: str) -> None:
    """Empties the others: a worker outlives operators, so their memories would add up."""
    for other, clear in _caches.items():
        if other != name:
            clear()


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def buckets_for(rows: int, each: int) -> int:
    """Groups of about ``each`` rows."""
    return max(1, -(-int(rows) // each))


def bucket_of(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("long")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of ``df`` has them, so that those columns are carried along untouched."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
