"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table whose files are smaller than this may be one row group, so one task would do all work in its rows;
#: it is dealt to all cores, which moves at most so many bytes.  Larger ones are read in the session's splits.
SMALL_BYTES = 64 << 20


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, by its status."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path)
    return found.repartition(spark.sparkContext.defaultParallelism) if file_bytes(spark, path) < SMALL_BYTES else found
