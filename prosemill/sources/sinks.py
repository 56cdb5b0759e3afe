"""Sinks: results as JSON lines, reports as Markdown, claims as CSV.

Each task writes its own part of a folder; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A line of JSON for each result; null fields are left out."""
    results.write.mode(mode).json(path)


def write_markdown(reports: DataFrame, path: str, *, key: str = "doc_id", report: str = "report", mode: str = "errorifexists") -> None:
    """``key=value/`` folders, each with the text of its report; meant for a selection of reports, not for a corpus."""
    text = F.regexp_replace(report, r"(?U)^\s+|\s+\z", "")  # the writer ends it with a line feed
    reports.select(key, text.alias("value")).write.mode(mode).partitionBy(key).text(path)


def write_claims_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Every cell quoted and quotes doubled; nulls are empty cells."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns]
    rows.select(*cells).write.mode(mode).options(header=True, quoteAll=True, escape='"', emptyValue="", lineSep="\n").csv(path)


def event(kind: str, message: str, data: Column, at: Column) -> Column:
    """One event as a line of JSON; ``data`` is a struct and ``at`` its time."""
    time = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message"), data.alias("data"), time.alias("timestamp")))
