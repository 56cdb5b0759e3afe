"""Requests for an analysis: JSON files, the options that override them, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a request may ask for.
MODES = ("editorial", "integrity", "research")
GOALS = ("publish_ready_review", "source_support", "clarity_rewrite", "risk_review", "editorial_triage")
PROFILES = ("full", "checklist", "claims-csv", "machine")

#: A source is a text or an object; an object is kept as its JSON.
SCHEMA = (
    "text string, url string, mode string, "
    "metadata struct<languageHint: string, locale: string, genre: string, audience: string, channel: string, purpose: string, goal: string, sources: array<string>>, "
    "options struct<includeSpans: boolean, includeRawMetrics: boolean, allowPrivateNetwork: boolean, reportProfile: string, includeProofreading: boolean, languageToolUrl: string>"
)
BROKEN = "broken"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """The requests of a folder of files, one or a list in each; one that is no JSON has its text in ``broken``."""
    options = {"multiLine": True, "columnNameOfCorruptRecord": BROKEN}
    return spark.read.schema(f"{SCHEMA}, {BROKEN} string").options(**options).json(path)


def parsed(line: Column) -> Column:
    """A request from a line of JSON."""
    return F.from_json(line, f"{SCHEMA}, {BROKEN} string", {"columnNameOfCorruptRecord": BROKEN})


def checked_option(value: str | None, allowed: tuple[str, ...], name: str) -> str | None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return value


def resolved(
    requests: DataFrame, *, mode: str | None = None, goal: str | None = None, profile: str | None = None, sources: tuple[str, ...] = (), checker_url: str | None = None
) -> DataFrame:
    """Requests with ``mode, goal, profile, sources, checker_url, allow_private`` after the options, and ``problem``.

    Options win over a request's own values; a request without a mode is
    editorial and one without a profile full.  Addresses are fetched from the
    public network only, whatever the request says.  ``problem`` is null for a
    sound request, else the first of ``no_json, not_one_input, bad_mode,
    bad_goal, bad_profile``; no row is dropped.  An empty text or address counts
    as none.
    """
    given = {
        "mode": (checked_option(mode, MODES, "mode"), "mode"), "goal": (checked_option(goal, GOALS, "goal"), "metadata.goal"),
        "profile": (checked_option(profile, PROFILES, "profile"), "options.reportProfile"), "checker_url": (checker_url, "options.languageToolUrl"),
    }

    def own(field: str) -> Column:
        return F.when(F.col(field) != "", F.col(field))

    def wrong(field: str, allowed: tuple[str, ...]) -> Column:
        return own(field).isNotNull() & ~F.col(field).isin(*allowed)

    inputs = F.when(own("text").isNotNull(), 1).otherwise(0) + F.when(own("url").isNotNull(), 1).otherwise(0)
    # What the file itself says is checked before any option replaces it.
    problem = (
        F.when(F.col(BROKEN).isNotNull(), "no_json").when(inputs != 1, "not_one_input").when(wrong("mode", MODES), "bad_mode")
        .when(wrong("metadata.goal", GOALS), "bad_goal").when(wrong("options.reportProfile", PROFILES), "bad_profile")
    )
    values = {name: own(field) if option is None else F.lit(option) for name, (option, field) in given.items()}
    values["mode"] = F.coalesce(values["mode"], F.lit("editorial"))
    values["profile"] = F.coalesce(values["profile"], F.lit("full"))
    none = F.array().cast("array<string>")
    values["sources"] = F.array(*map(F.lit, sources)) if sources else F.coalesce("metadata.sources", none)
    values["allow_private"] = F.when(own("url").isNull(), F.coalesce("options.allowPrivateNetwork", F.lit(False))).otherwise(False)
    return requests.withColumn("problem", problem).withColumns(values)
