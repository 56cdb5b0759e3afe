"""Answers of an external grammar checker as issues, merged with the local ones.

A table of answers holds what a caller got for a document: the ``url`` asked,
the ``answer`` as JSON, and ``failed`` where the request gave none.  The
checker counts UTF-16 units; here places are code points.

Defined results: a row without a url leaves the local result as it is; a url
that is not the machine's own is an error, and so is a failed request, but a
disabled result stays disabled and after a failed request an abstained one
abstained; a match without a whole place or with a length of 0 is left out, as
are replacements that are empty; of matches at one place and of one kind the
first stays; answers that are no JSON have no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Matches read of an answer, issues kept in all, and replacements of a match.
MOST_MATCHES, MOST_MERGED, MOST_REPLACEMENTS = 40, 60, 5
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1", "[::1]")
ENDPOINT = "/v2/check"
CONFIDENCE = {"spelling": 0.82, "grammar": 0.76, "typography": 0.8, "punctuation": 0.8, "style": 0.66}
ANSWER = (
    "struct<matches:array<struct<message:string,offset:double,length:double,replacements:array<struct<value:string>>,"
    "rule:struct<issueType:string,category:struct<id:string,name:string>>>>>"
)
ISSUE = "struct<index:int,start:int,end:int,kind:string,severity:string,message:string,suggestions:array<string>,confidence:double>"


def endpoint(url: Column) -> Column:
    """The address to ask, null where a url isn't the machine's own."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    whole = F.when(path.endswith(ENDPOINT), path).otherwise(F.concat(F.regexp_replace(path, "/+$", ""), F.lit(ENDPOINT)))
    base = F.regexp_extract(url, r"(?i)^(https?://[^/?#]*)", 1)
    return F.when(host.isin(*LOCAL_HOSTS), F.concat(base, whole, F.regexp_extract(url, r"^[^?#]*(.*)$", 1)))


def match_kind(rule: Column) -> Column:
    kind = F.lower(F.coalesce(rule["issueType"], F.lit("")))
    category = F.lower(F.concat_ws(" ", F.coalesce(rule["category"]["id"], F.lit("")), F.coalesce(rule["category"]["name"], F.lit(""))))
    return (
        F.when(kind.contains("misspelling") | category.contains("typo") | category.contains("spelling"), "spelling")
        .when(kind.contains("grammar") | category.contains("grammar"), "grammar")
        .when(kind.contains("typographical") | category.contains("typography") | category.contains("casing"), "typography")
        .when(kind.contains("punctuation") | category.contains("punctuation"), "punctuation")
        .otherwise("style")
    )


def wide_places(text: Column) -> Column:
    """UTF-16 places of the characters that take two units, in order."""
    wide = T.spans(text, r"[\x{10000}-\x{10FFFF}]")
    none = F.array().cast("array<int>")
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), F.transform(wide, lambda s, i: s["start"] + i)).otherwise(none)


def code_point(place: Column, wide: Column) -> Column:
    """A place in UTF-16 units as one in code points."""
    return (place - F.size(F.filter(wide, lambda w: w < place))).cast("int")


def answer_issues(text: Column, answer: Column) -> Column:
    """The issues of an answer, at most forty."""
    matches = F.coalesce(F.from_json(answer, ANSWER)["matches"], F.array().cast("array<" + ANSWER[len("struct<matches:array<") : -2] + ">"))
    numbered = F.transform(matches, lambda m, i: F.struct((i + 1).alias("index"), m.alias("m")))
    whole = lambda x: x.isNotNull() & (x == F.floor(x))
    valid = F.slice(F.filter(numbered, lambda x: whole(x["m"]["offset"]) & whole(x["m"]["length"]) & (x["m"]["offset"] >= 0) & (x["m"]["length"] > 0)), 1, MOST_MATCHES)
    sure = F.create_map(*[F.lit(v) for pair in CONFIDENCE.items() for v in pair])

    def issue(x: Column, wide: Column) -> Column:
        m, kind = x["m"], match_kind(x["m"]["rule"])
        told = F.filter(F.coalesce(F.transform(m["replacements"], lambda r: r["value"]), F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
        return F.struct(
            x["index"].alias("index"), code_point(m["offset"].cast("int"), wide).alias("start"), code_point((m["offset"] + m["length"]).cast("int"), wide).alias("end"), kind.alias("kind"),
            F.when(kind.isin("spelling", "grammar"), "medium").otherwise("low").alias("severity"), F.coalesce(m["message"], F.lit("reported")).alias("message"),
            F.slice(told, 1, MOST_REPLACEMENTS).alias("suggestions"), F.element_at(sure, kind).alias("confidence"),
        )

    return T.let(wide_places(text), lambda wide: F.transform(valid, lambda x: issue(x, wide)))


def outcomes(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """``doc_id, status, caveats, found``: the result's state after the checker, and the issues that it adds.

    ``texts`` has ``doc_id, norm`` and the local ``status`` and ``caveats``;
    ``answers`` has ``doc_id, url, answer, failed``, a row a document.
    """
    d = texts.join(answers, "doc_id", "left")
    asked, refused = F.col("url").isNotNull() & (F.col("url") != ""), endpoint(F.col("url")).isNull()
    lost = F.col("failed").isNotNull()
    was = F.col("status")
    status = (
        F.when(~asked | (was == "disabled"), was).when(refused, "error").when(lost, F.when(was == "abstained", was).otherwise("error")).otherwise("available")
    )
    more = F.when(asked & refused, F.array(F.lit("checker_url_refused"))).when(asked & lost, F.array(F.lit("checker_failed"), F.col("failed"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast(f"array<{ISSUE}>")
    found = F.when(asked & ~refused & ~lost, answer_issues(F.col("norm"), F.col("answer")).cast(f"array<{ISSUE}>")).otherwise(none)
    return d.select("doc_id", status.alias("status"), F.concat("caveats", more).alias("caveats"), found.alias("found"))


def merged(base: DataFrame, outcome: DataFrame, most: int = MOST_MERGED) -> DataFrame:
    """Local issues and those that the checker adds at other places or of other kinds, the first ``most`` of a document.

    ``base`` has ``doc_id, place, start, end, kind, severity``.
    """
    key = ["doc_id", "start", "end", "kind"]
    # No column itself is exploded: the optimiser would test its size, and so compute it, a second time.
    more = outcome.select("doc_id", F.inline(F.transform("found", lambda x: x)))
    parts = base.select(*key, "severity", F.lit(0).alias("late"), "place").unionByName(more.select(*key, "severity", F.lit(1).alias("late"), F.col("index").alias("place")))
    # Those of a place and kind are brought together once; a join with ``base`` would compute it a second time.
    parts = parts.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy("late", "place"))).filter("late = 0 OR turn = 1")
    order = Window.partitionBy("doc_id").orderBy("late", "place")
    return parts.drop("turn").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
