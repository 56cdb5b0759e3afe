"""Report rows: spans, ranked actions and capped sections, assembled from the long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import scoring as R

# What an action of each kind adds, by goal.
GOALS = {
    "source_support": {"claim": 90, "proofreading": 8, "other": 15},
    "clarity_rewrite": {"proofreading": 120, "quality": 90, "claim": 0, "other": 10},
    "risk_review": {"claim": 75, "provenance": 72, "quality": 20, "other": 10},
    "publish_ready_review": {"claim": 70, "proofreading": 55, "quality": 45, "other": 25},
    "default": {"claim": 55, "quality": 45, "proofreading": 35, "other": 30},
}


def severity(score: Column, inverted: bool) -> Column:
    value = 100 - score if inverted else score
    return F.when(value >= 72, "high").when(value >= 45, "medium").otherwise("low")


def dimension_findings(d: DataFrame) -> DataFrame:
    """``doc_id, kind, ord, name, score`` of every dimension of either kind with a finding."""
    q, p, found = R.quality_scores(), R.provenance_scores(), R.provenance_findings()
    rows = [F.struct(F.lit("quality").alias("kind"), F.lit(i).alias("ord"), F.lit(n).alias("name"), q[n].alias("score"), (q[n] < limit).alias("found")) for i, (n, _, limit, _) in enumerate(R.QUALITY)]
    rows += [F.struct(F.lit("provenance").alias("kind"), F.lit(100 + i).alias("ord"), F.lit(n).alias("name"), p[n].alias("score"), found[n].alias("found")) for i, (n, _, _) in enumerate(R.PROVENANCE)]
    return d.select("doc_id", F.inline(F.array(*rows))).filter("found").drop("found")


def all_spans(phrases: DataFrame, claim_spans: DataFrame, issues: DataFrame) -> DataFrame:
    """``doc_id, source, label, start, end``, the sources in their order."""
    parts = (
        phrases.select("doc_id", F.when(F.col("label") == "formulaic_phrase", 0).otherwise(1).alias("source"), "label", "start", "end"),
        claim_spans.select("doc_id", F.lit(2).alias("source"), "label", "start", "end"),
        issues.select("doc_id", F.lit(3).alias("source"), F.concat(F.lit("proofreading_"), F.col("kind")).alias("label"), "start", "end"),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def headline() -> Column:
    """The quality band and what comes first: sources to review, then the provenance band."""
    band = F.col("provenance_band")
    code = (
        F.when(F.col("source_band").isin("weakly_supported", "mixed"), "source_review")
        .when(band == "insufficient_evidence", "abstained")
        .when(band == "high", "clustered")
        .when(band == "elevated", "elevated")
        .otherwise("low")
    )
    return F.concat_ws(":", "quality_band", code)


# The audit's cards that are means of quality dimensions.
CARDS = {
    "plain_language": ("readability", "scannability", "mechanics", "readability_formula"),
    "scannability": ("structure", "scannability"),
    "reader_value": ("specificity", "depth", "actionability"),
}


def audit_cards() -> Column:
    """``card, score, status, severity`` of the six cards, in order, of a scored document with the counts of its claims and issues."""
    s, c = R.quality_scores(), F.col
    rows = []

    def card(name: str, score: Column, status: Column, level: Column) -> None:
        rows.append(F.struct(F.lit(name).alias("card"), score.cast("int").alias("score"), status.alias("status"), level.alias("severity")))

    for name, parts in CARDS.items():
        total = s[parts[0]]
        for p in parts[1:]:
            total = total + s[p]
        score = T.half_up(total / len(parts))
        status = F.when(score >= 78, "strong").when(score >= 62, "good").when(score >= 42, "review").otherwise("needs_work")
        card(name, score, status, F.when(score < 45, "high").when(score < 65, "medium").otherwise("low"))
    unresolved = c("unsupported") + c("inline_only") + c("partial") + c("not_checked")
    level = F.when((unresolved > 0) | (c("stale") > 0), "medium").otherwise("low")
    card("evidence_readiness", s["evidence_density"], F.when(unresolved > 0, "review").otherwise(c("source_band")), level)
    band = c("provenance_band")
    card("provenance", F.lit(None), band, F.when(band == "high", "high").when(band == "elevated", "medium").otherwise("low"))
    ran = F.when(c("language") == "en", "available").otherwise("abstained")
    card("proofreading", F.lit(None), ran, F.when(c("n_grave") > 0, "medium").otherwise("low"))
    return F.array(*rows)


def content_audit(d: DataFrame) -> DataFrame:
    """``doc_id, card, score, status, severity``: six cards a document."""
    return d.select("doc_id", F.inline(audit_cards()))


def actions(statuses: DataFrame, issues: DataFrame, findings: DataFrame, goal: str = "default", most: int = 8) -> DataFrame:
    """``doc_id, place, kind, name, weight``: the weightiest actions of a document; ties keep their order."""
    bonus = GOALS[goal]
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    need = F.when(F.col("need") == "essential", 4).when(F.col("need") == "important", 3).when(F.col("need") == "recommended", 2).otherwise(0)
    asked = (F.col("need") != "none") | F.col("status").isin("unsupported", "inline_citation_only") | F.col("stale")
    none = F.lit(None).cast("string")
    c = statuses.filter(asked).select("doc_id", F.lit("claim").alias("kind"), F.lit(0).alias("turn"), F.col("place").alias("ord"), F.concat(F.lit("claim-"), F.col("place").cast("string")).alias("name"), F.col("importance").alias("severity"), "need", F.lit(0.0).alias("points"))
    order = Window.partitionBy("doc_id").orderBy("place")
    p = issues.filter("severity <> 'low'").withColumn("k", F.row_number().over(order)).filter("k <= 4")
    p = p.select("doc_id", F.lit("proofreading").alias("kind"), F.lit(1).alias("turn"), F.col("place").alias("ord"), F.concat(F.lit("issue-"), F.col("place").cast("string")).alias("name"), "severity", none.alias("need"), F.lit(0.0).alias("points"))
    good = F.col("kind") == "quality"
    level = F.when(good, severity(F.col("score"), True)).otherwise(severity(F.col("score"), False))
    points = F.when(good, 100 - F.col("score")).otherwise(F.col("score")) / 10
    f = findings.select("doc_id", "kind", F.lit(2).alias("turn"), "ord", "name", level.alias("severity"), none.alias("need"), points.cast("double").alias("points"))
    d = c.unionByName(p).unionByName(f)
    extra = F.lit(bonus["other"])
    for kind, n in bonus.items():
        if kind != "other":
            extra = F.when(F.col("kind") == kind, n).otherwise(extra)
    d = d.withColumn("weight", rank * 10 + need * 14 + F.col("points") + extra)
    best = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "turn", "ord")
    return d.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most).select("doc_id", "place", "kind", "name", "weight")
