"""Queries that assemble report rows, each with its SQL where it is short enough to check by eye."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as K
from ..operators import claims as C
from ..operators import preparation as P
from ..operators import proofreading
from ..operators import report as A
from ..operators import scoring as R
from ..sources import store
from . import scoring_queries as SQ
from . import claim_queries as CQ
from . import source_queries as OQ
from . import sql as S
from . import text_queries as TQ


def _tables(spark, sf_dir):
    m = SQ.measured(spark, sf_dir)
    d = TQ.prepared(spark, sf_dir)
    statuses = CQ.statuses(spark, sf_dir)
    issues = proofreading.issues(P.with_language(d))
    return m, statuses, issues


def dimension_findings(spark, sf_dir):
    return A.dimension_findings(SQ.measured(spark, sf_dir)).select("doc_id", "kind", "name", "score")


def all_spans(spark, sf_dir):
    m, statuses, issues = _tables(spark, sf_dir)
    return A.all_spans(R.phrase_spans(m), CQ.spans(statuses), issues)


def _reviewed(spark, sf_dir, **own):
    """Scored documents with the counts of their claims and issues; ``own`` are columns of a document alone, made before it meets them."""
    m, statuses, issues = _tables(spark, sf_dir)
    m = m.withColumns(own) if own else m
    d = R.with_provenance(R.with_quality(m)).join(C.claim_review(statuses).drop("caveats"), "doc_id", "left")
    n = issues.groupBy("doc_id").agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity") != "low").alias("n_grave"))
    d = d.join(n, "doc_id", "left").fillna(0, ["n_issues", "n_grave", "factual", "unsupported", "partial", "inline_only", "not_checked", "stale"])
    return d.withColumn("source_band", F.coalesce("source_band", F.lit("not_checked")))


def report_summary(spark, sf_dir):
    d = _reviewed(spark, sf_dir)
    return d.select("doc_id", "n_words", "language", "genre", "quality_band", "provenance_band", "source_band", A.headline().alias("headline"))


def content_audit(spark, sf_dir):
    return A.content_audit(_reviewed(spark, sf_dir))


def report_store_rows(spark, sf_dir):
    """The 22 columns of the report store; the caller's clock gives the time, so that reruns agree. Every second report keeps its text."""
    null = lambda kind: F.lit(None).cast(kind)
    kept, norm = F.col("doc_id") % 2 == 0, F.col("norm")
    # The texts that are not kept stay out of the shuffle.
    own = {"input_hash": K.keyed_hash(norm, "secret"), "input_length": F.octet_length(norm), "input_excerpt": F.when(kept, SQ._excerpt(norm, 240)), "input_text": F.when(kept, norm)}
    d = _reviewed(spark, sf_dir, **own)
    return d.select(
        F.col("doc_id").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).cast("timestamp_ntz").alias("created_at"), F.lit("text").alias("source_type"), null("long").alias("post_id"), null("long").alias("user_id"),
        F.lit("editorial").alias("mode"), F.lit("1").alias("analyzer_version"), "genre", F.col("language").alias("language_hint"), *own,
        kept.alias("stored_raw_text"), A.headline().alias("summary_headline"), "quality_band", "provenance_band", "source_band",
        F.col("n_words").alias("word_count"), F.to_json(F.struct("quality_band", "provenance_band", F.col("n_words").alias("words"))).alias("result_json"), K.keyed_hash(F.col("doc_id").cast("string"), "secret").alias("visitor_hash"),
        K.keyed_hash(F.lit(""), "secret").alias("user_agent_hash"),
    )


# The columns that a list of reports shows.
LISTED = ("id", "created_at", "source_type", "post_id", "user_id", "mode", "analyzer_version", "stored_raw_text", "summary_headline", "quality_band", "provenance_band", "source_band", "word_count")


def report_list_topk(spark, sf_dir):
    return store.list_reports(store.stored(report_store_rows(spark, sf_dir)), 100).select(*LISTED)


def report_filter(spark, sf_dir):
    kept = store.stored(report_store_rows(spark, sf_dir))
    found = store.filter_reports(kept, quality=("fair", "poor"), not_provenance=("insufficient_evidence",), source=("not_checked", "weakly_supported"), day_prefix="2023-11-1")
    return found.select("id", "quality_band", "provenance_band", "source_band")


def redacted_reports(spark, sf_dir):
    """Reports whose text isn't kept show bands and counts only."""
    d = report_store_rows(spark, sf_dir)
    return d.select("id", "quality_band", "provenance_band", "source_band", "word_count", *[F.when(F.col("stored_raw_text"), F.col(c)).alias(c) for c in ("input_excerpt", "summary_headline", "result_json")])


def latest_report(spark, sf_dir):
    return store.latest_report(report_store_rows(spark, sf_dir)).select("id", "quality_band", "word_count")


def top_actions(spark, sf_dir):
    m, statuses, issues = _tables(spark, sf_dir)
    return A.actions(statuses, issues, A.dimension_findings(m))


_FINDINGS = (
    "fi AS ("
    + " UNION ALL ".join(
        [f"SELECT doc_id, 'quality' AS kind, {i} AS ord, '{n}' AS name, s_{n} AS score FROM qs WHERE s_{n} < {lim}" for i, (n, _, lim, _) in enumerate(R.QUALITY)]
        + [f"SELECT doc_id, 'provenance', {100 + i}, '{n}', {SQ._risk(n)} FROM qs WHERE {SQ.FOUND_SQL[n]}" for i, (n, _, _) in enumerate(R.PROVENANCE)]
    )
    + ")"
)
_ISSUES = "iss AS (SELECT doc_id, place, rule FROM (" + OQ.ORACLE["proof_issues"] + "))"
_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * 10 + CASE need WHEN 'essential' THEN 4 WHEN 'important' THEN 3 WHEN 'recommended' THEN 2 ELSE 0 END * 14 + points"
_ACTIONS = f"""
ac AS (SELECT doc_id, 'claim' AS kind, 0 AS turn, place AS ord, 'claim-' || place AS name, importance AS severity, need, 0.0::DOUBLE AS points, 55 AS extra FROM sc
  WHERE need <> 'none' OR status IN ('unsupported', 'inline_citation_only') OR stale
  UNION ALL SELECT doc_id, 'proofreading', 1, place, 'issue-' || place, 'medium', NULL, 0.0::DOUBLE, 35 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM iss WHERE rule = '1-misspelling') WHERE k <= 4
  UNION ALL SELECT doc_id, kind, 2, ord, name, CASE WHEN v >= 72 THEN 'high' WHEN v >= 45 THEN 'medium' ELSE 'low' END, NULL, v / 10.0::DOUBLE, CASE WHEN kind = 'quality' THEN 45 ELSE 30 END
  FROM (SELECT *, CASE WHEN kind = 'quality' THEN 100 - score ELSE score END AS v FROM fi)),
aw AS (SELECT *, {_RANK} + extra AS weight FROM ac),
ak AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, turn, ord) AS place FROM aw)"""

QUERIES = {f.__name__: f for f in (dimension_findings, all_spans, report_summary, content_audit, report_store_rows, report_list_topk, report_filter, redacted_reports, latest_report, top_actions)}

_HEADLINE = "quality_band || ':' || CASE WHEN source_band IN ('weakly_supported', 'mixed') THEN 'source_review' WHEN provenance_band = 'insufficient_evidence' THEN 'abstained' WHEN provenance_band = 'high' THEN 'clustered' WHEN provenance_band = 'elevated' THEN 'elevated' ELSE 'low' END"
_REVIEWED = f"""ic AS (SELECT doc_id, count(*) AS n_issues, count(*) FILTER (rule = '1-misspelling') AS n_grave FROM iss GROUP BY 1),
re AS (SELECT *, {_HEADLINE} AS headline FROM (SELECT pb.*, coalesce(n_issues, 0) AS n_issues, coalesce(n_grave, 0) AS n_grave, coalesce(rv.source_band, 'not_checked') AS source_band, coalesce(rv.factual, 0) AS factual,
  coalesce(rv.unsupported, 0) + coalesce(rv.inline_only, 0) + coalesce(rv.partial, 0) + coalesce(rv.not_checked, 0) AS unresolved, coalesce(rv.stale, 0) AS n_stale FROM pb LEFT JOIN rv USING (doc_id) LEFT JOIN ic USING (doc_id)))"""
_HMAC = lambda x: f"sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode({x}))))"
_PADS = tuple(bytes(b ^ k for b in b"secret".ljust(64, b"\0")).hex() for k in (0x36, 0x5C))
_STORE = f"""st AS (SELECT doc_id AS id, TIMESTAMP '1970-01-01' + to_seconds(1700000000 + doc_id * 60) AS created_at, 'text' AS source_type, NULL::BIGINT AS post_id, NULL::BIGINT AS user_id, 'editorial' AS mode, '1' AS analyzer_version, genre, language AS language_hint,
  {_HMAC("norm")} AS input_hash, strlen(norm) AS input_length, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN length({SQ._FLAT}) > 240 THEN substring({SQ._FLAT}, 1, 240) || '…' ELSE {SQ._FLAT} END END AS input_excerpt, CASE WHEN doc_id % 2 = 0 THEN norm END AS input_text,
  doc_id % 2 = 0 AS stored_raw_text, headline AS summary_headline, quality_band, provenance_band, source_band, n_words AS word_count, '{{"quality_band":"' || quality_band || '","provenance_band":"' || provenance_band || '","words":' || n_words || '}}' AS result_json,
  {_HMAC("CAST(doc_id AS VARCHAR)")} AS visitor_hash, {_HMAC("''")} AS user_agent_hash FROM re)"""


def _review(select: str, *more: str) -> str:
    return SQ._scored(select, SQ._Q, SQ._QB, SQ._P, *CQ.STATUS, CQ.REVIEW, _ISSUES, _REVIEWED, *more)


def _card(name: str, *parts: str) -> str:
    score = f"CAST(floor(({' + '.join(f's_{p}' for p in parts)}) / {len(parts)}.0::DOUBLE + 0.5::DOUBLE) AS INTEGER)"
    return f"SELECT doc_id, '{name}' AS card, {score} AS score, CASE WHEN {score} >= 78 THEN 'strong' WHEN {score} >= 62 THEN 'good' WHEN {score} >= 42 THEN 'review' ELSE 'needs_work' END AS status, CASE WHEN {score} < 45 THEN 'high' WHEN {score} < 65 THEN 'medium' ELSE 'low' END AS severity FROM re"


ORACLE = {
    "dimension_findings": SQ._scored("SELECT doc_id, kind, name, score FROM fi", SQ._Q, _FINDINGS),
    "top_actions": SQ._scored("SELECT doc_id, CAST(place AS INTEGER) AS place, kind, name, weight FROM ak WHERE place <= 8", SQ._Q, _FINDINGS, *CQ.STATUS, _ISSUES, _ACTIONS),
    "all_spans": SQ._scored(
        "SELECT doc_id, CASE WHEN label = 'formulaic_phrase' THEN 0 ELSE 1 END AS source, label, start, \"end\" FROM (" + SQ.ORACLE["phrase_spans"] + ") UNION ALL SELECT doc_id, 2, label, start, \"end\" FROM (" + CQ.ORACLE["claim_spans"] + ") UNION ALL "
        "SELECT doc_id, 3, 'proofreading_' || CASE rule WHEN '1-misspelling' THEN 'spelling' WHEN '4-wordy' THEN 'style' ELSE 'typography' END, start, \"end\" FROM (" + OQ.ORACLE["proof_issues"] + ")"
    ),
    "report_summary": _review("SELECT doc_id, n_words, language, genre, quality_band, provenance_band, source_band, headline FROM re"),
    "content_audit": _review(
        " UNION ALL ".join((_card("plain_language", "readability", "scannability", "mechanics", "readability_formula"), _card("scannability", "structure", "scannability"), _card("reader_value", "specificity", "depth", "actionability")))
        + " UNION ALL SELECT doc_id, 'evidence_readiness', s_evidence_density, CASE WHEN unresolved > 0 THEN 'review' ELSE source_band END, CASE WHEN unresolved > 0 OR n_stale > 0 THEN 'medium' ELSE 'low' END FROM re"
        " UNION ALL SELECT doc_id, 'provenance', NULL, provenance_band, CASE provenance_band WHEN 'high' THEN 'high' WHEN 'elevated' THEN 'medium' ELSE 'low' END FROM re"
        " UNION ALL SELECT doc_id, 'proofreading', NULL, CASE WHEN language = 'en' THEN 'available' ELSE 'abstained' END, CASE WHEN n_grave > 0 THEN 'medium' ELSE 'low' END FROM re"
    ),
    "report_store_rows": _review("SELECT * FROM st", _STORE),
    "report_list_topk": _review(f"SELECT {', '.join(LISTED)} FROM st ORDER BY created_at DESC, id DESC LIMIT 100", _STORE),
    "report_filter": _review("SELECT id, quality_band, provenance_band, source_band FROM st WHERE quality_band IN ('fair', 'poor') AND provenance_band <> 'insufficient_evidence' AND source_band IN ('not_checked', 'weakly_supported') AND starts_with(strftime(created_at, '%Y-%m-%d'), '2023-11-1')", _STORE),
    "redacted_reports": _review("SELECT id, quality_band, provenance_band, source_band, word_count, " + ", ".join(f"CASE WHEN stored_raw_text THEN {c} END AS {c}" for c in ("input_excerpt", "summary_headline", "result_json")) + " FROM st", _STORE),
    "latest_report": _review("SELECT id, quality_band, word_count FROM st ORDER BY created_at DESC, id DESC LIMIT 1", _STORE),
}
