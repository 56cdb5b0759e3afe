"""Queries over whole reports: sections, caveats, recommendations, profiles and their Markdown; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..operators import metrics as M
from ..operators import preparation as P
from ..operators import proofreading
from ..operators import scoring as R
from ..operators import views as V
from . import claim_queries as CQ
from . import report_queries as RQ
from . import scoring_queries as SQ
from . import sql as S
from . import text_queries as TQ


def parts(spark, sf_dir):
    statuses = CQ.statuses(spark, sf_dir)
    issues = proofreading.issues(P.with_language(TQ.prepared(spark, sf_dir)))
    scored = R.with_provenance(R.with_quality(SQ.measured(spark, sf_dir)))
    # What is told by the text and its words is told before the joins, so that neither is shuffled.
    hint = F.lit(None).cast("string")
    scored = scored.withColumns({"phrases": R.phrase_span_array(), "assumed": P.assumptions(hint, hint)})
    return V.with_parts(scored, statuses, None, issues)


def sectioned(spark, sf_dir):
    d = parts(spark, sf_dir)
    return V.with_sections(d, assumptions=F.col("assumed")).select("doc_id", "sections")


def _viewed(spark, sf_dir, profiles, modes=("editorial",)):
    """A row for each document, profile and mode."""
    d = sectioned(spark, sf_dir).withColumn("profile", F.explode(F.array(*map(F.lit, profiles))))
    d = d.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    visible = V.raw_visible(F.col("mode"), F.col("profile"), F.lit(False))
    return d.withColumns({"visible": visible, "sections": V.view(F.col("sections"), F.col("profile"), visible)})


def report_sections(spark, sf_dir):
    return V.section_rows(_viewed(spark, sf_dir, ("full",)))


def report_caveats(spark, sf_dir):
    """Each document's caveats: those of the summary, of the claims and of proofreading, each at its first place."""
    d = parts(spark, sf_dir)
    every = V.ordered_union(V.summary_caveats(), F.col("claim_caveats"), V.proofreading_caveats(F.col("language")))
    return d.select("doc_id", F.posexplode(every).alias("ord", "caveat"))


def recommendations(spark, sf_dir):
    d = parts(spark, sf_dir)
    return d.select("doc_id", F.posexplode(V.recommendations(d)).alias("ord", "advice"))


def report_visibility(spark, sf_dir):
    """What each profile shows under each analysis mode."""
    d = _viewed(spark, sf_dir, V.PROFILES, tuple(R.MODES))
    n = F.aggregate("sections", F.lit(0), lambda a, s: a + F.size(s["items"]))
    return d.select("doc_id", "profile", "mode", F.col("visible").alias("raw_shown"), F.size("sections").alias("n_sections"), n.alias("n_items"))


def report_profile(spark, sf_dir):
    """The Markdown of every document under every profile."""
    d = _viewed(spark, sf_dir, V.PROFILES)
    text = V.markdown(F.col("sections"), F.col("profile"))
    return d.select("doc_id", "profile", text.alias("report")).select("doc_id", "profile", F.length("report").alias("n_chars"), F.md5("report").alias("digest"))


def report_markdown(spark, sf_dir):
    d = _viewed(spark, sf_dir, ("checklist",))
    return d.select("doc_id", V.markdown(F.col("sections"), F.col("profile")).alias("report"))


QUERIES = {f.__name__: f for f in (report_sections, report_caveats, recommendations, report_visibility, report_profile, report_markdown)}

_ROUND = "floor({0} * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE"
_LEVEL = "CASE WHEN {0} >= 72 THEN 'high' WHEN {0} >= 45 THEN 'medium' ELSE 'low' END"
_CARD_ORDER = ("plain_language", "scannability", "reader_value", "evidence_readiness", "provenance", "proofreading")
_KIND = "CASE rule WHEN '1-misspelling' THEN 'spelling' WHEN '4-wordy' THEN 'style' ELSE 'typography' END"
_GRADE = "CASE rule WHEN '1-misspelling' THEN 'medium' ELSE 'low' END"
_CAVEATS = """
cv AS (SELECT re.doc_id, list_concat(list_concat(list_filter([CASE WHEN length_class = 'too_short' THEN 'provenance_abstained' END, CASE WHEN length_class = 'short' THEN 'provenance_limited_by_length' END,
    CASE WHEN length_class <> 'too_short' AND language = 'unknown' THEN 'language_not_detected' END, CASE WHEN length_class <> 'too_short' AND formal AND fam >= 4 AND ev >= 58 THEN 'escalation_softened_by_context' END,
    CASE WHEN language = 'unknown' THEN 'language_checks_weak' END, CASE WHEN mixed THEN 'language_mixed' END], lambda x: x IS NOT NULL),
  CASE WHEN coalesce(rv.caveats, '') = '' THEN [] ELSE string_split(rv.caveats, '|') END), [CASE WHEN language = 'en' THEN 'grammar_runs_elsewhere' ELSE 'proofreading_english_only' END]) AS every
  FROM re LEFT JOIN rv ON rv.doc_id = re.doc_id LEFT JOIN lm ON lm.doc_id = re.doc_id),
cw AS MATERIALIZED (SELECT doc_id, caveat, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord FROM (SELECT doc_id, every[i] AS caveat, min(i) AS ord FROM (SELECT doc_id, every, unnest(range(1, len(every) + 1)) AS i FROM cv) GROUP BY ALL))"""
_LANGUAGE = "lm AS MATERIALIZED (SELECT doc_id, CAST(language_confidence AS DOUBLE) AS confidence, language_mixed AS mixed FROM l)"
_PHRASES = " UNION ALL ".join(
    [f"SELECT doc_id, {i} AS turn, start, 'formulaic_phrase' AS label, '{sev}' AS severity, 'phrase' AS status FROM {S.span_rows(f'(SELECT * FROM l WHERE language = {S.quoted(c)})', 'low', p)}" for i, (c, p, sev) in enumerate(X.PHRASES)]
    + [f"SELECT doc_id, {100 + i}, start, 'bloated_phrase', 'low', 'phrase' FROM {S.span_rows('l', 'low', p)}" for i, p in enumerate(X.BLOAT)]
)
_MARKED = "CASE WHEN status IN ('unsupported', 'inline_citation_only') THEN status WHEN stale THEN 'freshness_risk' END"
_ITEMS = f"""
ro AS MATERIALIZED (SELECT * FROM re), au AS MATERIALIZED (SELECT *, list_position({list(_CARD_ORDER)}, card) AS place FROM ({{cards}})),
ps AS MATERIALIZED (SELECT doc_id, 0 AS part, turn, start AS spot, start, label, severity, status FROM ({_PHRASES}) UNION ALL
  SELECT doc_id, 1, 0, place, start, {_MARKED}, CASE WHEN status = 'unsupported' THEN 'medium' ELSE 'low' END, 'claim' FROM sc WHERE {_MARKED} IS NOT NULL UNION ALL
  SELECT doc_id, 2, 0, place, start, 'proofreading_' || {_KIND}, {_GRADE}, 'proofreading' FROM ip),
it AS MATERIALIZED (
  SELECT ak.doc_id, 1 AS sp, 'top_actions' AS section, ak.place, name AS item, severity, CASE kind WHEN 'claim' THEN sc.status WHEN 'proofreading' THEN ip.rule END AS status, CASE WHEN kind IN ('quality', 'provenance') THEN fi.score END AS score
    FROM ak LEFT JOIN sc ON kind = 'claim' AND sc.doc_id = ak.doc_id AND sc.place = ak.ord LEFT JOIN ip ON kind = 'proofreading' AND ip.doc_id = ak.doc_id AND ip.place = ak.ord
    LEFT JOIN (SELECT doc_id, name AS n, score FROM fi) fi ON kind IN ('quality', 'provenance') AND fi.doc_id = ak.doc_id AND fi.n = name WHERE ak.place <= 8
  UNION ALL SELECT doc_id, 2, 'score_overview', 1, 'provenance_band', NULL, provenance_band, floor(provenance_confidence * 100 + 0.5::DOUBLE) FROM ro
  UNION ALL SELECT doc_id, 2, 'score_overview', 2, 'quality_band', NULL, quality_band, NULL FROM ro
  UNION ALL SELECT doc_id, 2, 'score_overview', 3, 'source_band', NULL, source_band, NULL FROM ro
  UNION ALL SELECT doc_id, 3, 'content_audit', place, card, severity, status, score FROM au
  UNION ALL SELECT ro.doc_id, 4, 'context_confidence', 1, 'language', NULL, language, floor(lm.confidence * 100 + 0.5::DOUBLE) FROM ro JOIN lm ON lm.doc_id = ro.doc_id
  UNION ALL SELECT doc_id, 4, 'context_confidence', 2, 'genre', NULL, genre, floor(CAST(genre_confidence AS DOUBLE) * 100 + 0.5::DOUBLE) FROM ro
  UNION ALL SELECT doc_id, 4, 'context_confidence', 3, 'goal', 'low', 'default', NULL FROM ro
  UNION ALL SELECT ro.doc_id, 4, 'context_confidence', 4, 'sources', CASE WHEN coalesce(rv.n_given, 0) > 0 THEN 'low' ELSE 'medium' END, CAST(coalesce(rv.n_given, 0) AS VARCHAR), NULL FROM ro LEFT JOIN rv ON rv.doc_id = ro.doc_id
  UNION ALL SELECT doc_id, 4, 'context_confidence', 5, 'assumption:' || CASE genre WHEN 'academic' THEN 'genre_from_citation_markers' WHEN 'legal' THEN 'genre_from_legal_markers' WHEN 'marketing' THEN 'genre_from_calls' ELSE 'genre_weakly_inferred' END, 'low', NULL, NULL FROM ro
  UNION ALL SELECT doc_id, 5, 'writing_quality', k, name, {_LEVEL.format("(100 - score)")}, NULL, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, ord) AS k FROM fi WHERE kind = 'quality') WHERE k <= 10
  UNION ALL SELECT doc_id, 6, 'provenance_risk', k, name, {_LEVEL.format("score")}, NULL, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS k FROM fi WHERE kind = 'provenance') WHERE k <= 8
  UNION ALL SELECT doc_id, 7, 'proofreading', place, rule, {_GRADE}, {_KIND}, NULL FROM ip WHERE place <= 16
  UNION ALL SELECT doc_id, 8, 'claim_review', place, action || ':' || need, importance, status, NULL FROM sc WHERE place <= 16
  UNION ALL SELECT doc_id, 9, 'highlighted_passages', k, label, severity, status, start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, turn, spot) AS k FROM ps) WHERE k <= 14
  UNION ALL SELECT doc_id, 10, 'caveats', ord + 1, caveat, 'low', NULL, NULL FROM cw
  UNION ALL SELECT doc_id, 11, 'raw_diagnostics', list_position({list(M.NAMES)}, metric), metric, NULL, NULL, {_ROUND.format("value")} FROM (SELECT doc_id, {", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in M.NAMES)} FROM ro) UNPIVOT (value FOR metric IN ({", ".join(M.NAMES)})))"""
_CARDS = " UNION ALL ".join((RQ._card("plain_language", "readability", "scannability", "mechanics", "readability_formula"), RQ._card("scannability", "structure", "scannability"), RQ._card("reader_value", "specificity", "depth", "actionability"))) + (
    " UNION ALL SELECT doc_id, 'evidence_readiness', s_evidence_density, CASE WHEN unresolved > 0 THEN 'review' ELSE source_band END, CASE WHEN unresolved > 0 OR n_stale > 0 THEN 'medium' ELSE 'low' END FROM re"
    " UNION ALL SELECT doc_id, 'provenance', NULL, provenance_band, CASE provenance_band WHEN 'high' THEN 'high' WHEN 'elevated' THEN 'medium' ELSE 'low' END FROM re"
    " UNION ALL SELECT doc_id, 'proofreading', NULL, CASE WHEN language = 'en' THEN 'available' ELSE 'abstained' END, CASE WHEN n_grave > 0 THEN 'medium' ELSE 'low' END FROM re"
)
_PROOF_ROWS = "ip AS MATERIALIZED (SELECT doc_id, place, rule, start FROM (" + RQ.OQ.ORACLE["proof_issues"] + "))"
#: Sections, the profiles that have each, and whether a view shows its items.
_VIEWS = f"""
sn AS (SELECT unnest(range(1, {len(V.SECTIONS) + 1})) AS sp, unnest({[n for n, _ in V.SECTIONS]}) AS section),
pf AS (SELECT unnest({list(V.PROFILES)}) AS profile),
su AS MATERIALIZED (SELECT ro.doc_id, headline, concat_ws('/', n_words, n_sentences, n_paragraphs) AS counts, CASE WHEN language = 'en' THEN 'issues:' || n_issues ELSE 'proofreading_english_only' END AS proofs,
  concat_ws('/', coalesce(rv.supported, 0), coalesce(rv.partial, 0), coalesce(rv.inline_only, 0), coalesce(rv.unsupported, 0), coalesce(rv.not_checked, 0)) AS reviewed FROM ro LEFT JOIN rv ON rv.doc_id = ro.doc_id),
vw AS (SELECT su.*, profile, sp, section, CASE section WHEN 'score_overview' THEN headline WHEN 'context_confidence' THEN counts WHEN 'proofreading' THEN proofs WHEN 'claim_review' THEN reviewed END AS summary FROM su, pf, sn
  WHERE CASE profile WHEN 'checklist' THEN section IN ({", ".join(map(S.quoted, V.CHECKLIST))}) WHEN 'machine' THEN section = 'raw_diagnostics' ELSE true END),
li AS (SELECT doc_id, sp, count(*) AS n, string_agg(concat_ws(' ', '-', '[' || status || ']', '(' || regexp_replace(printf('%.3f', CAST(score AS DOUBLE)), '\\.?0+$', '') || ')', item), chr(10) ORDER BY place) AS body FROM it GROUP BY 1, 2),
vl AS (SELECT vw.doc_id, profile, vw.sp, section, summary, CASE WHEN section = 'raw_diagnostics' AND profile <> 'machine' THEN NULL ELSE body END AS body FROM vw LEFT JOIN li ON li.doc_id = vw.doc_id AND li.sp = vw.sp),
md AS (SELECT doc_id, profile, CASE profile WHEN 'claims-csv' THEN 'checklist' ELSE profile END AS own, string_agg(CASE WHEN profile IN ('checklist', 'claims-csv') AND body IS NULL THEN NULL
    ELSE concat_ws(chr(10) || chr(10), '## ' || section, summary, coalesce(body, '- none')) END, chr(10) || chr(10) ORDER BY sp) AS body FROM vl GROUP BY 1, 2),
rp2 AS (SELECT doc_id, profile, concat_ws(chr(10) || chr(10), '# Report: ' || own, coalesce(body, '')) AS report FROM md)"""


def _report(select: str, *more: str) -> str:
    return SQ._scored(select, SQ._Q, SQ._QB, SQ._P, _FI, *CQ.STATUS, CQ.REVIEW, RQ._ISSUES, RQ._REVIEWED, _PROOF_ROWS, _LANGUAGE, RQ._ACTIONS, _CAVEATS, *more)


_FI = RQ._FINDINGS.replace("fi AS (", "fi AS MATERIALIZED (", 1)
_ALL_ITEMS = _ITEMS.replace("{cards}", _CARDS)
_ADVICE = "[" + ", ".join(f"CASE WHEN s_{n} < {limit} THEN '{n}' END" for n, _, limit, _ in R.QUALITY) + "]"
ORACLE = {
    "report_sections": _report("SELECT doc_id, CAST(sp AS INTEGER) AS section_place, section, CAST(place AS INTEGER) AS place, item, severity, status, CAST(score AS DOUBLE) AS score FROM it WHERE section <> 'raw_diagnostics'", _ALL_ITEMS),
    "report_caveats": _report("SELECT doc_id, CAST(ord AS INTEGER) AS ord, caveat FROM cw"),
    "recommendations": _report(
        "SELECT doc_id, CAST(ord AS INTEGER) AS ord, advice FROM (SELECT doc_id, advice, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord FROM (SELECT doc_id, advice, min(ord) AS ord FROM ra GROUP BY 1, 2)) WHERE ord < 10",
        f"""ra AS (SELECT doc_id, i AS ord, x[i] AS advice FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, list_filter({_ADVICE}, lambda a: a IS NOT NULL)[1:8] AS x FROM re))
  UNION ALL SELECT doc_id, 100 + k, action || ':' || claim FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM sc WHERE status IN ('unsupported', 'inline_citation_only') OR stale) WHERE k <= 4)""",
    ),
    "report_visibility": _report(
        f"""SELECT vw.doc_id, profile, mode, mode = 'research' OR profile = 'machine' AS raw_shown, CAST(count(*) AS INTEGER) AS n_sections,
  CAST(sum(CASE WHEN section = 'raw_diagnostics' AND NOT (mode = 'research' OR profile = 'machine') THEN 0 ELSE coalesce(n, 0) END) AS INTEGER) AS n_items
FROM vw LEFT JOIN li ON li.doc_id = vw.doc_id AND li.sp = vw.sp, (SELECT unnest({list(R.MODES)}) AS mode) GROUP BY ALL""",
        _ALL_ITEMS,
        _VIEWS,
    ),
    "report_profile": _report("SELECT doc_id, profile, length(report) AS n_chars, md5(report) AS digest FROM rp2", _ALL_ITEMS, _VIEWS),
    "report_markdown": _report("SELECT doc_id, report FROM rp2 WHERE profile = 'checklist'", _ALL_ITEMS, _VIEWS),
}
