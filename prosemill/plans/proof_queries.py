"""Queries over single rules of proofreading and an external checker's answers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T
from ..operators import checker as C
from ..operators import preparation as P
from ..operators import proofreading as R
from ..operators import views as V
from . import sql as S
from .text_queries import prepared


def faulty() -> Column:
    """Texts with misspellings, wordy phrases, doubled words and characters of two UTF-16 units in the place of common words."""
    pairs = ((" the ", " definately the the "), (" of ", " in order to "), (" and ", "  recieve and "), (". ", ". \U0001f600 "))
    out = F.col("text")
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _faulty(spark, sf_dir):
    return P.with_language(prepared(spark, sf_dir, faulty()))


def _rule(rule: str):
    def query(spark, sf_dir):
        return R.issues(_faulty(spark, sf_dir), None, (rule,)).select("doc_id", "start", "end", F.lower("found").alias("found"), "suggestion")

    return query


def _answers(d):
    """What a checker might say of every text: its long words, some at impossible places; and requests that fail."""
    words = T.spans(F.col("norm"), "[A-Za-z]{9,}")
    kinds = F.array(*map(F.lit, ("misspelling", "grammar", "typographical", "punctuation", "style", "Misspelling")))

    def match(s: Column, i: Column, wide: Column) -> Column:
        # Characters before a place that take two units move it on.
        start = s["start"] + F.size(F.filter(wide, lambda w: w < s["start"]))
        offset = F.when(i % 11 == 4, -1).otherwise(start)
        rule = F.struct(F.get(kinds, (i % 6).cast("int")).alias("issueType"), F.struct(F.lit("X").alias("id"), F.lit("x").alias("name")).alias("category"))
        told = F.array(F.struct(F.lit("").alias("value")), F.struct(F.upper(s["text"]).alias("value")))
        return F.struct(F.lit("m").alias("message"), offset.alias("offset"), F.length(s["text"]).alias("length"), told.alias("replacements"), rule.alias("rule"))

    at = F.transform(T.spans(F.col("norm"), r"[\x{10000}-\x{10FFFF}]"), lambda s: s["start"])
    matches = T.let(at, lambda wide: F.transform(F.slice(words, 1, 60), lambda s, i: match(s, i, wide)))
    turn = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(7))
    url = F.when(turn == 0, F.lit(None)).when(turn == 1, "http://checker.example/v2/check").otherwise("http://localhost:8081/")
    failed = F.when(turn == 2, "http_500")
    return d.select("doc_id", url.alias("url"), F.when(failed.isNull(), F.to_json(F.struct(matches.alias("matches")))).alias("answer"), failed.alias("failed"))


def _outcome(spark, sf_dir):
    d = _faulty(spark, sf_dir)
    own = d.select("doc_id", "norm", V.proofreading_status(F.col("language")).alias("status"), V.proofreading_caveats(F.col("language")).alias("caveats"))
    return d, C.outcomes(own, _answers(d))


def checker_states(spark, sf_dir):
    _, found = _outcome(spark, sf_dir)
    return found.select("doc_id", "status", F.array_join("caveats", "|").alias("caveats"), F.size("found").alias("n_found"))


def checker_issues(spark, sf_dir):
    d, found = _outcome(spark, sf_dir)
    return C.merged(R.issues(d), found).select("doc_id", "place", "start", "end", "kind", "severity", "late")


def checker_endpoints(spark, sf_dir):
    """Which pages' addresses would do as a checker's; half of them are written as the machine's own."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    url = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://[^/]+", "http://LOCALHOST:8010")).otherwise(F.col("url"))
    return pages.select("page_id", C.endpoint(url).alias("endpoint"))


QUERIES = {
    "proof_misspellings": _rule("1-misspelling"), "proof_repeated_words": _rule("2-repeated"), "proof_spacing": _rule("3-spacing"), "proof_wordy": _rule("4-wordy"),
    "checker_states": checker_states, "checker_issues": checker_issues, "checker_endpoints": checker_endpoints,
}

_TEXT = "replace(replace(replace(replace(text, ' the ', ' definately the the '), ' of ', ' in order to '), ' and ', '  recieve and '), '. ', '. ' || chr(128512) || ' ')"
_EN = "en AS MATERIALIZED (SELECT * FROM l WHERE language = 'en')"


def _sql(select: str, *more: str) -> str:
    return S.with_language(select, _EN, *more).replace("FROM documents)", f"FROM (SELECT * REPLACE ({_TEXT} AS text) FROM documents))")


def _phrases(listed) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, start, \"end\", lower(text) AS found, {S.quoted(short)} AS suggestion, {i} AS i FROM {S.span_rows('en', 'norm', rf'(?i)\b(?:{p})\b')}" for i, (p, short) in enumerate(listed))


_REPEATED = (
    f"""wo AS (SELECT *, lead(text) OVER z AS nt, lead(start) OVER z AS ns, lead("end") OVER z AS ne FROM {S.span_rows("en", "norm", r"[\p{L}\p{M}_0-9]+")} WINDOW z AS (PARTITION BY doc_id ORDER BY ord))""",
    """pr AS (SELECT wo.doc_id, wo.ord, wo.start, ne AS "end", lower(substring(norm, wo.start + 1, ne - wo.start)) AS found FROM wo JOIN en USING (doc_id) WHERE lower(wo.text) = lower(nt) AND length(wo.text) >= 3
  AND NOT regexp_matches(wo.text, '[_0-9]') AND regexp_matches(substring(norm, wo."end" + 1, ns - wo."end"), '^\\s+$'))""",
    "ru AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM pr)",
    """rp AS MATERIALIZED (SELECT doc_id, start, "end", found FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY ord) AS z FROM ru) WHERE z % 2 = 1)""",
)
_SPACES = f"SELECT doc_id, start, \"end\", text AS found, ' ' AS suggestion FROM {S.span_rows('en', 'norm', '[ \\t]{2,}')}"
_BASE = f"""ba AS MATERIALIZED (SELECT * FROM (SELECT doc_id, start, "end", kind, severity, row_number() OVER (PARTITION BY doc_id ORDER BY r, i, start) AS place FROM (
  SELECT doc_id, start, "end", 1 AS r, i, 'spelling' AS kind, 'medium' AS severity FROM ({_phrases(X.MISSPELLINGS)}) UNION ALL SELECT doc_id, start, "end", 2, 0, 'typography', 'low' FROM rp
  UNION ALL SELECT doc_id, start, "end", 3, 0, 'typography', 'low' FROM ({_SPACES}) UNION ALL SELECT doc_id, start, "end", 4, i, 'style', 'low' FROM ({_phrases(X.WORDY)}))) WHERE place <= {R.MOST_ISSUES})"""
#: Matches in code points from the beginning: the places that the answers' units must come back to.
_FOUND = f"""lw AS (SELECT doc_id, ord AS i, start, "end" FROM {S.span_rows("l", "norm", "[A-Za-z]{9,}")} WHERE ord < 60 AND ord % 11 <> 4),
fo AS MATERIALIZED (SELECT *, CASE i % 6 WHEN 0 THEN 'spelling' WHEN 5 THEN 'spelling' WHEN 1 THEN 'grammar' WHEN 2 THEN 'typography' WHEN 3 THEN 'punctuation' ELSE 'style' END AS kind
  FROM (SELECT lw.*, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lw) JOIN tu USING (doc_id) WHERE k <= {C.MOST_MATCHES} AND turn > 2)"""
#: crc32 of each source, bit by bit, modulo 7.
_BYTE = "(CASE WHEN i % 8 = 0 THEN xor(c, ('0x' || substring(hex(s), 2 * (i // 8) + 1, 2))::BIGINT) ELSE c END)"
_TURN = f"""bits(s, i, c) AS (SELECT DISTINCT coalesce(source, ''), CAST(0 AS BIGINT), CAST(4294967295 AS BIGINT) FROM documents
  UNION ALL SELECT s, i + 1, CASE WHEN {_BYTE} % 2 = 1 THEN xor({_BYTE} // 2, CAST(3988292384 AS BIGINT)) ELSE {_BYTE} // 2 END FROM bits WHERE i < 8 * strlen(s)),
tu AS MATERIALIZED (SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) % 7 AS turn FROM l JOIN bits ON bits.s = coalesce(source, '') AND i = 8 * strlen(bits.s))"""


_MERGE = """mg AS (SELECT doc_id, start, "end", kind, severity, 0 AS late, place FROM ba UNION ALL
  SELECT doc_id, start, "end", kind, CASE WHEN kind IN ('spelling', 'grammar') THEN 'medium' ELSE 'low' END, 1, i FROM fo f WHERE NOT EXISTS (SELECT 1 FROM ba b WHERE b.doc_id = f.doc_id AND b.start = f.start AND b."end" = f."end" AND b.kind = f.kind))"""
_LOCAL = "CASE WHEN language = 'en' THEN 'available' ELSE 'abstained' END"


def _with_turn(select: str, *more: str) -> str:
    return _sql(select, _TURN, *more).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE = {
    "proof_misspellings": _sql(f"SELECT doc_id, start, \"end\", found, suggestion FROM ({_phrases(X.MISSPELLINGS)})"),
    "proof_repeated_words": _sql("SELECT doc_id, start, \"end\", found, '' AS suggestion FROM rp", *_REPEATED),
    "proof_spacing": _sql(_SPACES),
    "proof_wordy": _sql(f"SELECT doc_id, start, \"end\", found, suggestion FROM ({_phrases(X.WORDY)})"),
    "checker_states": _with_turn(
        f"""SELECT l.doc_id, CASE turn WHEN 0 THEN {_LOCAL} WHEN 1 THEN 'error' WHEN 2 THEN CASE WHEN language = 'en' THEN 'error' ELSE 'abstained' END ELSE 'available' END AS status,
  CASE WHEN language = 'en' THEN 'grammar_runs_elsewhere' ELSE 'proofreading_english_only' END || CASE turn WHEN 1 THEN '|checker_url_refused' WHEN 2 THEN '|checker_failed|http_500' ELSE '' END AS caveats,
  CAST(coalesce(n, 0) AS INTEGER) AS n_found FROM l JOIN tu USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM fo GROUP BY 1) USING (doc_id)""",
        _FOUND,
    ),
    "checker_issues": _with_turn(
        f"""SELECT doc_id, CAST(k AS INTEGER) AS place, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", kind, severity, late FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY late, place) AS k FROM mg) WHERE k <= {C.MOST_MERGED}""",
        *_REPEATED, _FOUND, _BASE, _MERGE,
    ),
    "checker_endpoints": r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://LOCALHOST:8010' || CASE WHEN ends_with(p, '/v2/check') THEN p ELSE regexp_replace(p, '/+$', '') || '/v2/check' END || q END AS endpoint
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*(.*)$', 1) AS q FROM pages)""",
}
