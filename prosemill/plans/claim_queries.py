"""Queries over claims and their sources, each with its SQL, which states the rules a second time in DuckDB's own terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..operators import claims as C
from . import sql as S
from .text_queries import prepared


def _rows(spark, sf_dir):
    return C.claims(prepared(spark, sf_dir))


def sources_given(spark, sf_dir, docs):
    """Sources of a document: two benchmark items, of every fourth document its own beginning, of every fifth a bare address."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n = items.count()
    null = F.lit(None).cast("string")
    parts = []
    for ord_, which in ((0, F.pmod("doc_id", F.lit(n))), (1, F.pmod(F.col("doc_id") * 7 + 3, F.lit(n)))):
        d = docs.filter("doc_id % 3 <> 1").select("doc_id", which.alias("item_id")).join(F.broadcast(items), "item_id")
        parts.append(d.select("doc_id", F.lit(ord_).alias("source_ord"), F.col("item_id").cast("string").alias("id"), "text", null.alias("title"), null.alias("url"), null.alias("citation")))
    own = docs.filter("doc_id % 4 = 0").select("doc_id", F.lit(2).alias("source_ord"), null.alias("id"), F.substring("norm", 1, 600).alias("text"), F.lit("own").alias("title"), null.alias("url"), null.alias("citation"))
    bare = docs.filter("doc_id % 5 = 0").select("doc_id", F.lit(3).alias("source_ord"), null.alias("id"), F.lit("https://example.org/a").alias("text"), null.alias("title"), null.alias("url"), null.alias("citation"))
    return C.normalized_sources(parts[0].unionByName(parts[1]).unionByName(own).unionByName(bare))


def statuses(spark, sf_dir):
    d = prepared(spark, sf_dir)
    return C.claim_status(C.claims(d), sources_given(spark, sf_dir, d))


def claim_rows(spark, sf_dir):
    d = _rows(spark, sf_dir)
    return d.select("doc_id", "place", "ord", "type", "stale", "importance", *[F.size(x).alias(f"n_{x}") for x in ("names", "numbers", "dates", "keywords")])


def claim_candidates(spark, sf_dir):
    """How many sentences of each document may be claims, without the limit."""
    return C.claims(prepared(spark, sf_dir), 1 << 30).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


def claim_types(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


def claim_entities(spark, sf_dir):
    d = _rows(spark, sf_dir)
    return d.select("doc_id", "place", *[F.array_join(x, "|").alias(x) for x in ("names", "numbers", "dates")])


def claim_keywords(spark, sf_dir):
    d = _rows(spark, sf_dir).select("doc_id", "place", F.explode("keywords").alias("keyword"))
    return d.groupBy("keyword").agg(F.count("*").alias("n"))


def freshness_risk(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", "place", "stale", "importance")


def inline_evidence(spark, sf_dir):
    """References in or behind each claim; the texts have none, so some are put in."""
    d = prepared(spark, sf_dir, F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"\. ([A-Z])", " [12]. See https://example.org/$1 and doi:10.1234/x.y1. $1")))
    return C.claims(d).select("doc_id", "place", F.array_join("inline", " ").alias("inline"), F.length("plain").alias("n_plain"))


def source_normalize(spark, sf_dir):
    d = sources_given(spark, sf_dir, prepared(spark, sf_dir))
    return d.select("doc_id", "source_ord", "label", F.md5("body").alias("digest"))


def claim_source_matches(spark, sf_dir):
    d = prepared(spark, sf_dir)
    return C.source_matches(C.with_matches(C.claims(d), sources_given(spark, sf_dir, d)))


def claim_status(spark, sf_dir):
    return statuses(spark, sf_dir).select("doc_id", "place", "overlap", "status", "need")


def claim_support_need(spark, sf_dir):
    return statuses(spark, sf_dir).groupBy("status", "importance", "need", "action", "note").agg(F.count("*").alias("n"))


def claim_gaps(spark, sf_dir):
    return statuses(spark, sf_dir).select("doc_id", "place", F.array_join("gaps", "|").alias("gaps"))


def claim_evidence(spark, sf_dir):
    return statuses(spark, sf_dir).select("doc_id", "place", F.array_join("evidence", "|").alias("evidence"), "support_coverage", "action", "note")


def claim_locations(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", "place", "paragraph", "section")


def claim_spans(spark, sf_dir):
    """Where claims that need attention stand: unsupported, cited only inline, or likely stale."""
    return spans(statuses(spark, sf_dir))


def spans(found):
    label = F.when(F.col("status").isin("unsupported", "inline_citation_only"), F.col("status")).when(F.col("stale"), "freshness_risk")
    d = found.withColumn("label", label).filter("label is not null")
    return d.select("doc_id", "start", "end", "label", F.when(F.col("label") == "unsupported", "medium").otherwise("low").alias("severity"))


def claim_review(spark, sf_dir):
    return C.claim_review(statuses(spark, sf_dir)).withColumn("caveats", F.array_join("caveats", "|"))


def source_band(spark, sf_dir):
    return C.claim_review(statuses(spark, sf_dir)).groupBy("source_band").agg(F.count("*").alias("n"))


def csv_rows(found):
    """The 18 columns of the claims file, as text; lists are joined by semicolons."""
    lists = {n: F.array_join(c, "; ") for n, c in (("entities", "names"), ("numbers", "numbers"), ("dates", "dates"), ("inlineCitations", "inline"), ("supportGaps", "gaps"), ("evidence", "evidence"))}
    plain = {
        "id": F.concat(F.lit("claim-"), F.col("place").cast("string")), "status": F.col("status"), "type": F.col("type"), "importance": F.col("importance"), "supportNeed": F.col("need"),
        "freshnessRisk": F.col("stale").cast("string"), "supportCoverage": F.format_string("%.2f", "support_coverage"), "sentenceIndex": F.col("ord").cast("string"),
        "paragraphIndex": F.coalesce(F.col("paragraph").cast("string"), F.lit("")), "recommendedAction": F.col("action"), "claim": F.col("claim"), "notes": F.col("note"),
    }
    return found.select("doc_id", *[(plain.get(n) if n in plain else lists[n]).alias(n) for n in CSV_COLUMNS])


# The columns of the claims file in order.
CSV_COLUMNS = (
    "id", "status", "type", "importance", "supportNeed", "freshnessRisk", "supportCoverage", "sentenceIndex", "paragraphIndex", "entities", "numbers", "dates", "inlineCitations",
    "supportGaps", "recommendedAction", "claim", "evidence", "notes",
)


def claims_csv(spark, sf_dir):
    return csv_rows(statuses(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        claim_rows, claim_candidates, claim_types, claim_entities, claim_keywords, freshness_risk, inline_evidence, source_normalize, claim_source_matches, claim_status, claim_support_need,
        claim_gaps, claim_evidence, claim_locations, claim_spans, claim_review, source_band, claims_csv,
    )
}

_INLINE = r"(?i)\bhttps?://[^\s<>)\]]+|\[(?:\d+|[A-Z][A-Za-z0-9_-]{1,20})\]|\bdoi:\s*10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
_LOCATOR = r"^(?:(?i:https?)://\S+|(?i:(?:doi:\s*)?10\.\d{4,9}/[-._;()/:A-Z0-9]+)|\[(?:\d+|[A-Z][A-Za-z0-9_-]{1,20})\])?$"
_DATE = rf"(?i)\b(?:{X.YEAR}|today|currently|as of|latest|newest|now)\b"


def _trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def _ordered(xs: str) -> str:
    """Distinct in order of first occurrence, eight at most."""
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)[1:8]"


def _names(x: str) -> str:
    found = f"regexp_extract_all({x}, '{S.NAME_SQL}')"
    opener = f"(i = 1 AND regexp_matches({x}, '^[A-Z]') AND n IN ({', '.join(map(S.quoted, X.OPENERS))}))"
    return f"list_filter({found}, lambda n, i: NOT {opener} AND NOT regexp_matches(n, '^(?:{X.ROLE_NOUNS})$'))"


def _marked(x: str) -> str:
    """With a mark on either side of all that is no letter or digit, so that a value's edges can be found without a pattern of its own."""
    return rf"chr(1) || regexp_replace({x}, '([^\p{{L}}\p{{M}}\d])', chr(1) || '\1' || chr(1), 'g') || chr(1)"


def _has(marked: str, value: str) -> str:
    return f"contains({marked}, {_marked(f'lower({value})')})"


_SENTENCES = rf"""
gaps AS (SELECT doc_id, i, gs[i] AS g, CAST(sum(length(gs[i]) + coalesce(length(ms[i]), 0)) OVER (PARTITION BY doc_id ORDER BY i) - length(gs[i]) - coalesce(length(ms[i]), 0) AS INTEGER) AS pos
  FROM (SELECT doc_id, unnest(range(1, len(gs) + 1)) AS i, gs, ms FROM (SELECT doc_id, string_split_regex(norm, '\n{{2,}}') AS gs, regexp_extract_all(norm, '\n{{2,}}') AS ms FROM t))),
pg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para, {_trim("g")} AS body, pos + length(g) - length(regexp_replace(g, '^\s+', '')) AS ps,
  pos + length(g) - length(regexp_replace(g, '^\s+', '')) + length({_trim("g")}) AS pe FROM gaps WHERE {_trim("g")} <> ''),
ph AS (SELECT *, sum(CASE WHEN regexp_matches(string_split(body, chr(10))[1], '^#{{1,6}}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY para) AS heads,
  sum(CASE WHEN regexp_matches(string_split(body, chr(10))[1], '^#{{1,6}}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS all_heads FROM pg),
se AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS ord, start, "end" AS fin, {_trim("text")} AS claim
  FROM {S.span_rows("t", "norm", r"[^.!?\n]+(?:[.!?]+|$)")} WHERE regexp_matches(text, '[\p{{L}}\p{{M}}]')),
sp AS (SELECT se.*, min(a.para) AS paragraph, min(b.para) AS behind FROM se LEFT JOIN ph a ON a.doc_id = se.doc_id AND se.start BETWEEN a.ps AND a.pe
  LEFT JOIN ph b ON b.doc_id = se.doc_id AND se.fin BETWEEN b.ps AND b.pe GROUP BY ALL),
sq AS (SELECT sp.*, a.body, a.heads, a.all_heads, b.pe, t.norm, {_names("claim")} AS nm, {_trim(r"regexp_replace(claim, '^\s*(?:[-*]|\d+[.)])\s+', '')")} AS step
  FROM sp JOIN t ON t.doc_id = sp.doc_id LEFT JOIN ph a ON a.doc_id = sp.doc_id AND a.para = paragraph LEFT JOIN ph b ON b.doc_id = sp.doc_id AND b.para = behind),
cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS nth FROM sq WHERE NOT ends_with(claim, '?')
  AND (regexp_matches(claim, '{S.NUMBER_SQL}') OR (regexp_matches(lower(claim), '\b(?:{X.CLAIM_VERBS})\b') AND (length(claim) >= 22 OR len(nm) > 0)) OR (length(claim) >= 35 AND len(nm) > 0))
  AND NOT (coalesce(regexp_matches(body, '^(?:[-*+]|\d+\.|#{{1,6}})\s+\S'), false) AND regexp_matches(step, '(?i)^(?:{X.STEP_VERBS})\b') AND NOT regexp_matches(step, '{S.NUMBER_SQL}') AND len(list_distinct({_names("step")})) <= 1))"""
_TYPE = "CASE " + " ".join(rf"WHEN regexp_matches(lower(claim), '\b(?:{w})\b') THEN '{k}'" for k, w in X.CLAIM_TYPES) + rf" WHEN regexp_matches(lower(claim), '\b(?:{X.ABSOLUTES})\b') AND NOT regexp_matches(claim, '\d') THEN 'unverifiable' ELSE 'factual' END"
_KEYWORDS = r"list_filter(regexp_extract_all(lower(plain), '[\p{L}\p{M}][\p{L}\p{M}''-]*'), lambda w: length(w) >= 5 AND w NOT IN (" + ", ".join(map(S.quoted, X.CLAIM_STOP_WORDS)) + "))"
_CLAIMS = rf"""
k1 AS (SELECT doc_id, CAST(nth AS INTEGER) AS place, ord, start, fin, claim, CAST(paragraph AS INTEGER) AS paragraph, CAST(CASE WHEN all_heads = 0 THEN 1 WHEN heads > 0 THEN heads END AS INTEGER) AS section,
  list_concat(regexp_extract_all(claim, {S.quoted(_INLINE)}), regexp_extract_all(substring(norm, fin + 1, greatest(0, least(coalesce(pe, length(norm)), fin + {C.NEAR}) - fin)), {S.quoted(_INLINE)})) AS inl,
  {_trim(rf"regexp_replace(regexp_replace(claim, {S.quoted(_INLINE)}, ' ', 'g'), '\s+', ' ', 'g')")} AS plain, {_TYPE} AS type FROM cand WHERE nth <= {C.MOST_CLAIMS}),
k2 AS MATERIALIZED (SELECT *, list_filter(inl, lambda x, i: list_position(inl, x) = i) AS inline, {_ordered(_names("plain"))} AS names, {_ordered(f"regexp_extract_all(plain, '{S.NUMBER_SQL}')")} AS numbers,
  {_ordered(f"regexp_extract_all(plain, '{_DATE}')")} AS dates, {_KEYWORDS} AS kw0, regexp_matches(plain, '(?i)\b(?:{X.STALE})\b') OR regexp_matches(plain, '\b20\d{{2}}\b') AS stale FROM k1),
c AS (SELECT *, list_filter(kw0, lambda x, i: list_position(kw0, x) = i) AS keywords, CASE WHEN stale OR regexp_matches(plain, '(?i)\b(?:{X.SENSITIVE})\b') THEN 'high'
  WHEN type = 'factual' AND (len(numbers) > 0 OR len(names) > 1) THEN 'medium' ELSE 'low' END AS importance FROM k2)"""
_SOURCES = rf"""
given AS (SELECT doc_id, 0 AS source_ord, CAST(item_id AS VARCHAR) AS name, b.text AS x FROM t JOIN benchmark b ON item_id = doc_id % (SELECT count(*) FROM benchmark) WHERE doc_id % 3 <> 1
  UNION ALL SELECT doc_id, 1, CAST(item_id AS VARCHAR), b.text FROM t JOIN benchmark b ON item_id = (doc_id * 7 + 3) % (SELECT count(*) FROM benchmark) WHERE doc_id % 3 <> 1
  UNION ALL SELECT doc_id, 2, 'own', substring(norm, 1, 600) FROM t WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 3, NULL, 'https://example.org/a' FROM t WHERE doc_id % 5 = 0),
src AS (SELECT doc_id, source_ord, coalesce(name, CASE WHEN regexp_matches({_trim("x")}, {S.quoted(_LOCATOR)}) AND {_trim("x")} <> '' THEN {_trim("x")} END, 'source-' || (source_ord + 1)) AS label,
  CASE WHEN regexp_matches({_trim("x")}, {S.quoted(_LOCATOR)}) THEN '' ELSE lower({_trim("x")}) END AS body FROM given)"""
_NEG = rf"(?i)\b(?:{X.NEGATIONS})\b".replace("'", "''")
_MATCH = rf"""
den AS MATERIALIZED (SELECT *, list_filter(string_split_regex(regexp_replace(body, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda seg: regexp_matches(seg, '{_NEG}')) AS denied, {_marked("body")} AS body_marked FROM src WHERE body <> ''),
y AS (SELECT *, list_filter(dates, lambda d: regexp_matches(d, '\b{X.YEAR}\b')) AS years, least(5, greatest(least(3, len(keywords)), CAST(ceil(len(keywords) * 0.45::DOUBLE) AS INTEGER))) AS needed FROM c),
z AS (SELECT *, CASE WHEN len(numbers) > 0 THEN numbers WHEN len(years) > 0 THEN years ELSE keywords[1:6] END AS anchors, regexp_matches(plain, '{_NEG}') AS negated FROM y),
m0 AS MATERIALIZED (SELECT z.doc_id, z.place, source_ord, label, needed, len(keywords) AS kn, CAST(len(list_filter(keywords, lambda w: {_has("body_marked", "w")})) AS INTEGER) AS overlap,
  list_filter(numbers, lambda v: NOT ({_has("body_marked", "v")})) AS no_numbers, list_filter(years, lambda v: NOT ({_has("body_marked", "v")})) AS no_years, list_filter(names, lambda v: NOT ({_has("body_marked", "v")})) AS no_names,
  negated <> (len(list_filter(denied, lambda seg: len(list_filter(anchors, lambda a: {_has(_marked("seg"), "a")})) > 0)) > 0) AS conflict
  FROM z JOIN den ON den.doc_id = z.doc_id),
m1 AS (SELECT *, overlap / CAST(kn AS DOUBLE) AS coverage, len(no_numbers) + len(no_years) + len(no_names) = 0 AND NOT conflict AS agrees FROM m0 WHERE overlap > 0),
mt AS (SELECT *, agrees AND ((coverage >= 0.92 AND overlap >= least(needed, 2)) OR (overlap >= needed AND coverage >= 0.38)) AS strong,
  CAST(row_number() OVER (PARTITION BY doc_id, place ORDER BY coverage DESC, agrees DESC, source_ord) - 1 AS INTEGER) AS rank FROM m1),
counts AS (SELECT doc_id, count(*) AS n_given, count(*) FILTER (body <> '') AS n_sources FROM src GROUP BY 1),
ev AS (SELECT doc_id, place, list(label ORDER BY rank) FILTER (strong) AS strong_labels, list(label ORDER BY rank) FILTER (rank < 2) AS first_labels FROM mt GROUP BY ALL),
s0 AS (SELECT y.*, coalesce(n_given, 0) AS n_given, coalesce(n_sources, 0) AS n_sources, coalesce(overlap, 0) AS overlap, coalesce(coverage, 0.0) AS coverage, coalesce(strong, false) AS strong,
  no_numbers, no_years, no_names, conflict, rank IS NOT NULL AS matched, strong_labels, first_labels
  FROM y LEFT JOIN counts ON counts.doc_id = y.doc_id LEFT JOIN mt ON mt.doc_id = y.doc_id AND mt.place = y.place AND rank = 0 LEFT JOIN ev ON ev.doc_id = y.doc_id AND ev.place = y.place),
s1 AS (SELECT *, CASE WHEN type <> 'factual' THEN 'not_checked' WHEN coverage >= 0.48 AND strong THEN 'supported' WHEN overlap >= 2 AND coverage >= 0.25 THEN 'partially_supported'
  WHEN len(inline) > 0 AND n_sources = 0 THEN 'inline_citation_only' WHEN n_sources > 0 THEN 'unsupported' ELSE 'not_checked' END AS status FROM s0),
s2 AS (SELECT *, CASE WHEN type <> 'factual' OR status = 'supported' THEN 'none' WHEN stale OR importance = 'high' THEN 'essential'
  WHEN status = 'unsupported' THEN CASE WHEN n_sources > 0 THEN 'essential' ELSE 'important' END WHEN status = 'inline_citation_only' THEN 'important'
  WHEN status = 'partially_supported' OR importance = 'medium' THEN 'recommended' ELSE 'none' END AS need,
  CASE WHEN len(strong_labels) > 0 THEN strong_labels WHEN status = 'partially_supported' THEN first_labels ELSE [] END AS evidence,
  list_filter([CASE WHEN n_sources = 0 AND status = 'not_checked' THEN CASE WHEN n_given > 0 THEN 'sources_without_text' ELSE 'no_sources' END END,
    CASE status WHEN 'unsupported' THEN 'no_match' WHEN 'partially_supported' THEN 'partial_overlap' END,
    CASE WHEN len(no_numbers) > 0 THEN 'number_mismatch:' || array_to_string(no_numbers[1:3], ',') END, CASE WHEN len(no_years) > 0 THEN 'date_mismatch:' || array_to_string(no_years[1:3], ',') END,
    CASE WHEN len(no_names) > 0 THEN 'name_missing:' || array_to_string(no_names[1:3], ',') END, CASE WHEN conflict THEN 'negation_mismatch' END,
    CASE WHEN status = 'inline_citation_only' THEN 'citation_unchecked' WHEN len(inline) > 0 AND status <> 'supported' THEN 'citation_not_enough' END,
    CASE WHEN len(numbers) > 0 AND status <> 'supported' THEN 'number_needs_support:' || array_to_string(numbers[1:3], ',') END,
    CASE WHEN (stale OR len(dates) > 0) AND status <> 'supported' THEN 'time_sensitive' END,
    CASE WHEN len(names) > 1 AND status <> 'supported' THEN 'names_need_support:' || array_to_string(names[1:3], ',') END,
    CASE WHEN matched AND status = 'partially_supported' THEN 'coverage:' || CAST(floor(coverage * 100 + 0.5::DOUBLE) AS INTEGER) END], lambda g: g IS NOT NULL)[1:5] AS gaps FROM s1),
sc AS (SELECT *, floor(coverage * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS support_coverage, CASE WHEN status = 'supported' THEN CASE WHEN stale THEN 'keep_and_recheck' ELSE 'keep_visible' END WHEN status = 'partially_supported' THEN 'tighten_wording'
  WHEN status = 'inline_citation_only' THEN 'provide_cited_material' WHEN status = 'unsupported' THEN CASE WHEN need = 'essential' THEN 'support_or_qualify' ELSE 'support_qualify_or_remove' END
  WHEN stale OR len(gaps) > 0 THEN 'check_current_material' ELSE 'review_need' END AS action, CASE WHEN status <> 'not_checked' THEN status WHEN stale THEN 'may_be_stale' ELSE 'not_checked' END AS note FROM s2)"""
CLAIMS = (_SENTENCES, _CLAIMS)
STATUS = (*CLAIMS, _SOURCES, _MATCH)
REVIEW = r"""rv AS (SELECT *, CASE WHEN factual = 0 OR n_given = 0 OR supported + partial + unsupported = 0 THEN 'not_checked' WHEN unsupported + partial + inline_only = 0 THEN 'supported'
  WHEN supported + partial + inline_only > 0 THEN 'mixed' ELSE 'weakly_supported' END AS source_band,
  array_to_string(list_filter([CASE WHEN n_sources = 0 AND factual > 0 THEN CASE WHEN n_given > 0 THEN 'sources_without_text' ELSE 'no_sources' END END, CASE WHEN inline_only > 0 THEN 'citations_are_no_proof' END,
    CASE WHEN conflicts > 0 THEN 'conflicts_are_partial' END], lambda x: x IS NOT NULL), '|') AS caveats
  FROM (SELECT doc_id, count(*) AS claims, count(*) FILTER (type = 'factual') AS factual, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'partially_supported') AS partial,
  count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (status = 'inline_citation_only') AS inline_only, count(*) FILTER (type = 'factual' AND status = 'not_checked') AS not_checked, count(*) FILTER (stale) AS stale,
  count(*) FILTER (need = 'essential') AS essential, count(*) FILTER (len(list_filter(gaps, lambda g: regexp_matches(g, '^(?:number_mismatch|date_mismatch|negation_mismatch)'))) > 0) AS conflicts,
  max(n_sources) AS n_sources, max(n_given) AS n_given FROM sc GROUP BY doc_id))"""


def _claims(select: str) -> str:
    return S.with_prepared(select, *CLAIMS)


def _status(select: str, *more: str) -> str:
    return S.with_prepared(select, *STATUS, *more)


_LISTS = {"entities": "names", "numbers": "numbers", "dates": "dates", "inlineCitations": "inline", "supportGaps": "gaps", "evidence": "evidence"}
_CELLS = {
    "id": "'claim-' || place", "supportNeed": "need", "freshnessRisk": "CAST(stale AS VARCHAR)", "supportCoverage": "printf('%.2f', support_coverage)", "sentenceIndex": "CAST(ord AS VARCHAR)",
    "paragraphIndex": "coalesce(CAST(paragraph AS VARCHAR), '')", "recommendedAction": "action", "notes": "note",
}

ORACLE = {
    "claim_rows": _claims("SELECT doc_id, place, ord, type, stale, importance, len(names) AS n_names, len(numbers) AS n_numbers, len(dates) AS n_dates, len(keywords) AS n_keywords FROM c"),
    "claim_candidates": S.with_prepared("SELECT doc_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts FROM cand GROUP BY 1", _SENTENCES),
    "claim_types": _claims("SELECT type, count(*) AS n FROM c GROUP BY 1"),
    "claim_entities": _claims("SELECT doc_id, place, array_to_string(names, '|') AS names, array_to_string(numbers, '|') AS numbers, array_to_string(dates, '|') AS dates FROM c"),
    "claim_keywords": _claims("SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM c) GROUP BY 1"),
    "freshness_risk": _claims("SELECT doc_id, place, stale, importance FROM c"),
    "inline_evidence": _claims("SELECT doc_id, place, array_to_string(inline, ' ') AS inline, length(plain) AS n_plain FROM c").replace(
        "FROM documents)", r"FROM (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '\. ([A-Z])', ' [12]. See https://example.org/\1 and doi:10.1234/x.y1. \1', 'g') END AS text) FROM documents))"
    ),
    "source_normalize": S.with_prepared("SELECT doc_id, source_ord, label, md5(body) AS digest FROM src", _SOURCES),
    "claim_source_matches": _status("SELECT doc_id, place, rank, source_ord, label, overlap, needed, coverage, agrees, strong FROM mt"),
    "claim_status": _status("SELECT doc_id, place, overlap, status, need FROM sc"),
    "claim_support_need": _status("SELECT status, importance, need, action, note, count(*) AS n FROM sc GROUP BY ALL"),
    "claim_gaps": _status("SELECT doc_id, place, array_to_string(gaps, '|') AS gaps FROM sc"),
    "claim_evidence": _status("SELECT doc_id, place, array_to_string(evidence, '|') AS evidence, support_coverage, action, note FROM sc"),
    "claim_locations": _claims("SELECT doc_id, place, paragraph, section FROM c"),
    "claim_spans": _status("SELECT doc_id, start, fin AS \"end\", CASE WHEN status IN ('unsupported', 'inline_citation_only') THEN status ELSE 'freshness_risk' END AS label, CASE WHEN status = 'unsupported' THEN 'medium' ELSE 'low' END AS severity FROM sc WHERE status IN ('unsupported', 'inline_citation_only') OR stale"),
    "claim_review": _status("SELECT * FROM rv", REVIEW),
    "source_band": _status("SELECT source_band, count(*) AS n FROM rv GROUP BY 1", REVIEW),
    "claims_csv": _status("SELECT doc_id, " + ", ".join(f"array_to_string({_LISTS[n]}, '; ') AS {n}" if n in _LISTS else f"{_CELLS.get(n, n)} AS {n}" for n in CSV_COLUMNS) + " FROM sc"),
}
