"""Queries over pages, requests and proofreading, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T
from ..operators import preparation as P
from ..operators import proofreading as R
from ..sources import pages as G
from ..sources import tables
from ..streaming import governance as V
from . import sql as S
from . import text_queries as TQ
from .text_queries import prepared


def _pages(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages")


def _events(spark, sf_dir):
    return tables.table(spark, sf_dir, "events")


def page_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", G.page_title(F.col("html")).alias("title"))


def page_size_gate(spark, sf_dir):
    d = _pages(spark, sf_dir)
    return d.groupBy(G.within_size(F.col("html")).alias("accepted")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))


def url_normalize(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", G.normalized_url(F.col("url")).alias("url"))


def url_guard_ipv4(spark, sf_dir):
    """Addresses are made from ids, so that all ranges occur."""
    i = F.col("event_id")
    host = F.concat_ws(".", *[(F.floor(i * k / 7) % 256).cast("long").cast("string") for k in (1, 13, 101, 7)])
    d = _events(spark, sf_dir).select("event_id", host.alias("host"))
    return d.select("event_id", "host", G.ipv4_number(F.col("host")).alias("number"), G.is_private(F.col("host")).alias("private"))


def html_to_text(spark, sf_dir):
    d = _pages(spark, sf_dir).select("page_id", G.fragment_text(G.without_chrome(F.col("html"))).alias("text"))
    return d.select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def html_candidate_scores(spark, sf_dir):
    d = _pages(spark, sf_dir).select("page_id", G.without_chrome(F.col("html")).alias("clean"))
    return G.with_score(G.candidates(d)).select("page_id", "ord", "words", "score")


def readable_extract(spark, sf_dir):
    return G.readable(_pages(spark, sf_dir)).select("page_id", "n_chars", "words", "chosen", "confidence", F.array_join("notes", "|").alias("notes"))


def editor_markup_text(spark, sf_dir):
    d = _pages(spark, sf_dir).select("page_id", G.editor_text(F.col("html")).alias("text"))
    return d.select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def url_redaction(spark, sf_dir):
    host = G.host_of(G.normalized_url(F.col("url")))
    return _pages(spark, sf_dir).select("page_id", F.concat(host, F.lit("/…")).alias("shown"))


def proof_issues(spark, sf_dir):
    d = R.issues(P.with_language(prepared(spark, sf_dir)))
    return d.select("doc_id", "place", "rule", "start", "end", "suggestion")


def proof_merge(spark, sf_dir):
    """Basic issues with those of a second provider (here one that reports spelling at the same places)."""
    base = R.issues(P.with_language(prepared(spark, sf_dir)))
    more = base.filter("kind <> 'typography'").withColumn("rule", F.lit("5-other")).withColumn("end", F.col("end") + F.col("place") % 2)
    return R.merged(base, more).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


def text_excerpt(spark, sf_dir):
    flat = T.trimmed(F.regexp_replace("norm", r"\s+", " "))
    return prepared(spark, sf_dir).select("doc_id", F.when(F.length(flat) > 72, F.concat(F.substring(flat, 1, 72), F.lit("…"))).otherwise(flat).alias("excerpt"))


def goal_inference(spark, sf_dir):
    low = F.lower("text")
    out = F.when(F.lit(False), "")
    for goal, words in X.GOAL_WORDS:
        out = out.when(low.rlike(X.whole(words)), goal)
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return d.select("conv_id", "turn", out.alias("goal"))


def dedupe_window(spark, sf_dir):
    d = V.with_duplicates(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id")
    return d.select("event_id", "duplicate")


def rate_limit_tumbling(spark, sf_dir):
    d = V.tumbling_counts(_events(spark, sf_dir), F.col("user_id"), "ts", "1 hour", 1)
    return d.select("key", F.unix_timestamp("start").alias("start"), "n", "rejected")


def rate_limit_daily(spark, sf_dir):
    d = V.tumbling_counts(_events(spark, sf_dir), F.lit("site"), "ts", "1 day", V.PER_DAY)
    return d.select("key", F.unix_timestamp("start").alias("start"), "n", "rejected")


def input_gates(spark, sf_dir):
    size = F.octet_length(F.coalesce("text", F.lit("")))
    gate = F.when(size < 20, "too_small").when(size > 20_000, "too_large").otherwise("accepted")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(gate.alias("gate")).agg(F.count("*").alias("n"))


def input_fingerprint(spark, sf_dir):
    return prepared(spark, sf_dir).select("doc_id", F.sha2(F.concat(F.lit("salt:"), "norm"), 256).alias("fingerprint"))


def sanitize_fields(spark, sf_dir):
    plain = F.regexp_replace("text", "<[^>]*>", "")
    flat = F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"^\s+|\s+\z", "")
    slug = F.regexp_replace(F.lower("role"), "[^a-z0-9_-]", "")
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return d.select("conv_id", "turn", slug.alias("role"), F.substring(flat, 1, 160).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        page_title, page_size_gate, url_normalize, url_guard_ipv4, html_to_text, html_candidate_scores, readable_extract, editor_markup_text, url_redaction,
        proof_issues, proof_merge, text_excerpt, goal_inference, dedupe_window, rate_limit_tumbling,
        rate_limit_daily, input_gates, input_fingerprint, sanitize_fields,
    )
}


def _chain(x: str, *steps: tuple[str, str]) -> str:
    for pattern, into in steps:
        x = f"regexp_replace({x}, {S.quoted(pattern)}, {into}, 'g')"
    return x


_TRIM = (r"^\s+", "''"), (r"\s+$", "''")
_NL = "chr(10)"


def _fragment(x: str) -> str:
    out = _chain(
        x, (r"(?i)<(?:br|hr)\s*/?>", _NL), (G.BLOCK_ENDS, _NL), (r"(?i)<li[^>]*>", f"{_NL} || '- '"), (r"<[^>]+>", "' '"),
        (r"[ \t\x{00a0}]+", "' '"), (r"[ \t]*\n[ \t]*", _NL), (r"\n{3,}", f"{_NL} || {_NL}"), *_TRIM,
    )
    for name, c in G.ENTITIES:
        out = f"replace({out}, {S.quoted(name)}, {S.quoted(c)})"
    return out


_CLEAN = _chain("coalesce(html, '')", (r"(?s)<!--.*?-->", "' '"), *[(rf"(?is)<{t}\b.*?</{t}\s*>", "' '") for t in G.CHROME])
_WORDS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{M}}][\p{{L}}\p{{M}}''-]*'))"
_FOUND = " || ".join(
    [f"regexp_extract_all(clean, '(?is)<{t}\\b[^>]*>.*?</{t}>')" for t in ("article", "main")]
    + [f"regexp_extract_all(clean, {S.quoted(rf'''(?is)<{t}\b[^>]*(?:id|class|role)=["'][^"']*(?:{G.CONTENT_WORDS})[^"']*["'][^>]*>.*?</{t}>''')})" for t in ("section", "div")]
)
_CANDIDATES = f"""
cl AS (SELECT page_id, {_CLEAN} AS clean FROM pages),
ca AS (SELECT page_id, CAST(unnest(range(0, len(fs))) AS INTEGER) AS ord, unnest(fs) AS fragment FROM (SELECT page_id, {_FOUND} AS fs FROM cl)),
ct AS (SELECT *, {_fragment("fragment")} AS text, array_to_string(list_transform(regexp_extract_all(fragment, '(?is)<a\\b[^>]*>.*?</a>'), lambda a: {_fragment("a")}), ' ') AS linked FROM ca),
cw AS (SELECT *, {_WORDS.format("text")} AS words FROM ct),
cs AS (SELECT *, CAST(words + 22 * {S.hits("fragment", "(?i)</p>")} + 10 * {S.hits("fragment", r"(?i)<h[1-6]\b")} + least(40, 3 * {S.hits("fragment", r"(?i)<li\b")})
  - floor(words * (CASE WHEN length(text) > 0 THEN length(linked) / CAST(length(text) AS DOUBLE) ELSE 0.0 END) * 1.8::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS score FROM cw)"""
_URL = r"""CASE WHEN regexp_matches(u, '^[a-zA-Z][a-zA-Z\d+\-.]*://') THEN u ELSE 'https://' || u END"""
_NURL = f"nu AS (SELECT page_id, CASE WHEN u <> '' AND regexp_matches({_URL}, '(?i)^https?://[^/?#]+') THEN {_URL} END AS url FROM (SELECT page_id, {_chain('url', *_TRIM)} AS u FROM pages))"
_EDITOR = _chain(
    "coalesce(html, '')", ("(?s)<!--.*?-->", "' '"), (r"(?is)<script\b.*?</script\s*>", "' '"), (r"(?is)<style\b.*?</style\s*>", "' '"), (r"(?i)<br\s*/?>", _NL), (r"(?i)<li[^>]*>", f"{_NL} || '- '"),
    *[(rf"(?i)<h{k}[^>]*>", f"{_NL} || '{'#' * k} '") for k in range(1, 7)], (r"(?i)</(?:p|div|section|article|main|blockquote|li|ul|ol|h[1-6])>", _NL),
    (r"<[^>]+>", "' '"), (r"[ \t\x{00a0}]+", "' '"), (r"[ \t]*\n[ \t]*", _NL), (r"\n{3,}", f"{_NL} || {_NL}"), *_TRIM,
)
_PROOF = " UNION ALL ".join(
    [f"SELECT doc_id, '1-misspelling' AS rule, {i} AS i, {S.quoted(right)} AS suggestion, start, \"end\" FROM {S.span_rows('en', 'norm', rf'(?i)\b(?:{wrong})\b')}" for i, (wrong, right) in enumerate(X.MISSPELLINGS)]
    + [f"SELECT doc_id, '3-spacing', 0, ' ', start, \"end\" FROM {S.span_rows('en', 'norm', '[ \\t]{2,}')}"]
    + [f"SELECT doc_id, '4-wordy', {i}, {S.quoted(short)}, start, \"end\" FROM {S.span_rows('en', 'norm', rf'(?i)\b(?:{p})\b')}" for i, (p, short) in enumerate(X.WORDY)]
)
_GUARD = " OR ".join(f"number BETWEEN {a} AND {b}" for a, b in (G._range(n, k) for n, k in G.PRIVATE))

ORACLE = {
    "page_title": f"SELECT page_id, CASE WHEN x <> '' THEN {_fragment('x')} END AS title FROM (SELECT page_id, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1) AS x FROM pages)",
    "page_size_gate": f"SELECT strlen(html) <= {G.MOST_BYTES} AS accepted, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1",
    "url_normalize": f"WITH {_NURL} SELECT * FROM nu",
    "url_redaction": f"WITH {_NURL} SELECT page_id, regexp_replace(lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\\.$', '') || '/…' AS shown FROM nu",
    "url_guard_ipv4": f"WITH o AS (SELECT event_id, {', '.join(f'CAST(floor(event_id * {k} / 7.0::DOUBLE) AS BIGINT) % 256 AS o{k}' for k in (1, 13, 101, 7))} FROM events), n AS (SELECT event_id, concat_ws('.', o1, o13, o101, o7) AS host, ((o1 * 256 + o13) * 256 + o101) * 256 + o7 AS number FROM o) SELECT *, ({_GUARD}) AS private FROM n",
    "html_to_text": f"SELECT page_id, length(x) AS n_chars, md5(x) AS digest FROM (SELECT page_id, {_fragment(_CLEAN)} AS x FROM pages)",
    "html_candidate_scores": f"WITH {_CANDIDATES} SELECT page_id, ord, words, score FROM cs",
    "readable_extract": f"""WITH {_CANDIDATES},
be AS (SELECT page_id, score, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS k FROM cs WHERE words >= 25) WHERE k = 1),
fu AS (SELECT page_id, {_fragment("clean")} AS f FROM cl),
ch AS (SELECT page_id, coalesce(score >= greatest(60.0::DOUBLE, {_WORDS.format("f")} * 0.18::DOUBLE), false) AS chosen, score IS NOT NULL AS found, text, f FROM fu LEFT JOIN be USING (page_id)),
tx AS (SELECT page_id, chosen, found, CASE WHEN chosen THEN text ELSE f END AS x FROM ch), tw AS (SELECT *, {_WORDS.format("x")} AS words FROM tx)
SELECT page_id, length(x) AS n_chars, words, chosen, CAST(CASE WHEN words >= 180 THEN 0.86 WHEN words >= 80 THEN 0.68 WHEN words >= 30 THEN 0.42 ELSE 0.18 END AS DOUBLE) AS confidence,
  concat_ws('|', CASE WHEN chosen THEN 'container_chosen' WHEN found THEN 'whole_page_after_scoring' END, CASE WHEN words < 80 THEN 'little_text' END) AS notes FROM tw""",
    "editor_markup_text": f"SELECT page_id, length(x) AS n_chars, md5(x) AS digest FROM (SELECT page_id, {_EDITOR} AS x FROM pages)",
    "proof_issues": S.with_language(
        f"""SELECT doc_id, CAST(k AS INTEGER) AS place, rule, start, "end", suggestion FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule, i, start) AS k FROM ({_PROOF} UNION ALL
  SELECT doc_id, '2-repeated', 0, '', start, "end" FROM rp)) WHERE k <= {R.MOST_ISSUES}""",
        "en AS (SELECT * FROM l WHERE language = 'en')",
        f"""wo AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS w, lead(text) OVER z AS nt, lead(start) OVER z AS ns, lead("end") OVER z AS ne
  FROM {S.span_rows("en", "norm", r"[\p{L}\p{M}_0-9]+")} WINDOW z AS (PARTITION BY doc_id ORDER BY ord))""",
        """pr AS (SELECT wo.doc_id, wo.ord, wo.start, ne AS "end" FROM wo JOIN en USING (doc_id) WHERE lower(wo.text) = lower(nt) AND length(wo.text) >= 3
  AND NOT regexp_matches(wo.text, '[_0-9]') AND regexp_matches(substring(norm, wo."end" + 1, ns - wo."end"), '^\\s+$'))""",
        """ru AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM pr)""",
        """rp AS (SELECT doc_id, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY ord) AS z FROM ru) WHERE z % 2 = 1)""",
    ),
    "text_excerpt": S.with_prepared(f"SELECT doc_id, CASE WHEN length(f) > 72 THEN substring(f, 1, 72) || '…' ELSE f END AS excerpt FROM (SELECT doc_id, {_chain('norm', (chr(92) + 's+', chr(39) + ' ' + chr(39)), *_TRIM)} AS f FROM d)"),
    "goal_inference": "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '\\b(?:{w})\\b') THEN '{g}'" for g, w in X.GOAL_WORDS) + " END AS goal FROM conversations",
    "dedupe_window": f"SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) <= {V.DUPLICATE_SECONDS * 1_000_000}, false) AS duplicate FROM events",
    "rate_limit_tumbling": "SELECT user_id AS key, epoch_us(ts) // 3600000000 * 3600 AS start, count(*) AS n, greatest(0, count(*) - 1) AS rejected FROM events GROUP BY 1, 2",
    "rate_limit_daily": f"SELECT 'site' AS key, epoch_us(ts) // 86400000000 * 86400 AS start, count(*) AS n, greatest(0, count(*) - {V.PER_DAY}) AS rejected FROM events GROUP BY 1, 2",
    "input_gates": "SELECT CASE WHEN strlen(coalesce(text, '')) < 20 THEN 'too_small' WHEN strlen(coalesce(text, '')) > 20000 THEN 'too_large' ELSE 'accepted' END AS gate, count(*) AS n FROM documents GROUP BY 1",
    "input_fingerprint": S.with_prepared("SELECT doc_id, sha256('salt:' || norm) AS fingerprint FROM d"),
    "sanitize_fields": f"SELECT conv_id, turn, regexp_replace(lower(role), '[^a-z0-9_-]', '', 'g') AS role, substring({_chain('text', ('<[^>]*>', chr(39) * 2), (r'\s+', chr(39) + ' ' + chr(39)), *_TRIM)}, 1, 160) AS text FROM conversations",
}
ORACLE["proof_merge"] = f"""WITH ba AS MATERIALIZED (SELECT * FROM ({ORACLE["proof_issues"]})),
mo AS (SELECT doc_id, '5-other' AS rule, start, "end" + 1 AS "end", 1 AS late, place FROM ba b WHERE rule IN ('1-misspelling', '4-wordy') AND place % 2 = 1
  AND NOT EXISTS (SELECT 1 FROM ba c WHERE c.doc_id = b.doc_id AND c.start = b.start AND c."end" = b."end" + 1))
SELECT doc_id, rule, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY late, place) AS k FROM (SELECT doc_id, rule, start, "end", 0 AS late, place FROM ba UNION ALL SELECT * FROM mo)) WHERE k <= {R.MOST_ISSUES} GROUP BY ALL"""
