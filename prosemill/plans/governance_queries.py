"""Queries over page gates, sanitisers, redaction, hashes and report statuses, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as K
from ..sources import pages as G
from ..sources import store, tables
from ..streaming import governance as V
from . import sql as S


def _events(spark, sf_dir):
    return tables.table(spark, sf_dir, "events")


def url_guard_ipv6(spark, sf_dir):
    """Addresses are made from ids, so that all ranges occur; every third is compressed, every fifth ends in a dotted IPv4 address."""
    i = F.col("event_id")
    first = F.get(F.array(*[F.lit(x) for x in FIRST]), F.pmod(i, F.lit(len(FIRST))).cast("int"))
    second = F.pmod(F.floor(i / 3), F.lit(40))
    last = F.pmod(i * 7, F.lit(65536))
    hexed = lambda x: F.lower(F.hex(x.cast("long")))
    long_form = F.concat_ws(":", hexed(first), hexed(second), *[F.lit("0")] * 5, hexed(last))
    short = F.concat(hexed(first), F.lit(":"), hexed(second), F.lit("::"), hexed(last))
    mapped = F.concat(F.lit("[::ffff:"), F.pmod(i, F.lit(256)).cast("string"), F.lit("."), F.pmod(i * 3, F.lit(256)).cast("string"), F.lit(".1.9]"))
    host = F.when(i % 5 == 0, mapped).when(i % 3 == 0, short).otherwise(long_form)
    d = _events(spark, sf_dir).select("event_id", host.alias("host"))
    return d.select("event_id", "host", G.is_private(F.col("host")).alias("private"))


FIRST = (0x0100, 0xFC01, 0xFE80, 0xFEC0, 0xFF02, 0x2002, 0x2001, 0x2606, 0xFD00, 0x0000)


def _gated(spark, sf_dir):
    """Pages with what a fetch would say of them, made from their ids."""
    i = F.col("page_id")
    kinds = F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "text/plain", "image/png", "application/xhtml+xml")])
    hops = F.when(i % 11 == 0, F.array(F.lit("http://10.0.0.8/x"))).when(i % 7 == 0, F.array_repeat(F.lit("https://example.org/a"), 6)).when(i % 13 == 0, F.array(F.lit("ftp://example.org")))
    ips = F.when(i % 9 == 0, F.array(F.lit("127.0.0.1"))).when(i % 10 == 0, F.array(F.lit("93.184.216.34"), F.lit("::1"))).otherwise(F.array(F.lit("93.184.216.34")))
    return tables.table(spark, sf_dir, "pages").withColumns({"content_type": F.get(kinds, F.pmod(i, F.lit(4)).cast("int")), "redirects": hops, "addresses": ips})


def page_gates(spark, sf_dir):
    d = _gated(spark, sf_dir)
    return d.select("page_id", G.gate(F.col("url"), F.col("redirects"), F.col("addresses"), F.col("content_type"), F.col("html")).alias("gate"))


def page_bodies(spark, sf_dir):
    """Plain pages pass as they are, others as text."""
    d = _gated(spark, sf_dir)
    body = F.when(G.is_plain(F.col("content_type")), F.regexp_replace("html", r"^\s+|\s+\z", "")).otherwise(G.fragment_text(G.without_chrome(F.col("html"))))
    return d.select("page_id", F.md5(body).alias("digest"))


def entity_decode(spark, sf_dir):
    """Pages with their references and some of every kind after them: odd cases, lengths, zero, the last code point and beyond."""
    pages = tables.table(spark, sf_dir, "pages")
    n = F.length("html")
    extra = F.concat(F.lit(REFERENCES), n.cast("string"), F.lit("; &amp;lt; &#x"), F.hex(n.cast("long")), F.lit(";"))
    return pages.select("page_id", F.md5(G.decoded(F.concat("html", extra))).alias("digest"))


REFERENCES = "&AMP; &Nbsp;&qUot; &#0; &bogus; &#00000065; &#x1F600; &#X10ffff; &#x110000; &#99999999; &#xD800; &#"


def renewing_limit(spark, sf_dir):
    """Which events of a user are accepted under three at most, a day after the last of which the count lapses."""
    return V.renewing_decisions(_events(spark, sf_dir), "user_id", "ts", "event_id", limit=3, seconds=86_400).select("event_id", "accepted")


def field_sanitizers(spark, sf_dir):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return _events(spark, sf_dir).select(
        "event_id", K.one_of(F.upper("event_type"), ("click", "error", "view"), "other").alias("kind"), K.number(raw, 1.0, 0.0, 100.0).alias("value"),
        K.truth(F.when(i % 3 == 0, " Yes ").when(i % 3 == 1, "0")).alias("flag"), F.array_join(K.key_list(F.split(F.concat_ws("|", F.lit("A b!"), "event_type", F.lit("")), r"\|"), 2), ",").alias("keys"),
    )


def list_caps(spark, sf_dir):
    """Words as a list of metrics, cut as a stored report cuts them."""
    d = tables.table(spark, sf_dir, "documents")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return d.select("doc_id", F.size(K.capped(words, "metrics")).alias("n_metrics"), F.array_join(K.text_list(words, K.LIST_LIMITS["providers"], 5), "|").alias("providers"))


def json_path(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", K.at_path(F.col("props"), "$.k", "none").alias("k"), K.at_path(F.col("props"), "$.a.b", "none").alias("deep"))


def url_summaries(spark, sf_dir):
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, "?a=1&b=2").when(F.col("page_id") % 3 == 1, "#top").otherwise(""))
    text = F.concat(F.lit("see "), url, F.lit(" or http://b.example/x?y and more"))
    return tables.table(spark, sf_dir, "pages").select("page_id", K.url_summary(url).alias("summary"), K.without_urls(text).alias("shown"))


def input_hmac(spark, sf_dir):
    """Keyed hashes; DuckDB nests the two digests with pads of its own making."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", K.keyed_hash(F.col("text"), "secret").alias("hash"))


def rolling_hash(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", K.rolling_hash(F.coalesce("text", F.lit(""))).alias("hash"))


def source_lines(spark, sf_dir):
    d = tables.table(spark, sf_dir, "conversations")
    box = F.concat(F.lit(" \r\n"), F.regexp_replace("text", r"\. ", ".\r\n\n  "))
    return d.select("conv_id", "turn", F.array_join(K.source_lines(box, 3), "|").alias("lines"))


def _jobs(spark, sf_dir):
    """Events as analysis jobs: three marks a job, the last of which some lack."""
    i = F.col("event_id")
    mark = F.when(i % 3 == 0, "started").when(i % 7 == 0, "failed").otherwise("finished")
    return _events(spark, sf_dir).select(F.floor(i / 3).alias("job"), "ts", mark.alias("mark"))


def job_lifecycle(spark, sf_dir):
    return store.job_states(_jobs(spark, sf_dir)).select("job", "status", F.round("seconds", 3).alias("seconds"))


def job_status_counts(spark, sf_dir):
    return store.job_states(_jobs(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        url_guard_ipv6, page_gates, page_bodies, entity_decode, renewing_limit, field_sanitizers, list_caps, json_path, url_summaries, input_hmac, rolling_hash, source_lines, job_lifecycle, job_status_counts,
    )
}

_V4 = " OR ".join(f"{{0}} BETWEEN {a} AND {b}" for a, b in (G._range(n, k) for n, k in G.PRIVATE))
_MAPPED = "((event_id % 256) * 16777216 + (event_id * 3 % 256) * 65536 + 256 + 9)"
_HEX = "lower(to_hex(CAST({0} AS BIGINT)))"
_PAD = {k: bytes(b ^ x for b in b"secret".ljust(64, b"\0")).hex() for k, x in (("i", 0x36), ("o", 0x5C))}
_JOBS = "j AS (SELECT event_id // 3 AS job, ts, CASE WHEN event_id % 3 = 0 THEN 'started' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'finished' END AS mark FROM events), js AS (SELECT job, CASE WHEN bool_or(mark = 'failed') THEN 'failed' WHEN bool_or(mark = 'finished') THEN 'complete' ELSE 'in_progress' END AS status, CAST(epoch_us(max(ts) FILTER (mark <> 'started')) - epoch_us(min(ts) FILTER (mark = 'started')) AS DOUBLE) / 1000000.0::DOUBLE AS seconds FROM j GROUP BY job)"
_U = "(url || CASE page_id % 3 WHEN 0 THEN '?a=1&b=2' WHEN 1 THEN '#top' ELSE '' END)"


def _fragment(x: str) -> str:
    from . import source_queries

    return source_queries._fragment(x)


ORACLE = {
    "url_guard_ipv6": f"""WITH a AS (SELECT event_id, list_extract([{", ".join(map(str, FIRST))}], CAST(event_id % {len(FIRST)} AS INTEGER) + 1) AS f, (event_id // 3) % 40 AS s, event_id * 7 % 65536 AS z FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '[::ffff:' || (event_id % 256) || '.' || (event_id * 3 % 256) || '.1.9]' WHEN event_id % 3 = 0 THEN {_HEX.format("f")} || ':' || {_HEX.format("s")} || '::' || {_HEX.format("z")}
  ELSE {_HEX.format("f")} || ':' || {_HEX.format("s")} || ':0:0:0:0:0:' || {_HEX.format("z")} END AS host,
  CASE WHEN event_id % 5 = 0 THEN {_V4.format(*[_MAPPED] * len(G.PRIVATE)).replace("{0}", _MAPPED)} ELSE (f = 0 AND s = 0 AND z IN (0, 1)) OR (f = 256 AND s = 0) OR f BETWEEN 64512 AND 65023 OR f BETWEEN 65152 AND 65215 OR f >= 65280 OR f = 8194
    OR (f = 8193 AND (s = 2 OR s BETWEEN 16 AND 31)) END AS private FROM a""",
    "page_gates": """SELECT page_id, CASE WHEN page_id % 11 <> 0 AND page_id % 7 <> 0 AND page_id % 13 = 0 THEN 'not_web' WHEN page_id % 11 = 0 THEN 'private' WHEN page_id % 9 = 0 OR page_id % 10 = 0 THEN 'resolves_to_private'
  WHEN page_id % 7 = 0 THEN 'too_many_redirects' WHEN page_id % 4 = 2 THEN 'unsupported_type' WHEN strlen(html) > 2000000 THEN 'too_large' ELSE 'accepted' END AS gate FROM pages""",
    "entity_decode": r"""WITH t AS (SELECT page_id, html || '@REFS@' || length(html) || '; &amp;lt; &#x' || to_hex(length(html)) || ';' AS x FROM pages),
r AS (SELECT page_id, regexp_extract_all(x, '(?i)&(?:#x[0-9a-f]+|#[0-9]+|[a-z][a-z0-9]+);') AS ms, string_split_regex(x, '(?i)&(?:#x[0-9a-f]+|#[0-9]+|[a-z][a-z0-9]+);') AS gs FROM t),
n AS (SELECT page_id, i, ms[i] AS m, gs[i] AS g, CASE WHEN regexp_matches(ms[i], '^&#[xX]') THEN try_cast('0x0' || regexp_extract(ms[i], '(?i)^&#x0*([0-9a-f]*);', 1) AS BIGINT)
  WHEN starts_with(ms[i], '&#') THEN try_cast(regexp_extract(ms[i], '^&#([0-9]+);', 1) AS BIGINT) END AS code FROM (SELECT *, unnest(range(1, len(gs) + 1)) AS i FROM r))
SELECT page_id, md5(string_agg(g || CASE WHEN m IS NULL THEN '' WHEN starts_with(m, '&#') THEN CASE WHEN code BETWEEN 0 AND 1114111 AND code NOT BETWEEN 55296 AND 57343 THEN chr(CAST(code AS INTEGER)) ELSE m END
  ELSE CASE lower(m) WHEN '&amp;' THEN '&' WHEN '&apos;' THEN chr(39) WHEN '&gt;' THEN '>' WHEN '&lt;' THEN '<' WHEN '&nbsp;' THEN ' ' WHEN '&quot;' THEN '"' ELSE m END END, '' ORDER BY i)) AS digest FROM n GROUP BY page_id""".replace("@REFS@", REFERENCES),
    "renewing_limit": """WITH RECURSIVE ev AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
st(event_id, user_id, k, last, n, accepted) AS (SELECT event_id, user_id, k, t, 1, true FROM ev WHERE k = 1
  UNION ALL SELECT ev.event_id, ev.user_id, ev.k, CASE WHEN ev.t - st.last >= 86400000000 OR st.n < 3 THEN ev.t ELSE st.last END, CASE WHEN ev.t - st.last >= 86400000000 THEN 1 WHEN st.n < 3 THEN st.n + 1 ELSE st.n END, ev.t - st.last >= 86400000000 OR st.n < 3
  FROM st JOIN ev ON ev.user_id = st.user_id AND ev.k = st.k + 1)
SELECT event_id, accepted FROM st""",
    "field_sanitizers": """SELECT event_id, CASE WHEN lower(event_type) IN ('click', 'error', 'view') THEN lower(event_type) ELSE 'other' END AS kind, CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE least(100.0, greatest(0.0, value)) END::DOUBLE AS value,
  event_id % 3 = 0 AS flag, 'ab,' || event_type AS keys FROM events""",
    "list_caps": """SELECT doc_id, CAST(least(80, len(string_split(coalesce(text, ''), ' '))) AS INTEGER) AS n_metrics,
  array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), ' ')[1:6], lambda x: substring(trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), ' '), 1, 5)), lambda x: x <> ''), '|') AS providers FROM documents""".replace("\\\\", "\\"),
    "json_path": "SELECT event_id, coalesce(props->>'$.k', 'none') AS k, coalesce(props->>'$.a.b', 'none') AS deep FROM events",
    "url_summaries": rf"""SELECT page_id, CASE WHEN len(n) > 0 THEN o || ' (' || array_to_string(n, '; ') || ' omitted)' ELSE o END AS summary, 'see ' || o || ' or http://b.example and more' AS shown FROM (SELECT page_id, regexp_extract(u, '^[a-z]+://[^/?#]*') AS o,
  list_filter([CASE WHEN k > 0 THEN k || ' path' END, CASE WHEN q <> '' THEN len(string_split(q, '&')) || ' query' END, CASE WHEN contains(u, '#') THEN 'fragment' END], lambda x: x IS NOT NULL) AS n
  FROM (SELECT page_id, u, regexp_extract(u, '\?([^#]*)', 1) AS q, len(list_filter(string_split(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS k FROM (SELECT page_id, {_U} AS u FROM pages)))""",
    "input_hmac": f"SELECT doc_id, sha256(from_hex('{_PAD['o']}') || from_hex(sha256(from_hex('{_PAD['i']}') || encode(coalesce(text, ''))))) AS hash FROM documents",
    "rolling_hash": "SELECT doc_id, lower(to_hex(list_reduce(list_prepend(5381::BIGINT, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: xor((h * 33) & 4294967295, c)))) AS hash FROM documents",
    "source_lines": r"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(text, '\. ', '.' || chr(10), 'g'), '\r?\n'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')[1:3], '|') AS lines FROM conversations",
    "job_lifecycle": f"WITH {_JOBS} SELECT job, status, round(seconds, 3) AS seconds FROM js",
    "job_status_counts": f"WITH {_JOBS} SELECT status, count(*) AS n FROM js GROUP BY 1",
}


def _bodies() -> str:
    from . import source_queries as OQ

    return f"SELECT page_id, md5(CASE WHEN page_id % 4 = 1 THEN {OQ._chain('html', *OQ._TRIM)} ELSE {_fragment(OQ._CLEAN)} END) AS digest FROM pages"


ORACLE["page_bodies"] = _bodies()
