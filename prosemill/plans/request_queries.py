"""Queries over requests, the store's upkeep and the files that results go to, each with its SQL.

Requests are made of what conversations hold: their texts, and their roles as
modes, profiles and goals, most of which are none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import pages as G
from ..sources import requests as R
from ..sources import sinks, store, tables
from . import report_queries as RQ
from . import sql as S


def _requests(spark, sf_dir):
    d = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    n = F.col("turn")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.pmod(F.length("text"), F.lit(len(values))).cast("int"))
    request = F.struct(
        F.when(n % 5 != 4, F.col("text")).alias("text"), F.when(n % 3 == 0, F.lit("https://example.org/")).alias("url"), pick((*R.MODES, None, "other")).alias("mode"),
        F.struct(pick((None, *R.GOALS, "win")).alias("goal"), F.array(F.col("role")).alias("sources")).alias("metadata"), F.struct(pick((*R.PROFILES, None)).alias("reportProfile"), F.lit(True).alias("allowPrivateNetwork")).alias("options"),
    )
    line = F.when(F.length("text") % 17 == 3, F.concat(F.lit("{"), "text")).otherwise(F.to_json(request))
    return d.select("conv_id", "turn", line.alias("line"))


def _parsed(spark, sf_dir):
    return _requests(spark, sf_dir).select("conv_id", "turn", R.parsed(F.col("line")).alias("r")).select("conv_id", "turn", "r.*")


def request_json(spark, sf_dir):
    d = R.resolved(_parsed(spark, sf_dir))
    return d.select("conv_id", "turn", "problem", "mode", "goal", "profile", F.array_join("sources", ",").alias("sources"), "allow_private")


def request_overrides(spark, sf_dir):
    """The same under options, which win over what a request says but don't mend it."""
    d = R.resolved(_parsed(spark, sf_dir), mode="integrity", profile="checklist", sources=("a", "b"))
    return d.groupBy("problem", "mode", "profile", F.array_join("sources", ",").alias("sources")).agg(F.count("*").alias("n"), F.countDistinct("goal").alias("goals"))


def report_lookup(spark, sf_dir):
    """What a store finds of every tenth report after every fifth was taken out."""
    rows = RQ.report_store_rows(spark, sf_dir)
    path = store.scratch_path(spark, "reports")
    store.save_reports(rows, path)
    gone = [r[0] for r in tables.table(spark, sf_dir, "documents").filter("doc_id % 5 = 0 AND doc_id < 500").select("doc_id").collect()]
    store.remove_reports(spark, path, gone)
    kept = store.read_reports(spark, path)
    return kept.select("id", F.col("created_day").cast("string").alias("day"), "quality_band", "word_count")


def result_lines(spark, sf_dir):
    """Results as lines of JSON, as the sink writes them."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.struct("doc_id", F.upper("lang").alias("lang"), F.octet_length("text").alias("bytes")).alias("r"))
    return d.select("doc_id", F.to_json("r").alias("line"))


def event_lines(spark, sf_dir):
    d = tables.table(spark, sf_dir, "events")
    return d.select("event_id", sinks.event("analysis.finished", "Done.", F.struct("user_id", "event_type"), F.col("ts").cast("timestamp")).alias("line"))


def url_guard_pages(spark, sf_dir):
    """Addresses of pages whose host is written as the number that the page's own bytes give, in the forms that a guard must know."""
    d = tables.table(spark, sf_dir, "pages").select("page_id", F.conv(F.substring(F.md5("html"), 1, 8), 16, 10).cast("long").alias("n"))
    octets = [F.pmod(F.shiftrightunsigned("n", k), F.lit(256)) for k in (24, 16, 8, 0)]
    first = F.when(F.col("n") % 3 == 0, F.get(F.array(*map(F.lit, (10, 127, 169, 172, 192, 100, 198, 203))), F.pmod("n", F.lit(8)).cast("int")).cast("long")).otherwise(octets[0])
    host = F.concat_ws(".", first.cast("string"), *[o.cast("string") for o in octets[1:]])
    return d.select("page_id", host.alias("host")).select("page_id", "host", G.is_private(F.col("host")).alias("private"))


QUERIES = {f.__name__: f for f in (request_json, request_overrides, report_lookup, result_lines, event_lines, url_guard_pages)}


def _pick(values) -> str:
    return "[" + ", ".join("NULL" if v is None else S.quoted(v) for v in values) + f"][length(text) % {len(values)} + 1]"


_BROKEN = "length(text) % 17 = 3"
_RESOLVED = f"""WITH q AS (SELECT conv_id, turn, role, {_BROKEN} AS broken, text <> '' AND turn % 5 <> 4 AS has_text, turn % 3 = 0 AS has_url, {_pick((*R.MODES, None, "other"))} AS m, {_pick((None, *R.GOALS, "win"))} AS g, {_pick((*R.PROFILES, None))} AS p FROM conversations),
z AS (SELECT *, CASE WHEN broken THEN 'no_json' WHEN CAST(has_text AS INTEGER) + CAST(has_url AS INTEGER) <> 1 THEN 'not_one_input' WHEN m = 'other' THEN 'bad_mode' WHEN g = 'win' THEN 'bad_goal' END AS problem FROM q)
"""
_GUARD = " OR ".join(f"number BETWEEN {a} AND {b}" for a, b in (G._range(n, k) for n, k in G.PRIVATE))
ORACLE = {
    "request_json": _RESOLVED
    + """SELECT conv_id, turn, problem, CASE WHEN broken THEN 'editorial' ELSE coalesce(m, 'editorial') END AS mode, CASE WHEN NOT broken THEN g END AS goal, CASE WHEN broken THEN 'full' ELSE coalesce(p, 'full') END AS profile,
  CASE WHEN broken THEN '' ELSE coalesce(role, '') END AS sources, NOT broken AND NOT has_url AS allow_private FROM z""",
    "request_overrides": _RESOLVED + "SELECT problem, 'integrity' AS mode, 'checklist' AS profile, 'a,b' AS sources, count(*) AS n, count(DISTINCT CASE WHEN NOT broken THEN g END) AS goals FROM z GROUP BY problem",
    "url_guard_pages": f"""WITH n AS (SELECT page_id, ('0x' || md5(html)[1:8])::BIGINT AS n FROM pages), o AS (SELECT page_id, CASE WHEN n % 3 = 0 THEN [10, 127, 169, 172, 192, 100, 198, 203][n % 8 + 1] ELSE n // 16777216 END AS a,
  n // 65536 % 256 AS b, n // 256 % 256 AS c, n % 256 AS d FROM n), h AS (SELECT page_id, concat_ws('.', a, b, c, d) AS host, ((a * 256 + b) * 256 + c) * 256 + d AS number FROM o)
SELECT page_id, host, ({_GUARD}) AS private FROM h""",
    "report_lookup": RQ._review("SELECT id, strftime(created_at, '%Y-%m-%d') AS day, quality_band, word_count FROM st WHERE NOT (id % 5 = 0 AND id < 500)", RQ._STORE),
    "result_lines": """SELECT doc_id, '{' || concat_ws(',', '"doc_id":' || doc_id, '"lang":"' || upper(lang) || '"', '"bytes":' || strlen(text)) || '}' AS line FROM documents""",
    "event_lines": """SELECT event_id, '{"type":"analysis.finished","message":"Done.","data":{' || concat_ws(',', '"user_id":' || user_id, '"event_type":"' || event_type || '"') || '},"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z"}' AS line FROM events""",
}
