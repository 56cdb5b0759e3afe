"""Report views: order, limits, caveats and what profiles show."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prosemill.operators import claims, preparation, proofreading, scoring, views
from prosemill.plans import report_queries, view_queries

LONG = "The river town kept its market. Traders came from Lisbon and sold 40 baskets in 2019. " * 24


@pytest.fixture(scope="module")
def parts(spark):
    texts = [LONG, "Too short, wich is so.", "", "xyzzy " * 200]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prepared = preparation.prepare(d)
    sources = spark.createDataFrame([(0, 0, "s", "Traders sold 40 baskets in Lisbon in 2019.", None, None, None)], "doc_id long, source_ord int, id string, text string, title string, url string, citation string")
    statuses = claims.claim_status(claims.claims(prepared), claims.normalized_sources(sources))
    issues = proofreading.issues(preparation.with_language(prepared).withColumn("language", F.lit("en")))
    scored = scoring.with_provenance(scoring.with_quality(scoring.measured(d)))
    return views.with_parts(scored, statuses, claims.claim_review(statuses), issues)


def test_union_keeps_first_places(spark):
    d = spark.createDataFrame([(["b", "a"], ["a", None, "c"], None)], "x array<string>, y array<string>, z array<string>")
    assert d.select(views.ordered_union(F.col("x"), F.col("y"), F.col("z"), F.col("x"))).first()[0] == ["b", "a", "c"]


def test_sections_come_in_order_with_their_limits(parts):
    rows = views.with_sections(parts).select("doc_id", "sections").collect()
    assert len(rows) == 4
    for r in rows:
        assert [s.section for s in r.sections] == [n for n, _ in views.SECTIONS]
        assert all(len(s["items"]) <= most for s, (_, most) in zip(r.sections, views.SECTIONS, strict=True))
    first = {s.section: s["items"] for s in next(r for r in rows if r.doc_id == 0).sections}
    assert len(first["claim_review"]) == 16 and len(first["top_actions"]) == 8
    scores = [i.score for i in first["writing_quality"]]
    assert scores == sorted(scores)


def test_caveats_of_short_and_unknown_texts(parts):
    every = views.ordered_union(views.summary_caveats(), F.col("claim_caveats"), views.proofreading_caveats(F.col("language")))
    got = {r.doc_id: r.x for r in parts.select("doc_id", every.alias("x")).collect()}
    assert got[2] == ["provenance_abstained", "language_checks_weak", "proofreading_english_only"]
    assert got[3] == ["language_not_detected", "language_checks_weak", "proofreading_english_only"]
    assert got[1][0] == "provenance_abstained"


def test_recommendations_are_ten_at_most(parts):
    got = {r.doc_id: r.x for r in parts.select("doc_id", views.recommendations(parts).alias("x")).collect()}
    assert all(len(x) <= 10 and len(set(x)) == len(x) for x in got.values()) and any(":" in a for a in got[0])


def test_machine_view_has_every_metric_and_nothing_else(parts):
    d = views.with_sections(parts).withColumn("profile", F.explode(F.array(*map(F.lit, views.PROFILES))))
    visible = views.raw_visible(F.lit("editorial"), F.col("profile"), F.lit(False))
    d = d.withColumn("sections", views.view(F.col("sections"), F.col("profile"), visible))
    got = {(r.doc_id, r.profile): r for r in d.select("doc_id", "profile", "sections", views.markdown(F.col("sections"), F.col("profile")).alias("text")).collect()}
    machine = got[0, "machine"].sections
    assert [s.section for s in machine] == ["raw_diagnostics"]
    assert {i.item for i in machine[0]["items"]} == set(views.M.NAMES)
    full = {s.section: s["items"] for s in got[0, "full"].sections}
    assert len(full) == 11 and full["raw_diagnostics"] == []
    listed = [s.section for s in got[0, "checklist"].sections]
    assert listed == ["top_actions", "content_audit", "proofreading", "claim_review", "caveats"]
    heads = [x[3:] for x in got[2, "checklist"].text.split("\n") if x.startswith("## ")]
    assert heads == [h for h in listed if h not in ("proofreading", "claim_review")]
    assert got[0, "claims-csv"].text.startswith("# Report: checklist") and len(got[0, "claims-csv"].sections) == 11


def test_research_shows_metrics(spark):
    d = spark.createDataFrame([("research", "full", False), ("editorial", "full", True), ("editorial", "machine", False), ("integrity", "checklist", False), (None, "full", None)], "m string, p string, a boolean")
    assert [r[0] for r in d.select(views.raw_visible(F.col("m"), F.col("p"), F.col("a"))).collect()] == [True, True, True, False, False]


def joined(d):
    """The columns of every join in a plan, as text."""

    def walk(node):
        kids = node.children()
        below = [x for i in range(kids.size()) for x in walk(kids.apply(i))]
        return ([node.output().mkString(" ")] if node.nodeName() == "Join" else []) + below

    return walk(d._jdf.queryExecution().optimizedPlan())


def test_reports_meet_their_claims_without_their_texts(spark):
    """Whole texts, also those that no report keeps, were shuffled to be hashed behind the joins."""
    found = joined(report_queries.report_store_rows(spark, "/root/testdata/sf0.001"))
    assert any("input_hash#" in x for x in found) and not any("norm#" in x for x in found)


def test_sections_take_each_claim_once_and_no_text(spark):
    """Claims were computed a second time for their review, and texts and words were shuffled to look for phrases and languages behind the joins."""
    found = joined(view_queries.sectioned(spark, "/root/testdata/sf0.001"))
    names = [{c.split("#")[0] for c in x.split()} for x in found]
    assert sum("sources" in x for x in names) == 1 and not any({"low", "words"} & x for x in names)
