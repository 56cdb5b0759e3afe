"""Requests and sinks, on files written for it."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from prosemill.sources import pages, requests, sinks, store


def test_options_win_and_problems_are_told(spark, tmp_path):
    files = {
        "a": {"text": "One.", "mode": "research", "metadata": {"goal": "risk_review", "sources": ["s", {"id": "k"}]}, "options": {"allowPrivateNetwork": True}},
        "b": {"url": "https://example.org", "options": {"allowPrivateNetwork": True, "reportProfile": "machine"}},
        "c": {"text": "One.", "url": "https://example.org"},
        "d": {"text": ""},
        "e": {"text": "One.", "mode": "other"},
        "f": {"text": "One.", "metadata": {"goal": "other"}},
        "g": {"text": "One.", "options": {"reportProfile": "other"}},
    }
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "h.json").write_text("{no json")
    read = requests.read_requests(spark, str(tmp_path)).withColumn("file", F.substring(F.input_file_name(), -6, 1))
    got = {r.file: r for r in requests.resolved(read).collect()}
    assert {k: r.problem for k, r in got.items()} == {
        "a": None, "b": None, "c": "not_one_input", "d": "not_one_input", "e": "bad_mode", "f": "bad_goal", "g": "bad_profile", "h": "no_json",
    }
    a, b = got["a"], got["b"]
    assert (a.mode, a.goal, a.profile, a.allow_private) == ("research", "risk_review", "full", True)
    assert a.sources[0] == "s" and json.loads(a.sources[1]) == {"id": "k"}
    assert (b.mode, b.goal, b.profile, b.sources, b.allow_private) == ("editorial", None, "machine", [], False)
    won = requests.resolved(read, mode="integrity", goal="source_support", profile="checklist", sources=("x",), checker_url="http://localhost:8081").collect()
    assert {(r.mode, r.goal, r.profile, tuple(r.sources), r.checker_url) for r in won} == {("integrity", "source_support", "checklist", ("x",), "http://localhost:8081")}
    with pytest.raises(ValueError, match="mode must be one of"):
        requests.resolved(read, mode="other")


def test_no_requests(spark):
    empty = spark.createDataFrame([], f"{requests.SCHEMA}, {requests.BROKEN} string")
    assert requests.resolved(empty).count() == 0


def test_claims_file_reads_back(spark, tmp_path):
    rows = [(1, 'says "no"; twice', "a\nb"), (2, None, ""), (3, "back\\slash", "x,y")]
    sinks.write_claims_csv(spark.createDataFrame(rows, "doc_id long, claim string, notes string").coalesce(1), str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("part-*")
    with part.open(newline="") as f:
        text = f.read()
    back = list(csv.reader(text.splitlines(keepends=True)))
    assert back[0] == ["doc_id", "claim", "notes"]
    assert sorted(back[1:]) == [["1", 'says "no"; twice', "a\nb"], ["2", "", ""], ["3", "back\\slash", "x,y"]]
    assert text.startswith('"doc_id","claim","notes"\n') and '"2","",""' in text


def test_reports_and_events(spark, tmp_path):
    d = spark.createDataFrame([(1, "\n# One\n\ntext \n"), (2, "# Two")], "doc_id long, report string")
    sinks.write_markdown(d, str(tmp_path / "m"))
    text = {p.parent.name: p.read_text() for p in (tmp_path / "m").glob("doc_id=*/part-*")}
    assert text == {"doc_id=1": "# One\n\ntext\n", "doc_id=2": "# Two\n"}
    sinks.write_json(d, str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(x["doc_id"] for x in lines) == [1, 2]
    at = F.lit("2024-01-02 03:04:05.678").cast("timestamp")
    line = d.limit(1).select(sinks.event("analysis.started", "Begun.", F.struct(F.lit(1).alias("n")), at)).first()[0]
    assert json.loads(line) == {"type": "analysis.started", "message": "Begun.", "data": {"n": 1}, "timestamp": "2024-01-02T03:04:05.678Z"}


def test_reports_are_taken_out_of_their_days_only(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 3} 10:00:00", "h", 5, "good", "low", 3) for i in range(9)]
    names = "id long, created_at string, input_hash string, input_length int, quality_band string, provenance_band string, word_count int"
    d = spark.createDataFrame(rows, names).withColumn("created_at", F.to_timestamp("created_at"))
    path = str(tmp_path / "s")
    store.save_reports(d, path)
    untouched = {p.name for p in (tmp_path / "s" / "created_day=2024-01-01").glob("part-*")}
    store.remove_reports(spark, path, [4, 6, 7, 8, 99])
    assert sorted(r.id for r in store.read_reports(spark, path).collect()) == [0, 1, 2, 3, 5]
    assert {p.name for p in (tmp_path / "s" / "created_day=2024-01-01").glob("part-*")} == untouched
    assert not (tmp_path / "s" / "created_day=2024-01-03").exists()
    store.remove_reports(spark, path, [99])
    assert store.read_reports(spark, path).count() == 5
    assert not store.is_ready(d) and store.missing_columns(d, store.COLUMNS)[0] == "source_type"


def test_notes_of_an_extraction(spark):
    long = "Words that tell something stand here. " * 40
    html = [f"<article><p>{long}</p></article>", "<p>short</p>", f"<div>{long}</div><article>{'one two three ' * 10}</article>"]
    d = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = {r.page_id: r.notes for r in pages.readable(d).collect()}
    assert got == {0: ["container_chosen"], 1: ["little_text"], 2: ["whole_page_after_scoring"]}


def test_the_latest_report_carries_no_text(spark, tmp_path):
    """Whole reports were aggregated, so that every text was hashed and shuffled for three columns of one row."""
    rows = [(1, "2024-01-02", "t" * 9), (3, "2024-01-02", "u"), (9, "2024-01-01", "v"), (None, "2024-01-02", "w"), (5, None, "x")]
    d = spark.createDataFrame(rows, "id long, created_at string, input_text string")
    assert tuple(store.latest_report(d).first()) == (3, "2024-01-02", "u") and store.latest_report(d.filter("false")).count() == 0
    d.write.parquet(str(tmp_path / "r"))
    latest = store.latest_report(store.read_reports(spark, str(tmp_path / "r"))).select("id")
    read = latest._jdf.queryExecution().sparkPlan().toString()
    assert "ReadSchema" in read and "input_text" not in read and latest.first().id == 3


def test_a_day_of_reports_is_not_split_by_the_tasks(spark, tmp_path):
    """Each task wrote a file for each day, so files grew with tasks times days."""
    rows = [(i, f"2024-01-0{1 + i % 3} 10:00:00", "h", 5, "good", "low", 3) for i in range(60)]
    names = "id long, created_at string, input_hash string, input_length int, quality_band string, provenance_band string, word_count int"
    d = spark.createDataFrame(rows, names).withColumn("created_at", F.to_timestamp("created_at")).repartition(6)
    store.save_reports(d, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("created_day=*/part-*"))) == 3
    store.remove_reports(spark, str(tmp_path / "s"), [0, 3])
    assert len(list((tmp_path / "s").glob("created_day=*/part-*"))) == 3 and store.read_reports(spark, str(tmp_path / "s")).count() == 58
