"""Structure of texts, nested shapes and the external checker on small cases, against plain versions."""

from __future__ import annotations

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from prosemill.functions import lexicon as X
from prosemill.functions import shapes
from prosemill.functions import text as T
from prosemill.operators import checker, preparation, proofreading, structure
from prosemill.sources import pages
from prosemill.streaming import governance


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_composition_is_nfc(spark):
    rng = random.Random(4)
    some = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x1100, 0x1200), *range(0xAC00, 0xAC20), *range(0x1E00, 0x2130), *range(0x900, 0xE00), *range(0xF900, 0xFB50)]]
    some = [c for c in some if unicodedata.category(c) != "Cn"]
    texts = ["".join(rng.choices(some, k=rng.randrange(14))) for _ in range(3_000)] + ["", None, "plain"]
    got = {r.doc_id: r.x for r in docs(spark, *texts).select("doc_id", T.normalized(F.col("text")).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == unicodedata.normalize("NFC", (t or "").replace("\r\n", "\n").replace("\r", "\n"))


def blocks(spark, *texts):
    return structure.with_blocks(structure.with_paragraphs(preparation.prepare(docs(spark, *texts))))


def plain_sections(text):
    """The stack of open headings, block by block."""
    out, stack, place = [], [], 0
    parts, at = [], 0
    for part in text.split("\n\n"):
        parts.append((part, at))
        at += len(part) + 2
    for place, (part, start) in enumerate(p for p in parts if p[0].strip()):
        level = len(part) - len(part.lstrip("#")) if part.startswith("#") else 0
        if level:
            while stack and stack[-1]["level"] >= level:
                closed = stack.pop()
                closed["end"] = max(closed["end"], start - 1)
            own = {"id": len(out) + 1, "title": part.lstrip("#").strip(), "level": level, "start": start, "end": start + len(part), "parent": stack[-1]["id"] if stack else None, "first": place + 1, "last": place + 1}
            out.append(own)
            stack.append(own)
        elif stack:
            stack[-1]["end"], stack[-1]["last"] = start + len(part), place + 1
    return out


def test_sections_are_those_of_a_stack(spark):
    rng = random.Random(8)
    texts = ["\n\n".join(rng.choice(["# a", "## b", "### c", "#### d", "words here.", "more, of them"]) for _ in range(rng.randrange(1, 25))) for _ in range(40)]
    texts = [t for t in texts if "#" in t]
    d = blocks(spark, *texts)
    for r in d.select("doc_id", "sections").collect():
        assert [s.asDict() for s in r.sections] == plain_sections(texts[r.doc_id])
    for column in ("blocks", "paras"):
        for r in structure.with_section(d, column).collect():
            own = [s["id"] for s in plain_sections(texts[r.doc_id]) if s["first"] <= r.ord <= s["last"]]
            assert r.section == (own[-1] if own else None)


def test_texts_without_headings_or_words(spark):
    d = blocks(spark, "one.\n\ntwo", "", None, " \n\n ")
    got = {r.doc_id: r.sections for r in d.select("doc_id", "sections").collect()}
    assert [tuple(s) for s in got[0]] == [(1, "Body", 1, 0, 9, None, 1, 2)] and got[1] == got[2] == got[3] == []
    assert {r.section for r in structure.with_section(d, "blocks").collect()} == {1}


def test_blocks_count_what_lies_in_them(spark):
    text = "See [1] and https://a.example/x twice [2].\n\nNone here.\n\n(Moss et al., 2020) said so. Yes!"
    rows = structure.with_section(blocks(spark, text), "blocks").orderBy("ord").collect()
    assert [(r.n_citations, r.n_urls, r.n_sentences) for r in rows] == [(2, 1, 2), (0, 0, 1), (1, 0, 3)]


def test_places_within_ranges(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        cuts = sorted(rng.sample(range(60), 12))
        ranges = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        cuts = sorted(rng.sample(range(60), 16))
        rows.append((ranges, [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]))
    kind = "array<struct<start:int,end:int>>"
    d = spark.createDataFrame(rows, f"r {kind}, p {kind}").select("r", "p", structure.counted_within(F.col("r"), F.col("p")).alias("n"))
    for r in d.collect():
        assert r.n == [sum(x.start <= p.start and p.end <= x.end for p in r.p) for x in r.r]


def test_one_pattern_finds_what_each_phrase_would(spark):
    rng = random.Random(1)
    some = [*proofreading.PHRASES, "In Order To", "the", "the", "a", "  ", "untilx", "-wich"]
    texts = ["the and that " + " ".join(rng.choices(some, k=40)) for _ in range(20)]
    d = preparation.with_language(preparation.prepare(docs(spark, *texts)), F.lit("en")).withColumn("language", F.lit("en"))
    got = proofreading.issues(d, None, ("1-misspelling", "4-wordy")).groupBy("doc_id").count().collect()
    low = [t.lower() for t in texts]
    import re

    want = {i: sum(len(re.findall(rf"(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])", t)) for p in proofreading.PHRASES) for i, t in enumerate(low)}
    assert {r.doc_id: r["count"] for r in got} == {i: n for i, n in want.items() if n}


def answer(*matches):
    return json.dumps({"matches": [{"message": "m", "offset": o, "length": n, "replacements": [{"value": v} for v in vs], "rule": {"issueType": k, "category": {"id": c}}} for o, n, vs, k, c in matches]})


def test_checker_places_kinds_and_states(spark):
    text = "\U0001f600 ab \U0001f600\U0001f600 cd"  # in UTF-16 ab begins at 3 and cd at 11
    own = spark.createDataFrame([(i, text, s, ["own"]) for i, s in enumerate(["available", "available", "abstained", "disabled", "available", "available"])], "doc_id long, norm string, status string, caveats array<string>")
    good = answer((3, 2, ["", "x", "y"], "misspelling", ""), (11, 2, [], "other", "CASING"), (-1, 2, [], "grammar", ""), (1.5, 2, [], "grammar", ""), (3, 0, [], "grammar", ""))
    local = "http://localhost:8081"
    answers = [(0, local, good, None), (1, None, good, None), (2, local, None, "http_500"), (3, "http://far.example/", good, None), (4, "https://far.example/", good, None), (5, "http://127.0.0.1/", "no json", None)]
    out = {r.doc_id: r for r in checker.outcomes(own, spark.createDataFrame(answers, "doc_id long, url string, answer string, failed string")).collect()}
    assert [(f["index"], text[f.start : f.end], f.kind, f.suggestions) for f in out[0].found] == [(1, "ab", "spelling", ["x", "y"]), (2, "cd", "typography", [])]
    assert [out[i].status for i in range(6)] == ["available", "available", "abstained", "disabled", "error", "available"]
    assert out[1].caveats == ["own"] and out[2].caveats == ["own", "checker_failed", "http_500"] and out[4].caveats == ["own", "checker_url_refused"] and out[5].found == []


def test_checker_merge_keeps_the_first_at_a_place(spark):
    base = spark.createDataFrame([(0, 1, 0, 2, "spelling", "low")], "doc_id long, place int, start int, end int, kind string, severity string")
    found = [(i, a, b, k, "low", "m", [], 0.5) for i, (a, b, k) in enumerate([(0, 2, "spelling"), (0, 2, "style"), (5, 6, "style"), (5, 6, "style")])]
    outcome = spark.createDataFrame([(0, "available", [], found)], f"doc_id long, status string, caveats array<string>, found array<{checker.ISSUE}>")
    got = checker.merged(base, outcome).orderBy("place").collect()
    assert [(r.start, r.kind, r.late) for r in got] == [(0, "spelling", 0), (0, "style", 1), (5, "style", 1)]
    assert checker.merged(base, outcome, 2).count() == 2


@pytest.mark.parametrize(("url", "want"), [("http://localhost:8081", "http://localhost:8081/v2/check"), ("http://[::1]/x//", "http://[::1]/x/v2/check"), ("https://127.0.0.1/v2/check?a=1", "https://127.0.0.1/v2/check?a=1"), ("http://localhost.example/", None), ("ftp://localhost/", None), ("", None)])
def test_checker_addresses(spark, url, want):
    assert spark.range(1).select(checker.endpoint(F.lit(url))).first()[0] == want


def test_shapes_take_anything(spark):
    given = [None, "", "no", "[1]", "{}", '{"dimensions": 5, "claims": [null, {"id": "A b!", "start": "x", "numbers": "7"}], "rawMetrics": {"A": "1", "a": 2, "b": "x"}}']
    rows = docs(spark, *given).select("doc_id", shapes.stored(F.col("text"), F.lit(True)).alias("r")).orderBy("doc_id").collect()
    for r in rows[:5]:
        assert (r.r.dimensions, r.r.claims, r.r.spans, r.r.proofreading.status, r.r.proofreading.issueCount, r.r.rawMetrics) == ([], [], [], "abstained", 0, {})
    last = rows[5].r
    assert last.dimensions == [] and last.rawMetrics == {"a": 2.0}
    assert [(c.id, c.start, c.numbers, c.type) for c in last.claims] == [("ab", 0, [], "unverifiable")]


def test_every_limit_of_a_shape(spark):
    n = 100
    item = {"id": "I d", "body": "<b>x</b>", "score": "1e3", "severity": "HIGH"}
    given = {
        "dimensions": [{"score": 500, "scoreContributions": [{}] * n, "findings": ["x" * 900] * n, "reasonCodes": ["K"] * n}] * n, "scoreContributions": [{"value": "1e400"}] * n,
        "proofreading": {"providers": [{"egress": "moon", "notes": ["n"] * n}] * n, "issues": [{"end": -5}] * n}, "claims": [{"claim": "c" * 5_000, "entities": ["e"] * n}] * n, "spans": [{}] * n,
        "analysisSections": [{"kind": "proofreading", "items": [item] * n}, {"kind": "x", "items": []}] * n, "rawMetrics": {f"k{i}": i for i in range(n)},
    }
    kept, cut = (docs(spark, json.dumps(given)).select(shapes.stored(F.col("text"), F.lit(x)).alias("r")).first().r for x in (True, False))
    assert [len(x) for x in (kept.dimensions, kept.scoreContributions, kept.proofreading.providers, kept.proofreading.issues, kept.claims, kept.spans, kept.analysisSections, kept.rawMetrics)] == [30, 80, 6, 40, 32, 80, 12, 80]
    d = kept.dimensions[0]
    assert (d.score, len(d.scoreContributions), len(d.findings), len(d.findings[0]), d.reasonCodes) == (100.0, 12, 8, 400, ["k"] * 12)
    assert len(kept.claims[0].claim) == 1000 and len(kept.claims[0].entities) == 8 and kept.proofreading.issues[0].end == 0 and kept.proofreading.providers[0].egress == "none"
    assert [(len(s["items"]), s.kind) for s in kept.analysisSections[:2]] == [(40, "proofreading"), (0, "caveats")] and kept.analysisSections[0]["items"][0].severity == "high"
    assert cut.spans == [] and cut.proofreading.issues == [] and cut.proofreading.issueCount == n and cut.claims[0].claim is None
    assert [len(s["items"]) for s in cut.analysisSections[:2]] == [1, 0] and cut.analysisSections[0]["items"][0].body == "items:40"


def test_budget_drops_whole_entries(spark):
    d = spark.createDataFrame([([5, 5, 1], 10), ([5, 5, 1], 11), ([20, 1], 10), ([], 1)], "s array<int>, b int")
    assert [tuple(r.w)[:2] for r in d.select(shapes.within(F.col("s"), F.col("b")).alias("w")).collect()] == [(2, 10), (3, 11), (0, 0), (0, 0)]


def test_references_of_any_kind(spark):
    got = docs(spark, "&AMP;&Nbsp;&#0;&#00065;&#x1f600;&#x110000;&#99999999999;&bogus;&amp;lt; & &#xD800;").select(pages.decoded(F.col("text"))).first()[0]
    assert got == "& \x00A\U0001f600&#x110000;&#99999999999;&bogus;&lt; & &#xD800;"


def test_stored_requests_are_decided_in_order(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(40_000), i) for i in range(600)]
    d = spark.createDataFrame(rows, "visitor string, at int, id long").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.id: r.accepted for r in governance.renewing_decisions(d, "visitor", "ts", "id", limit=4, seconds=900).collect()}
    for who in ("a", "b", "c", None):
        own = sorted((t, i) for v, t, i in rows if v == who)
        want, _, _ = governance.decide([t for t, _ in own], None, 0, 4, 900)
        assert [got[i] for _, i in own] == want


def test_issues_compute_the_words_once(spark):
    """A filter on the language was pushed below the words and computed them eleven times; merging computed the local issues twice."""
    d = preparation.with_language(preparation.prepare(docs(spark, "in order to recieve  the the")))
    own = d.select("doc_id", "norm", F.lit("available").alias("status"), F.array().cast("array<string>").alias("caveats"))
    answers = spark.createDataFrame([(0, "http://localhost:1", answer((0, 2, [], "grammar", "")), None)], "doc_id long, url string, answer string, failed string")
    merged = checker.merged(proofreading.issues(d), checker.outcomes(own, answers))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(X.WORD) == 1 and plan.count("from_json") + plan.count("jsontostructs") == 1 and "LeftAnti" not in plan
    assert merged.count() == proofreading.issues(d).count() + 1


def test_a_map_of_numbers_is_cleaned_once(spark):
    """Its entries were cleaned again for each entry and each one behind it, and each part of the JSON was parsed by itself."""
    d = docs(spark, '{"rawMetrics": {"B": "7", "A": "1", "b c": "2", "a": 3, "bc": "4", "x": "many"}, "claims": [{"claim": " <b>a</b>\\tb "}], "spans": [{}]}')
    made = d.select(F.map_entries(shapes.sanitised(F.col("text"), shapes.RESULT)["rawMetrics"]).alias("m"))
    assert [tuple(e) for e in made.first().m] == [("b", 7.0), ("a", 3.0), ("bc", 4.0)]
    plan = d.select(shapes.stored(F.col("text"), F.col("doc_id") == 0).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_entries") == 1 and plan.count("from_json") + plan.count("jsontostructs") == 1
    parts = {n: shapes.RESULT[n] for n in ("claims", "spans")}
    kept, bare = (d.select(shapes.stored(F.col("text"), F.lit(x), parts).alias("r")).first().r for x in (True, False))
    assert kept.claims[0].claim == "a b" and len(kept.spans) == 1 and list(kept.asDict()) == ["claims", "spans"]
    assert bare.claims[0].claim is None and bare.claims[0].type == "unverifiable" and bare.spans == []
