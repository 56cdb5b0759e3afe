"""Behaviour of the analysis operators on small texts written for it."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from prosemill.functions import lexicon as X
from prosemill.functions import text as T
from prosemill.operators import claims, metrics, preparation, proofreading, scoring
from prosemill.sources import pages, store
from prosemill.streaming import governance

LONG = "The river town kept its market. Traders came from Lisbon and sold 40 baskets. " * 12


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sentences_drop_lines_without_an_end(spark):
    d = preparation.prepare(docs(spark, "# Title\nOne two. Three!\nno end", "", None, "3.5 is split"))
    rows = preparation.sentence_rows(d).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.text.strip(), r.n_words) for r in rows] == [(0, "One two.", 2), (0, "Three!", 1), (0, "no end", 2), (3, "5 is split", 2)]
    text = "# Title\nOne two. Three!\nno end"
    assert all(text[r.start : r.end] == r.text for r in rows if r.doc_id == 0)


def test_accents_and_words(spark):
    d = preparation.prepare(docs(spark, "Él niño's ÀÇ-é"))
    assert d.first().words == ["el", "nino's", "ac-e"]


def test_paragraph_roles_and_blocks(spark):
    text = "# Head\n\nfirst " + "word " * 15 + "\n\n- item one\n- item two\n\n> said\n\nlast " + "word " * 15
    d = preparation.prepare(docs(spark, text))
    assert [r.role for r in preparation.paragraphs(d).orderBy("ord").collect()] == ["structured_item", "body", "structured_item", "structured_item", "closing"]
    assert [r.kind for r in preparation.blocks(d).orderBy("ord").collect()] == ["heading", "paragraph", "list", "quote", "paragraph"]


def test_section_tree(spark):
    text = "\n\n".join(["intro", "# A", "## B", "body", "### C", "## D", "# E"])
    rows = preparation.sections(preparation.blocks(preparation.prepare(docs(spark, text)))).orderBy("ord").collect()
    assert [(r.section, r.parent) for r in rows] == [(-1, None), (1, -1), (2, 1), (2, None), (4, 2), (5, 1), (6, -1)]


def test_references_have_places(spark):
    text = "See [12] and (Smith et al., 2020), doi:10.1234/ab.c or https://a.example/x)."
    rows = preparation.references(preparation.prepare(docs(spark, text))).collect()
    assert {(r.kind, r.text) for r in rows} == {("citation", "[12]"), ("citation", "(Smith et al., 2020)"), ("citation", "doi:10.1234/ab.c"), ("url", "https://a.example/x")}
    assert all(text[r.start : r.end] == r.text for r in rows)


def test_language_hint_and_ties(spark):
    d = preparation.prepare(docs(spark, "the cat and the dog with this", "la casa que es una cosa", "xyz", ""))
    got = [(r.language, float(r.language_confidence)) for r in preparation.with_language(d).orderBy("doc_id").collect()]
    assert got[0] == ("en", 0.625) and got[1][0] == "es" and got[2] == ("unknown", 0.1) and got[3] == ("unknown", 0.0)
    hinted = preparation.with_language(d, F.lit("de-DE")).orderBy("doc_id").collect()
    assert [(r.language, float(r.language_confidence)) for r in hinted][2:] == [("de", 0.45), ("de", 0.5)] and float(hinted[0].language_confidence) == 0.55


def test_metrics_by_hand(spark):
    r = metrics.with_metrics(preparation.prepare(docs(spark, "Many cats sleep. Many cats sleep. Many cats sleep well."))).first()
    assert (r.n_words, r.n_sentences, r.repeated_phrases, r.repeated_openings) == (10, 3, 3, 1)
    assert r.repeated_2 == 5 and r.repeated_words == 6 and abs(r.qualifier_density - 1) < 1e-9
    assert abs(r.sentence_deviation - (2 / 9) ** 0.5) < 1e-9
    none = metrics.with_metrics(preparation.prepare(docs(spark, ""))).first()
    assert none.lexical_diversity == 0 and none.mean_sentence == 0 and none.formatting_density == 0


def test_numbers_take_no_trailing_percent_sign(spark):
    assert claims_of(spark, "It grew 75% in 2023 to 1,234.5x.").numbers == ["75", "2023", "1,234"]


def claims_of(spark, text):
    return claims.claims(preparation.prepare(docs(spark, text))).first()


def test_bands(spark):
    d = scoring.with_provenance(scoring.with_quality(scoring.measured(docs(spark, LONG, "Too short."))))
    long, short = d.orderBy("doc_id").collect()
    assert short.provenance_band == "insufficient_evidence" and short.provenance_confidence == 0.15
    assert long.provenance_band in ("low", "elevated") and 0 <= long.quality_score <= 100


def test_marks_alone_are_never_high(spark):
    text = "It is important to note that this plays a crucial role. " * 18
    assert scoring.with_provenance(scoring.measured(docs(spark, text))).first().provenance_band != "high"


def sources(spark, *texts):
    rows = [(0, i, str(i), t, None, None, None) for i, t in enumerate(texts)]
    return claims.normalized_sources(spark.createDataFrame(rows, "doc_id long, source_ord int, id string, text string, title string, url string, citation string"))


CLAIM = "The harbour project increased regional exports by 40 in Lisbon."


@pytest.mark.parametrize(
    ("source", "status"),
    [
        (CLAIM, "supported"),
        (CLAIM.replace("40", "55"), "partially_supported"),
        (CLAIM.replace("Lisbon", "Madrid"), "partially_supported"),
        (CLAIM.replace("increased", "did not increase"), "partially_supported"),
        (CLAIM + " The storm was not mild, and gardens were flooded.", "supported"),
        ("Gardens need water and light every morning.", "unsupported"),
        ("https://a.example/page", "not_checked"),
    ],
)
def test_claim_support(spark, source, status):
    found = claims.claims(preparation.prepare(docs(spark, CLAIM)))
    assert claims.claim_status(found, sources(spark, source)).first().status == status


def test_claim_rules(spark):
    text = "Is this a claim? We should repaint the door in Porto. Prices will rise in 2027. I think Porto is nice. [7] shows that Porto has 3 bridges."
    rows = claims.claims(preparation.prepare(docs(spark, text))).orderBy("place").collect()
    assert [r.type for r in rows] == ["recommendation", "prediction", "opinion", "factual"]
    review = claims.claim_review(claims.claim_status(claims.claims(preparation.prepare(docs(spark, text))), sources(spark))).first()
    assert review.claims == 4 and review.inline_only == 1 and review.source_band == "not_checked"


def judged(spark, text, *given):
    return claims.claim_status(claims.claims(preparation.prepare(docs(spark, text))), sources(spark, *given)).orderBy("place").collect()


def test_a_reference_behind_a_claim_counts_and_is_no_keyword(spark):
    rows = judged(spark, "The harbour project increased exports in Lisbon. See https://example.org/report.\n\nGardens need 3 lamps in Porto.")
    assert rows[0].status == "inline_citation_only" and rows[0].inline == ["https://example.org/report."] and rows[0].action == "provide_cited_material"
    assert rows[-1].inline == [] and "number_needs_support:3" in rows[-1].gaps
    cited = claims.claims(preparation.prepare(docs(spark, "The harbour of Lisbon was rebuilt [Silva20]."))).first()
    assert "silva" not in cited.keywords and cited.names == ["Lisbon"]


def test_steps_of_a_procedure_are_no_claims(spark):
    text = "1. Open the settings page that is shown.\n\n2. Select the language that is used.\n\n3. Wait for 5 minutes, as it is slow."
    assert [r.ord for r in claims.claims(preparation.prepare(docs(spark, text))).collect() if "Open" in r.claim or "Select" in r.claim] == []


def test_gaps_name_what_conflicts(spark):
    row = judged(spark, CLAIM, CLAIM.replace("40", "55"), "Gardens need water.")[0]
    assert row.status == "partially_supported" and row.gaps[:2] == ["partial_overlap", "number_mismatch:40"] and row.evidence == ["0"]
    assert judged(spark, CLAIM, "https://a.example/page")[0].gaps[0] == "sources_without_text" and judged(spark, CLAIM)[0].gaps[0] == "no_sources"
    best = judged(spark, CLAIM, "The harbour project is old.", CLAIM)[0]
    assert best.status == "supported" and best.evidence == ["1"] and best.action == "keep_visible"


def test_claims_stop_at_the_limit(spark):
    text = " ".join(f"Porto has {i} bridges." for i in range(40))
    assert claims.claims(preparation.prepare(docs(spark, text))).count() == claims.MOST_CLAIMS


def test_proofreading(spark):
    text = "the cat and and the dog will recieve  this in order to rest with that for you"
    d = preparation.with_language(preparation.prepare(docs(spark, text, "el perro y la casa que come wich")))
    rows = proofreading.issues(d).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.rule, r.found) for r in rows] == [(0, "1-misspelling", "recieve"), (0, "2-repeated", "and and"), (0, "3-spacing", "  "), (0, "4-wordy", "in order to")]
    assert all(text[r.start : r.end] == r.found for r in rows)
    base = proofreading.issues(d)
    assert proofreading.merged(base, base).count() == 4


PAGE = """<html><head><title>A &amp; B</title></head><body><nav><a href="/">Home page link</a></nav>
<main><article><h1>Story</h1>{}</article></main><footer>Bottom</footer></body></html>"""


def test_readable_page(spark):
    body = "".join(f"<p>{'word ' * 20}&quot;end&quot;.</p>" for _ in range(4))
    d = spark.createDataFrame([(1, PAGE.format(body)), (2, "<p>short</p>"), (3, None)], "page_id long, html string")
    one, two, three = pages.readable(d).orderBy("page_id").collect()
    assert one.chosen and "Home" not in one.text and "Bottom" not in one.text and '"end"' in one.text and one.confidence == 0.68
    assert not two.chosen and two.text == "short" and three.text == ""
    assert d.select(pages.page_title(F.col("html")).alias("t")).first().t == "A & B"


def test_address_guard(spark):
    hosts = {"127.0.0.1": True, "10.1.2.3": True, "172.31.0.1": True, "172.32.0.1": False, "8.8.8.8": False, "100.64.0.1": True, "224.0.0.1": True, "localhost": True, "printer.local": True, "a.example": False, "300.1.1.1": False}
    d = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", pages.is_private(F.col("host")).alias("p"))
    assert {r.host: r.p for r in d.collect()} == hosts
    urls = {"a.example/x": "https://a.example/x", " http://b.example ": "http://b.example", "ftp://c.example": None, "": None}
    d = spark.createDataFrame([(u,) for u in urls], "u string").select("u", pages.normalized_url(F.col("u")).alias("n"))
    assert {r.u: r.n for r in d.collect()} == urls


def test_editor_markup(spark):
    d = spark.createDataFrame([("<h2>Head</h2><p>One<br>two</p><ul><li>a</li><li>b</li></ul><!-- x -->",)], "m string")
    assert d.select(pages.editor_text(F.col("m")).alias("t")).first().t == "## Head\nOne\ntwo\n\n- a\n\n- b"


def test_spans_of_adjacent_matches(spark):
    r = spark.createDataFrame([("aXXbX",)], "t string").select(T.spans(F.col("t"), "X").alias("s")).first().s
    assert [(x.start, x.end) for x in r] == [(1, 2), (2, 3), (4, 5)]


def test_store_round_trip(spark, tmp_path):
    row = (1, dt.datetime(2024, 1, 2), "h", 5, "good", "low", 9)
    d = spark.createDataFrame([row], "id long, created_at timestamp, input_hash string, input_length int, quality_band string, provenance_band string, word_count int")
    store.save_reports(d, str(tmp_path / "s"))
    store.save_reports(d.withColumn("id", F.lit(2).cast("long")), str(tmp_path / "s"))
    kept = store.read_reports(spark, str(tmp_path / "s"))
    assert [r.id for r in store.list_reports(kept).collect()] == [2, 1]
    assert store.filter_reports(kept, quality=("good",), day_prefix="2024-01").count() == 2
    with pytest.raises(ValueError, match="word_count"):
        store.save_reports(d.drop("word_count"), str(tmp_path / "s"))


def test_renewing_limit_by_hand():
    ok, start, count = governance.decide([0, 10, 20, 30, 3700], None, 0, 3, 3600)
    assert ok == [True, True, True, False, True] and (start, count) == (3700, 1)
    assert governance.decide([100], 0, 3, 3, 3600)[0] == [False]


def test_streams(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(u, at + dt.timedelta(seconds=s), "h") for u, s in (("a", 0), ("a", 60), ("b", 5), ("a", 3599))]
    spark.createDataFrame(rows, "visitor string, ts timestamp, hash string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("visitor string, ts timestamp, hash string").parquet(str(tmp_path / "in"))
    for name, frame, want in (
        ("dedupe_out", governance.deduplicated(stream, ["visitor", "hash"], "ts"), 2),
        ("limit_out", governance.renewing_limit(stream, "visitor", "ts", limit=2), 4),
    ):
        q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == want
    assert spark.table("limit_out").filter("accepted").count() == 3


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)


def test_citation_proximity(spark):
    near, none = "The tower is 40 m high [12]. It was built early.", "The tower is 40 m high. It was built early."
    far = "The tower is 40 m high. " + "Bells ring loudly here now and then. " * 8 + "See [12]."
    got = [r.citation_proximity for r in metrics.with_metrics(preparation.prepare(docs(spark, near, none, far))).orderBy("doc_id").collect()]
    assert got == [1.0, 0.0, 0.5]


def test_sentences_of_a_long_line_without_a_closing_mark(spark):
    """A line without a mark at its end is read once; from each of its characters it would take minutes."""
    line = "word " * 60000
    docs = spark.createDataFrame([(1, line + "\nIt is 5. Ends" + line), (2, "a.b\n!c d?! e\nf")], "doc_id long, text string")
    began = time.perf_counter()
    found = preparation.sentence_rows(preparation.prepare(docs)).select("doc_id", "ord", "start", "end").collect()
    assert time.perf_counter() - began < 30
    n = len(line)
    assert [tuple(r) for r in found] == [(1, 0, n + 1, n + 9), (1, 1, n + 9, 2 * n + 14), (2, 0, 0, 2), (2, 1, 5, 10), (2, 2, 13, 14)]


def test_claims_of_a_text_of_many_sentences(spark):
    """Places are running totals, paragraphs are found by order: neither grows with the square of the sentences."""
    docs = spark.createDataFrame([(1, "# Head\n\n" + "Rome has 12 gates. " * 20000 + "\n\nIt was built in 753.")], "doc_id long, text string")
    began = time.perf_counter()
    found = claims.claims(preparation.prepare(docs), 1 << 30).select("start", "end", "paragraph", "section").collect()
    assert time.perf_counter() - began < 60
    assert len(found) == 20001 and tuple(found[0]) == (8, 26, 1, 1) and tuple(found[-1]) == (380010, 380030, 2, 1)


def test_running_totals_and_counts(spark):
    row = spark.range(1).select(
        T.running_totals(F.sequence(F.lit(1), F.lit(9))).alias("totals"), T.running_totals(F.array().cast("array<int>")).alias("none"),
        T.counts_upto(F.array(*map(F.lit, (0, 3, 4, 4, 9))), F.array(*map(F.lit, (1, 4, 10)))).alias("counts"),
    ).first()
    assert row["totals"] == [1, 3, 6, 10, 15, 21, 28, 36, 45] and row["none"] == [] and row["counts"] == [0, 1, 2, 2, 2]


def test_mixed_language_at_the_limit(spark):
    """55 of 100 are 0.55 of them, though 100 * 0.55 is more than 55 in floating point."""
    d = preparation.prepare(docs(spark, "the " * 100 + "el " * 55, "the " * 100 + "el " * 54))
    assert [r.language_mixed for r in preparation.with_language(d).orderBy("doc_id").collect()] == [True, False]


def test_spans_of_a_text_without_matches(spark):
    rows = spark.createDataFrame([("a [1] b",), ("",), ("plain",), (None,)], "t string").select(T.spans(F.col("t"), r"\[\d+\]").alias("s")).collect()
    assert [None if r.s is None else [tuple(x) for x in r.s] for r in rows] == [[("[1]", 2, 5)], [], [], None]


def test_counts_by_class_are_those_of_plain_patterns(spark):
    """One pattern and a look-up count what a pattern for each class would, also beside digits, marks and other letters."""
    import random
    import re
    from collections import Counter

    rng = random.Random(3)
    some = "may might open so that as a result debido a car since nation station3 _action mayß ßtion stationß a-may may's ity xity may2 many use reuse SHALL".split(" ")
    texts = ["".join(rng.choice(some) + rng.choice([" ", " ", "-", ". ", "_", "ß", "\n"]) for _ in range(80)) for _ in range(30)]
    d = metrics.with_metrics(preparation.prepare(docs(spark, *texts)))
    counts = d.select("doc_id", "low", "words", "n_hedges", "n_qualifiers", "n_actions", "n_nouns", "repeated_phrases", "repeated_4", metrics.causal_count(F.col("low"), F.col("counted")).alias("causal")).collect()

    def n(pattern, text):
        return len(re.findall(pattern, text))

    def whole(words):
        return rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"

    for r in counts:
        assert (r.n_hedges, r.n_qualifiers, r.n_actions, r.causal) == tuple(n(whole(x), r.low) for x in (X.HEDGES, X.QUALIFIERS, X.ACTIONS, X.CAUSAL))
        assert r.n_nouns == n(rf"(?<![A-Za-z0-9_])[^\W\d_]+(?:{X.NOUN_ENDINGS})(?![A-Za-z0-9_])", r.low)
        grams = {k: [g for i in range(len(r.words) - k + 1) if len(g := " ".join(r.words[i : i + k])) >= 4 * k] for k in (3, 4)}
        assert r.repeated_phrases == sum(v > 1 for v in Counter(grams[3]).values()) and r.repeated_4 == len(grams[4]) - len(set(grams[4]))


def test_lines_are_trimmed_once_for_all_metrics(spark):
    plan = metrics.with_metrics(preparation.prepare(docs(spark, "a"))).select(*metrics.NAMES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)^\s+") <= 2  # of lines and of paragraphs; it was one for each kind of line


def test_sentences_behind_the_last_claim_are_not_tested(spark):
    def even(x, i):
        return F.when(x > 5, F.raise_error(F.lit("tested")).cast("boolean")).otherwise(x % 2 == 0)

    xs = F.sequence(F.lit(1), F.lit(9))
    row = spark.range(1).select(T.first_where(xs, even, 2).alias("few"), T.first_where(xs, lambda x, i: x % 2 == 0, 1 << 30).alias("all"), T.first_where(F.array().cast("array<int>"), even, 2).alias("none")).first()
    assert (row["few"], row["all"], row["none"]) == ([1, 3], [1, 3, 5, 7], [])


def test_what_a_source_denies_is_told_once(spark):
    """A source is cut into sentences before its document's claims are joined to it, not for each claim."""
    plan = claims.claim_status(claims.claims(preparation.prepare(docs(spark, CLAIM))), sources(spark, CLAIM))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join ", 1)
    assert "(?<=[.!?])" not in above and "(?<=[.!?])" in below


def test_trimmed_takes_any_white_space_off_the_ends(spark):
    ends = ["", " ", "\n", "\t ", " ", " \r\n", "　 \x85"]
    inner = ["", "a", "a b", "a   b\n\nc", "\U0001f600", "x   y " * 3 + "z"]
    texts = [a + x + b for a in ends for x in inner for b in ends]
    assert [r.t for r in docs(spark, *texts).orderBy("doc_id").select(T.trimmed(F.col("text")).alias("t")).collect()] == [x.strip() for x in texts]


def test_patterns_that_branch_find_what_plain_ones_find(spark):
    import random
    import re

    rng = random.Random(5)
    pairs = [
        (claims.STALE, f"(?i){X.whole(X.STALE + '|' + '20[0-9]{2}')}"), (claims.SENSITIVE, f"(?i){X.whole(X.SENSITIVE)}"), (claims.NEGATED, f"(?i){X.whole(X.NEGATIONS)}"),
        (claims.VERBS, X.whole(X.CLAIM_VERBS)), (claims.DATES, f"(?i){X.whole(X.YEAR + '|today|currently|as of|latest|newest|now')}"),
        (claims.TELLING, X.whole("|".join([*(w for _, w in X.CLAIM_TYPES), X.ABSOLUTES]))),
    ]
    some = [w for x in (X.STALE, X.SENSITIVE, X.NEGATIONS.replace("lacks?", "lack|lacks"), X.CLAIM_VERBS, X.ABSOLUTES, *(w for _, w in X.CLAIM_TYPES)) for w in x.split("|")] + ["2024", "1999", "As Of", "NOW", "x", "is_", "éis"]
    for _ in range(3000):
        text = "".join(rng.choice(some) + rng.choice([" ", "-", "", "_", "é", "1", ". "]) for _ in range(3))
        for quick, plain in pairs:
            assert re.findall(quick, text) == re.findall(plain, text), (quick, text)


def test_references_and_white_space_leave_a_plain_sentence(spark):
    texts = ["It is so.", "It  is\tso.", "See [12] and https://a.example/x now.", "At doi: 10.1234/ab.c it is.", "It is."]
    assert [r.t for r in docs(spark, *texts).orderBy("doc_id").select(claims.without_references(F.col("text")).alias("t")).collect()] == ["It is so.", "It is so.", "See and now.", "At it is.", "It is."]


def test_places_are_looked_up_for_claims_only(spark):
    """No place of every sentence is put in order among the paragraphs; what stands behind a claim is cut only from a text that may refer."""
    d = docs(spark, "# Head\n\nRome has 3 hills.\n\n- Open the door.\n- It has 4 locks.\n\nParis is in France. See [7] there.", "Rome has 3 hills.\n\nIt had 5 kings [2] once. Why?", "")
    plan = claims.claims(preparation.prepare(d)).select("doc_id", "paragraph", "section")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan
    found = claims.claims(preparation.prepare(d)).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.claim, r.paragraph, r.section, r.inline) for r in found] == [
        (0, "Rome has 3 hills.", 1, 1, []), (0, "- It has 4 locks.", 2, 1, []), (0, "Paris is in France.", 3, 1, ["[7]"]), (0, "See [7] there.", 3, 1, ["[7]"]),
        (1, "Rome has 3 hills.", 0, 1, []), (1, "It had 5 kings [2] once.", 1, 1, ["[2]"]),
    ]


def test_search_by_halves_counts_what_is_not_behind(spark):
    from bisect import bisect_right

    for xs in ([], [0], [2, 2, 5], list(range(0, 40, 3))):
        starts = F.array(*map(F.lit, xs)).cast("array<int>")
        d = spark.range(-1, 45).select("id", T.count_upto(F.col("id"), starts, T.search_steps(starts)).alias("n"))
        assert all(r.n == bisect_right(xs, r.id) for r in d.collect())
