"""The pipeline's stages against a plain version of each on one fixture."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from prosemill.llm import mixing, quality_classifier, tokens

from .test_operators import brute_components, words_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for i in range(240):
        good = i % 4 > 0
        text = words_of(rng, rng.randint(60, 160))
        if not good:
            text = " ".join(w + rng.choice(("!!", "$$")) for w in text.upper().split())
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(300, "short text", "en", "s0", 10), (301, words_of(rng, 3) + " x y z" * 40, "en", "s1", 10)]
    base = rows[5][1].split()
    for i in range(12):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"new{i}"
        rows.append((400 + i, " ".join(copy), "en", "s2", 1))
    rows += [(500, None, "en", "s0", None), (501, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    (_, classify), (_, rules), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    model = quality_classifier.train(docs, spark.read.parquet(f"{path}/labels.parquet"))

    one = classify(spark, docs, path)
    assert one.columns == columns
    kept = {r.doc_id: r.text for r in one.collect()}
    assert set(kept) == {r[0] for r in rows if model.score(quality_classifier.indicators(r[1])) >= 0.3}
    assert set(kept).isdisjoint(range(0, 240, 4)) and set(kept) >= {i for i in range(240) if i % 4}

    two = rules(spark, one, path)
    assert two.columns == columns
    kept = {r.doc_id: r.text for r in two.collect()}
    assert set(kept) == {i for i in range(240) if i % 4} | set(range(400, 412))

    three = near(spark, two, path)
    assert three.columns == columns
    component = brute_components(sorted(kept.items()))
    kept = {r.doc_id: r for r in three.collect()}
    assert set(kept) == {c for _, c in component.values()}
    assert 5 in kept and set(kept).isdisjoint(range(400, 412))

    four = mix(spark, three, path)
    assert four.columns == columns
    size = Counter()
    for r in kept.values():
        size[r.source] += len(r.text.split())
    taken = Counter()
    for r in four.collect():
        assert kept[r.doc_id].text.split()[: len(r.text.split())] == r.text.split()
        taken[r.source] += len(r.text.split())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 3
    assert all(taken[s] <= 2 * size[s] + 1 for s in size) and taken["s0"] > taken["s2"]

    library = Tokenizer.from_file(tokens.vocabulary_path())
    want = Counter((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids) + 1) for r in four.collect())
    lengths, places = Counter(), {}
    for r in pack(spark, four, path).collect():
        lengths[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    totals = Counter()
    for (doc, n), times in want.items():
        totals[doc] += n * times
    assert lengths == totals
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_is_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def test_repeated_rows_leave_one(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").filter("doc_id in (1, 2)")
    out = corpus_pipeline.drop_near_duplicates(spark, docs.union(docs), folder[0])
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_rows_without_an_id_or_with_a_repeated_one(spark, folder):
    rng = random.Random(21)
    good = [words_of(rng, 120) for _ in range(4)]
    rows = [(None, good[0]), (None, good[0]), (None, good[1]), (None, "a b c"), (None, None), (7, good[2]), (7, good[3]), (7, good[3] + " end"), (8, good[2])]
    docs = spark.createDataFrame([(i, t, "en", "s0", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    ruled = corpus_pipeline.apply_quality_rules(spark, docs, folder[0])
    assert Counter((r.doc_id, r.text) for r in ruled.collect()) == Counter((i, t) for i, t in rows if t and len(t) > 10)
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder[0]).collect())
    # Three texts of id 7 make two groups of least id 7, so one document.
    assert left[(None, good[0])] == left[(None, good[1])] == 1 and (8, good[2]) not in left
    assert sum(n for (i, _), n in left.items() if i == 7) == 1


def test_mixed_rows_are_not_inflated_and_keep_their_lines(spark):
    rows = [(1, "a b\nc  d\te\n\nf g h", "x"), (1, "a b\nc  d\te\n\nf g h", "x"), (2, "i j k\nl", "y"), (None, "m\n n o", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_documents(docs)
    planned, got = Counter(), Counter()
    for r in plan.collect():
        planned[r.source] += r.taken
    for r in mixing.repeat_documents(docs, plan).collect():
        got[r.source] += len(r.text.split())
        assert any(t.startswith(r.text) for _, t, _ in rows)
    assert got == planned


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder[0]).count() == 0


def test_columns_of_any_name_are_carried_along(spark, folder):
    """Names that the stages use themselves, in a table where every stage has something to drop."""
    path, rows = folder
    names = ["text_hash", "key_0", "key_1", "size", "taken", "part", "of_id", "takes", "TEXT_HASH_", "a.b"]
    mine = spark.createDataFrame([(*r, *[f"{n}:{r[0]}" for n in names]) for r in rows + rows[5:8]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    docs = mine
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, path)
        assert docs.columns == mine.columns, name
        got = docs.collect()
        assert got and all(tuple(r)[5:] == tuple(f"{n}:{r.doc_id}" for n in names) for r in got), name
    assert corpus_pipeline.STAGES[4][1](spark, docs, path).count() > 0
