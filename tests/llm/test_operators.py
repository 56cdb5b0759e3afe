"""The ten operators against brute force, round trips and the odd rows every table holds."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from prosemill.llm import (
    components,
    fingerprints,
    html_blocks,
    html_extraction,
    licences,
    mixing,
    near_duplicates,
    packing,
    page_samples,
    quality_classifier,
    quality_rules,
    sharding,
    token_files,
    tokens,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, size string"


def words_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 60)) for _ in range(n))


def odd_rows(rng: random.Random) -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeats, and a long text; clashing extra columns."""
    long_text = words_of(rng, 6_000)
    same = words_of(rng, 80)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, same, "en", None), (5, same, "en", "b"), (5, same, "en", "b"),
        (6, long_text, None, None), (None, words_of(rng, 60), "en", "a"), (None, None, None, None), (7, "one", "en", "b"), (8, "é  ü\tx\n\ny", "de", "b"),
        (9, "before <|endoftext|> after", "en", "b"),
    ]
    rows += [(i, words_of(rng, rng.randint(1, 200)), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(10, 60)]
    return [(*r, 0, "k", 0, "s") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows(random.Random(3))
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def encode():
    return tokens.encoder(tokens.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    """The plain library, which the operators' encoder is compared with."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: plain.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_library(encode, library):
    texts = ["a b", "a\nb c", "  x", "x\ty", "", None, "a  b\tc", "it's 'll\nfoo's ###", "é ü. ñ! ", "<|endoftext|> a", "a b\u00a0c", "a b\nc", "don't. x)."]
    texts += ["hello <|endoftext|> world", "x<|endoftext|>", "a <|endof text|> b", "a<|endoftext|>\nb c d", "word " * 20_000]
    for text, ids in zip(texts, encode.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library(text)
    assert 50256 in np.frombuffer(encode.encode(["hello <|endoftext|> world"])[0], "<u4")


def test_encoder_is_the_library_on_fuzzed_texts(library):
    rng = random.Random(17)
    alphabet = "aaeiou tsrn   \n\n.,;:!?#*$%&|'\"0123ABZ\t\r\x0b\x85\u00a0\u2003\u3000éüßñøşİıКшдمرع中文字日本語한국어देवना\u0301\u0308\u200d\ufeff😀👩🏽\U00010348\x00\x7f"
    pieces = ["don't", "'s", "'LL", "x.y", "...", "--", "3.14", "<|endoftext|>", "<|endoftext", "naïve", "Ünï", "http://a.b/c?d=1#e"]
    texts = []
    for _ in range(3_000):
        parts = [rng.choice(pieces) if rng.random() < 0.2 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))]
        texts.append(rng.choice((" ", "\n", "")).join(parts))
    small = tokens.TextEncoder(tokens.vocabulary_path(), memo_pieces=500)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], small.encode(texts[at : at + 100]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library(text)


def test_encoder_forgets_and_still_agrees(library):
    small = tokens.TextEncoder(tokens.vocabulary_path(), memo_pieces=20)
    rng = random.Random(1)
    for _ in range(5):
        text = words_of(rng, 50) + "."
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == library(text)


def test_mix_is_capped_and_near_its_targets(odd):
    rows, df = odd
    out = mixing.mix_documents(df).collect()
    assert len(out) == len(rows)
    size = Counter()
    for _, text, _, source, *_ in rows:
        size[source] += len((text or "").encode().split())
    total = 1.5 * sum(size.values())
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, free = {}, set(size)
    left = total
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
        if not free:
            break
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
        assert math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert r.source_size == size[r.source]
    for s in size:
        assert abs(taken[s] - target[s]) <= 1
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix_documents(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in out}


def test_mixed_documents_hold_what_was_taken(odd):
    _, df = odd
    plan = mixing.mix_documents(df)
    out = mixing.repeat_documents(df.filter("doc_id > 9"), plan).collect()
    taken = {r.doc_id: r.taken for r in plan.collect()}
    got = Counter()
    for r in out:
        got[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in got.items()} == {k: v for k, v in taken.items() if k and k > 9 and v}


def test_lower_bound_never_passes_the_best_packing():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(1, 65, rng.integers(1, 60))
        bins, offsets, loads = packing.best_fit_decreasing(sizes, 64)
        assert packing.lower_bound(sizes, 64) <= len(loads)
        assert loads.max() <= 64
        assert np.bincount(bins, sizes).tolist() == loads.tolist()
    assert packing.lower_bound(np.array([40] * 10), 64) == 10
    assert packing.lower_bound(np.array([33, 33, 31, 31]), 64) == 2


def test_packing_round_trip(odd, library, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_BUCKET", 8)
    rows, df = odd
    out = packing.pack_documents(df, capacity=64, end_id=2, with_ids=True).collect()
    held = defaultdict(list)
    docs = defaultdict(list)
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        assert r.length <= 64
        held[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for doc, text in {(r[0], r[1]) for r in rows if r[0] not in (5, None)}:
        pieces = sorted(docs[doc], key=lambda r: r.piece)
        want = library(text) + [2]
        assert [i for p in pieces for i in p.ids] == want
        assert all(p.length == 64 for p in pieces[1:])
    assert len(docs[5]) == 2 * len({r.piece for r in docs[5]})
    total = sum(r.length for r in out)
    assert len(held) <= -(-total // 64) * 1.1 + 2


def test_karmarkar_karp_beats_greedy_and_covers_all():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 10_000, 400)
    parts = np.zeros((400, 8), np.int64)
    parts[:, 0] = sizes
    sums, places = sharding.combine(parts)
    assert np.bincount(places[:, 0], sizes, 8).astype(int).tolist() == sums.tolist()
    assert sums.max() - sums.min() <= 20


def test_sharding(odd, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_PER_BUCKET", 12)
    monkeypatch.setattr(sharding, "PARTIALS_PER_BUCKET", 2)
    rows, df = odd
    out = sharding.shard_documents(df, shards=4).collect()
    assert len(out) == len(rows)
    slots, groups, sizes = defaultdict(list), defaultdict(set), Counter()
    text = {r[0]: r[1] or "" for r in rows}
    for r in out:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        if r.doc_id is not None:
            assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
            groups[text[r.doc_id]].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    # Groups are indivisible, so shards differ by no more than the largest group.
    group_sizes = Counter()
    for r in rows:
        group_sizes[r[1] or ""] += len((r[1] or "").encode()) + 16
    assert sum(sizes.values()) == sum(group_sizes.values())
    assert max(sizes.values()) - min(sizes[i] for i in range(4)) <= max(group_sizes.values())


def test_shards_of_many_small_groups_are_even(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_PER_BUCKET", 100)
    rng = random.Random(2)
    df = spark.createDataFrame([(i, words_of(rng, rng.randint(1, 60))) for i in range(1_000)], "doc_id long, text string")
    sizes = [r[0] for r in sharding.shard_documents(df, shards=8).groupBy("shard").sum("size").select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 200


def test_token_files_round_trip(odd, library, spark, tmp_path):
    rows, df = odd
    files = token_files.write_token_files(df, path=f"file://{tmp_path}/t", length=16, file_bytes=4_000)
    assert files.parts.count() > 5
    got = sorted(files.documents().collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    at, left = 0, Counter()
    for r in rows:
        ids = library(r[1] or "") + [0]
        left[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for r in got:
        assert r.start == at
        left[r.doc_id, r.n_tokens, r.ids_crc32] -= 1
        at += r.n_tokens
    assert set(left.values()) == {0}
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    part = files.parts.filter("tokens > 16").first().part
    reader = token_files.SequenceReader(f"file://{tmp_path}/t/part-{part:06d}.arrows")
    again = reader.run(0, 3)
    ids, mask = reader.sequence(0)
    assert ids[:3].tolist() == again.tolist()
    assert not ids.flags.owndata and len(ids) == 16 and len(mask) == 16 and mask.to_pylist() == [True] * 16


@pytest.mark.parametrize("doc_id", [None, 7])
def test_token_files_of_many_rows_of_one_id(spark, tmp_path, doc_id):
    rng = random.Random(4)
    rows = [(doc_id, words_of(rng, 40)) for _ in range(800)] + [(doc_id, "same " * 60)] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    files = token_files.write_token_files(df, path=f"file://{tmp_path}/t", length=64, file_bytes=20_000)
    docs = [r.docs for r in files.parts.collect()]
    assert sum(docs) == len(rows) and len(docs) > 8 and max(docs) < 3 * np.median(docs)
    assert files.documents().count() == len(rows)


def brute_counts(text: str | None) -> tuple:
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rule_counts(odd, spark):
    rows, df = odd
    extra = [(100, "a b c a b c\nx y\nx y\n## <b>", "en", "a"), (101, "z z z z z", "en", "a"), (102, "a b c d " * 40, "en", "a")]
    df = df.unionByName(spark.createDataFrame([(*r, 0, "k", 0, "s") for r in extra], SCHEMA))
    out = quality_rules.quality_rules(df).collect()
    want = Counter(brute_counts(r[1]) for r in [*rows, *extra])
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_rule_counts_of_a_very_long_text(spark):
    # Of 400,000 distinct windows, 36 bits would take one or two for repeats; 64 bits none.
    text = " ".join(f"w{i}" for i in range(400_000))
    df = spark.createDataFrame([(0, text, "en", "a", 0, "k", 0, "s"), (1, text + " w1 w2 w3", "en", "a", 0, "k", 0, "s")], SCHEMA)
    out = quality_rules.base_statistics(df, "doc_id", "text", "lang", "source").collect()
    assert {r.doc_id: r.n_repeat_words for r in out} == {0: 0, 1: 6}


def test_quality_rules_reject_outliers_and_keep_the_rest(spark):
    rng = random.Random(5)
    rows = [(i, words_of(rng, rng.randint(60, 300)), "en", "ab"[i % 2]) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in words_of(rng, 100).split()), "en", "a") for i in range(60)]
    df = spark.createDataFrame([(*r, 0, "k", 0, "s") for r in rows], SCHEMA)
    kept = {r.doc_id for r in quality_rules.quality_rules(df).filter("kept").collect()}
    assert kept == set(range(400))


def test_quality_rules_reject_repeated_lines_or_windows_alone(spark):
    rng = random.Random(6)
    cut = lambda w, k: "\n".join(" ".join(w[i : i + k]) for i in range(0, len(w), k))
    rows = [(i, cut([f"w{rng.randrange(10**9):09d}" for _ in range(rng.randint(60, 300))], 10)) for i in range(400)]
    word = lambda: f"w{rng.randrange(10**9):09d}"
    lines = [*[f"{word()} {word()}" for _ in range(40)], *[word()] * 60]
    lines = [x for pair in zip(lines[:40], lines[40:80], strict=True) for x in pair] + [y for x in lines[80:] for y in (" ".join(word() for _ in range(3)), x)]
    rows.append((1000, "\n".join(lines)))
    some = [word() for _ in range(30)]
    rows.append((1001, cut([*some[:15], *[word() for _ in range(50)], *some[:15], *[word() for _ in range(120)], *some[15:], *[word() for _ in range(30)], *some[15:]], 7)))
    df = spark.createDataFrame([(*r, "en", "a", 0, "k", 0, "s") for r in rows], SCHEMA)
    out = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert not out[1000].base_failed and out[1000].n_repeat_words == 0 and out[1000].n_dup_lines == 59 and not out[1000].kept
    assert not out[1001].base_failed and out[1001].n_repeat_words == 60 and out[1001].n_dup_lines == 0 and not out[1001].kept
    assert sum(r.kept for r in out.values()) == 400


def test_chi_square():
    assert math.isclose(quality_rules.chi2_quantile(0.95, 4), 9.4877, abs_tol=1e-3)
    assert math.isclose(quality_rules.chi2_below(5.9915, 2), 0.95, abs_tol=1e-4)


def jaccard(a: str, b: str) -> float:
    x, y = Counter(a.split()), Counter(b.split())
    most = sum((x | y).values())
    return sum((x & y).values()) / most if most else 1.0


def test_gamma_quantiles():
    for x in (0.01, 0.5, 2.0, 9.0):
        assert fingerprints.gamma_quantile(1 - (1 + x) * math.exp(-x)) == pytest.approx(x, rel=1e-6)


def test_fingerprints(odd, spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 3) for _ in range(rng.randint(1, 120))), "en", "a", 0, "k", 0, "s") for i in range(150)]
    rows += [(200, "", "en", "a", 0, "k", 0, "s"), (201, None, "en", "a", 0, "k", 0, "s"), (202, rows[3][1], "en", "a", 0, "k", 0, "s"), (203, rows[3][1], "en", "a", 0, "k", 0, "s")]
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 500)
    monkeypatch.setattr(fingerprints, "RANGES_AT_ONCE", 4)
    out = fingerprints.fingerprint_with_edit(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.doc_id: r for r in out}
    texts = [(r[0], r[1] or "") for r in rows]
    errors = []
    for i, (doc, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    # At the registered number of samples the standard error is 0.044 at most.
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045
    assert got[3].fingerprint == got[202].fingerprint == got[203].fingerprint and got[202].near_next == 1
    assert got[200].fingerprint == "" and got[200].near_next == 1
    odd_out = fingerprints.fingerprint_with_edit(odd[1]).collect()
    assert len(odd_out) == len(odd[0])
    assert all(r.near_next is None for r in odd_out if r.doc_id is None)


def test_fingerprint_ranges_hold_little_of_any_ids(spark, monkeypatch):
    """Dense and sparse ids, one id many times, equal rows and rows without an id."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 4_000)
    rng = random.Random(6)
    rows = [(i, words_of(rng, 6)) for i in range(6_000)] + [(10**9 * (i + 1), words_of(rng, 6)) for i in range(300)]
    rows += [(77, words_of(rng, 6)) for _ in range(1_500)] + [(5 * 10**8, "equal rows of one id")] * 1_500 + [(None, "no id")] * 1_500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    df = df.withColumn("hash", fingerprints.F.xxhash64("text")).withColumn("origin", fingerprints.F.spark_partition_id())
    dealt, _, _ = fingerprints._ranges(df)
    held = dealt.groupBy("bucket").agg(fingerprints.F.sum(fingerprints.F.octet_length("text") + 64).alias("n"), fingerprints.F.min("doc_id").alias("a"), fingerprints.F.max("doc_id").alias("b"))
    held = sorted((r.bucket, r.n, r.a, r.b) for r in held.collect())
    sizes = [h[1] for h in held]
    # Equal rows of one part of the input can't be told apart: 1,500 of 84 bytes over 24 parts.
    assert max(sizes) <= 3 * 4_000 + 1_500 * 84 // 24 * 2 and dealt.count() == len(rows)
    ends = [(a, b) for _, _, a, b in held if a is not None]
    assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:], strict=False))


def test_fingerprints_of_many_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 600)
    rows = [(i // 40, f"word{i} " * 3) for i in range(120)] + [(9, "same text")] * 60 + [(None, "no id")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = fingerprints.fingerprint_with_edit(df, samples=8).collect()
    assert len(out) == len(rows)
    after = Counter(r.near_next for r in out if r.doc_id == 9)
    assert after[1.0] == 59 and sum(after.values()) == 60
    assert all(r.near_next is None for r in out if r.doc_id is None) and all(r.near_next == 0 for r in out if r.doc_id in (0, 1, 2))


def brute_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def cloud(rng: random.Random) -> list[tuple[int, str]]:
    """Edited copies of a few texts, at similarities on both sides of the threshold, and texts around one passage."""
    rows, doc = [], 0
    for base in range(4):
        text = words_of(rng, rng.choice((20, 60, 200))).split()
        for _ in range(40):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 18))):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 10**6)}"
            rows.append((doc, " ".join(copy)))
            doc += 1
    passage = words_of(rng, 55)
    for _ in range(40):
        rows.append((doc, f"{words_of(rng, rng.randint(0, 12))} {passage} {words_of(rng, rng.randint(0, 12))}"))
        doc += 1
    rows += [(doc, ""), (doc + 1, None), (doc + 2, "Two Words"), (doc + 3, "two words"), (doc + 4, rows[0][1].upper())]
    return rows


@pytest.mark.parametrize(("leaders", "small"), [(3, 48), (0, 2), (1, 10_000)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, leaders, small):
    monkeypatch.setattr(near_duplicates, "LEADERS", leaders)
    monkeypatch.setattr(near_duplicates, "SMALL_KEY", small)
    monkeypatch.setattr(near_duplicates, "BLOCK_NODES", 16)
    rows = cloud(random.Random(11))
    df = spark.createDataFrame([(d, t, "en", "a", 0, "k", 0, "s") for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_odd_rows(odd):
    rows, df = odd
    out = near_duplicates.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {r.component_id for r in out if r.doc_id in (4, 5)} == {4}
    assert all(r.kept and r.component_id == r.doc_id for r in out if r.doc_id in (1, 2, 3))


def test_near_duplicates_without_ids_keep_one_row(spark):
    text = words_of(random.Random(5), 30)
    df = spark.createDataFrame([(None, text), (None, text), (None, text + " more"), (None, None), (None, ""), (3, "other words")], "doc_id long, text string")
    out = near_duplicates.near_duplicates(df).collect()
    assert len(out) == 6 and all(r.component_id is None for r in out if r.doc_id is None)
    assert [r.kept for r in out if r.n_shingles > 20].count(True) == 1 and all(r.kept for r in out if r.n_shingles < 20)


def test_keys_reach_every_pair_within_the_distance():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 16, (200, near_duplicates.POSITIONS), dtype=np.uint16)
    y = x.copy()
    for i in range(200):
        at = rng.choice(near_duplicates.POSITIONS, 2 * near_duplicates.CHUNKS - 1, replace=False)
        y[i, at] ^= 1
    a, b = near_duplicates.chunk_keys(x), near_duplicates.chunk_keys(y)
    assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist(), strict=True))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201)]
    got = dict(components.connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}


def test_dual_coordinate_descent_finds_the_margin():
    rows = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0]))] * 10
    w = quality_classifier.dual_coordinate_descent(rows, np.array([1.0, -1.0] * 10), np.full(20, 1.0), 2, 50)
    assert w[0] == pytest.approx(1, abs=1e-3) and w[1] == pytest.approx(-1, abs=1e-3)


def test_ratios_descent_and_curve_against_plain_versions():
    rng = np.random.default_rng(7)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(60)]
    labels = np.array([int((r < 12).sum() > 3) for r in rows])
    counts = [[1 + sum(1 for r, y in zip(rows, labels, strict=True) if y == k and b in r) for b in range(40)] for k in (0, 1)]
    total = [sum(c) + (1 << quality_classifier.BITS) - 40 for c in counts]
    ratio = quality_classifier.log_count_ratios(rows, labels)
    for b in range(40):
        assert ratio[b] == pytest.approx(math.log(counts[1][b] / total[1] / (counts[0][b] / total[0])), abs=1e-5)
    # The dual of the hinge loss by many small projected steps.
    x = np.zeros((60, 40))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    signs = np.where(labels > 0, 1.0, -1.0)
    q = (x @ x.T) * np.outer(signs, signs)
    alpha = np.zeros(60)
    for _ in range(20_000):
        alpha = np.clip(alpha - 0.05 * (q @ alpha - 1), 0, 1)
    want = (alpha * signs) @ x
    units = [(r, x[i, r]) for i, r in enumerate(rows)]
    got = quality_classifier.dual_coordinate_descent(units, signs, np.ones(60), 40, 500)
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - signs * (x @ w)).sum()
    assert loss(got) <= loss(want) * 1.001
    margins = x @ got
    slope, offset = quality_classifier._logistic(margins, labels, np.ones(60))
    target = np.where(labels > 0, 1 - 1 / (2 + labels.sum()), 1 / (2 + 60 - labels.sum()))
    entropy = lambda a, b: -(target * np.log(1 / (1 + np.exp(-a * margins - b))) + (1 - target) * np.log(1 / (1 + np.exp(a * margins + b)))).sum()
    least = entropy(slope, offset)
    assert all(entropy(slope + da, offset + db) > least - 1e-2 for da in (-0.5, 0, 0.5) for db in (-0.5, 0, 0.5))


def brute_determinant(x: np.ndarray, v: np.ndarray, share: float, scale: float, rng) -> float:
    """The least determinant by concentration steps from many random subsets."""
    h, best = int(np.ceil(share * len(x))), math.inf
    for _ in range(40):
        some = rng.choice(len(x), 10, replace=False)
        for _ in range(60):
            mean, cov = x[some].mean(0), np.cov(x[some].T, bias=True) * (scale if len(some) == h else 1)
            d = x - mean
            d2 = np.array([di @ np.linalg.solve(cov + np.diag(vi), di) for di, vi in zip(d, v, strict=True)])
            new = np.argsort(d2, kind="stable")[:h]
            if set(new) == set(some):
                break
            some = new
        best = min(best, np.linalg.slogdet(np.cov(x[some].T, bias=True) * scale + np.diag(v[some].mean(0)))[1])
    return best


def test_least_determinant_is_that_of_many_random_starts(spark):
    rng = np.random.default_rng(11)
    n, names = 300, quality_rules.NAMES
    x = rng.normal(size=(n, 4)) * (0.2, 0.05, 0.1, 0.1) + (1.5, 0.2, 0.3, 0.2)
    x[:50] += (1.0, 0.3, 0.0, 0.4)
    v = np.full((n, 4), 1e-4)
    df = spark.createDataFrame([("g", *map(float, a), *map(float, b)) for a, b in zip(x, v, strict=True)], ["group", *names, *[f"v_{k}" for k in names]])
    fit = quality_rules.least_determinant(df, quality_rules.SUBSET, True).first()
    cov = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = fit[f"c{i}{j}"]
    scale = quality_rules.SUBSET / quality_rules.chi2_below(quality_rules.chi2_quantile(quality_rules.SUBSET, 4), 6)
    got = np.linalg.slogdet(cov + np.diag(v.mean(0)))[1]
    assert got <= brute_determinant(x, v, quality_rules.SUBSET, scale, rng) + 0.05
    assert all(abs(fit[f"m_{k}"] - m) < 0.05 for k, m in zip(names, (1.5, 0.2, 0.3, 0.2), strict=True))


def fit_of(row) -> tuple[np.ndarray, np.ndarray]:
    cov = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = row[f"c{i}{j}"]
    return np.array([row[f"m_{k}"] for k in quality_rules.NAMES]), cov


def noisy_members(spark, seed: int):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in (("a", 400), ("b", 150), ("c", 30)):
        v = rng.uniform(1e-4, 0.05, size=(n, 4))
        x = rng.normal(size=(n, 4)) * np.sqrt(0.01 + v) + rng.normal(size=4)
        x[: n // 6] += rng.normal(size=4) * 2
        rows += [(g, *map(float, a), *map(float, b)) for a, b in zip(x, v, strict=True)]
    return rows, spark.createDataFrame(rows, ["group", *quality_rules.NAMES, *[f"v_{k}" for k in quality_rules.NAMES]])


def test_no_step_raises_the_determinant_that_is_returned(spark, monkeypatch):
    rows, df = noisy_members(spark, 21)
    before = {}
    for most in (0, 1, 2, 4, 8):
        monkeypatch.setattr(quality_rules, "MOST_STEPS", most)
        fits = {r.group: r for r in quality_rules.least_determinant(df, quality_rules.SUBSET, True).collect()}
        assert set(fits) == {"a", "b", "c"}
        for g, r in fits.items():
            noise = np.mean([x[5:] for x in rows if x[0] == g], axis=0)
            assert r.logdet == pytest.approx(np.linalg.slogdet(fit_of(r)[1] + np.diag(noise))[1], abs=1e-6)
            assert r.logdet <= before.get(g, math.inf) + 1e-12
            before[g] = r.logdet


def test_verdicts_against_a_plain_version(spark):
    """``kept`` of every row, from determinants of many random starts."""
    rng = random.Random(17)
    docs = []
    for i in range(420):
        text = words_of(rng, rng.randint(60, 300))
        if i % 12 == 0:
            text = " ".join(w + rng.choice(("##", "$", "&&&")) * (1 + i % 3) for w in text.split())
        if i % 15 == 0:
            text = "\n".join([*text.split(" "), *["again and again"] * (i % 40)])
        docs.append((i, text, "en" if i % 3 else "de", "s" if i % 2 else "t", 0, "k", 0, "s"))
    out = quality_rules.quality_rules(spark.createDataFrame(docs, SCHEMA)).collect()
    q, groups = quality_rules, defaultdict(list)
    for r in out:
        if not r.base_failed:
            groups[r.lang, r.source].append(r)
    plain = np.random.default_rng(2)
    checked = 0
    for (lang, _), rows in groups.items():
        fitted = rows if len(rows) >= q.LEAST_GROUP else [r for (x, _), y in groups.items() if x == lang for r in y]
        assert len(fitted) >= q.LEAST_GROUP
        lines = {i: len([x for x in t.split("\n") if x.split()]) for i, t, *_ in docs}

        def vectors(some):
            w, c = np.array([r.n_words for r in some]), np.array([r.word_chars for r in some])
            n = np.array([lines[r.doc_id] for r in some])
            x = np.stack([np.log(c / w), np.sqrt([r.n_symbols for r in some] / c), np.sqrt([r.n_dup_lines for r in some] / n), np.sqrt([r.n_repeat_words for r in some] / w)], 1)
            v = np.stack([0.25 / w, 0.25 / c, 0.25 / n, 0.25 * q.WINDOW_WORDS / w], 1) + np.square(list(q.FLOORS.values()))
            return x, v

        x, v = vectors(fitted)
        h, scale = math.ceil(q.SUBSET * len(x)), q.SUBSET / q.chi2_below(q.chi2_quantile(q.SUBSET, 4), 6)
        best = (math.inf, None, None)
        for _ in range(60):
            some = plain.choice(len(x), 5, replace=False)
            for _ in range(40):
                m, s = x[some].mean(0), np.cov(x[some].T, bias=True) * scale
                z = x - m
                d2 = np.einsum("ij,jk,ik->i", z, np.linalg.inv(s + np.diag(v.mean(0))), z)
                some = np.argsort(d2, kind="stable")[:h]
            m, s = x[some].mean(0), np.cov(x[some].T, bias=True) * scale
            best = min(best, (np.linalg.slogdet(s + np.diag(v.mean(0)))[1], m.tolist(), s.tolist()))

        def distances(x, v, m, s):
            return np.array([(a - m) @ np.linalg.inv(s + np.diag(b)) @ (a - m) for a, b in zip(x, v, strict=True)])

        inner = x[distances(x, v, np.array(best[1]), np.array(best[2])) <= q.chi2_quantile(q.REWEIGHT, 4)]
        m, s = inner.mean(0), np.cov(inner.T, bias=True)
        for r, d2 in zip(rows, distances(*vectors(rows), m, s), strict=True):
            # The subset is cut on a grid, so a row at the edge of the quantile may fall on either side.
            if abs(d2 / q.chi2_quantile(q.CUTOFF, 4) - 1) > 0.1:
                assert r.kept == (d2 <= q.chi2_quantile(q.CUTOFF, 4))
                checked += 1
    assert checked > 380 and 10 < sum(not r.kept for r in out) < 80


def test_classifier_on_held_out_rows(spark, odd, empty):
    rng = random.Random(4)
    rows = [(i, words_of(rng, 60) if i % 3 else " ".join([rng.choice(("BUY!!", "win$$")) for _ in range(30)] + [words_of(rng, 30)]), "en", "a", 0, "k", 0, "s") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    out = quality_classifier.score_documents(docs, model).collect()
    apart = [r for r in out if r.held_out]
    assert {r.doc_id for r in apart} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == int(r.doc_id % 3 > 0) and 0 <= r.score <= 1 for r in apart)
    assert quality_classifier.keep_good(docs, model).count() == 200
    assert quality_classifier.score_documents(odd[1], model).count() == len(odd[0])
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score_documents(docs, none).collect()} == {0.5}
    assert quality_classifier.score_documents(empty, model).count() == 0


def test_extraction_on_unseen_pages():
    field = html_extraction.default_field()
    right = total = 0
    for page, main in page_samples.labelled_pages(150, seed=77):
        want = "\n".join(" ".join(x.split()) for x in main)
        right += field.main_text(page) == want
        total += 1
    assert right / total > 0.85


def test_blocks_decode_and_close():
    page = "<body><p>a &amp; b&nbsp;c<p><b>d\n e<br>f</b><div>g<script>var x='</p>';</script>h</div><ul><li>i<li>j</ul><!-- k --><p>l &#233;"
    assert [b.text for b in html_blocks.blocks(page)] == ["a & b c", "d e f", "gh", "i", "j", "l é"]
    assert html_blocks.blocks(None) == [] and html_blocks.blocks("plain text")[0].text == "plain text"


def test_pages_with_odd_rows(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>Some prose, with words. And more.</p></article><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", page)]
    out = html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "T\nSome prose, with words. And more."
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, text, len(text)), (2, "", 0), (3, text, len(text))]


def test_licences(spark, odd):
    mit = dict((i, t) for i, t in reversed(licences.KNOWN))["MIT"]
    changed = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,").replace("LICENSE", "LICENCE")
    prose = "Copyright is a right of authors, and it lapses.\n" + mit
    rows = [(1, mit), (2, changed), (3, mit + " more"), (4, "prose\nReleased under the MIT Licence\nAll rights reserved."), (5, None), (None, "All rights reserved.")]
    rows += [(6, prose), (7, "COPYRIGHT © Some Holder\n" + mit), (8, "words " * 100_000 + "\nSPDX-License-Identifier: MIT"), (4, "prose")]
    found = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_notices for r in found if r.doc_id == 4) == [0, 2]
    out = {r.doc_id: r for r in found if r.doc_id != 4 or r.n_notices}
    assert out[6].licence is None and out[7].licence == "MIT" and (out[8].licence, out[8].notices) == (None, "MIT")
    assert out[1].licence == out[2].licence == "MIT" and out[3].licence is None
    assert (out[4].notices, out[4].n_notices) == ("MIT,reserved", 2) and out[5].licence is None and (out[None].licence, out[None].n_notices) == ("reserved", 1)
    for _, text in licences.KNOWN:
        assert any(w in text.lower() for w in licences.MARK_WORDS)
    assert licences.scan_licences(odd[1]).count() == len(odd[0])


def test_licences_by_their_full_texts(spark):
    bsd = "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\n\n" + licences._BSD.format(licences._NAMES).replace("1. ", "\n1. ")
    rows = [(1, bsd), (2, licences._BSD.format(""))]
    files = {i: t for i, t in licences.KNOWN if len(t) > 5_000}
    rows += [(10 + k, t.upper().replace("\n", "\n  ")) for k, t in enumerate(files.values())]
    out = {r.doc_id: r.licence for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1], out[2]) == ("BSD-3-Clause", "BSD-2-Clause")
    short = [(k, "\n\n" + t.replace(". ", ".\n")) for k, (_, t) in enumerate(licences.KNOWN) if 400 < len(t) < 5_000]
    got = {r.doc_id: r.licence for r in licences.scan_licences(spark.createDataFrame(short, "doc_id long, text string")).collect()}
    assert all(got[k] == licences.KNOWN[k][0] for k, _ in short) and {"Unlicense", "Zlib", "BSL-1.0", "MIT-0", "ISC", "0BSD"} <= set(got.values())
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(files)
    assert [out[10 + k] for k in range(len(files))] == list(files)


def test_empty_tables(empty, spark):
    assert mixing.mix_documents(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert token_files.write_token_files(empty).documents().count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    assert fingerprints.fingerprint_with_edit(empty).count() == 0
    assert near_duplicates.near_duplicates(empty).count() == 0
    assert licences.scan_licences(empty).count() == 0
    assert html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_reader_fetches_any_batch(tmp_path):
    length, n = 4, token_files.BATCH_ROWS * 4 * 3 + 7
    with pa.OSFile(f"{tmp_path}/x", "wb") as sink:
        writer = token_files.SequenceWriter(sink, token_files.sequence_schema(50_000, length), length)
        for i in range(0, n, 100):
            writer.add(np.arange(i, min(n, i + 100)))
        writer.close()
    reader = token_files.SequenceReader(f"file://{tmp_path}/x")
    for i in (0, 129, 3, 384, 300, 385):
        ids, mask = reader.sequence(i)
        assert [x for x, m in zip(ids.tolist(), mask.to_pylist(), strict=True) if m] == list(range(4 * i, min(n, 4 * i + 4)))
    assert reader.run(500, 600).tolist() == list(range(500, 1100))


def test_arrow_sink_pads_only_the_last_row():
    sink = pa.BufferOutputStream()
    writer = token_files.SequenceWriter(sink, token_files.sequence_schema(50_000, 4), 4)
    writer.add(np.arange(6))
    writer.close()
    table = pa.ipc.open_stream(sink.getvalue()).read_all()
    assert table.column("ids").to_pylist() == [[0, 1, 2, 3], [4, 5, 0, 0]] and table.column("mask").to_pylist()[1] == [True, True, False, False]


#: Pages written by hand, each with the text that belongs to its article.
LAYOUTS = {
    "one paragraph": ("<article><p>body text, long enough here.</p></article>", ["body text, long enough here."]),
    "linked list": (
        "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav><article><h1>Ten towns to see</h1><p>We went to ten towns, and liked most of them. Here they are.</p>"
        "<ul><li><a href=/1>Northwick by the sea</a></li><li><a href=/2>Old Harrow and its market</a></li></ul><p>That is the list, in no order.</p></article><footer>&copy; 2024 Site</footer></body></html>",
        ["Ten towns to see", "We went to ten towns, and liked most of them. Here they are.", "Northwick by the sea", "Old Harrow and its market", "That is the list, in no order."],
    ),
    "raw elements": (
        "<body><article><h1>Energy</h1><p>Mass and energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> are one, as is well known.</p>"
        "<p>An icon <svg><g><svg><text>inner</text></svg><text>outer</text></g></svg> stands here, inside the sentence.</p><script>if (a < b) { x = '</p>' }</script></article></body>",
        ["Energy", "Mass and energy E=m are one, as is well known.", "An icon stands here, inside the sentence."],
    ),
    "unclosed": ("<body><article><p>First part of the text, as it is.<svg><p>The rest of it follows, after an icon left open.</article>", ["First part of the text, as it is.", "The rest of it follows, after an icon left open."]),
    "apostrophes": ("<div class=post title=it's><p>It's a text with a quote, and that's all of it.</p><p>Another one follows, isn't it.</p></div>", ["It's a text with a quote, and that's all of it.", "Another one follows, isn't it."]),
    "blog": (
        '<html><body><div class="site-header"><a href="/">My site</a></div><div id="menu"><a href=/a>About</a> | <a href=/c>Contact</a></div><div class="post"><h2>A walk in the hills</h2>'
        '<div class="entry-content"><p>We set out early, before the sun was up, and took the old road.</p><blockquote><p>The hills are older than the road, said the guide.</p></blockquote><p>It rained, of course. We went on.</p></div>'
        '<div class="share-buttons">Share this <a href=#>Mail</a></div></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>Lovely walk, thank you for telling us.</p></div></div><div id="sidebar"><h3>Archive</h3><ul><li><a href=/1>May</a></li></ul></div></body></html>',
        ["A walk in the hills", "We set out early, before the sun was up, and took the old road.", "The hills are older than the road, said the guide.", "It rained, of course. We went on."],
    ),
    "main with aside": (
        "<body><header><h1>Daily News</h1></header><main><h1>Council votes on bridge</h1><p>The council voted on Monday to mend the bridge, after a long debate.</p><aside><h4>More news</h4><p>Read about the harbour.</p></aside>"
        "<p>Work begins in spring, and should last two years.</p></main><form><label>Mail</label><input><button>Subscribe</button></form><footer><p>&copy; Daily News</p></footer></body>",
        ["Council votes on bridge", "The council voted on Monday to mend the bridge, after a long debate.", "Work begins in spring, and should last two years."],
    ),
    "page builder": (
        '<body><div class="elementor-section"><div class="elementor-widget-wrap"><div class="elementor-widget-text"><p>Our workshop has made chairs since the war, all of them by hand.</p></div></div></div>'
        '<div class="elementor-section"><div class="elementor-column"><p>Each takes a week, and the wood comes from the valley.</p></div></div><div class="elementor-share"><span>Share this</span></div><div class="footer">&copy; 2020 Workshop</div></body>',
        ["Our workshop has made chairs since the war, all of them by hand.", "Each takes a week, and the wood comes from the valley."],
    ),
    "notices": (
        '<body><div class="cookie-banner"><p>We use cookies to improve this site. Please accept them.</p><button>Accept</button></div><article><h1>Soup</h1><p>Take onions, leeks and a little salt; cook them for an hour.</p><ol><li>Cut the onions.</li><li>Heat the butter.</li></ol>'
        '<div class="ad">Buy the best pots today!</div><p>Serve it hot, with bread.</p></article><div class="newsletter"><p>Get one recipe a week.</p></div></body>',
        ["Soup", "Take onions, leeks and a little salt; cook them for an hour.", "Cut the onions.", "Heat the butter.", "Serve it hot, with bread."],
    ),
    "comments in article": (
        '<html><body><article><h1>On patience</h1><p>Patience is a habit, and habits are made slowly.</p><p>It helps to wait.</p><section class="comments"><h3>Comments</h3><ul><li><p>I could not agree more with this.</p></li><li><p>Nor could I, to be honest.</p></li></ul></section></article><aside class="related"><h3>Related posts</h3><ul><li><a href=/x>On haste</a></li></ul></aside></body></html>',
        ["On patience", "Patience is a habit, and habits are made slowly.", "It helps to wait."],
    ),
    "references": (
        "<body><article><h1>Caf&#233; &amp; th&eacute;</h1><p>Prices&nbsp;rose\n by 5&#x25;, they &lt;say&gt;.</p><p>See <a href=/r>the report of the bureau</a> for more, or ask.</p></article></body>",
        ["Café & thé", "Prices rose by 5%, they <say>.", "See the report of the bureau for more, or ask."],
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_by_hand(name):
    page, want = LAYOUTS[name]
    assert html_extraction.default_field().main_text(page).split("\n") == want


def test_viterbi_and_gradient_against_enumeration():
    rng = np.random.default_rng(4)
    chain = [html_blocks.Block((html_blocks.Node("p", (f"w{i % 3}",)),), "text " * (i + 1), 0) for i in range(7)]
    for _ in range(20):
        weights = {f: float(rng.normal()) for b in chain for f in html_extraction.path_features(b.path) + html_extraction.text_features(b)}
        field = html_extraction.Field(weights, rng.normal(size=(2, 2)), rng.normal(size=2))

        def score(labels, field=field):
            total = field.start[labels[0]] + sum(field.emission(b) for b, y in zip(chain, labels, strict=True) if y)
            return total + sum(field.moves[p, q] for p, q in zip(labels, labels[1:], strict=False))

        every = [tuple(i >> k & 1 for k in range(7)) for i in range(128)]
        assert tuple(map(int, field.decode(chain))) == max(every, key=score)
    # One plain step up the likelihood of two pages, by the sums over all labellings.
    pages = [("<article><p>one two.</p><p>three</p></article><nav><a>x</a></nav>", ["one two.", "three"]), ("<nav><a>y</a></nav><p>four five.</p>", ["four five."])]
    field = html_extraction.fit(pages, steps=400, rate=0.05, ridge=0.05)

    def loss(f):
        out = 0.025 * (sum(w * w for w in f.weights.values()) + (f.moves**2).sum() + (f.start**2).sum())
        for page, main in pages:
            found = html_blocks.blocks(page)
            gold = html_extraction._labels(found, main)

            def score(labels, found=found):
                total = f.start[labels[0]] + sum(f.emission(b) for b, y in zip(found, labels, strict=True) if y)
                return total + sum(f.moves[p, q] for p, q in zip(labels, labels[1:], strict=False))

            every = [tuple(i >> k & 1 for k in range(len(found))) for i in range(2 ** len(found))]
            out += (math.log(sum(math.exp(score(y)) for y in every)) - score(gold)) / len(pages)
        return out

    least = loss(field)
    for name in list(field.weights)[:6]:
        for step in (-0.05, 0.05):
            other = html_extraction.Field({**field.weights, name: field.weights[name] + step}, field.moves, field.start)
            assert loss(other) > least
    for i in range(2):
        for j in range(2):
            moved = field.moves.copy()
            moved[i, j] += 0.05
            assert loss(html_extraction.Field(field.weights, moved, field.start)) > least


def test_many_open_tags_cost_no_square():
    for page in ("<x " * 200_000, "<svg>" * 50_000 + "text", "<a '" * 100_000, "a<" * 300_000, "<!--" + "<p>x" * 50_000):
        html_blocks.blocks(page)


def test_a_very_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>Sentence {i} of the text, as long as others.</p>" for i in range(20_000)) + "</article>"
    assert html_extraction.default_field().main_text(page).count("\n") == 19_999
