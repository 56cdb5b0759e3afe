"""Token counts, the audit of sources and the fill-in-middle form against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosemill.llm import fill_in_middle, source_audit, token_counts
from prosemill.llm.queries import ORACLE, QUERIES
from prosemill.llm.tokens import vocabulary_path

ODD = "doc_id long, text string, lang string, source string, n_tokens string, digest int, number string, term string, form int"
ALPHABET = "ab AB\n\t.,'!9é́ßİΣ字，。<|>　\xa0\x00s"


def odd_rows(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], ODD)


def plain_counts(name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path(name))
    return lambda text: len(library.encode(text or "", add_special_tokens=False).ids)


def odd_texts(seed, n, most):
    rng = random.Random(seed)
    bits = [*ALPHABET, "hello ", "World's ", "<|endoftext|>", "<|startoftext|>", "don't", "12 ", "漢字", "é "]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_are_the_librarys(spark, name):
    plain = plain_counts(name)
    texts = [None, "", " \n ", "a" * 3_000, "word " * 700, "字" * 900, "<|endoftext|>" * 90, *odd_texts(1, 60, 900)]
    docs = odd_rows(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[4], None, None)] * 3)
    # Small chunks, so that many are spliced, some not before overlaps have grown.
    got = token_counts.count_tokens(docs, vocabulary=vocabulary_path(name), huge_chars=300, chunk_chars=160, overlap_chars=48).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        text = texts[4] if r.doc_id is None else texts[r.doc_id]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (plain(text), len((text or "").encode()), plain(text) > 2048)


def test_counts_of_whole_texts_by_pieces():
    known, plain = token_counts.Rules(vocabulary_path("piece_bpe_32k.model")), token_counts.Rules(vocabulary_path())
    assert known.edge is None and known.counts(["Hello world", ""]) == [2, 0]
    assert plain.edge is token_counts.BYTE_EDGE


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=60), st.text(ALPHABET, max_size=60))
def test_proven_places_hold_in_any_surroundings(left, right):
    """Whatever stands around it, a proven place has a token's edge, and counts add up over it."""
    known = token_counts.rules(vocabulary_path("word_bpe_49k.json"))
    text = left + right
    for m in token_counts.WORD_EDGE.finditer(text):
        p = m.start()
        whole = known.library.encode(text, add_special_tokens=False)
        assert not any(a < p < b for a, b in whole.offsets)
        sides = [known.library.encode(t, add_special_tokens=False).ids for t in (text[:p], text[p:])]
        assert whole.ids == sides[0] + sides[1]


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(odd_rows(spark, [])).collect() == []


def test_chunks_cover_texts():
    for n in (1, 47, 48, 160, 161, 1_000):
        cut = token_counts.chunks(n, 160, 48)
        assert cut[0][0] == 0 and cut[-1][1] == n
        assert all(b == a + 160 and c == b - 48 for (a, b), (c, _) in zip(cut, cut[1:], strict=False))


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least, top):
    """The contract, row by row."""
    rows = [(x or "", y or "", z or "") for _, x, y, z in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = [(lang, source, TERM.findall(text.translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in terms}:
        df = Counter(t for x, _, found in terms if x == lang for t in set(found))
        kept = sorted(t for t, n in df.items() if n >= least)
        sources = sorted({s for x, s, _ in terms if x == lang})
        counts = {s: Counter() for s in sources}
        for x, s, found in terms:
            if x == lang:
                counts[s].update(t for t in found if t in set(kept))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            words = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", words)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def audit_rows(n=240):
    rng = random.Random(3)
    words = ["Ant", "bee", "cat's", "dÖg", "x1y", "漢字", "@", "egg_fog", "\x00", "ﬁn", "Z", "\U0001f600"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None])) for i in range(n)]
    return rows + [(None, "bee " * 5_000, "en", "huge"), (1, None, "en", "silent"), (1, None, "en", "silent"), (2, "only here", "xx", "a"), (2, "", "xx", "b")]


@pytest.mark.parametrize(("slice_bytes", "cells", "held"), [(source_audit.SLICE_BYTES, source_audit.BLOCK_CELLS, source_audit.HELD), (20, 7, 5)])
def test_audit_is_the_plain_one(spark, monkeypatch, slice_bytes, cells, held):
    for name, value in (("SLICE_BYTES", slice_bytes), ("BLOCK_CELLS", cells), ("HELD", held)):
        monkeypatch.setattr(source_audit, name, value)
    rows = audit_rows()
    got = source_audit.audit_sources(odd_rows(spark, rows), least_docs=30, top=4)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_audit(rows, 30, 4)


def test_audit_shares_do_not_overflow(spark):
    made = spark.createDataFrame([(10**13, 3 * 10**13, 1_000_000)], "c long, n long, v long")
    got = made.select(source_audit._share(F.col("c"), F.col("n"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 5 * 10**6)


def test_audit_of_an_empty_table(spark):
    assert source_audit.audit_sources(odd_rows(spark, [])).collect() == []


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    a, m, z = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return len(units), "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.none(), st.integers(-3, 10**6)), st.text(" \t\nab<>PSM\xa0字\x85\x1c", max_size=40))
def test_middle_is_the_plain_one(doc_id, text):
    output, form, n, prefix, middle = fill_in_middle.rearranged(text, doc_id)
    assert (n, form, prefix, middle, output) == plain_middle(doc_id, text)
    assert fill_in_middle.restored(output, form) == text


def test_middle_over_a_table(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "a", "x " * 200_000, "<S>", "<P", *("".join(rng.choices(" \n\tab<>PSM", k=rng.randrange(50))) for _ in range(150))]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "a b c", None, None)] * 2
    got = fill_in_middle.digests(odd_rows(spark, rows)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        n, form, prefix, middle, output = plain_middle(i, t)
        want.append((i, n, form, prefix, middle, sha(output), sha(t or "")))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_middle_of_an_empty_table(spark):
    assert fill_in_middle.digests(odd_rows(spark, [])).collect() == []


def test_new_queries_are_registered():
    assert {"op11_token_counts", "op12_source_audit", "op13_fill_in_middle"} <= QUERIES.keys()
    assert {"op12_source_audit", "op13_fill_in_middle"} <= ORACLE.keys()
