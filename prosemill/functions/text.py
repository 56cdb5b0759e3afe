"""Column functions over whole texts: normal forms, tokens, sentences, spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X


#: A fold that appends copies what it has found, so it is for so many elements at most.
FEW = 64


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def composed(text: Column) -> Column:
    """Canonical composition (NFC) by the ICU library that Spark carries.

    A text of characters before the first combining mark is composed already,
    so the call is made for the others only.
    """
    made = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(~is_ascii(text) & text.rlike("[^\\x00-\\u02FF]"), made).otherwise(text)


def normalized(text: Column) -> Column:
    """Line ends as line feeds, composed; null as the empty text."""
    given = F.coalesce(text, F.lit(""))
    return composed(F.when(given.contains("\r"), F.regexp_replace(given, "\r\n?", "\n")).otherwise(given))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters with an accent and their base letters, by Unicode decomposition."""
    marked, plain = [], []
    for c in map(chr, range(0xC0, 0x2000)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
        if len(base) == 1 and base != c:
            marked.append(c)
            plain.append(base)
    return "".join(marked), "".join(plain)


def without_accents(text: Column) -> Column:
    """Letters without their marks; a text of characters before the first letter with one has none."""
    marked, plain = _accents()
    return F.when(~is_ascii(text) & text.rlike("[^\\x00-\\xBF]"), F.regexp_replace(F.translate(text, marked, plain), r"\p{M}+", "")).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    Inside a lambda a plain column would be computed for every element again,
    since the optimiser puts an expression in the place where it is named once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def holds_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether any of ``parts`` stands anywhere in the text; a search for each is cheaper than one pattern of all."""
    return reduce(lambda a, b: a | b, [text.contains(x) for x in parts])


def count_where(text: Column, sign: Column, pattern: str) -> Column:
    """Matches of ``pattern`` in texts with ``sign``, which each match has; others are not searched."""
    return F.when(sign, count_of(text, pattern)).otherwise(0)


def word_tokens(text: Column) -> Column:
    """Lower-case words of an accent-free text."""
    # The small letter of a sigma goes by its word's end, so texts with one are cut first.
    cut_first = F.transform(all_matches(text, X.WORD), lambda w: F.lower(w))
    return F.when(text.contains("\u03a3"), cut_first).otherwise(all_matches(F.lower(text), X.WORD))


def sentence_texts(text: Column) -> Column:
    """Sentences with at least one word."""
    return F.filter(all_matches(text, X.SENTENCE), lambda s: s.rlike(r"[\p{L}\p{M}]"))


def trimmed(text: Column) -> Column:
    """White space of any kind taken off both ends."""
    # The end is looked for from behind, so no white space inside is tried.
    return F.regexp_extract(text, r"(?Us)^\s*+(.*\S)", 1)


def first_where(xs: Column, test: Callable[[Column, Column], Column], most: int) -> Column:
    """Places of the first ``most`` elements that pass a test of element and place; behind the last of few none is tested."""
    places = F.transform(xs, lambda x, i: i)
    if most > FEW:
        return F.slice(F.filter(places, lambda i: test(F.get(xs, i), i)), 1, most)

    def taken(found: Column, i: Column) -> Column:
        return F.when(F.size(found) >= most, found).when(test(F.get(xs, i), i), F.concat(found, F.array(i))).otherwise(found)

    return F.aggregate(places, F.array().cast("array<int>"), taken)


def running_totals(xs: Column) -> Column:
    """Totals up to each element, in as many passes as the size has binary digits.

    A fold that appends its totals would copy all of them for every element.
    """

    def passed(totals: Column, back: Column) -> Column:
        return F.transform(totals, lambda x, i: x + F.coalesce(F.get(totals, i - back), F.lit(0)))

    steps = F.array(*[F.lit(1 << k) for k in range(31)])
    return let(xs, lambda v: F.aggregate(F.filter(steps, lambda k: k < F.size(v)), v, passed))


def counts_upto(places: Column, starts: Column) -> Column:
    """For each of ``places`` how many of ``starts`` are not behind it; both ascend."""

    def at(xs: Column, kind: int) -> Column:
        return F.transform(xs, lambda x: F.struct(x.alias("at"), F.lit(kind).alias("place")))

    def counted(events: Column) -> Column:
        n = running_totals(F.transform(events, lambda e: 1 - e["place"]))
        both = F.filter(F.arrays_zip(events.alias("e"), n.alias("n")), lambda x: x["e"]["place"] == 1)
        return F.transform(both, lambda x: x["n"])

    return let(F.array_sort(F.concat(at(starts, 0), at(places, 1))), counted)


def search_steps(xs: Column | str) -> Column:
    """The steps of a search among ``xs`` by halves: powers of two up to their number, the largest first."""
    return F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda k: k <= F.size(xs))


def count_upto(place: Column, starts: Column | str, steps: Column | str) -> Column:
    """How many of the ascending ``starts`` are not behind a place, by :func:`search_steps` of them."""
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(F.get(starts, n + k - 1) <= place, n + k).otherwise(n))


def spans(text: Column, pattern: str) -> Column:
    """Matches with the code points at which they start and end.

    The gaps between matches and the matches alternate, so running totals of
    their lengths give the places.
    """
    found, gaps = all_matches(text, pattern), F.split(text, pattern, -1)

    def placed(pairs: Column) -> Column:
        def one(p: Column, end: Column) -> Column:
            return F.struct(p["found"].alias("text"), (end - F.length(p["found"])).alias("start"), end.alias("end"))

        ends = running_totals(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["found"])))
        return let(ends, lambda e: F.transform(pairs, lambda p, i: one(p, F.get(e, i))))

    # Most texts have none of the rarer marks, and then need not be cut.
    none = F.array().cast("array<struct<text:string,start:int,end:int>>")
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found")), lambda p: p["found"].isNotNull())
    return F.when(~text.rlike(pattern), none).otherwise(let(pairs, placed))


def spans_where(sign: Column, text: Column, pattern: str) -> Column:
    """``spans`` of texts with ``sign``, which each match has; others are not searched."""
    return F.when(~sign, F.array().cast("array<struct<text:string,start:int,end:int>>")).otherwise(spans(text, pattern))


def gap_spans(text: Column, pattern: str) -> Column:
    """What stands between matches, white space trimmed, with its place; empty gaps are dropped."""
    found, gaps = all_matches(text, pattern), F.split(text, pattern, -1)

    def size(p: Column) -> Column:
        return F.length(p["gap"]) + F.coalesce(F.length(p["found"]), F.lit(0))

    def placed(pairs: Column) -> Column:
        def one(p: Column, end: Column) -> Column:
            start = end - size(p) + F.length(F.regexp_extract(p["gap"], r"(?U)^\s+", 0))
            whole = F.struct(trimmed(p["gap"]).alias("text"), start.alias("start"))
            return let(whole, lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end")))

        ends = running_totals(F.transform(pairs, size))
        return let(ends, lambda e: F.transform(pairs, lambda p, i: one(p, F.get(e, i))))

    return F.filter(let(F.arrays_zip(gaps.alias("gap"), found.alias("found")), placed), lambda x: x["text"] != "")


def half_up(value: Column, places: int = 0) -> Column:
    """Rounding half towards plus infinity."""
    return F.floor(value * 10**places + F.lit(0.5)) / F.lit(float(10**places)) if places else F.floor(value + F.lit(0.5))


def clamp_score(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(value))).cast("int")


def over(a: Column, b: Column) -> Column:
    """a / max(1, b) as a double."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


def mean_of(xs: Column) -> Column:
    total = F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(xs) == 0, F.lit(0.0)).otherwise(total.cast("double") / F.size(xs))


def deviation_of(xs: Column) -> Column:
    """Population standard deviation of whole numbers, 0 under two of them; sums stay whole."""
    n = F.size(xs).cast("long")
    total = F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt((n * squares - total * total).cast("double")) / n)
