"""The metrics of a prepared text, as one projection of in-row expressions.

Counts of repeats are sizes less distinct sizes, so nothing is exploded or
shuffled.  ``with_metrics`` computes every metric; ``GROUPS`` names them by
kind for queries that want a few, of which Catalyst prunes the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T
from .preparation import structure_counts, trimmed_lines

GROUPS: dict[str, tuple[str, ...]] = {
    "lexical": ("n_words", "n_distinct", "lexical_diversity", "normalized_diversity", "repeated_word_rate"),
    "ngrams": ("repeated_phrases", "repeated_2", "repeated_3", "repeated_4", "repeated_5"),
    "openings": ("repeated_openings",),
    "sentences": ("n_sentences", "mean_sentence", "max_sentence", "long_sentence_rate", "very_long_sentences", "sentence_deviation", "sentence_variation"),
    "paragraphs": ("n_paragraphs", "mean_paragraph", "max_paragraph", "long_paragraph_rate", "paragraph_deviation", "paragraph_variation"),
    "style": ("hedge_density", "qualifier_density", "passive_rate", "noun_density", "action_density"),
    "specific": ("n_names", "n_dates", "n_numbers", "name_density", "date_density", "number_density"),
    "evidence": ("claim_like", "citations", "urls", "evidence_density", "citation_proximity", "quote_density"),
    "format": ("headings", "list_items", "table_lines", "quote_lines", "heading_coverage", "formatting_density"),
}
NAMES = tuple(x for names in GROUPS.values() for x in names)


def grams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces, of at least 4 n characters."""

    # Not slice(), which copies the whole array each time; a run beyond the end is null, and no null is kept.
    def joined(w: Column, i: Column) -> Column:
        return F.concat(w, *[x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))])

    return F.filter(F.transform(words, joined), lambda g: F.length(g) >= 4 * n)


def repeats(xs: Column) -> Column:
    """How many elements equal an earlier one."""
    return F.size(xs) - F.size(F.array_distinct(xs))


def repeated_kinds(xs: Column) -> Column:
    """How many different elements occur more than once: those in order that begin a run of two or more."""

    def begins(v: Column) -> Callable[[Column, Column], Column]:
        return lambda x, i: (x == F.get(v, i + 1)) & ((i == 0) | (x != F.get(v, i - 1)))

    return T.let(F.sort_array(xs), lambda v: F.size(F.filter(v, begins(v))))


#: Single words that are counted by class: found by one pattern, told apart by a look-up.
CAUSAL_WORDS = tuple(w for w in X.CAUSAL.split("|") if " " not in w)
CAUSAL_PHRASES = tuple(w for w in X.CAUSAL.split("|") if " " in w)
COUNTED = sorted({w for listed in (X.HEDGES, X.QUALIFIERS, X.ACTIONS) for w in listed.split("|")} | set(CAUSAL_WORDS))


def counted_words(low: Column) -> Column:
    """The words of ``COUNTED`` in a small-letter text, in order; each is a whole run of ASCII letters, digits and underscores."""
    return T.all_matches(low, X.whole(X.by_beginning(COUNTED)))


def n_of(found: Column, listed: Iterable[str]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(*listed)))


def causal_count(low: Column, found: Column) -> Column:
    """Causal words and phrases; no phrase overlaps another or holds one of the words."""
    return sum([T.count_where(low, low.contains(p), X.whole(p)) for p in CAUSAL_PHRASES], n_of(found, CAUSAL_WORDS))


def noun_count(low: Column) -> Column:
    """Words with a noun's ending; in an ASCII text a word ends at one place only, so none is read again from behind."""
    plain = rf"{X.START}[a-z]++{X.END}(?<=[a-z](?:{X.NOUN_ENDINGS}))"
    any_ = rf"{X.START}[\p{{L}}\p{{M}}]+(?:{X.NOUN_ENDINGS}){X.END}"
    return F.when(T.is_ascii(low), T.count_of(low, plain)).otherwise(T.count_of(low, any_))


def with_metrics(prepared: DataFrame) -> DataFrame:
    """Adds every metric of ``NAMES`` to a prepared table."""
    d = prepared.withColumn("grams_3", grams(F.col("words"), 3))
    # Columns that are named more than once stay columns; as expressions they would be computed for each mention.
    d = d.withColumn("sentence_words", F.transform("sentences", lambda s: T.all_matches(T.without_accents(s), X.WORD)))
    d = d.withColumn("openings", F.filter(F.transform("sentence_words", _opening), lambda o: F.length(o) >= 6))
    d = d.withColumn("sentence_sizes", F.transform("sentence_words", lambda s: F.size(s).cast("long")))
    parts = F.filter(F.transform(F.split("norm", "\n{2,}"), lambda p: T.trimmed(p)), lambda p: p != "")
    d = d.withColumn("paragraph_sizes", F.transform(parts, lambda p: F.size(T.all_matches(p, r"\S+")).cast("long")))
    d = d.withColumn("trimmed_lines", trimmed_lines()).withColumn("counted", counted_words(F.col("low")))
    d = d.withColumns(structure_counts(F.col("trimmed_lines")))
    # What a citation or an address cannot do without.
    cited, linked = T.holds_any(F.col("low"), ("[", "(", "doi:")), F.col("low").contains("://")
    d = d.withColumns({"citation_spans": T.spans_where(cited, F.col("norm"), X.CITATION), "url_spans": T.spans_where(linked, F.col("norm"), X.URL)})
    words, low, norm = F.col("words"), F.col("low"), F.col("norm")
    n, sizes, psizes = F.size("words"), F.col("sentence_sizes"), F.col("paragraph_sizes")
    long_words = F.filter(words, lambda w: F.length(w) >= 4)
    d = d.withColumns(
        {
            "n_words": n,
            "n_distinct": F.size(F.array_distinct(words)),
            "n_sentences": F.size("sentences"),
            "n_paragraphs": F.size(psizes),
            "repeated_phrases": repeated_kinds(F.col("grams_3")),
            **{f"repeated_{k}": repeats(grams(words, k)) for k in (2, 3, 4, 5)},
            "repeated_openings": repeated_kinds(F.col("openings")),
            "repeated_words": repeats(long_words),
            "mean_sentence": T.mean_of(sizes),
            "max_sentence": F.coalesce(F.array_max(sizes), F.lit(0)),
            "very_long_sentences": F.size(F.filter(sizes, lambda x: x > 35)),
            "long_sentences": F.size(F.filter(sizes, lambda x: x > 25)),
            "sentence_deviation": T.deviation_of(sizes),
            "mean_paragraph": T.mean_of(psizes),
            "max_paragraph": F.coalesce(F.array_max(psizes), F.lit(0)),
            "long_paragraphs": F.size(F.filter(psizes, lambda x: x > 120)),
            "paragraph_deviation": T.deviation_of(psizes),
            "n_hedges": n_of(F.col("counted"), X.HEDGES.split("|")),
            "n_qualifiers": n_of(F.col("counted"), X.QUALIFIERS.split("|")),
            "n_passives": T.count_of(low, X.whole(r"(?:is|are|was|were|be|been|being)\s+[a-z]+(?:ed|en)|(?:is|are|was|were)\s+being\s+[a-z]+(?:ed|en)")),
            "n_nouns": noun_count(low),
            "n_actions": n_of(F.col("counted"), X.ACTIONS.split("|")),
            "n_names": T.count_of(norm, X.NAME),
            "n_dates": T.count_of(norm, "(?=[12A-S])" + X.whole(rf"20\d{{2}}|19\d{{2}}|{X.MONTHS}")),
            "n_numbers": T.count_of(norm, X.NUMBER),
            "claim_like": F.size(F.filter("sentences", lambda s: s.rlike(f"{X.whole(X.FACT_VERBS)}|{X.NUMBER}|{X.NAME}"))),
            "citations": F.size("citation_spans"),
            "urls": F.size("url_spans"),
            "citation_proximity": _proximity(),
        }
    )
    per_sentence, per_hundred = F.col("n_sentences"), F.greatest(n, F.lit(1)) / 100
    return d.withColumns(
        {
            "lexical_diversity": F.when(n > 0, F.col("n_distinct") / n).otherwise(0.0),
            "normalized_diversity": F.when(n > 0, F.col("n_distinct") / F.sqrt(n * 2)).otherwise(0.0),
            "repeated_word_rate": F.when(n > 0, F.col("repeated_words") / n).otherwise(0.0),
            "long_sentence_rate": T.over(F.col("long_sentences"), per_sentence),
            "sentence_variation": F.when(F.col("mean_sentence") > 0, F.col("sentence_deviation") / F.col("mean_sentence")).otherwise(0.0),
            "long_paragraph_rate": T.over(F.col("long_paragraphs"), F.col("n_paragraphs")),
            "paragraph_variation": F.when(F.col("mean_paragraph") > 0, F.col("paragraph_deviation") / F.col("mean_paragraph")).otherwise(0.0),
            "hedge_density": T.over(F.col("n_hedges"), per_sentence),
            "qualifier_density": T.over(F.col("n_qualifiers"), per_sentence),
            "passive_rate": T.over(F.col("n_passives"), per_sentence),
            "action_density": T.over(F.col("n_actions"), per_sentence),
            "noun_density": F.col("n_nouns") / per_hundred,
            "name_density": F.col("n_names") / per_hundred,
            "date_density": F.col("n_dates") / per_hundred,
            "number_density": F.col("n_numbers") / per_hundred,
            "evidence_density": T.over(F.col("citations") + F.col("urls") + F.col("quote_lines"), F.col("claim_like")),
            "quote_density": T.over(F.col("quote_lines"), F.col("n_paragraphs")),
            "heading_coverage": T.over(F.col("headings"), F.col("n_paragraphs") / 4),
            "formatting_density": T.over(F.col("headings") + F.col("list_items") + F.col("table_lines") + F.col("quote_lines"), F.col("filled_lines")),
        }
    ).drop("grams_3", "openings", "sentence_words", "trimmed_lines", "sentence_sizes", "paragraph_sizes", "citation_spans", "url_spans")


def _opening(words: Column) -> Column:
    return F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.lower(w)), " ")


def _proximity() -> Column:
    """Share of the sentences with a verb or number that have a reference inside, or starting within 180 of their end."""
    sentences = T.spans(F.col("norm"), X.SENTENCE)
    stated = F.filter(sentences, lambda s: s["text"].rlike(r"[\p{L}\p{M}]") & s["text"].rlike(f"{X.whole(X.FACT_VERBS)}|{X.NUMBER}"))

    def near(s: Column) -> Column:
        def by(m: Column) -> Column:
            return (F.abs(m["start"] - s["end"]) <= 180) | ((m["start"] >= s["start"]) & (m["end"] <= s["end"]))

        return F.exists("citation_spans", by) | F.exists("url_spans", by)

    # Most texts have no reference, and then no sentence need be looked at.
    marks = F.size("citation_spans") + F.size("url_spans")
    return F.when(marks == 0, 0.0).otherwise(T.over(F.size(F.filter(stated, near)), F.size(stated)))


def connector_count(low: Column, language: Column) -> Column:
    """Formulaic phrases of the text's language."""
    total = F.lit(0)
    for code, phrase, _ in X.PHRASES:
        total = total + T.count_where(low, (language == code) & low.contains(phrase), phrase)
    return total


def unpivot_metrics(measured: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """``doc_id, metric, value``: a row a metric."""
    return measured.select("doc_id", *[F.col(x).cast("double").alias(x) for x in names]).unpivot("doc_id", list(names), "metric", "value")
