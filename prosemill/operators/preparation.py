"""From raw texts to the prepared row that every later operator reads.

One projection a stage; nothing is shuffled.  ``prepare`` adds the normal
forms, tokens, sentences and structure counts; the child tables (sentences,
paragraphs, blocks, sections, references) are exploded from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``norm, plain, low, words, sentences``; other columns stay."""
    d = docs.withColumn("norm", T.normalized(F.col(text_col)))
    d = d.withColumn("plain", T.without_accents(F.col("norm")))
    return d.withColumns(
        {"low": F.lower("plain"), "words": T.word_tokens(F.col("plain")), "sentences": T.sentence_texts(F.col("norm"))}
    )


def lines() -> Column:
    return F.split("norm", "\n")


def trimmed_lines() -> Column:
    return F.transform(lines(), lambda s: T.trimmed(s))


def structure_counts(trimmed: Column | None = None) -> dict[str, Column]:
    """Lines of each kind; one line may count for several.  ``trimmed`` are the trimmed lines where they are a column."""
    rows = trimmed_lines() if trimmed is None else trimmed

    def count(test) -> Column:
        return F.size(F.filter(rows, test))

    return {
        "headings": count(lambda s: s.rlike(r"^#{1,6}\s+\S")),
        "list_items": count(lambda s: s.rlike(r"^(?:[-*+]|\d+\.)\s+\S")),
        "table_lines": count(lambda s: s.contains("|")),
        "quote_lines": count(lambda s: s.startswith(">")),
        "filled_lines": count(lambda s: s != ""),
    }


def block_kind(first_line: Column) -> Column:
    s = T.trimmed(first_line)
    return (
        F.when(s.rlike(r"^#{1,6}\s+\S"), "heading")
        .when(s.rlike(r"^(?:[-*+]|\d+\.)\s+\S"), "list")
        .when(s.startswith(">"), "quote")
        .when(s.contains("|"), "table")
        .when(s.startswith("```"), "code")
        .otherwise("paragraph")
    )


def script_of(text: Column) -> Column:
    out = F.when(text.rlike(r"\p{IsLatin}"), "latin")
    for name, script in (("cyrillic", "IsCyrillic"), ("arabic", "IsArabic"), ("han", "IsHan"), ("devanagari", "IsDevanagari")):
        out = out.when(text.rlike(rf"\p{{{script}}}"), name)
    return out.otherwise("unknown")


def stop_word_hits(words: Column) -> dict[str, Column]:
    def hits(language: str) -> Column:
        listed = X.STOP_WORDS[language]
        return F.size(F.filter(words, lambda w: w.isin(*listed)))

    return {x: hits(x) for x in X.LANGUAGES}


def stop_words_in(words: Column) -> Column:
    """The words that are a stop word of any language."""
    every = sorted({w for listed in X.STOP_WORDS.values() for w in listed})
    return F.filter(words, lambda w: w.isin(*every))


def with_language(prepared: DataFrame, hint: Column | None = None) -> DataFrame:
    """Adds ``language``, ``language_confidence`` and ``language_mixed``."""
    hint = F.lower(F.substring(T.trimmed(hint), 1, 2)) if hint is not None else F.lit(None).cast("string")
    hint = F.when(hint.isin(*X.LANGUAGES), hint)
    d = prepared.withColumn("stops", stop_words_in(F.col("words")))
    d = d.withColumns({f"hits_{k}": v for k, v in stop_word_hits(F.col("stops")).items()}).withColumn("hint", hint)
    ranked = F.reverse(
        F.array_sort(
            F.array(*[F.struct(F.col(f"hits_{x}").alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(X.LANGUAGES)])
        )
    )
    d = d.withColumn("ranked", ranked).withColumns({"top": F.get("ranked", F.lit(0)), "next": F.get("ranked", F.lit(1))})
    n, top, second = F.size("words"), F.col("top.n"), F.col("next.n")
    share = F.greatest(F.lit(0.25), F.least(F.lit(1.0), top / F.greatest(F.lit(8), F.least(n, F.lit(80)))))
    mixed = (top > 0) & (second * 100 >= F.greatest(F.lit(300), top * 55))  # in whole numbers: 100 * 0.55 is more than 55
    weak = top == 0
    language = F.when(n == 0, F.coalesce("hint", F.lit("unknown"))).when(weak, F.coalesce("hint", F.lit("unknown"))).otherwise(F.col("top.x"))
    confidence = (
        F.when(n == 0, F.when(F.col("hint").isNull(), 0.0).otherwise(0.5))
        .when(weak, F.when(F.col("hint").isNull(), 0.1).otherwise(0.45))
        .when(F.col("hint").isNotNull() & (F.col("hint") != F.col("top.x")), F.least(share, F.lit(0.55)))
        .otherwise(share)
    )
    d = d.withColumns({"language": language, "language_confidence": confidence, "language_mixed": mixed & (n > 0)})
    return d.drop("stops", "ranked", "top", "next", "hint", *[f"hits_{x}" for x in X.LANGUAGES])


#: Marks of a genre, in small letters; none has one that a character beyond ASCII becomes.
ACADEMIC = ("abstract", "methodology", "references", "doi:", "et al.")
LEGAL = ("terms of service", "privacy policy", "hereby", "pursuant")


def genre_of(text: Column) -> Column:
    def told(low: Column) -> Column:
        return (
            F.when(T.holds_any(low, ACADEMIC), "academic")
            .when(T.holds_any(low, LEGAL) | (low.contains("shall") & text.rlike(rf"(?i)shall{X.END}")), "legal")
            .when(T.holds_any(low, ("buy now", "learn more", "contact us")), "marketing")
            .otherwise("general")
        )

    return T.let(F.lower(text), told)


def assumptions(hint: Column, genre_hint: Column) -> Column:
    """Codes of what was assumed of language and genre, in order; ``language`` and the words are in the row."""
    given = F.lower(F.substring(T.trimmed(hint), 1, 2))
    known = given.isin(*X.LANGUAGES)
    hits = F.greatest(*stop_word_hits(F.col("words")).values())
    top = F.col("language")
    explicit = F.lower(T.trimmed(genre_hint)).isin(*X.GENRES)
    genre = F.col("genre")
    inferred = F.when(genre == "academic", "genre_from_citation_markers").when(genre == "legal", "genre_from_legal_markers").when(genre == "marketing", "genre_from_calls").otherwise("genre_weakly_inferred")
    none = F.coalesce(explicit, F.lit(False))
    return F.array_compact(
        F.array(
            F.when((F.size("words") > 0) & (hits == 0) & known, "language_from_hint"),
            F.when((hits > 0) & known & (given != top), "language_hint_differs"),
            F.when(genre_hint.isNotNull() & (genre_hint != "") & ~none, "genre_hint_unknown"),
            F.when(~none, inferred),
        )
    )


def genre_confidence(genre: Column) -> Column:
    return F.when(genre.isin("academic", "legal"), 0.55).when(genre == "marketing", 0.45).otherwise(0.25)


def length_class(words: Column) -> Column:
    return F.when(words < 60, "too_short").when(words < 140, "short").otherwise("sufficient")


def paragraphs(prepared: DataFrame) -> DataFrame:
    """``doc_id, ord, text, n_tokens, role`` of every paragraph (a run of text between blank lines)."""
    parts = F.filter(F.transform(F.split("norm", "\n{2,}"), lambda p: T.trimmed(p)), lambda p: p != "")
    d = prepared.select("doc_id", parts.alias("parts")).select(
        "doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("ord", "text")
    )
    tokens = F.size(T.all_matches(F.col("text"), r"[^\s]+"))
    structured = F.col("text").rlike(r"^(?:#{1,6}\s+|[-*+]|\d+\.|>|\|)")
    role = (
        F.when(structured, "structured_item")
        .when(tokens < 12, "short_note")
        .when(F.col("ord") == 0, "opening")
        .when(F.col("ord") == F.col("n") - 1, "closing")
        .otherwise("body")
    )
    return d.select("doc_id", "ord", "text", tokens.alias("n_tokens"), role.alias("role"))


def sentence_rows(prepared: DataFrame) -> DataFrame:
    """``doc_id, ord, start, end, text, n_words`` of every sentence."""
    found = F.filter(T.spans(F.col("norm"), X.SENTENCE), lambda s: s["text"].rlike(r"[\p{L}\p{M}]"))
    d = prepared.select("doc_id", F.posexplode(found).alias("ord", "s"))
    n = F.size(T.all_matches(T.without_accents(F.col("s.text")), X.WORD))
    return d.select("doc_id", "ord", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"), n.alias("n_words"))


def references(prepared: DataFrame) -> DataFrame:
    """``doc_id, kind, start, end, text`` of URLs and citations."""
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), T.spans(F.col("norm"), p).alias("found")) for k, p in (("url", X.URL), ("citation", X.CITATION))]
    )
    d = prepared.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", F.col("k.kind").alias("kind"), F.explode("k.found").alias("f"))
    return d.select("doc_id", "kind", F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.text").alias("text"))


def blocks(prepared: DataFrame) -> DataFrame:
    """``doc_id, ord, kind, level, text, n_words`` of every block; level is a heading's."""
    parts = F.filter(F.transform(F.split("norm", "\n{2,}"), lambda p: T.trimmed(p)), lambda p: p != "")
    d = prepared.select("doc_id", F.posexplode(parts).alias("ord", "text"))
    first = F.split("text", "\n")[0]
    kind = block_kind(first)
    return d.select(
        "doc_id",
        "ord",
        kind.alias("kind"),
        F.when(kind == "heading", F.length(F.regexp_extract(T.trimmed(first), "^(#+)", 1))).alias("level"),
        "text",
        F.size(T.all_matches(T.without_accents(F.col("text")), X.WORD)).alias("n_words"),
    )


def sections(block_rows: DataFrame) -> DataFrame:
    """``doc_id, ord, section, parent``: each block's section and that section's parent.

    A section is named by its heading's place; -1 is the body before any
    heading.  A parent is the last earlier heading of a lower level.
    """
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("kind") == "heading"
    d = block_rows.withColumn("section", F.coalesce(F.last(F.when(heading, F.col("ord")), True).over(upto), F.lit(-1)))
    earlier = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(1, 7):
        at = F.last(F.when(heading & (F.col("level") == level), F.col("ord")), True).over(earlier)
        d = d.withColumn(f"last_{level}", at)
    lower = [F.when(F.col("level") > level, F.col(f"last_{level}")) for level in range(1, 7)]
    parent = F.when(heading, F.coalesce(F.greatest(F.lit(-1), *lower), F.lit(-1)))
    return d.select("doc_id", "ord", "kind", "section", parent.alias("parent"))
