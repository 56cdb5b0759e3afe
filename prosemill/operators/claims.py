"""Claims of a text and their support in given sources.

A document's candidate sentences are found, filtered and cut in its row, so
nothing is shuffled before the claims are rows.  A document's sources are one
array, joined to its claims once; each claim meets each source in the row, and
the best match is the first of the sorted matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T

MOST_CLAIMS = 24
NEAR = 180
DATES = "(?i)" + X.any_word(("today", "currently", "as of", "latest", "newest", "now"), X.YEAR)
VERBS = X.any_word(X.CLAIM_VERBS.split("|"))
STALE = "(?i)" + X.any_word(X.STALE.split("|"), r"20\d{2}")
SENSITIVE = "(?i)" + X.any_word(X.SENSITIVE.split("|"))
NEGATED = "(?i)" + X.any_word(X.NEGATIONS.replace("lacks?", "lack|lacks").split("|"))
#: Words of any type of claim; most claims have none, and then no type is tried.
TELLING = X.any_word("|".join([*(words for _, words in X.CLAIM_TYPES), X.ABSOLUTES]).split("|"))
STRUCTURED = r"^(?:[-*+]|\d+\.|#{1,6})\s+\S"
HEADING = r"^#{1,6}[ \t\x0B\f\r]+\S"
LOCATOR = r"(?i)^(?:https?://\S+|(?:doi:\s*)?10\.\d{4,9}/[-._;()/:A-Z0-9]+|\[(?:\d+|(?-i:[A-Z])[A-Za-z0-9_-]{1,20})\])?$"


def names_of(sentence: Column) -> Column:
    """Distinct capitalised runs, less an opening function word and role nouns; eight at most."""
    found = T.all_matches(sentence, X.NAME)
    first = sentence.rlike("^[A-Z]")
    kept = F.filter(found, lambda x, i: ~((i == 0) & first & x.isin(*X.OPENERS)) & ~x.rlike(f"^(?:{X.ROLE_NOUNS})$"))
    return F.slice(F.array_distinct(kept), 1, 8)


def numbers_of(sentence: Column) -> Column:
    return F.slice(F.array_distinct(T.all_matches(sentence, X.NUMBER)), 1, 8)


def dates_of(sentence: Column) -> Column:
    return F.slice(F.array_distinct(T.all_matches(sentence, DATES)), 1, 8)


def keywords_of(sentence: Column) -> Column:
    words = T.all_matches(F.lower(sentence), X.WORD)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 5) & ~w.isin(*X.CLAIM_STOP_WORDS)))


def without_references(sentence: Column) -> Column:
    """The trimmed sentence without its URLs and citation marks, white space as single spaces."""
    bare = T.trimmed(F.regexp_replace(F.regexp_replace(sentence, X.INLINE, " "), r"(?U)\s+", " "))
    return F.when(may_refer(sentence) | sentence.rlike(r"(?U)\s(?:\s|(?<! ))"), bare).otherwise(sentence)


def may_refer(text: Column) -> Column:
    """Whether a text has what a reference cannot do without."""
    return T.holds_any(text, ("://", "[", "10."))


def references_in(text: Column) -> Column:
    return F.when(may_refer(text), T.all_matches(text, X.INLINE)).otherwise(F.array().cast("array<string>"))


def claim_type(sentence: Column) -> Column:
    def told(low: Column) -> Column:
        out = F.when(~low.rlike(TELLING), "factual")
        for kind, words in X.CLAIM_TYPES:
            out = out.when(low.rlike(X.any_word(words.split("|"))), kind)
        return out.when(low.rlike(X.any_word(X.ABSOLUTES.split("|"))) & ~low.rlike(r"\d"), "unverifiable").otherwise("factual")

    return T.let(F.lower(sentence), told)


def is_stale(sentence: Column) -> Column:
    return sentence.rlike(STALE)


def is_candidate(sentence: Column) -> Column:
    """No question, and with a number, a verb of fact, or a name in a sentence that is long enough; cheap tests first."""
    n, verb = F.length(sentence), F.lower(sentence).rlike(VERBS)
    named = sentence.rlike(X.NAME) & (F.size(names_of(sentence)) > 0)
    told = T.let(verb, lambda v: (v & (n >= 22)) | ((v | (n >= 35)) & named))
    return ~sentence.endswith("?") & (sentence.rlike(X.NUMBER) | told)


def is_step(sentence: Column) -> Column:
    """A step of a procedure: an imperative without numbers and with one name at most."""

    def told(plain: Column) -> Column:
        return plain.rlike(f"(?i)^(?:{X.STEP_VERBS}){X.END}") & ~plain.rlike(X.NUMBER) & (F.size(names_of(plain)) <= 1)

    return T.let(T.trimmed(F.regexp_replace(sentence, r"(?U)^\s*(?:[-*]|\d+[.)])\s+", "")), told)


def claims(prepared: DataFrame, most: int = MOST_CLAIMS) -> DataFrame:
    """The first ``most`` claims of each document, in order, with what they say and where they stand."""
    sentences = F.filter(T.spans(F.col("norm"), X.SENTENCE), lambda s: s["text"].rlike(r"[\p{L}\p{M}]"))
    d = prepared.select("doc_id", "norm", sentences.alias("sentences"), T.gap_spans(F.col("norm"), "\n{2,}").alias("paras"))
    heads = F.transform("paras", lambda p: p["text"].rlike(HEADING).cast("int"))
    listed = F.transform("paras", lambda p: p["text"].rlike(STRUCTURED))
    d = d.withColumns(
        {
            "starts": F.transform("paras", lambda p: p["start"]),
            "listed": T.let(listed, lambda xs: F.when(F.array_contains(xs, True), xs).otherwise(F.array().cast("array<boolean>"))),
            "heads": F.when(F.col("norm").contains("#"), T.running_totals(heads)).otherwise(F.array().cast("array<int>")),
        }
    ).withColumn("steps", T.search_steps("starts"))

    # Paragraphs are in order and apart, so a place lies in the last one that starts before it, or in none.  It is
    # looked for where it is asked for: few sentences are steps, and only claims tell their place.
    def holding(place: Column) -> Column:
        return T.let(T.count_upto(place, "starts", "steps"), lambda n: F.when(place <= F.get("paras", n - 1)["end"], n - 1))

    def placed(i: Column) -> Column:
        s = F.get("sentences", i)
        return F.struct(
            i.alias("ord"), T.trimmed(s["text"]).alias("claim"), s["start"].alias("start"), s["end"].alias("end"),
            holding(s["start"]).alias("paragraph"), holding(s["end"]).alias("behind"),
        )

    def candidate(s: Column, i: Column) -> Column:
        inside = F.coalesce(F.get("listed", holding(s["start"])), F.lit(False))
        return T.let(T.trimmed(s["text"]), lambda claim: is_candidate(claim) & ~((F.size("listed") > 0) & is_step(claim) & inside))

    def located(s: Column, refers: Column) -> Column:
        until = F.least(F.coalesce(F.get("paras", s["behind"])["end"], F.length("norm")), s["end"] + NEAR)
        upto = F.get("heads", s["paragraph"])
        section = F.when(F.coalesce(F.get("heads", F.size("heads") - 1), F.lit(0)) == 0, 1).when(upto > 0, upto)
        return F.struct(
            s["ord"].alias("ord"), s["start"].alias("start"), s["end"].alias("end"), s["claim"].alias("claim"),
            F.when(refers, F.substring("norm", s["end"] + 1, F.greatest(F.lit(0), until - s["end"]))).otherwise("").alias("tail"), s["paragraph"].alias("paragraph"), section.alias("section"),
        )

    # No column of the array itself is exploded: the optimiser would test its size, and so compute it, a second time.
    found = F.transform(T.first_where(F.col("sentences"), candidate, most), placed)
    # What stands behind a claim is read for its references alone, so a text without one is not cut for each claim.
    cut = T.let(may_refer(F.col("norm")), lambda refers: F.transform(found, lambda s: located(s, refers)))
    d = d.select("doc_id", F.posexplode(cut).alias("place", "c"))
    d = d.select("doc_id", (F.col("place") + 1).alias("place"), "c.*")
    d = d.withColumn("plain", without_references(F.col("claim")))
    d = d.withColumns(
        {
            "inline": F.array_distinct(F.concat(references_in(F.col("claim")), references_in(F.col("tail")))),
            "names": names_of(F.col("plain")), "numbers": numbers_of(F.col("plain")), "dates": dates_of(F.col("plain")), "keywords": keywords_of(F.col("plain")),
            "type": claim_type(F.col("claim")), "stale": is_stale(F.col("plain")),
        }
    )
    sensitive = F.col("plain").rlike(SENSITIVE)
    telling = (F.col("type") == "factual") & ((F.size("numbers") > 0) | (F.size("names") > 1))
    weight = F.when(F.col("stale") | sensitive, "high").when(telling, "medium").otherwise("low")
    return d.withColumn("importance", weight).drop("tail")


def normalized_sources(sources: DataFrame) -> DataFrame:
    """``doc_id, source_ord, label, body`` of all sources given; a bare locator has an empty body."""
    text = T.trimmed(F.coalesce("text", F.lit("")))
    locator = text.rlike(LOCATOR)
    label = F.coalesce("title", "url", "citation", "id", F.when(locator & (text != ""), text), F.concat(F.lit("source-"), (F.col("source_ord") + 1).cast("string")))
    return sources.select("doc_id", "source_ord", label.alias("label"), F.lower(F.when(locator, "").otherwise(text)).alias("body"))


def contains_value(body: Column, value: Column) -> Column:
    """Whether the (lower-case) body holds a value that no letter or digit touches."""
    low = F.lower(value)
    return F.contains(body, low) & F.rlike(body, F.concat(F.lit(f"(?<!{X.LETTER})\\Q"), low, F.lit(f"\\E(?!{X.LETTER})")))


def with_matches(claim_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with ``matches``, best first, and the numbers of sources given and of those with text."""
    # What a source denies is told once, not for each claim.  No negation holds a place where a text is cut.
    segments = F.filter(F.split("body", r"(?<=[.!?])\s+|\n+"), lambda x: x.rlike(NEGATED))
    denied = F.when(F.col("body").rlike(NEGATED), segments).otherwise(F.array().cast("array<string>"))
    body = F.collect_list(F.struct("source_ord", "label", "body", "denied"))
    given = sources.withColumn("denied", denied).groupBy("doc_id").agg(F.array_sort(body).alias("sources"))
    d = claim_rows.join(given, "doc_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<source_ord:int,label:string,body:string,denied:array<string>>>")))
    texts = F.filter("sources", lambda s: s["body"] != "")
    d = d.withColumns({"n_given": F.size("sources").cast("long"), "sources": texts}).withColumn("n_sources", F.size("sources").cast("long"))
    k = F.size("keywords")
    years = F.filter("dates", lambda x: x.rlike(X.whole(X.YEAR)))
    d = d.withColumns(
        {
            "years": years,
            "needed": F.least(F.lit(5), F.greatest(F.least(F.lit(3), k), F.ceil(k * 0.45).cast("int"))),
            "anchors": F.when(F.size("numbers") > 0, F.col("numbers")).when(F.size(years) > 0, years).otherwise(F.slice("keywords", 1, 6)),
            "negated": F.col("plain").rlike(NEGATED),
        }
    )

    def match(s: Column) -> Column:
        def lacking(values: str) -> Column:
            return F.filter(values, lambda v: ~contains_value(s["body"], v))

        denied = F.exists(s["denied"], lambda x: F.exists("anchors", lambda a: contains_value(x, a)))

        def told(overlap: Column) -> Column:
            found = F.struct(
                overlap.alias("overlap"), s["source_ord"].alias("source_ord"), s["label"].alias("label"), lacking("numbers").alias("numbers"),
                lacking("years").alias("years"), lacking("names").alias("names"), (F.col("negated") != denied).alias("conflict"),
            )
            return F.when(overlap > 0, found)

        return T.let(F.size(F.filter("keywords", lambda w: contains_value(s["body"], w))), told)

    def judged(m: Column) -> Column:
        coverage = m["overlap"] / F.size("keywords")
        agrees = (F.size(m["numbers"]) == 0) & (F.size(m["years"]) == 0) & (F.size(m["names"]) == 0) & ~m["conflict"]
        small = (coverage >= 0.92) & (m["overlap"] >= F.least(F.col("needed"), F.lit(2)))
        strong = agrees & (small | ((m["overlap"] >= F.col("needed")) & (coverage >= 0.38)))
        return F.struct(
            (-coverage).alias("turn"), (~agrees).alias("late"), m["source_ord"].alias("source_ord"), m["label"].alias("label"), m["overlap"].alias("overlap"), coverage.alias("coverage"),
            agrees.alias("agrees"), strong.alias("strong"), m["numbers"].alias("numbers"), m["years"].alias("years"), m["names"].alias("names"), m["conflict"].alias("conflict"),
        )

    found = F.filter(F.transform("sources", match), lambda m: m.isNotNull())
    d = d.withColumn("matches", F.when(k > 0, found)).drop("sources", "anchors", "negated")
    matches = F.array_sort(F.transform("matches", judged))
    return d.withColumn("matches", F.coalesce(matches, F.array().cast(_MATCHES)))


_MATCHES = (
    "array<struct<turn:double,late:boolean,source_ord:int,label:string,overlap:int,coverage:double,agrees:boolean,strong:boolean,"
    "numbers:array<string>,years:array<string>,names:array<string>,conflict:boolean>>"
)


def source_matches(matched: DataFrame) -> DataFrame:
    """A row for each claim and source that shares a keyword with it."""
    d = matched.select("doc_id", "place", "needed", F.posexplode("matches").alias("rank", "m"))
    return d.select("doc_id", "place", "rank", "m.source_ord", "m.label", "m.overlap", "needed", "m.coverage", "m.agrees", "m.strong")


def claim_status(claim_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Every claim with the status that its best source gives it, the support it needs, what is lacking and what to do."""
    d = with_matches(claim_rows, sources)
    best = F.get("matches", F.lit(0))
    d = d.withColumns({"overlap": F.coalesce(best["overlap"], F.lit(0)), "coverage": F.coalesce(best["coverage"], F.lit(0.0)), "strong": F.coalesce(best["strong"], F.lit(False))})
    status = (
        F.when(F.col("type") != "factual", "not_checked")
        .when((F.col("coverage") >= 0.48) & F.col("strong"), "supported")
        .when((F.col("overlap") >= 2) & (F.col("coverage") >= 0.25), "partially_supported")
        .when((F.size("inline") > 0) & (F.col("n_sources") == 0), "inline_citation_only")
        .when(F.col("n_sources") > 0, "unsupported")
        .otherwise("not_checked")
    )
    d = d.withColumn("status", status)
    s = F.col("status")
    need = (
        F.when((F.col("type") != "factual") | (s == "supported"), "none")
        .when(F.col("stale") | (F.col("importance") == "high"), "essential")
        .when(s == "unsupported", F.when(F.col("n_sources") > 0, "essential").otherwise("important"))
        .when(s == "inline_citation_only", "important")
        .when(s == "partially_supported", "recommended")
        .when(F.col("importance") == "medium", "recommended")
        .otherwise("none")
    )
    strong = F.transform(F.filter("matches", lambda m: m["strong"]), lambda m: m["label"])
    some = F.transform(F.slice("matches", 1, 2), lambda m: m["label"])
    none = F.array().cast("array<string>")
    evidence = F.when(F.size(strong) > 0, strong).when(s == "partially_supported", some).otherwise(none)
    d = d.withColumns({"need": need, "evidence": evidence, "support_coverage": T.half_up(F.col("coverage"), 2)})
    d = d.withColumn("gaps", support_gaps())
    action = (
        F.when((s == "supported") & F.col("stale"), "keep_and_recheck")
        .when(s == "supported", "keep_visible")
        .when(s == "partially_supported", "tighten_wording")
        .when(s == "inline_citation_only", "provide_cited_material")
        .when(s == "unsupported", F.when(F.col("need") == "essential", "support_or_qualify").otherwise("support_qualify_or_remove"))
        .when(F.col("stale") | (F.size("gaps") > 0), "check_current_material")
        .otherwise("review_need")
    )
    note = F.when(s != "not_checked", s).when(F.col("stale"), "may_be_stale").otherwise("not_checked")
    return d.withColumns({"action": action, "note": note})


def support_gaps() -> Column:
    """Codes of what a claim's support lacks, with up to three of the values concerned; five at most, in order."""
    s, best = F.col("status"), F.get("matches", F.lit(0))
    open_ = s != "supported"

    def values(code: str, xs: Column) -> Column:
        return F.concat(F.lit(f"{code}:"), F.array_join(F.slice(xs, 1, 3), ","))

    nothing = (F.col("n_sources") == 0) & (s == "not_checked")
    cover = F.concat(F.lit("coverage:"), T.half_up(best["coverage"] * 100).cast("int").cast("string"))
    found = [
        (nothing & (F.col("n_given") > 0), F.lit("sources_without_text")),
        (nothing & (F.col("n_given") == 0), F.lit("no_sources")),
        (s == "unsupported", F.lit("no_match")),
        (s == "partially_supported", F.lit("partial_overlap")),
        (F.size(best["numbers"]) > 0, values("number_mismatch", best["numbers"])),
        (F.size(best["years"]) > 0, values("date_mismatch", best["years"])),
        (F.size(best["names"]) > 0, values("name_missing", best["names"])),
        (best["conflict"], F.lit("negation_mismatch")),
        (s == "inline_citation_only", F.lit("citation_unchecked")),
        ((F.size("inline") > 0) & open_ & (s != "inline_citation_only"), F.lit("citation_not_enough")),
        ((F.size("numbers") > 0) & open_, values("number_needs_support", F.col("numbers"))),
        ((F.col("stale") | (F.size("dates") > 0)) & open_, F.lit("time_sensitive")),
        ((F.size("names") > 1) & open_, values("names_need_support", F.col("names"))),
        ((F.size("matches") > 0) & (s == "partially_supported"), cover),
    ]
    return F.slice(F.array_compact(F.array(*[F.when(test, code) for test, code in found])), 1, 5)


CONFLICTS = r"^(?:number_mismatch|date_mismatch|negation_mismatch)"


def claim_review(statuses: DataFrame, *more: Column) -> DataFrame:
    """Counts a document, its source band and the caveats that hold; ``more`` are further aggregates of its claims."""

    def n(test: Column) -> Column:
        return F.count_if(test)

    s, factual = F.col("status"), F.col("type") == "factual"
    d = statuses.groupBy("doc_id").agg(
        F.count("*").alias("claims"),
        n(factual).alias("factual"),
        n(s == "supported").alias("supported"),
        n(s == "partially_supported").alias("partial"),
        n(s == "unsupported").alias("unsupported"),
        n(s == "inline_citation_only").alias("inline_only"),
        n(factual & (s == "not_checked")).alias("not_checked"),
        n(F.col("stale")).alias("stale"),
        n(F.col("need") == "essential").alias("essential"),
        n(F.exists("gaps", lambda g: g.rlike(CONFLICTS))).alias("conflicts"),
        F.max("n_sources").alias("n_sources"),
        F.max("n_given").alias("n_given"),
        *more,
    )
    c = F.col
    checked = c("supported") + c("partial") + c("unsupported")
    band = (
        F.when((c("factual") == 0) | (c("n_given") == 0) | (checked == 0), "not_checked")
        .when(c("unsupported") + c("partial") + c("inline_only") == 0, "supported")
        .when(c("supported") + c("partial") + c("inline_only") > 0, "mixed")
        .otherwise("weakly_supported")
    )
    caveats = F.array_compact(
        F.array(
            F.when((c("n_sources") == 0) & (c("factual") > 0), F.when(c("n_given") > 0, "sources_without_text").otherwise("no_sources")),
            F.when(c("inline_only") > 0, "citations_are_no_proof"),
            F.when(c("conflicts") > 0, "conflicts_are_partial"),
        )
    )
    return d.withColumns({"source_band": band, "caveats": caveats})
