"""Report views: eleven sections of a document in one row, and the profiles that show some of them.

``with_sections`` joins a document's claims and issues to its scores once, as
bounded arrays, and builds all sections in the row: items are ranked, cut and
put in order without another shuffle.  A profile is a value of a row, so one
table may hold views of any; sections keep the place that the profile's order
gives them.

Items carry codes instead of prose: what stands in a section is its ``item``
with ``severity``, ``status`` and ``score``.

Defined results: a document without claims or issues has empty sections of
them; a section without items stays in the full view and is left out of a
checklist; an unknown profile shows what the full one does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import claims as C
from . import metrics as M
from . import report as A
from . import scoring as R

# Sections in order, rows that each keeps, the sections of a checklist, and modes that show raw metrics.
SECTIONS = (
    ("top_actions", 8), ("score_overview", 3), ("content_audit", 6), ("context_confidence", 11), ("writing_quality", 10), ("provenance_risk", 8), ("proofreading", 16), ("claim_review", 16),
    ("highlighted_passages", 14), ("caveats", 1_000), ("raw_diagnostics", 1_000),
)
CHECKLIST = ("top_actions", "content_audit", "claim_review", "proofreading", "caveats")
PROFILES = ("full", "checklist", "claims-csv", "machine")
RAW_MODES = ("research",)
MOST_ASSUMPTIONS, MOST_RECOMMENDATIONS, MOST_CLAIM_ADVICE = 6, 10, 4

ITEM = "struct<item:string,severity:string,status:string,score:double>"


def ordered_union(*lists: Column) -> Column:
    """The distinct values of several ordered lists, each at its first place; null lists and values are left out."""
    none = F.array().cast("array<string>")
    return F.array_compact(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists])))


def item(code: Column | str, severity: Column | None = None, status: Column | None = None, score: Column | None = None) -> Column:
    none = F.lit(None)
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(
        code.alias("item"), (none if severity is None else severity).cast("string").alias("severity"), (none if status is None else status).cast("string").alias("status"),
        (none if score is None else score).cast("double").alias("score"),
    )


def summary_caveats() -> Column:
    """Codes of what limits the provenance band and the language checks; a text that is too short has one of the former."""
    c = F.col
    short = c("length_class") == "too_short"
    strong = (c("families") >= 4) & (c("evidence") >= 58)
    return F.array_compact(
        F.array(
            F.when(short, "provenance_abstained"),
            F.when(c("length_class") == "short", "provenance_limited_by_length"),
            F.when(~short & (c("language") == "unknown"), "language_not_detected"),
            F.when(~short & c("formal") & strong, "escalation_softened_by_context"),
            F.when(c("language") == "unknown", "language_checks_weak"),
            F.when(c("language_mixed"), "language_mixed"),
        )
    )


def proofreading_caveats(language: Column, enabled: Column | None = None) -> Column:
    ran = F.when(language == "en", F.array(F.lit("grammar_runs_elsewhere"))).otherwise(F.array(F.lit("proofreading_english_only")))
    return ran if enabled is None else F.when(enabled, ran).otherwise(F.array(F.lit("proofreading_disabled")))


def proofreading_status(language: Column, enabled: Column | None = None) -> Column:
    ran = F.when(language == "en", "available").otherwise("abstained")
    return ran if enabled is None else F.when(enabled, ran).otherwise("disabled")


def raw_visible(mode: Column, profile: Column, asked: Column) -> Column:
    """Whether a view shows its raw metrics: by the analysis mode, because it was asked for, or for machines."""
    return F.coalesce(mode.isin(*RAW_MODES) | asked | (profile == "machine"), F.lit(False))


def shown(profile: Column, section: Column) -> Column:
    """Whether a profile has a section."""
    return F.when(profile == "checklist", section.isin(*CHECKLIST)).when(profile == "machine", section == "raw_diagnostics").otherwise(True)


def with_parts(scored: DataFrame, statuses: DataFrame, review: DataFrame | None, issues: DataFrame) -> DataFrame:
    """A row a document: scores with ``claims``, ``issues`` and ``spans_of_claims`` as arrays in order, and the claim review's counts.

    Without a ``review``, the claims are reviewed and put in order by one aggregate; a review of its own computes them a second time.
    """
    label = F.when(F.col("status").isin("unsupported", "inline_citation_only"), F.col("status")).when(F.col("stale"), "freshness_risk")
    c = F.struct("place", "claim", "status", "need", "stale", "importance", "action", "start", "end", label.alias("label"))
    every = F.array_sort(F.collect_list(c)).alias("every")
    if review is None:
        review = C.claim_review(statuses, every)
    else:
        review = review.join(statuses.groupBy("doc_id").agg(every), "doc_id", "left")
    p = issues.select("doc_id", F.struct("place", "rule", "kind", "severity", "start", "end").alias("p"))
    p = p.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("issues"))
    counts = ("factual", "supported", "partial", "inline_only", "unsupported", "not_checked")
    r = review.select("doc_id", F.col("every").alias("claims"), "source_band", F.col("caveats").alias("claim_caveats"), F.col("stale").alias("n_stale"), *[F.col(x).alias(f"n_{x}") for x in counts], F.col("n_given"))
    d = scored.join(r, "doc_id", "left").join(p, "doc_id", "left")
    empty = {x: F.coalesce(x, F.array().cast(d.schema[x].dataType)) for x in ("claims", "issues")}
    zero = {x: F.coalesce(x, F.lit(0).cast("long")) for x in ("n_stale", "n_given", *[f"n_{x}" for x in counts])}
    grave = F.size(F.filter("issues", lambda i: i["severity"] != "low")).cast("long")
    d = d.withColumns(empty | zero | {"source_band": F.coalesce("source_band", F.lit("not_checked"))})
    same = {x: F.col(f"n_{x}") for x in ("unsupported", "partial", "inline_only", "not_checked")}
    return d.withColumns({"n_grave": grave, "stale": F.col("n_stale")} | same)


def recommendations(d: DataFrame) -> Column:
    """The advice of quality dimensions, then of up to four claims in need of it, distinct and in order; ten at most."""
    scores = R.quality_scores()
    advice = F.slice(F.array_compact(F.array(*[F.when(scores[n] < limit, n) for n, _, limit, _ in R.QUALITY])), 1, 8)
    asked = F.filter("claims", lambda c: c["status"].isin("unsupported", "inline_citation_only") | c["stale"])
    told = F.transform(F.slice(asked, 1, MOST_CLAIM_ADVICE), lambda c: F.concat(c["action"], F.lit(":"), c["claim"]))
    return F.slice(ordered_union(advice, told), 1, MOST_RECOMMENDATIONS)


def _actions(goal: str) -> Column:
    """The eight weightiest actions, by :func:`report.actions`' weights, from the arrays of a row."""
    bonus = A.GOALS[goal]
    of = lambda kind: F.lit(float(bonus.get(kind, bonus["other"])))

    def rank(severity: Column) -> Column:
        return F.when(severity == "high", 30.0).when(severity == "medium", 20.0).otherwise(10.0)

    def action(weight: Column, turn: int, ord_: Column, code: Column, severity: Column, status: Column, score: Column) -> Column:
        return F.struct((-weight).alias("weight"), F.lit(turn).alias("turn"), ord_.cast("int").alias("ord"), item(code, severity, status, score).alias("item"))

    def claim(c: Column) -> Column:
        need = F.when(c["need"] == "essential", 56.0).when(c["need"] == "important", 42.0).when(c["need"] == "recommended", 28.0).otherwise(0.0)
        return action(rank(c["importance"]) + need + of("claim"), 0, c["place"], F.concat(F.lit("claim-"), c["place"].cast("string")), c["importance"], c["status"], F.lit(None))

    def issue(i: Column) -> Column:
        return action(rank(i["severity"]) + of("proofreading"), 1, i["place"], F.concat(F.lit("issue-"), i["place"].cast("string")), i["severity"], i["rule"], F.lit(None))

    q, p, found = R.quality_scores(), R.provenance_scores(), R.provenance_findings()
    dims = [F.when(q[n] < limit, action(rank(A.severity(q[n], True)) + (100 - q[n]) / 10 + of("quality"), 2, F.lit(i), F.lit(n), A.severity(q[n], True), F.lit(None), q[n])) for i, (n, _, limit, _) in enumerate(R.QUALITY)]
    dims += [F.when(found[n], action(rank(A.severity(p[n], False)) + p[n] / 10 + of("provenance"), 2, F.lit(100 + i), F.lit(n), A.severity(p[n], False), F.lit(None), p[n])) for i, (n, _, _) in enumerate(R.PROVENANCE)]
    asked = F.filter("claims", lambda c: (c["need"] != "none") | c["status"].isin("unsupported", "inline_citation_only") | c["stale"])
    grave = F.slice(F.filter("issues", lambda i: i["severity"] != "low"), 1, 4)
    every = F.concat(F.transform(asked, claim), F.transform(grave, issue), F.array_compact(F.array(*dims)))
    return F.transform(F.slice(F.array_sort(every), 1, 8), lambda a: a["item"])


def _ranked(rows: list[Column]) -> Column:
    """Items of the structs (key, ord, item) that aren't null, by key and place."""
    return F.transform(F.array_sort(F.array_compact(F.array(*rows))), lambda r: r["item"])


def with_sections(d: DataFrame, *, goal: str = "default", assumptions: Column | None = None) -> DataFrame:
    """Adds ``sections``: for each of the eleven its name, place, summary and items.

    ``d`` comes from :func:`with_parts`; its ``phrases`` are those of the text, which are looked for here where they are no column.
    """
    c, q, p, found = F.col, R.quality_scores(), R.provenance_scores(), R.provenance_findings()

    def keyed(key: Column, i: int, of: Column) -> Column:
        return F.struct(key.cast("int").alias("key"), F.lit(i).alias("ord"), of.alias("item"))

    hundred = lambda x: T.half_up(x * 100)
    low = F.lit("low")
    overview = F.array(
        item("provenance_band", None, c("provenance_band"), hundred(c("provenance_confidence"))), item("quality_band", None, c("quality_band")), item("source_band", None, c("source_band"))
    )
    context = [
        item("language", None, c("language"), hundred(c("language_confidence"))), item("genre", None, c("genre"), hundred(c("genre_confidence"))), item("goal", low, F.lit(goal)),
        item("sources", F.when(c("n_given") > 0, "low").otherwise("medium"), c("n_given").cast("string")),
    ]
    assumed = F.transform(F.slice(F.coalesce(assumptions, F.array().cast("array<string>")) if assumptions is not None else F.array().cast("array<string>"), 1, MOST_ASSUMPTIONS), lambda a: item(F.concat(F.lit("assumption:"), a), low))
    quality = [F.when(q[n] < limit, keyed(q[n], i, item(n, A.severity(q[n], True), None, q[n]))) for i, (n, _, limit, _) in enumerate(R.QUALITY)]
    risk = [F.when(found[n], keyed(-p[n], i, item(n, A.severity(p[n], False), None, p[n]))) for i, (n, _, _) in enumerate(R.PROVENANCE)]
    issues = F.transform("issues", lambda i: item(i["rule"], i["severity"], i["kind"]))
    claims = F.transform("claims", lambda x: item(F.concat_ws(":", x["action"], x["need"]), x["importance"], x["status"]))
    marked = F.transform(F.filter("claims", lambda x: x["label"].isNotNull()), lambda x: item(x["label"], F.when(x["label"] == "unsupported", "medium").otherwise("low"), F.lit("claim"), x["start"]))
    proofs = F.transform("issues", lambda i: item(F.concat(F.lit("proofreading_"), i["kind"]), i["severity"], F.lit("proofreading"), i["start"]))
    phrases = F.transform(c("phrases") if "phrases" in d.columns else R.phrase_span_array(), lambda x: item(x["label"], x["severity"], F.lit("phrase"), x["start"]))
    caveats = F.transform(ordered_union(summary_caveats(), c("claim_caveats"), proofreading_caveats(c("language"))), lambda x: item(x, low))
    raw = F.array(*[item(n, None, None, T.half_up(c(n).cast("double"), 3)) for n in M.NAMES])
    cards = F.transform(A.audit_cards(), lambda a: item(a["card"], a["severity"], a["status"], a["score"]))
    parts = {
        "top_actions": _actions(goal), "score_overview": overview, "content_audit": cards, "context_confidence": F.concat(F.array(*context), assumed), "writing_quality": _ranked(quality),
        "provenance_risk": _ranked(risk), "proofreading": issues, "claim_review": claims, "highlighted_passages": F.concat(phrases, marked, proofs), "caveats": caveats, "raw_diagnostics": raw,
    }
    counts = [c(f"n_{x}").cast("string") for x in ("supported", "partial", "inline_only", "unsupported", "not_checked")]
    summaries = {
        "score_overview": A.headline(),
        "context_confidence": F.concat_ws("/", c("n_words"), c("n_sentences"), c("n_paragraphs")),
        "proofreading": F.when(c("language") == "en", F.concat(F.lit("issues:"), F.size("issues").cast("string"))).otherwise("proofreading_english_only"),
        "claim_review": F.concat_ws("/", *counts),
    }
    rows = [
        F.struct(F.lit(i + 1).alias("place"), F.lit(n).alias("section"), summaries.get(n, F.lit(None).cast("string")).alias("summary"), F.slice(parts[n], 1, most).cast(f"array<{ITEM}>").alias("items"))
        for i, (n, most) in enumerate(SECTIONS)
    ]
    return d.withColumn("sections", F.array(*rows))


def view(sections: Column, profile: Column, visible: Column) -> Column:
    """The sections that a profile shows; raw metrics only where they are visible."""
    none = F.array().cast(f"array<{ITEM}>")
    held = F.transform(sections, lambda s: s.withField("items", F.when((s["section"] == "raw_diagnostics") & ~visible, none).otherwise(s["items"])))
    return F.filter(held, lambda s: shown(profile, s["section"]))


def section_rows(d: DataFrame, *keys: str) -> DataFrame:
    """``doc_id``, ``keys``, ``section_place, section, place`` and the item's fields: a row an item."""
    rows = d.select("doc_id", *keys, F.inline("sections"))
    rows = rows.select("doc_id", *keys, F.col("place").alias("section_place"), "section", F.posexplode("items").alias("ord", "i"))
    return rows.select("doc_id", *keys, "section_place", "section", (F.col("ord") + 1).alias("place"), "i.*")


def markdown(sections: Column, profile: Column) -> Column:
    """A view as Markdown: its sections in their order; a checklist leaves out those without items."""
    own = F.when(profile == "claims-csv", "checklist").otherwise(profile)

    def line(i: Column) -> Column:
        number = F.regexp_replace(F.format_string("%.3f", i["score"]), r"\.?0+$", "")
        score = F.when(i["score"].isNotNull(), F.concat(F.lit("("), number, F.lit(")")))
        return F.concat_ws(" ", F.lit("-"), F.concat(F.lit("["), i["status"], F.lit("]")), score, i["item"])

    def part(s: Column) -> Column:
        body = F.when(F.size(s["items"]) == 0, "- none").otherwise(F.array_join(F.transform(s["items"], line), "\n"))
        return F.concat_ws("\n\n", F.concat(F.lit("## "), s["section"]), s["summary"], body)

    kept = F.filter(sections, lambda s: (own != "checklist") | (F.size(s["items"]) > 0))
    return F.concat_ws("\n\n", F.concat(F.lit("# Report: "), own), F.array_join(F.transform(kept, part), "\n\n"))
