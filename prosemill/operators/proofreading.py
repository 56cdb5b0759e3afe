"""Local proofreading rules for English text, as spans."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T

MOST_ISSUES = 40


RULES = ("1-misspelling", "2-repeated", "3-spacing", "4-wordy")
#: Every fixed phrase with its rule, place in the rule's list, kind, severity and suggestion.  None begins where
#: another ends, so that one pattern of them all finds what one of each would.
PHRASES = {w: ("1-misspelling", i, "spelling", "medium", right) for i, (w, right) in enumerate(X.MISSPELLINGS)}
PHRASES |= {w: ("4-wordy", i, "style", "low", short) for i, (w, short) in enumerate(X.WORDY)}


def _literal(text: str, _: Column) -> Column:
    return F.lit(text)


def issues(prepared: DataFrame, most: int | None = MOST_ISSUES, rules: tuple[str, ...] = RULES) -> DataFrame:
    """``doc_id, place, rule, kind, severity, start, end, found, suggestion`` by rule, phrase and start.

    ``prepared`` has ``language``; only English rows are read.  All fixed
    phrases are found by one pattern and told apart by a look-up.
    """
    spans = "array<struct<text:string,start:int,end:int>>"
    found = []

    def keyed(pattern: str, key: Callable[[Column], Column]) -> None:
        found.append(F.transform(T.spans(F.col("norm"), pattern).cast(spans), lambda a: F.struct(key(a).alias("key"), a.alias("a"))))

    listed = {w: v for w, v in PHRASES.items() if v[0] in rules}
    if listed:
        keyed("(?i)" + X.whole("|".join(listed)), lambda a: F.lower(a["text"]))
    for rule, pattern in (("2-repeated", rf"(?i){X.START}([\p{{L}}\p{{M}}]{{3,}})\s+\1{X.END}"), ("3-spacing", r"[ \t]{2,}")):
        if rule in rules:
            keyed(pattern, partial(_literal, rule))
    known = listed | {"2-repeated": ("2-repeated", 0, "typography", "low", ""), "3-spacing": ("3-spacing", 0, "typography", "low", " ")}
    names = ("rule", "i", "kind", "severity", "suggestion")
    said = F.create_map(*[x for w, v in known.items() for x in (F.lit(w), F.struct(*[F.lit(y).alias(n) for n, y in zip(names, v, strict=True)]))])
    # A filter on the language would be pushed below the texts' columns and compute them once for each mention.
    d = prepared.select("doc_id", F.inline(F.when(F.col("language") == "en", F.concat(*found))))
    d = d.select("doc_id", F.element_at(said, F.col("key")).alias("r"), "a").select("doc_id", "r.*", F.col("a.start").alias("start"), F.col("a.end").alias("end"), F.col("a.text").alias("found"))
    order = Window.partitionBy("doc_id").orderBy("rule", "i", "start")
    d = d.withColumn("place", F.row_number().over(order)).drop("i")
    return d if most is None else d.filter(F.col("place") <= most)


def merged(base: DataFrame, more: DataFrame, most: int = MOST_ISSUES) -> DataFrame:
    """``base`` and what ``more`` reports at other places, the first ``most`` of a document."""
    both = base.withColumn("late", F.lit(0)).unionByName(more.withColumn("late", F.lit(1)))
    # What stands at a place is brought together once; a join with ``base`` would compute it a second time.
    here = Window.partitionBy("doc_id", "start", "end")
    both = both.withColumn("known", F.min("late").over(here)).filter("late = known OR doc_id IS NULL").drop("known")
    order = Window.partitionBy("doc_id").orderBy("late", "place")
    return both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("late")
