"""Queries for quality and provenance scores, bands, spans and rollups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T
from ..operators import scoring as R
from ..sources import tables
from . import sql as S
from . import text_queries as TQ


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.measured(tables.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured documents with metadata made from their ids."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pick = lambda n, *xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod("doc_id", F.lit(n)).cast("int"))
    return R.measured(d.withColumns({"genre_hint": pick(7, *HINTS), "channel": pick(5, "policy", "web"), "audience": pick(4, "readers"), "locale": pick(3, "en-GB"), "goal": pick(2, "source_support")}))


HINTS = ("Policy", "marketing", "poem", "support", "academic")


def dimension_confidence(spark, sf_dir):
    """Scores and confidences of all dimensions where the metadata say something."""
    d = profiled(spark, sf_dir)
    q = R.quality_dimensions(d).select("doc_id", "dimension", "score", "confidence", "finding")
    return q.unionByName(R.provenance_dimensions(d).select("doc_id", "dimension", "score", "confidence", "finding"))


def profile_bands(spark, sf_dir):
    d = R.with_provenance(R.with_quality(profiled(spark, sf_dir)))
    return d.select("doc_id", "genre", "genre_confidence", "quality_band", "provenance_band", "provenance_confidence")


def overall_quality(spark, sf_dir):
    return R.with_quality(measured(spark, sf_dir)).groupBy("quality_band").agg(F.count("*").alias("n"), F.sum("quality_score").cast("long").alias("total"))


def quality_recommendations(spark, sf_dir):
    return R.quality_recommendations(measured(spark, sf_dir)).select("doc_id", F.array_join("advice", "|").alias("advice"))


def bloat_only(spark, sf_dir):
    return R.phrase_spans(measured(spark, sf_dir)).filter("label = 'bloated_phrase'").select("doc_id", "phrase", "start", "end")


def formulaic_only(spark, sf_dir):
    return R.phrase_spans(measured(spark, sf_dir)).filter("label = 'formulaic_phrase'").select("doc_id", "phrase", "severity", "start", "end")


def quality_dimensions(spark, sf_dir):
    return R.quality_dimensions(measured(spark, sf_dir))


def quality_band(spark, sf_dir):
    return R.with_quality(measured(spark, sf_dir)).select("doc_id", "quality_score", "quality_band")


def provenance_dimensions(spark, sf_dir):
    return R.provenance_dimensions(measured(spark, sf_dir))


def score_contributions(spark, sf_dir):
    return R.contributions(measured(spark, sf_dir)).select("doc_id", "dimension", "metric", "value", "impact")


def provenance_band(spark, sf_dir):
    return R.with_provenance(measured(spark, sf_dir)).select("doc_id", "provenance_band", "provenance_confidence")


def band_rollup(spark, sf_dir):
    d = R.with_provenance(R.with_quality(measured(spark, sf_dir)))
    return d.cube("quality_band", "provenance_band").agg(F.count("*").alias("n"))


def source_scorecard(spark, sf_dir):
    d = R.with_quality(measured(spark, sf_dir))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality_score").alias("total"), F.max("quality_score").alias("best"), F.min("quality_score").alias("worst"))


def bloat_spans(spark, sf_dir):
    return R.phrase_spans(measured(spark, sf_dir))


def top_findings(spark, sf_dir):
    from pyspark.sql import Window

    d = measured(spark, sf_dir)
    p = R.provenance_dimensions(d).filter("finding").select("doc_id", "ord", "dimension", F.col("score").alias("concern"))
    q = R.quality_dimensions(d).filter("finding").select("doc_id", (F.col("ord") + 100).alias("ord"), "dimension", (100 - F.col("score")).alias("concern"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("concern"), "ord")
    return p.unionByName(q).withColumn("place", F.row_number().over(order)).filter("place <= 5").select("doc_id", "place", "dimension", "concern")


def _excerpt(text, n: int):
    flat = T.trimmed(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


_ALL = ", ".join([*TQ._SELECT.values(), TQ._EVIDENCE])
MEASURED = f"""
mm AS (SELECT m.*, {_ALL} FROM m LEFT JOIN prox USING (doc_id)),
g AS (SELECT mm.* EXCLUDE (ss, ps, ls, tl, sn, hn), l.language, {S.GENRE.replace("norm", "mm.norm")} AS genre, {S.LENGTH.replace("words", "mm.words")} AS length_class,
  {" + ".join(S.hits("mm.low", p) for p in X.BLOAT)} AS n_bloat, {S.hits("mm.low", rf"\b(?:{X.CAUSAL})\b")} AS n_causal,
  ({" + ".join(f"CASE WHEN l.language = '{c}' THEN {S.hits('mm.low', p)} ELSE 0 END" for c, p, _ in X.PHRASES)}) / CAST(greatest(1, len(mm.sentences)) AS DOUBLE) AS connector_density,
  regexp_matches(mm.low, {S.quoted(rf"\b(?:{X.ACTION_CALLS})\b")}) AS has_action, regexp_matches(mm.low, '\\b(?:{R.FORMAL_MARKS})\\b') AS formal_mark,
  regexp_matches(mm.low, '{R.INSTITUTIONAL}') AS institutional, regexp_matches(mm.low, '{R.CLOSINGS}') AS closing
  FROM mm JOIN l USING (doc_id)),
gh AS (SELECT g.* EXCLUDE (genre), CASE WHEN lower(genre_hint) IN ({", ".join(map(S.quoted, X.GENRES))}) THEN lower(genre_hint) ELSE genre END AS genre,
  CASE WHEN lower(genre_hint) IN ({", ".join(map(S.quoted, X.GENRES))}) THEN 0.75 WHEN genre IN ('academic', 'legal') THEN 0.55 WHEN genre = 'marketing' THEN 0.45 ELSE 0.25 END AS genre_confidence,
  coalesce(lower(genre_hint), genre) AS gg, genre_hint, channel, audience, locale, goal FROM g JOIN meta USING (doc_id)),
f AS (SELECT *, regexp_matches(gg || ' ' || coalesce(channel, ''), '{X.DENSE_CONTEXT}') AS dense, regexp_matches(gg || ' ' || coalesce(channel, ''), '{X.TONE_CONTEXT}') AS formal_tone,
  gg IN ({", ".join(map(S.quoted, X.FORMAL_GENRES))}) AS formal_genre, gg IN ({", ".join(map(S.quoted, X.FORMAL_GENRES))}) OR coalesce(channel IN ({", ".join(map(S.quoted, X.FORMAL_GENRES))}), false) AS formal,
  n_words / greatest(1.0::DOUBLE, n_paragraphs) AS pavg, (list_items > 0 AND n_words > 120) AS listed FROM gh)"""


def _clamp(x: str) -> str:
    return f"CAST(greatest(0, least(100, floor(({x}) + 0.5::DOUBLE))) AS INTEGER)"


QUALITY_SQL = {
    "readability": "100.0::DOUBLE - 2.2::DOUBLE * greatest(0, mean_sentence - CASE WHEN dense THEN 24 ELSE 20 END) - 0.35::DOUBLE * greatest(0, pavg - CASE WHEN dense THEN 145 ELSE 120 END) - least(18, 36 * long_sentence_rate) - least(16, 32 * long_paragraph_rate) - CASE WHEN mean_sentence < 6 AND n_sentences > 4 THEN 12 ELSE 0 END",
    "scannability": "78.0::DOUBLE + least(12, 3 * headings + CASE WHEN listed THEN 5 ELSE 0 END) - least(34, 68 * long_sentence_rate) - least(28, 56 * long_paragraph_rate) - least(18, 1.2::DOUBLE * greatest(0, max_sentence - CASE WHEN dense THEN 44 ELSE 36 END))",
    "bloat": "100.0::DOUBLE - 12 * n_bloat - 160 * repeated_word_rate",
    "specificity": "least(100, 30 + 8 * n_numbers + 4 * n_names + least(18, 1.4::DOUBLE * name_density))",
    "depth": "least(100, 35 + 8 * n_causal + least(25, 4 * n_paragraphs) + least(14, 6 * evidence_density))",
    "structure": "55 + least(20, 4 * headings) + CASE WHEN n_paragraphs >= 3 THEN 12 ELSE -10 END + CASE WHEN listed THEN 8 ELSE 0 END",
    "tone_fit": "CASE WHEN formal_tone OR NOT formal_mark THEN 76 - least(12, 4 * qualifier_density) ELSE 52 END",
    "actionability": "CASE WHEN has_action THEN 78 + least(16, 5 * action_density) WHEN n_words > 160 THEN 48 ELSE 62 END",
    "evidence_density": "CASE WHEN citations + urls > 0 THEN 68 + least(24, 24 * citation_proximity) WHEN (claim_like > 0 AND (n_words > 120 OR coalesce(genre_hint = 'marketing', false) OR coalesce(goal = 'source_support', false))) OR n_words > 180 THEN 45 ELSE 62 END",
    "mechanics": "100 - least(38, 5 * passive_rate) - least(24, 0.6::DOUBLE * noun_density)",
    "readability_formula": "100 - 2 * abs(mean_sentence - 18) - 0.25::DOUBLE * greatest(0, pavg - 110)",
}
_B = "CASE WHEN formal_genre THEN 0.78::DOUBLE ELSE 1.0 END"
_SP = "CASE WHEN gg IN ('legal', 'policy') THEN 0.72::DOUBLE WHEN formal_genre THEN 0.86::DOUBLE WHEN gg = 'marketing' THEN 1.12::DOUBLE ELSE 1.0 END"
_RISKS = {
    "lexical_repetition": [("repeated_word_rate", "repeated_word_rate", "420"), ("repeated_phrases", "repeated_phrases", "8"), ("low_diversity", "CASE WHEN normalized_diversity < 3.2 AND n_words > 120 THEN 1.0 ELSE 0.0 END", "18"), ("repeated_openings", "repeated_openings", "10")],
    "discourse_regularity": [("connector_density", "connector_density", f"55 * {_B}"), ("template", "CASE WHEN n_paragraphs >= 4 AND (closing OR list_items >= 3) THEN 1.0 ELSE 0.0 END", f"35 * {_B}"), ("uniform_sentences", "CASE WHEN n_paragraphs >= 4 AND sentence_variation < 0.35 THEN 1.0 ELSE 0.0 END", f"25 * {_B}")],
    "connector_density": [("connector_density", "connector_density", f"90 * {_B}")],
    "formatting_density": [("formatting_density", "formatting_density", f"120 * {_B}"), ("headings", "CASE WHEN headings >= 3 THEN 1.0 ELSE 0.0 END", f"20 * {_B}"), ("tables", "CASE WHEN table_lines >= 2 THEN 1.0 ELSE 0.0 END", f"20 * {_B}")],
    "sentence_rhythm": [("sentence_variation", "CASE WHEN n_sentences >= 6 AND sentence_variation < 0.32 THEN 62 WHEN n_sentences >= 6 AND sentence_variation < 0.42 THEN 42 ELSE 12 END", _B)],
    "register_mismatch": [("register", "CASE WHEN formal THEN 18 WHEN institutional THEN 58 ELSE 20 END", "1.0")],
    "specific_texture": [("texture", "CASE WHEN n_numbers + n_names = 0 AND n_words >= 180 THEN 58 WHEN n_numbers + n_names = 0 AND n_words >= 120 THEN 40 ELSE 12 END", _SP)],
}
_FAMILY = {n: f for n, f, _ in R.PROVENANCE}


def _impact(v: str, w: str) -> str:
    return f"floor(CAST({v} AS DOUBLE) * ({w}) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE"


def _risk(n: str) -> str:
    return _clamp(" + ".join(_impact(v, w) for _, v, w in _RISKS[n]))


_NO_META = "meta AS (SELECT doc_id, NULL::VARCHAR AS genre_hint, NULL::VARCHAR AS channel, NULL::VARCHAR AS audience, NULL::VARCHAR AS locale, NULL::VARCHAR AS goal FROM documents)"
_META = "meta AS (SELECT doc_id, " + ", ".join(
    f"CAST(list_extract([{', '.join(map(S.quoted, xs))}], CAST(doc_id % {n} AS INTEGER) + 1) AS VARCHAR) AS {c}"
    for n, c, xs in ((7, "genre_hint", HINTS), (5, "channel", ("policy", "web")), (4, "audience", ("readers",)), (3, "locale", ("en-GB",)), (2, "goal", ("source_support",)))
) + " FROM documents)"


def _scored(select: str, *more: str, meta: str = _NO_META) -> str:
    return S.with_language(select, TQ._STATS, TQ._REFERENCES, meta, MEASURED, *more)


FOUND_SQL = {
    "lexical_repetition": "repeated_word_rate > 0.08 OR repeated_phrases > 1 OR repeated_openings > 1",
    "discourse_regularity": "n_paragraphs >= 4 AND (closing OR list_items >= 3)",
    "connector_density": "connector_density > 0",
    "formatting_density": "formatting_density > 0.28",
    "sentence_rhythm": "n_sentences >= 6 AND sentence_variation < 0.42",
    "register_mismatch": "institutional AND NOT formal",
    "specific_texture": "n_words >= 120 AND n_numbers + n_names = 0",
}
_SURE = {n: str(v) for n, _, _, v in R.QUALITY} | {n: str(v) for n, _, v in R.PROVENANCE} | {
    "specificity": "CASE WHEN audience IS NOT NULL OR locale IS NOT NULL THEN 0.65 ELSE 0.45 END",
    "tone_fit": "CASE WHEN genre_hint IS NOT NULL OR channel IS NOT NULL OR audience IS NOT NULL THEN 0.70 ELSE 0.38 END",
    "mechanics": "CASE WHEN language = 'en' THEN 0.62 ELSE 0.35 END",
    "register_mismatch": "CASE WHEN genre_hint IS NOT NULL OR channel IS NOT NULL THEN 0.58 ELSE 0.35 END",
    "specific_texture": "CASE WHEN audience IS NOT NULL OR locale IS NOT NULL THEN 0.50 ELSE 0.28 END",
}
_TEXTURE = "CASE language " + " ".join(f"WHEN '{k}' THEN '{', '.join(v)}'" for k, v in X.TEXTURE.items()) + " ELSE '" + ", ".join(X.ANY_TEXTURE) + "' END"
#: Value, weight and, where it isn't their product, the impact of each quality contribution.
_QUALITY_PARTS = {
    "readability": (("mean_sentence", "mean_sentence", "-2.2", "-2.2::DOUBLE * greatest(0, mean_sentence - CASE WHEN dense THEN 24 ELSE 20 END)"), ("paragraph_average", "pavg", "-0.35", "-0.35::DOUBLE * greatest(0, pavg - CASE WHEN dense THEN 145 ELSE 120 END)"), ("long_sentence_rate", "long_sentence_rate", "-36", "-least(18.0::DOUBLE, 36 * long_sentence_rate)"), ("long_paragraph_rate", "long_paragraph_rate", "-32", "-least(16.0::DOUBLE, 32 * long_paragraph_rate)")),
    "scannability": (("long_sentence_rate", "long_sentence_rate", "-68", "-least(34.0::DOUBLE, 68 * long_sentence_rate)"), ("long_paragraph_rate", "long_paragraph_rate", "-56", "-least(28.0::DOUBLE, 56 * long_paragraph_rate)"), ("heading_coverage", "heading_coverage", "3", "least(12.0::DOUBLE, 3 * headings + CASE WHEN listed THEN 5 ELSE 0 END)")),
    "bloat": (("bloat_phrases", "n_bloat", "-12", ""), ("repeated_word_rate", "repeated_word_rate", "-160", "")),
    "specificity": (("numbers", "n_numbers", "8", ""), ("names", "n_names", "4", "")),
    "depth": (("causal_marks", "n_causal", "8", ""), ("evidence_density", "evidence_density", "6", "")),
    "structure": (("heading_coverage", "heading_coverage", "10", ""), ("paragraphs", "n_paragraphs", "4", "")),
    "tone_fit": (("qualifier_density", "qualifier_density", "-4", ""),),
    "actionability": (("action_density", "action_density", "5", ""),),
    "evidence_density": (("citation_proximity", "citation_proximity", "24", ""), ("evidence_density", "evidence_density", "8", "")),
    "mechanics": (("passive_rate", "passive_rate", "-5", ""), ("noun_density", "noun_density", "-0.6::DOUBLE", "")),
    "readability_formula": (("mean_sentence", "mean_sentence", "-2", ""),),
}


_Q = "qs AS (SELECT *, " + ", ".join(f"{_clamp(v)} AS s_{k}" for k, v in QUALITY_SQL.items()) + " FROM f)"
_SUM = " + ".join(f"s_{k}" for k in QUALITY_SQL)
_BAND = "CASE WHEN {0} >= 78 THEN 'strong' WHEN {0} >= 62 THEN 'good' WHEN {0} >= 42 THEN 'fair' ELSE 'poor' END"
_QB = f"qb AS (SELECT *, CAST(floor(({_SUM}) / 11.0::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS quality_score, {_BAND.format(f'(({_SUM}) / 11.0::DOUBLE)')} AS quality_band FROM qs)"
_P = (
    "ps2 AS (SELECT *, ["
    + ", ".join(f"{{'f': '{_FAMILY[n]}', 's': {_risk(n)}}}" for n in _RISKS)
    + "] AS sc FROM qb), ps3 AS (SELECT *, len(list_distinct(list_transform(list_filter(sc, lambda x: x.s >= 60), lambda x: x.f))) AS fam, "
    + "coalesce(list_avg(list_transform(list_filter(sc, lambda x: x.s >= 45), lambda x: x.s)), 0.0) AS ev FROM ps2), "
    + "pb AS (SELECT *, CASE WHEN length_class = 'too_short' THEN 'insufficient_evidence' WHEN fam >= 4 AND ev >= 58 THEN CASE WHEN formal OR length_class = 'short' OR language = 'unknown' THEN 'elevated' ELSE 'high' END WHEN fam >= 2 OR ev >= 42 THEN 'elevated' ELSE 'low' END AS provenance_band, "
    + "CAST(CASE WHEN length_class = 'too_short' THEN 0.15 ELSE greatest(0.0, least(1.0, floor((0.2::DOUBLE + least(0.55::DOUBLE, 0.14::DOUBLE * fam) + CASE WHEN length_class = 'sufficient' THEN 0.15::DOUBLE ELSE 0.0 END - CASE WHEN formal THEN 0.12::DOUBLE ELSE 0.0 END) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE)) END AS DOUBLE) AS provenance_confidence FROM ps3)"
)
_FLAT = r"regexp_replace(regexp_replace(regexp_replace(norm, '\s+', ' ', 'g'), '^\s+', ''), '\s+$', '')"
QUERIES = {
    "quality_dimensions": quality_dimensions,
    "quality_band": quality_band,
    "provenance_dimensions": provenance_dimensions,
    "score_contributions": score_contributions,
    "provenance_band": provenance_band,
    "band_rollup": band_rollup,
    "source_scorecard": source_scorecard,
    "phrase_spans": bloat_spans,
    "bloat_spans": bloat_only,
    "formulaic_spans": formulaic_only,
    "overall_quality": overall_quality,
    "quality_recommendations": quality_recommendations,
    "dimension_confidence": dimension_confidence,
    "profile_bands": profile_bands,
    "top_findings": top_findings,
}

_LONG = "ql AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{n}' AS dimension, '{f}' AS family, s_{n} AS score, s_{n} < {lim} AS finding, CAST({_SURE[n]} AS DOUBLE) AS confidence FROM qs" for i, (n, f, lim, _) in enumerate(R.QUALITY)) + ")"

_PL = "pl AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ord, '{n}' AS dimension, '{f}' AS family, {_risk(n)} AS score, coalesce({FOUND_SQL[n]}, false) AS finding, CAST({_SURE[n]} AS DOUBLE) AS confidence, '{', '.join(X.FALSE_POSITIVES[f])}' AS contexts, {f'CASE WHEN {FOUND_SQL[n]} THEN {_TEXTURE} END' if n == 'specific_texture' else 'NULL::VARCHAR'} AS texture FROM f"
    for i, (n, f, _) in enumerate(R.PROVENANCE)
) + ")"

ORACLE = {
    "quality_dimensions": _scored("SELECT * FROM ql", _Q, _LONG),
    "quality_band": _scored("SELECT doc_id, quality_score, quality_band FROM qb", _Q, _QB),
    "provenance_dimensions": _scored("SELECT * FROM pl", _PL),
    "score_contributions": _scored(
        " UNION ALL ".join(
            [f"SELECT doc_id, '{n}' AS dimension, '{m}' AS metric, floor(CAST({v} AS DOUBLE) * 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE AS value, {_impact(v, w) if not i else f'floor(({i}) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE'} AS impact FROM f" for n, parts in _QUALITY_PARTS.items() for m, v, w, i in parts]
            + [f"SELECT doc_id, '{n}' AS dimension, '{m}' AS metric, floor(CAST({v} AS DOUBLE) * 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE AS value, {_impact(v, w)} AS impact FROM f" for n, parts in _RISKS.items() for m, v, w in parts]
        )
    ),
    "dimension_confidence": _scored("SELECT doc_id, dimension, score, confidence, finding FROM ql UNION ALL SELECT doc_id, dimension, score, confidence, finding FROM pl", _Q, _LONG, _PL, meta=_META),
    "profile_bands": _scored("SELECT doc_id, genre, CAST(genre_confidence AS DOUBLE) AS genre_confidence, quality_band, provenance_band, provenance_confidence FROM pb", _Q, _QB, _P, meta=_META),
    "overall_quality": _scored("SELECT quality_band, count(*) AS n, CAST(sum(quality_score) AS BIGINT) AS total FROM qb GROUP BY 1", _Q, _QB),
    "quality_recommendations": _scored("SELECT doc_id, coalesce(string_agg(dimension, '|' ORDER BY ord) FILTER (finding AND k <= 8), '') AS advice FROM (SELECT *, sum(CAST(finding AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM ql) GROUP BY doc_id", _Q, _LONG),
    "provenance_band": _scored("SELECT doc_id, provenance_band, provenance_confidence FROM pb", _Q, _QB, _P),
    "band_rollup": _scored("SELECT quality_band, provenance_band, count(*) AS n FROM pb GROUP BY CUBE (quality_band, provenance_band)", _Q, _QB, _P),
    "source_scorecard": _scored("SELECT source, count(*) AS n, CAST(sum(quality_score) AS BIGINT) AS total, max(quality_score) AS best, min(quality_score) AS worst FROM qb GROUP BY source", _Q, _QB),
    "phrase_spans": S.with_language(
        " UNION ALL ".join(
            [f"SELECT doc_id, 'bloated_phrase' AS label, {S.quoted(p)} AS phrase, 'low' AS severity, start, \"end\" FROM {S.span_rows('l', 'low', p)}" for p in X.BLOAT]
            + [f"SELECT doc_id, 'formulaic_phrase' AS label, {S.quoted(p)} AS phrase, '{sev}' AS severity, start, \"end\" FROM {S.span_rows(f'''(SELECT * FROM l WHERE language = '{c}')''', 'low', p)}" for c, p, sev in X.PHRASES]
        )
    ),
    "top_findings": _scored(
        "SELECT doc_id, CAST(place AS INTEGER) AS place, dimension, concern FROM (SELECT doc_id, dimension, 100 - score AS concern, row_number() OVER (PARTITION BY doc_id ORDER BY 100 - score DESC, ord) AS place FROM (SELECT doc_id, dimension, score, ord + 100 AS ord, finding FROM ql UNION ALL SELECT doc_id, dimension, 100 - score, ord, finding FROM pl) WHERE finding) WHERE place <= 5",
        _Q,
        _LONG,
        _PL,
    ),
}
ORACLE["bloat_spans"] = S.with_language(" UNION ALL ".join(f"SELECT doc_id, {S.quoted(p)} AS phrase, start, \"end\" FROM {S.span_rows('l', 'low', p)}" for p in X.BLOAT))
ORACLE["formulaic_spans"] = S.with_language(
    " UNION ALL ".join(f"SELECT doc_id, {S.quoted(p)} AS phrase, '{sev}' AS severity, start, \"end\" FROM {S.span_rows(f'(SELECT * FROM l WHERE language = {S.quoted(c)})', 'low', p)}" for c, p, sev in X.PHRASES)
)
