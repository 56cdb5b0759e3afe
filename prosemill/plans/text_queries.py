"""Queries over ``documents``: preparation and metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T
from ..operators import metrics as M
from ..operators import preparation as P
from ..sources import tables
from . import sql as S


def prepared(spark: SparkSession, sf_dir: str, text: Column | None = None) -> DataFrame:
    """The prepared documents; ``text`` takes the place of theirs."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return P.prepare(docs if text is None else docs.withColumn("text", text))


def text_normalize(spark, sf_dir):
    d = prepared(spark, sf_dir)
    return d.select("doc_id", F.length("norm").alias("n_chars"), F.size(P.lines()).alias("n_lines"), F.md5("norm").alias("digest"))


def word_tokens(spark, sf_dir):
    d = prepared(spark, sf_dir)
    return d.select("doc_id", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"), F.md5(F.array_join("words", " ")).alias("digest"))


def word_frequency(spark, sf_dir):
    d = prepared(spark, sf_dir).select("doc_id", F.explode("words").alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def sentence_split(spark, sf_dir):
    return P.sentence_rows(prepared(spark, sf_dir)).select("doc_id", "ord", "start", "end", "n_words")


def paragraph_roles(spark, sf_dir):
    return P.paragraphs(prepared(spark, sf_dir)).select("doc_id", "ord", "n_tokens", "role")


def block_types(spark, sf_dir):
    return P.blocks(prepared(spark, sf_dir)).select("doc_id", "ord", "kind", "level", "n_words")


def structure_counts(spark, sf_dir):
    return prepared(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in P.structure_counts().items()])


def inline_references(spark, sf_dir):
    return P.references(prepared(spark, sf_dir))


def script_detect(spark, sf_dir):
    return prepared(spark, sf_dir).select("doc_id", P.script_of(F.col("norm")).alias("script"))


def language_detect(spark, sf_dir):
    d = P.with_language(prepared(spark, sf_dir))
    return d.select("doc_id", "language", "language_confidence", "language_mixed")


def language_confusion(spark, sf_dir):
    return P.with_language(prepared(spark, sf_dir)).groupBy("lang", "language").agg(F.count("*").alias("n"))


def genre_detect(spark, sf_dir):
    genre = P.genre_of(F.col("norm"))
    return prepared(spark, sf_dir).select("doc_id", genre.alias("genre"), P.genre_confidence(genre).alias("confidence"))


def length_class(spark, sf_dir):
    return prepared(spark, sf_dir).groupBy(P.length_class(F.size("words")).alias("length_class")).agg(F.count("*").alias("n"))


def _group(name: str):
    def query(spark, sf_dir):
        return M.with_metrics(prepared(spark, sf_dir)).select("doc_id", *M.GROUPS[name])

    return query


def connector_markers(spark, sf_dir):
    d = P.with_language(prepared(spark, sf_dir))
    d = d.withColumn("n", M.connector_count(F.col("low"), F.col("language")))
    return d.select("doc_id", "language", F.col("n").alias("connectors"), T.over(F.col("n"), F.size("sentences")).alias("density"))


def metrics_unpivot(spark, sf_dir):
    return M.unpivot_metrics(M.with_metrics(prepared(spark, sf_dir)))


def _sentences_sql() -> str:
    return S.span_rows("t", "norm", r"[^.!?\n]+(?:[.!?]+|$)")


_SIZES = r"list_transform(sentences, lambda s: len(regexp_extract_all(strip_accents(s), '[\p{L}\p{M}][\p{L}\p{M}''-]*')))"
_PSIZES = r"list_transform(paras, lambda x: len(regexp_extract_all(x, '\S+')))"


def _gram(n: int) -> str:
    return f"list_filter(list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(words[i:i + {n - 1}], ' ')), lambda g: length(g) >= {4 * n})"


def _kinds(xs: str) -> str:
    return f"coalesce(len(list_filter(map_values(list_histogram({xs})), lambda c: c > 1)), 0)"


def _deviation(xs: str) -> str:
    return f"CASE WHEN len({xs}) < 2 THEN 0.0 ELSE sqrt(CAST(len({xs}) * list_sum(list_transform({xs}, lambda x: x * x)) - list_sum({xs}) * list_sum({xs}) AS DOUBLE)) / len({xs}) END"


_STATS = f"""
k AS (SELECT *, {_SIZES} AS ss, {_PSIZES} AS ps, string_split(norm, chr(10)) AS ls FROM t),
q AS (SELECT *, list_transform(ls, lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')) AS tl FROM k),
m AS (SELECT *, CAST(greatest(1, len(sentences)) AS DOUBLE) AS sn, greatest(1, len(words)) / 100.0::DOUBLE AS hn,
  len(list_filter(tl, lambda x: regexp_matches(x, '^#{{1,6}}\\s+\\S'))) AS headings,
  len(list_filter(tl, lambda x: regexp_matches(x, '^(?:[-*+]|\\d+\\.)\\s+\\S'))) AS list_items,
  len(list_filter(tl, lambda x: contains(x, '|'))) AS table_lines,
  len(list_filter(tl, lambda x: starts_with(x, '>'))) AS quote_lines,
  len(list_filter(tl, lambda x: x <> '')) AS filled_lines FROM q)"""


def _metric(select: str) -> str:
    return S.with_prepared(f"SELECT doc_id, {select} FROM m", _STATS)


_CLAIM_LIKE = f"len(list_filter(sentences, lambda s: regexp_matches(s, {S.quoted(rf'\b(?:{X.FACT_VERBS})\b|{S.NUMBER_SQL}|{S.NAME_SQL}')})))"
_REFERENCES = f"""
refs AS (SELECT doc_id, start, "end" FROM {S.span_rows("t", "norm", "(?i)" + S.URL_SQL)} UNION ALL
         SELECT doc_id, start, "end" FROM {S.span_rows("t", "norm", "(?i)" + S.CITATION_SQL)}),
stated AS (SELECT * FROM {_sentences_sql()} WHERE regexp_matches(text, '[\\p{{L}}\\p{{M}}]')
           AND regexp_matches(text, {S.quoted(rf"\b(?:{X.FACT_VERBS})\b|{S.NUMBER_SQL}")})),
near AS (SELECT DISTINCT s.doc_id, s.ord FROM stated s JOIN refs r ON r.doc_id = s.doc_id
         AND (abs(r.start - s."end") <= 180 OR (r.start >= s.start AND r."end" <= s."end"))),
prox AS (SELECT s.doc_id, count(n.ord) / CAST(count(*) AS DOUBLE) AS px FROM stated s LEFT JOIN near n ON n.doc_id = s.doc_id AND n.ord = s.ord GROUP BY 1)"""

_SELECT = {
    "lexical": """len(words) AS n_words, len(list_distinct(words)) AS n_distinct,
  CASE WHEN len(words) > 0 THEN len(list_distinct(words)) / CAST(len(words) AS DOUBLE) ELSE 0.0 END AS lexical_diversity,
  CASE WHEN len(words) > 0 THEN len(list_distinct(words)) / sqrt(len(words) * 2) ELSE 0.0 END AS normalized_diversity,
  CASE WHEN len(words) > 0 THEN (len(list_filter(words, lambda w: length(w) >= 4)) - len(list_distinct(list_filter(words, lambda w: length(w) >= 4)))) / CAST(len(words) AS DOUBLE) ELSE 0.0 END AS repeated_word_rate""",
    "ngrams": f"{_kinds(_gram(3))} AS repeated_phrases, " + ", ".join(f"len({_gram(n)}) - len(list_distinct({_gram(n)})) AS repeated_{n}" for n in (2, 3, 4, 5)),
    "openings": _kinds(r"list_filter(list_transform(sentences, lambda s: array_to_string(list_transform(regexp_extract_all(strip_accents(s), '[\p{L}\p{M}][\p{L}\p{M}''-]*')[1:3], lambda w: lower(w)), ' ')), lambda o: length(o) >= 6)") + " AS repeated_openings",
    "sentences": f"""len(sentences) AS n_sentences, CASE WHEN len(ss) = 0 THEN 0.0 ELSE list_sum(ss) / CAST(len(ss) AS DOUBLE) END AS mean_sentence,
  coalesce(list_max(ss), 0) AS max_sentence, len(list_filter(ss, lambda x: x > 25)) / sn AS long_sentence_rate,
  len(list_filter(ss, lambda x: x > 35)) AS very_long_sentences, {_deviation("ss")} AS sentence_deviation,
  CASE WHEN coalesce(list_sum(ss), 0) > 0 THEN ({_deviation("ss")}) / (list_sum(ss) / CAST(len(ss) AS DOUBLE)) ELSE 0.0 END AS sentence_variation""",
    "paragraphs": f"""len(ps) AS n_paragraphs, CASE WHEN len(ps) = 0 THEN 0.0 ELSE list_sum(ps) / CAST(len(ps) AS DOUBLE) END AS mean_paragraph,
  coalesce(list_max(ps), 0) AS max_paragraph, len(list_filter(ps, lambda x: x > 120)) / CAST(greatest(1, len(ps)) AS DOUBLE) AS long_paragraph_rate,
  {_deviation("ps")} AS paragraph_deviation,
  CASE WHEN coalesce(list_sum(ps), 0) > 0 THEN ({_deviation("ps")}) / (list_sum(ps) / CAST(len(ps) AS DOUBLE)) ELSE 0.0 END AS paragraph_variation""",
    "style": ", ".join(
        f"{S.hits('low', rf'\b(?:{p})\b')} / sn AS {n}"
        for n, p in (("hedge_density", X.HEDGES), ("qualifier_density", X.QUALIFIERS), ("action_density", X.ACTIONS))
    )
    + ", "
    + S.hits("low", r"\b(?:is|are|was|were|be|been|being)\s+[a-z]+(?:ed|en)\b|\b(?:is|are|was|were)\s+being\s+[a-z]+(?:ed|en)\b")
    + " / sn AS passive_rate, "
    + S.hits("low", rf"\b[\p{{L}}\p{{M}}]+(?:{X.NOUN_ENDINGS})\b")
    + " / hn AS noun_density",
    "specific": ", ".join(
        f"{S.hits('norm', p)} AS n_{n}s, {S.hits('norm', p)} / hn AS {n}_density"
        for n, p in (("name", S.NAME_SQL), ("date", rf"\b(?:20\d{{2}}|19\d{{2}}|{X.MONTHS})\b"), ("number", S.NUMBER_SQL))
    ),
    "format": """headings, list_items, table_lines, quote_lines, headings / greatest(1.0::DOUBLE, len(ps) / 4.0::DOUBLE) AS heading_coverage,
  (headings + list_items + table_lines + quote_lines) / CAST(greatest(1, filled_lines) AS DOUBLE) AS formatting_density""",
}
_C, _U = S.hits("norm", "(?i)" + S.CITATION_SQL), S.hits("norm", "(?i)" + S.URL_SQL)
_EVIDENCE = f"""{_CLAIM_LIKE} AS claim_like, {_C} AS citations, {_U} AS urls,
  ({_C} + {_U} + quote_lines) / CAST(greatest(1, {_CLAIM_LIKE}) AS DOUBLE) AS evidence_density,
  coalesce(px, 0.0) AS citation_proximity, quote_lines / CAST(greatest(1, len(ps)) AS DOUBLE) AS quote_density"""
_EVIDENCE_SQL = S.with_prepared(f"SELECT doc_id, {_EVIDENCE} FROM m LEFT JOIN prox USING (doc_id)", _STATS, _REFERENCES)
_ALL = S.with_prepared(
    "SELECT doc_id, metric, value FROM (SELECT doc_id, "
    + ", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in M.NAMES)
    + f" FROM (SELECT doc_id, {', '.join([*_SELECT.values(), _EVIDENCE])} FROM m LEFT JOIN prox USING (doc_id))) UNPIVOT (value FOR metric IN ({', '.join(M.NAMES)}))",
    _STATS,
    _REFERENCES,
)

QUERIES = {
    "text_normalize": text_normalize,
    "word_tokens": word_tokens,
    "word_frequency": word_frequency,
    "sentence_split": sentence_split,
    "paragraph_roles": paragraph_roles,
    "block_types": block_types,
    "structure_counts": structure_counts,
    "inline_references": inline_references,
    "script_detect": script_detect,
    "language_detect": language_detect,
    "language_confusion": language_confusion,
    "genre_detect": genre_detect,
    "length_class": length_class,
    "lexical_metrics": _group("lexical"),
    "ngram_repetition": _group("ngrams"),
    "sentence_openings": _group("openings"),
    "sentence_stats": _group("sentences"),
    "paragraph_stats": _group("paragraphs"),
    "style_densities": _group("style"),
    "specificity_densities": _group("specific"),
    "evidence_metrics": _group("evidence"),
    "formatting_density": _group("format"),
    "connector_markers": connector_markers,
    "metrics_unpivot": metrics_unpivot,
}

_ROLE = r"""CASE WHEN regexp_matches(x, '^(?:#{1,6}\s+|[-*+]|\d+\.|>|\|)') THEN 'structured_item' WHEN n_tokens < 12 THEN 'short_note'
  WHEN ord = 0 THEN 'opening' WHEN ord = total - 1 THEN 'closing' ELSE 'body' END"""
_FIRST = r"regexp_replace(regexp_replace(string_split(x, chr(10))[1], '^\s+', ''), '\s+$', '')"
_KIND = rf"""CASE WHEN regexp_matches({_FIRST}, '^#{{1,6}}\s+\S') THEN 'heading' WHEN regexp_matches({_FIRST}, '^(?:[-*+]|\d+\.)\s+\S') THEN 'list'
  WHEN starts_with({_FIRST}, '>') THEN 'quote' WHEN contains({_FIRST}, '|') THEN 'table' WHEN starts_with({_FIRST}, '```') THEN 'code' ELSE 'paragraph' END"""
_PARAS = "pp AS (SELECT doc_id, len(paras) AS total, CAST(unnest(range(0, len(paras))) AS INTEGER) AS ord, unnest(paras) AS x FROM t)"

ORACLE = {
    "text_normalize": S.with_prepared("SELECT doc_id, length(norm) AS n_chars, len(string_split(norm, chr(10))) AS n_lines, md5(norm) AS digest FROM d"),
    "word_tokens": S.with_prepared("SELECT doc_id, len(words) AS n_words, len(list_distinct(words)) AS n_distinct, md5(array_to_string(words, ' ')) AS digest FROM t"),
    "word_frequency": S.with_prepared("SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(words) AS word FROM t) GROUP BY word"),
    "sentence_split": S.with_prepared(
        f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS ord, start, "end",
  len(regexp_extract_all(strip_accents(text), '[\\p{{L}}\\p{{M}}][\\p{{L}}\\p{{M}}''-]*')) AS n_words
FROM {_sentences_sql()} WHERE regexp_matches(text, '[\\p{{L}}\\p{{M}}]')"""
    ),
    "paragraph_roles": S.with_prepared(f"SELECT doc_id, ord, n_tokens, {_ROLE} AS role FROM (SELECT *, len(regexp_extract_all(x, '\\S+')) AS n_tokens FROM pp)", _PARAS),
    "block_types": S.with_prepared(
        f"""SELECT doc_id, ord, {_KIND} AS kind, CASE WHEN {_KIND} = 'heading' THEN length(regexp_extract({_FIRST}, '^(#+)', 1)) END AS level,
  len(regexp_extract_all(strip_accents(x), '[\\p{{L}}\\p{{M}}][\\p{{L}}\\p{{M}}''-]*')) AS n_words FROM pp""",
        _PARAS,
    ),
    "structure_counts": _metric("headings, list_items, table_lines, quote_lines, filled_lines"),
    "inline_references": S.with_prepared(
        f"""SELECT doc_id, 'url' AS kind, start, "end", text FROM {S.span_rows("t", "norm", "(?i)" + S.URL_SQL)}
UNION ALL SELECT doc_id, 'citation' AS kind, start, "end", text FROM {S.span_rows("t", "norm", "(?i)" + S.CITATION_SQL)}"""
    ),
    "script_detect": S.with_prepared(
        r"""SELECT doc_id, CASE WHEN regexp_matches(norm, '\p{Latin}') THEN 'latin' WHEN regexp_matches(norm, '\p{Cyrillic}') THEN 'cyrillic'
  WHEN regexp_matches(norm, '\p{Arabic}') THEN 'arabic' WHEN regexp_matches(norm, '\p{Han}') THEN 'han'
  WHEN regexp_matches(norm, '\p{Devanagari}') THEN 'devanagari' ELSE 'unknown' END AS script FROM d"""
    ),
    "language_detect": S.with_language("SELECT doc_id, language, CAST(language_confidence AS DOUBLE) AS language_confidence, language_mixed FROM l"),
    "language_confusion": S.with_language("SELECT lang, language, count(*) AS n FROM l GROUP BY 1, 2"),
    "genre_detect": S.with_prepared(
        f"SELECT doc_id, genre, CAST(CASE WHEN genre IN ('academic', 'legal') THEN 0.55 WHEN genre = 'marketing' THEN 0.45 ELSE 0.25 END AS DOUBLE) AS confidence FROM (SELECT doc_id, {S.GENRE} AS genre FROM d)"
    ),
    "length_class": S.with_prepared(f"SELECT {S.LENGTH} AS length_class, count(*) AS n FROM t GROUP BY 1"),
    "lexical_metrics": _metric(_SELECT["lexical"]),
    "ngram_repetition": _metric(_SELECT["ngrams"]),
    "sentence_openings": _metric(_SELECT["openings"]),
    "sentence_stats": _metric(_SELECT["sentences"]),
    "paragraph_stats": _metric(_SELECT["paragraphs"]),
    "style_densities": _metric(_SELECT["style"]),
    "specificity_densities": _metric(_SELECT["specific"]),
    "evidence_metrics": _EVIDENCE_SQL,
    "formatting_density": _metric(_SELECT["format"]),
    "connector_markers": S.with_language(
        "SELECT doc_id, language, n AS connectors, n / CAST(greatest(1, len(sentences)) AS DOUBLE) AS density FROM (SELECT *, "
        + " + ".join(f"CASE WHEN language = '{c}' THEN {S.hits('low', p)} ELSE 0 END" for c, p, _ in X.PHRASES)
        + " AS n FROM l)"
    ),
    "metrics_unpivot": _ALL,
}
