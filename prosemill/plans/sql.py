"""Shared beginnings of the DuckDB statements that queries are checked against."""

from __future__ import annotations

from ..functions import lexicon as X


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PREPARED = r"""
d AS (SELECT doc_id, lang, source, nfc_normalize(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS norm
      FROM documents),
p AS (SELECT *, strip_accents(norm) AS plain FROM d),
t AS (SELECT *, lower(plain) AS low,
        list_transform(regexp_extract_all(plain, '[\p{L}\p{M}][\p{L}\p{M}''-]*'), lambda w: lower(w)) AS words,
        list_filter(regexp_extract_all(norm, '[^.!?\n]+(?:[.!?]+|$)'), lambda s: regexp_matches(s, '[\p{L}\p{M}]')) AS sentences,
        list_filter(list_transform(string_split_regex(norm, '\n{2,}'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')),
                    lambda x: x <> '') AS paras
      FROM p)
"""

LANGUAGE = (
    "h AS (SELECT *, "
    + ", ".join(f"len(list_filter(words, lambda w: w IN ({', '.join(map(quoted, ws))}))) AS h_{k}" for k, ws in X.STOP_WORDS.items())
    + " FROM t),\n"
    + "r AS (SELECT *, list_reverse_sort(["
    + ", ".join(f"{{'n': h_{k}, 'i': -{i}, 'x': '{k}'}}" for i, k in enumerate(X.STOP_WORDS))
    + "]) AS rk FROM h),\n"
    + """l AS (SELECT *, CASE WHEN len(words) = 0 OR rk[1].n = 0 THEN 'unknown' ELSE rk[1].x END AS language,
  CASE WHEN len(words) = 0 THEN 0.0 WHEN rk[1].n = 0 THEN 0.1
       ELSE greatest(0.25, least(1.0, rk[1].n / CAST(greatest(8, least(len(words), 80)) AS DOUBLE))) END AS language_confidence,
  (len(words) > 0 AND rk[1].n > 0 AND rk[2].n >= greatest(3.0, rk[1].n * 0.55)) AS language_mixed FROM r)"""
)

GENRE = r"""CASE WHEN regexp_matches(norm, '(?i)abstract|methodology|references|doi:|et al\.') THEN 'academic'
  WHEN regexp_matches(norm, '(?i)terms of service|privacy policy|hereby|pursuant|shall\b') THEN 'legal'
  WHEN contains(lower(norm), 'buy now') OR contains(lower(norm), 'learn more') OR contains(lower(norm), 'contact us') THEN 'marketing'
  ELSE 'general' END"""

LENGTH = "CASE WHEN len(words) < 60 THEN 'too_short' WHEN len(words) < 140 THEN 'short' ELSE 'sufficient' END"

URL_SQL = r"\bhttps?://[^\s<>)\]]+"
CITATION_SQL = r"\[(?:\d+|[A-Z][A-Za-z0-9_-]{1,20})\]|\bdoi:\s*10\.\d{4,9}/[-._;()/:A-Z0-9]+\b|\([A-Z][A-Za-z-]+(?:\s+et\s+al\.)?,\s*\d{4}\)"
NAME_SQL = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
NUMBER_SQL = r"\b\d+(?:[.,]\d+)?%?\b"


def with_prepared(select: str, *more: str) -> str:
    return "WITH " + ",\n".join((PREPARED, *more)) + "\n" + select


def with_language(select: str, *more: str) -> str:
    return with_prepared(select, LANGUAGE, *more)


def hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def span_rows(source: str, text: str, pattern: str, keys: str = "doc_id") -> str:
    """Rows ``keys, ord, start, end, text`` of all matches, placed by the gaps between them."""
    q = quoted(pattern)
    return f"""(SELECT {keys}, CAST(ord AS INTEGER) AS ord, CAST(gone - n AS INTEGER) AS start, CAST(gone AS INTEGER) AS "end", m AS text FROM (
  SELECT {keys}, i - 1 AS ord, ms[i] AS m, length(ms[i]) AS n,
    sum(length(gs[i]) + length(ms[i])) OVER (PARTITION BY {keys} ORDER BY i) AS gone
  FROM (SELECT {keys}, unnest(range(1, len(ms) + 1)) AS i, ms, gs FROM (
    SELECT {keys}, regexp_extract_all({text}, {q}) AS ms, string_split_regex({text}, {q}) AS gs FROM {source}))))"""
