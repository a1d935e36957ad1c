"""DuckDB SQL with the results of the operators that SQL can express."""

from __future__ import annotations

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _fence(name: str, value: str, slack: int, low: bool) -> tuple[str, str]:
    test = f"m.{name} <= coalesce(t.{name}_high, m.{name})"
    if low:
        test += f" AND m.{name} >= coalesce(t.{name}_low, m.{name})"
    return f"CASE WHEN n_words > 0 THEN {value} ELSE 0 END AS {name}", test


_FENCES = (
    ("symbols", "n_symbols * 1000 // n_words", 200, False),
    ("capitals", "n_capitals * 1000 // word_chars", 100, False),
    ("repeated_lines", "n_dup_lines * 1000 // n_lines", 400, False),
    ("word_length", "word_chars * 1000 // n_words", 1500, True),
)
_SELECTED = ", ".join(_fence(*f)[0] for f in _FENCES)
_TESTS = " AND ".join(_fence(*f)[1] for f in _FENCES)
_LONG = " UNION ALL ".join(
    f"SELECT lang, source, '{f[0]}' AS fence, {f[0]} AS v FROM m WHERE n_words >= 20"
    for f in _FENCES)
_LIMITS = ", ".join(
    f"max(CASE WHEN fence = '{f[0]}' THEN q1 - 3 * (q3 - q1) - {f[2]} END) AS {f[0]}_low,"
    f" max(CASE WHEN fence = '{f[0]}' THEN q3 + 3 * (q3 - q1) + {f[2]} END) AS {f[0]}_high"
    for f in _FENCES)
_BUCKET = ("CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)::INT)"
           " << (length(bin(v)) - 6)::INT END")

QUALITY_RULES = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS body FROM documents
), w AS (
  SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(body, chr(10)), lambda x: translate(x, {_BLANKS}, '') <> '') AS lines
  FROM d
), counted AS (
  SELECT doc_id, lang, source, words, len(words) AS n_words,
    length(translate(body, {_BLANKS}, '')) AS word_chars,
    length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols,
    length(body) - length(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM w
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 6)) AS i FROM counted WHERE n_words >= 8)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id
), m AS (
  SELECT c.doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, {_SELECTED}
  FROM counted c LEFT JOIN repeats r USING (doc_id)
), sketch AS (
  SELECT lang, source, fence, {_BUCKET} AS bucket, count(*) AS n FROM ({_LONG}) GROUP BY ALL
), levels AS (
  SELECT 1 AS level, lang AS l, source AS s, fence, bucket, n FROM sketch
  UNION ALL SELECT 2, lang, NULL, fence, bucket, sum(n) FROM sketch GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, fence, bucket, sum(n) FROM sketch GROUP BY ALL
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY level, l, s, fence ORDER BY bucket) AS seen,
    sum(n) OVER (PARTITION BY level, l, s, fence) AS size FROM levels
), marks AS (
  SELECT level, l, s, fence, max(size) AS size,
    min(CASE WHEN seen * 4 >= size THEN bucket END) AS q1,
    min(CASE WHEN seen * 4 >= size * 3 THEN bucket END) AS q3
  FROM running GROUP BY ALL
), picked AS (
  SELECT g.l AS lang, g.s AS source, g.fence, x.q1, x.q3
  FROM marks g JOIN marks x ON x.fence = g.fence
    AND (x.level = 3 OR x.l IS NOT DISTINCT FROM g.l)
    AND (x.level > 1 OR x.s IS NOT DISTINCT FROM g.s)
    AND (x.size >= 100 OR x.level = 3)
  WHERE g.level = 1
  QUALIFY row_number() OVER (PARTITION BY g.l, g.s, g.fence ORDER BY x.level) = 1
), limits AS (
  SELECT lang, source, {_LIMITS} FROM picked GROUP BY ALL
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {_TESTS} AS kept
FROM m LEFT JOIN limits t ON m.lang IS NOT DISTINCT FROM t.lang
  AND m.source IS NOT DISTINCT FROM t.source
"""

BLOCK_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
