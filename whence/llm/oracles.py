"""DuckDB statements for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from . import chat, quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Exact sets, links by shared shingles, and labels that spread along links until nothing changes.
NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS grams FROM w
), sets AS (SELECT doc_id, len(grams) AS n, CASE WHEN len(grams) > 0 THEN md5(array_to_string(grams, chr(10))) END AS mark, grams FROM s
), classes AS (SELECT mark, min(doc_id) AS set_id, any_value(n) AS n FROM sets WHERE mark IS NOT NULL GROUP BY mark
), held AS (SELECT c.set_id, c.n, unnest(sets.grams) AS gram FROM classes c JOIN sets ON sets.doc_id = c.set_id
), shared AS (
  SELECT a.set_id AS a, b.set_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM held a JOIN held b ON a.gram = b.gram AND a.set_id > b.set_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared WHERE 100 * n >= 85 * (na + nb - n)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, top) AS (
  SELECT set_id, set_id FROM classes UNION SELECT edges.a, reach.top FROM reach JOIN edges ON edges.b = reach.node
), roots AS (SELECT node, min(top) AS root FROM reach GROUP BY node)
SELECT sets.doc_id, sets.n::BIGINT AS n_shingles, coalesce(roots.root, sets.doc_id) AS component_id, coalesce(classes.set_id, sets.doc_id) AS set_id
FROM sets LEFT JOIN classes ON classes.mark = sets.mark LEFT JOIN roots ON roots.node = classes.set_id
"""

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), grams AS (
  SELECT k, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i, unnest(list_transform(range(1, len(words) - {quality.WINDOW - 2}), lambda i: array_to_string(words[i:i + {quality.WINDOW - 1}], ' '))) AS gram FROM d WHERE len(words) >= {quality.WINDOW}
), hits AS (
  SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS follow FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM grams) WHERE n > 1
), repeats AS (SELECT k, sum(CASE WHEN follow IS NULL THEN {quality.WINDOW} ELSE least({quality.WINDOW}, follow - i) END) AS n FROM hits GROUP BY k
), lines AS (SELECT k, host, doc_id, text, line FROM (SELECT k, host, doc_id, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY k
), normal AS (SELECT k, host, doc_id, text, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines
), hosts AS (SELECT host, count(*) AS n FROM (SELECT DISTINCT host, doc_id FROM d) GROUP BY host
), docs AS (SELECT host, line, doc_id, min(text) AS text FROM normal GROUP BY host, line, doc_id
), frequent AS (
  SELECT docs.host, line FROM docs JOIN hosts ON hosts.host = docs.host GROUP BY docs.host, line, hosts.n
  HAVING count(DISTINCT text) >= {quality.LEAST_DOCS} AND count(*) >= {quality.LEAST_DOCS} AND (count(*) >= {quality.MOST_DOCS} OR count(*) >= {quality.SHARE} * hosts.n)
), removed AS (SELECT k, sum(n) AS n FROM normal JOIN frequent ON frequent.host = normal.host AND frequent.line = normal.line GROUP BY k
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN repeats ON repeats.k = d.k LEFT JOIN dups ON dups.k = d.k LEFT JOIN removed ON removed.k = d.k
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {quality.LEAST_WORDS} OR n_words - removed_words < {quality.LEAST_PART} * n_words)) AS kept FROM f
"""


def _escaped(col: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"replace({col}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, {quote(c)}, {quote(c[0] + chr(92) + c[1:])})"
    return out


_PER_TURN = len(chat.HEAD) + len(chat.MIDDLE) + len(chat.FOOT)
CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_PER_TURN} + length(replace({_escaped("role")}, chr(10), '\\n')) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES = {"op2_ngram_join": NGRAM_JOIN, "op5_quality_rules": QUALITY, "op8_chat_format": CHAT}
