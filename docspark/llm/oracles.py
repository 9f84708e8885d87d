"""The same rows in DuckDB's SQL, for the operators that SQL can express."""

from __future__ import annotations

from docspark.llm import url_filter

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS inter FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
one AS (SELECT a, b FROM shared WHERE 100 * inter >= 75 * (na + nb - inter)),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_of USING (doc_id)
"""

QUALITY_RULES = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
keyed AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS g FROM grams),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY 1),
base AS (SELECT w.doc_id, text, words, lines, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (4 * n_symbols > n_words) AND NOT (upper >= 20 AND 2 * upper > letters) AND NOT (4 * (length(text) - length(replace(text, '!', ''))) > n_words + 8) AND NOT (len(lines) > 3 AND 10 * n_dup_lines > 3 * len(lines))
  AND NOT (n_words >= 10 AND 4 * len(list_filter(range(2, n_words + 1), lambda i: words[i] = words[i - 1])) > n_words) AND NOT (2 * len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]'))) < n_words)
  AND NOT (n_words > 50 AND len(list_distinct(words)) < least(n_words / 6.0::DOUBLE, 4 * sqrt(n_words))) AS kept
FROM judged
"""

CHAT_FORMATTING = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY 1
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM benchmark),
sized AS (SELECT item, words, least(10, len(words)) AS m FROM b WHERE len(words) > 0),
strings AS (SELECT DISTINCT item, m, array_to_string(list_slice(words, i, i + m - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT m FROM strings),
runs AS (SELECT doc_id, i, m, array_to_string(list_slice(words, i, i + m - 1), ' ') AS s FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, lengths WHERE len(words) >= m)),
hits AS (SELECT doc_id, i, m, item FROM runs JOIN strings USING (m, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(words), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES = {
    "op2_minhash_near_dedup": NEAR_DEDUP,
    "op3_quality_rules": QUALITY_RULES,
    "op4_chat_formatting": CHAT_FORMATTING,
    "op7_url_filter": url_filter.SQL,
    "op9_decontamination": DECONTAMINATION,
}
