"""SQL counterparts of the operators that SQL can state."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 of every byte.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS tab)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text in UTF-8; ``tab`` of ``crc_table`` must be in scope."""
    octets = f"""list_transform(range(1, octet_length(encode({text})) + 1),
      lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT)"""
    step = "lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce({octets}, {step}, 4294967295::BIGINT), 4294967295)"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


PREFIX_TRIE = f"""
WITH {_CRC_TABLE},
ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, {_crc32("conv_id::VARCHAR")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM ranked), crc_table),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, r.place, r.role, r.text
  FROM ids i JOIN ranked r ON r.conv_id = i.conv_id - i.conv_id % 5 AND r.place < i.h
  UNION ALL
  SELECT i.conv_id, 1, r.place, r.role, r.text
  FROM ids i JOIN ranked r ON r.conv_id = i.conv_id AND r.place >= i.h),
lists AS (
  SELECT i.conv_id,
         coalesce(list({{'role': role, 'text': text}} ORDER BY part, place) FILTER (WHERE part IS NOT NULL), []) AS seq
  FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id),
steps AS (
  SELECT conv_id, seq, d, list_slice(seq, 1, d) AS key
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM lists)),
nodes AS (
  SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = d), '') AS ends,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(key[d].text)) END AS saved
  FROM steps GROUP BY d, key),
children AS (
  SELECT list_slice(key, 1, d - 1) AS key, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.key = n.key),
below AS (
  SELECT list_slice(key, 1, e) AS key, e AS d, sum(saved)::BIGINT AS saved_tokens,
         count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves,
       b.saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN below b ON b.d = n.d AND b.key = n.key
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = list_slice(n.key, 1, n.d - 1) AND n.d > 0
"""

EXACT_DUPLICATES = f"""
WITH texts AS (SELECT doc_id, sha256({_lower("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
"""

SPELLING_VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_lower("text")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (
  SELECT run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM runs GROUP BY doc_id, run),
marked AS (SELECT run, n, {_crc32("key")} AS h FROM counted, crc_table WHERE length(run) >= 6),
spelled AS (
  SELECT CASE WHEN h % 199 = 0
              THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT)
              ELSE run END AS word, n FROM marked),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (
  SELECT word, n, substr(word, 1, i - 1) AS x, substr(word, i + 1) AS y
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.x = b.x AND a.y = b.y AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON b.word = a.x || a.y
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.x || a.y),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.near END AS form,
         CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, walk.at AS root
FROM walk JOIN formed last ON last.word = walk.at AND last.form IS NULL JOIN formed f ON f.word = walk.word
"""
