"""op13: all conversations, damaged and repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatterloom.llm.conversation_repair import repaired
from chatterloom.llm.registry import query
from chatterloom.llm.shared import table

SQL = r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i))),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
  list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda a, b: xor(a >> 8, t[CAST(1 + (xor(a, b) & 255) AS INTEGER)]), 4294967295)) % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos, rtrim(text, E' \t\n\x0b\x0c\r') AS body,
  count(*) OVER (PARTITION BY conv_id) AS n FROM d),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN body = '' THEN 'b' WHEN pos > min(pos) OVER (PARTITION BY conv_id, role, text) THEN 'd'
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM p),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM f GROUP BY conv_id),
ins(q, m, letters, lines) AS (VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']),
  (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])),
step(q, initial, role, next) AS (VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
e AS (SELECT conv_id, pos, m AS q, 'D' AS letter, 4 AS cost, m AS next, []::VARCHAR[] AS line FROM f, (SELECT unnest(range(4)) AS m)
  UNION ALL SELECT conv_id, pos, q, 'K', CASE fault WHEN 't' THEN 3 ELSE 0 END, next, [f.role || ':' || text] FROM f JOIN step USING (initial) WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, pos, q, 'R', CASE fault WHEN 't' THEN 6 ELSE 3 END, next, [step.role || ':' || text] FROM f, step WHERE step.role IS NOT NULL AND fault NOT IN ('b', 'd')),
b AS (SELECT conv_id, n AS pos, q, CAST(3 * len(letters) AS BIGINT) AS cost, letters AS audit, lines FROM c, ins WHERE m IN (0, 3) QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1
  UNION ALL SELECT x.conv_id, x.pos, x.q, min(x.cost), arg_min(x.audit, (x.cost, x.audit)), arg_min(x.lines, (x.cost, x.audit)) FROM (
    SELECT b.conv_id, b.pos - 1 AS pos, ins.q, 3 * len(ins.letters) + e.cost + b.cost AS cost, ins.letters || e.letter || b.audit AS audit, ins.lines || e.line || b.lines AS lines
    FROM b JOIN e ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND b.pos = e.pos AND b.q = e.next JOIN ins ON ins.m = e.q) x GROUP BY x.conv_id, x.pos, x.q)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.pos = 0 AND b.q = 0
"""


@query("op13_conversation_repair", SQL)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
