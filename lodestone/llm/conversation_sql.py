"""DuckDB SQL for op12: the dynamic program as a recursion over rows, with whole strings of edits instead of backpointers."""

from __future__ import annotations


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _option(letter: str, cost: str, rest: str) -> str:
    return f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a}}"


def _own(at: int, go: int, keep: dict[str, int]) -> str:
    """The best that starts with this row's own edit, from place `at`."""
    late = "CASE WHEN fault = 3 THEN 1 ELSE 0 END"
    kept = " ".join(f"WHEN ini = '{i}' AND fault IN (0, 3) THEN {_option('K', late, f's{to}')}" for i, to in keep.items())
    keeps = [f"CASE {kept} END"] if kept else []
    return _least(_option("D", "3", f"s{at}"), *keeps, f"CASE WHEN fault IN (0, 3) THEN {_option('R', f'2 + {late}', f's{go}')} END")


def op12_sql() -> str:
    go = (2, 2, 3, 2)
    keep = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    own = ", ".join(f"{_own(i, go[i], keep[i])} AS w{i}" for i in range(4))
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i))
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), act AS (
  SELECT src.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS act FROM src, tab
), bad AS (
  SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role, CASE WHEN act = 1 THEN '' WHEN act = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN act = 3 THEN [0, 1] ELSE [0] END) AS copy FROM act WHERE act <> 0
), named AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink, md5(strlen(role) || ':' || role || strlen(text) || ':' || text) AS digest FROM bad
), line AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, copy, nth) AS i, role[1] AS ini,
    CASE WHEN ink = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, digest ORDER BY turn NULLS FIRST, copy) AS nth FROM named)
), pair AS (
  SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS two FROM line
), stat AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (i > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM pair GROUP BY conv_id
), dp AS (
  SELECT conv_id, n AS i, {{'c': 0, 'a': ''}} AS s0, {{'c': 4, 'a': 'II'}} AS s1, {{'c': 2, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3 FROM stat
  UNION ALL
  SELECT conv_id, i, {_least("w0", _option("I", "2", "v2"))} AS s0, {_least("w1", _option("I", "2", "v2"))} AS s1, v2 AS s2, v3 AS s3
  FROM (SELECT conv_id, i, w0, w1, {_least("w2", _option("I", "2", "w3"))} AS v2, {_least("w3", _option("I", "2", "w2"))} AS v3
    FROM (SELECT dp.conv_id, dp.i - 1 AS i, {own} FROM dp JOIN line ON line.conv_id IS NOT DISTINCT FROM dp.conv_id AND line.i = dp.i))
), best AS (
  SELECT stat.*, s0.c AS cost, s0.a AS audit FROM stat JOIN dp ON dp.conv_id IS NOT DISTINCT FROM stat.conv_id AND dp.i = 0
), walk AS (
  SELECT conv_id, audit, 1 AS pos, 0 AS i, 0 AS place, []::VARCHAR[] AS lines FROM best
  UNION ALL
  SELECT w.conv_id, w.audit, w.pos + 1, CASE WHEN w.audit[w.pos] = 'I' THEN w.i ELSE w.i + 1 END,
    CASE WHEN w.audit[w.pos] = 'D' THEN w.place WHEN w.audit[w.pos] = 'K' THEN CASE l.ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN w.place = 2 THEN 3 ELSE 2 END,
    CASE w.audit[w.pos] WHEN 'D' THEN w.lines WHEN 'K' THEN list_append(w.lines, l.role || ':' || l.text) WHEN 'R' THEN list_append(w.lines, CASE WHEN w.place = 2 THEN 'assistant' ELSE 'user' END || ':' || l.text) ELSE list_append(w.lines, CASE WHEN w.place = 2 THEN 'assistant:' ELSE 'user:' END) END
  FROM walk w LEFT JOIN line l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i + 1 WHERE w.pos <= length(w.audit)
), whole AS (SELECT conv_id, array_to_string(lines, chr(10)) AS repaired FROM walk WHERE pos = length(audit) + 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, sha256(coalesce(repaired, '')) AS repaired_sha256, coalesce(audit, '') AS audit
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""
