"""Queries op11, op12 and op13, and the SQL of the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversations, mixing, whitening
from .common import table


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")))


def _op13_sql() -> str:
    """Turn by turn over the best way to each of four states, a struct of cost and audit."""
    c = conversations
    add = lambda cell, cost, letters: f"CASE WHEN {cell} IS NOT NULL THEN {{'c': {cell}.c + {cost}, 'a': {cell}.a || '{letters}'}} END"
    least = lambda *cells: f"list_min([{', '.join(cells)}])"
    # Deleted; kept or made to fit; then inserts.
    turn = {
        "n0": add("v0", c.DELETE, "D"),
        "n1": least(add("v1", c.DELETE, "D"), f"CASE WHEN fresh AND x = 's' THEN {add('v0', 'more', 'K')} END"),
        "n2": least(add("v2", c.DELETE, "D"), *(f"CASE WHEN fresh THEN {add(v, f'CASE WHEN x = {u} THEN 0 ELSE {c.REROLE} END + more', '~')} END" for v in ("v0", "v1", "v3") for u in ("'u'",))),
        "n3": least(add("v3", c.DELETE, "D"), f"CASE WHEN fresh THEN {add('v2', f'CASE WHEN x = {chr(39)}a{chr(39)} THEN 0 ELSE {c.REROLE} END + more', '~')} END"),
    }
    turn = {k: v.replace("'~'", f"CASE WHEN x = '{'u' if k == 'n2' else 'a'}' THEN 'K' ELSE 'R' END") for k, v in turn.items()}
    one, two = c.INSERT, 2 * c.INSERT
    shut = {
        "v0": "n0", "v1": "n1",
        "v2": least("n2", add("n0", one, "I"), add("n1", one, "I"), add("n3", one, "I")),
        "v3": least("n3", add("n2", one, "I"), add("n0", two, "II"), add("n1", two, "II")),
    }
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR))"
    start = f"{{'c': 0::BIGINT, 'a': ''}}::STRUCT(c BIGINT, a VARCHAR) AS v0, {none} AS v1, {{'c': {one}::BIGINT, 'a': 'I'}}::STRUCT(c BIGINT, a VARCHAR) AS v2, {{'c': {two}::BIGINT, 'a': 'II'}}::STRUCT(c BIGINT, a VARCHAR) AS v3"
    spaces = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda b: ascii(b)::BIGINT),
           lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, crc),
m AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM d),
r AS (
  SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS x, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         NOT regexp_matches(text, '[.!?]{spaces}*$') AS cut, lag(substr(role, 1, 1)) OVER w AS before
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS (SELECT conv_id, turn, role, text, i, x, blank, again, cut, before, NOT blank AND NOT again AS fresh, CASE WHEN cut THEN {c.TRUNCATED} ELSE 0 END AS more FROM r),
s AS (
  SELECT conv_id, 0::BIGINT AS i, {start} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {', '.join(f'{v} AS {k}' for k, v in shut.items())}
  FROM (SELECT s.conv_id, f.i, {', '.join(f'{v} AS {k}' for k, v in turn.items())} FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)),
b AS (SELECT conv_id, {least('v0', 'v3')} AS best FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
         count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (before || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
l AS (SELECT conv_id, best.a AS a, unnest(range(1, length(best.a) + 1)) AS p FROM b),
e AS (SELECT *, a[p] AS op, sum(CASE WHEN a[p] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM l),
k AS (
  SELECT e.conv_id, p, op, f.role, coalesce(f.text, '') AS text, row_number() OVER (PARTITION BY e.conv_id ORDER BY p) AS place,
         first_value(CASE WHEN op = 'K' THEN f.x ELSE 'u' END) OVER (PARTITION BY e.conv_id ORDER BY p) = 's' AS led
  FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND op <> 'I' WHERE op <> 'D'),
h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (place + led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS sha FROM k GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM b LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM b.conv_id
"""


QUERIES = {"op11_mixing": op11_mixing, "op12_whitening": op12_whitening, "op13_conversations": op13_conversations}
SQL = {"op13_conversations": _op13_sql()}
