"""Queries op1, op7 and op8, and the SQL that gives their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, quality_rules, url_filter
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return df.select("page_id", "host", "path", "rule", "verdict")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _op1_sql() -> str:
    forms = sorted({f for s in quality_rules.STOP_WORDS for f in (s, s.capitalize(), s.upper())})
    tests = []
    for r in quality_rules.RULES:
        tests += [f"coalesce({r.metric} >= {r.least}, true)"] * (r.least is not None)
        tests += [f"coalesce({r.metric} <= {r.most}, true)"] * (r.most is not None)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+4]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: x IN ({_quoted(forms)}))) AS n_stop,
         length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
q AS (
  SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio,
         CASE WHEN n_words >= 20 THEN n_stop / n_words END AS stop_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
         n_upper / nullif(word_chars, 0) AS upper_ratio, n_exclamations / nullif(n_words, 0) AS exclamation_ratio,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM q
"""


def _op7_sql() -> str:
    u = url_filter
    rule = verdict = "NULL"
    for says, text in sorted(u.RULES, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '/{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{says}' ELSE {verdict} END"
    bare = rf"list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(regexp_replace(s, '\.[a-z]{{1,5}}$', ''), '{u.VARIABLE}') THEN '*' ELSE s END)"
    steps, before = [], "s0"
    for k in range(u.DEPTH + 1):
        steps.append(f"""
c{k} AS (SELECT host, tpl, b[{k + 2}] AS seg, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad FROM {before} GROUP BY ALL),
p{k} AS (SELECT host, tpl, count(*) AS kids, sum(n) AS n_all, sum(lab) AS lab_all, sum(bad) AS bad_all FROM c{k} GROUP BY ALL),
w{k} AS (
  SELECT host, tpl, seg, CASE WHEN seg <> '' AND ((kids >= {u.MANY_CHILDREN} AND n * kids <= 4 * n_all) OR coalesce(
    abs(bad / nullif(lab, 0) - (bad_all - bad) / nullif(lab_all - lab, 0)) <= {u.SAME_Z} * sqrt(greatest(0, (bad_all / nullif(lab_all, 0)) * (1 - bad_all / nullif(lab_all, 0)))
      * (1.0::DOUBLE / nullif(lab, 0) + 1.0::DOUBLE / nullif(lab_all - lab, 0))), false)) THEN '*' ELSE seg END AS step
  FROM c{k} JOIN p{k} USING (host, tpl)),
s{k + 1} AS (SELECT s.host, s.b, s.n, s.lab, s.bad, s.tpl || '/' || step AS tpl FROM {before} s JOIN w{k} w ON s.host = w.host AND s.tpl = w.tpl AND s.b[{k + 2}] = w.seg),""")
        before = f"s{k + 1}"
    return rf"""
WITH u0 AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u1 AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u0),
u2 AS (SELECT *, {rule} AS rule, {verdict} AS said, {bare} AS parts FROM u1),
u3 AS (SELECT *, [''] || list_transform(range(2, {u.DEPTH + 2}), lambda k: coalesce(parts[k], '')) || [array_to_string(parts[{u.DEPTH + 2}:], '/')] AS b FROM u2),
s0 AS (SELECT host, b, count(*) AS n, count(said) AS lab, count(*) FILTER (said = 'block') AS bad, '' AS tpl FROM u3 GROUP BY host, b),{''.join(steps)}
f AS (SELECT *, tpl AS t FROM {before}),
o AS (SELECT host, t, sum(bad) AS bad, sum(lab) AS lab FROM f GROUP BY host, t),
e AS (SELECT t, (sum(bad) + {u.PRIOR * u.WEIGHT}) / (sum(lab) + {u.WEIGHT}) AS anywhere FROM o GROUP BY t),
y AS (SELECT host, o.t AS t, (bad + anywhere * {u.WEIGHT}) / (lab + {u.WEIGHT}) AS purity FROM o JOIN e ON o.t = e.t)
SELECT page_id, u3.host AS host, path, rule, coalesce(said, CASE WHEN purity >= {u.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM u3 JOIN f ON u3.host = f.host AND u3.b = f.b JOIN y ON f.host = y.host AND f.t = y.t
"""


def _op8_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    width = decontaminate.WIDTH
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
g AS (SELECT DISTINCT item, w[i:i + {width - 1}] AS gram FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {width - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(gram) AS n FROM g),
x AS (SELECT doc_id, i, n, w[i:i + n - 1] AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n)),
h AS (SELECT doc_id, i, n, item FROM x JOIN g USING (gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""


QUERIES = {"op1_quality_rules": op1_quality_rules, "op7_url_filter": op7_url_filter, "op8_decontaminate": op8_decontaminate}
SQL = {"op1_quality_rules": _op1_sql(), "op7_url_filter": _op7_sql(), "op8_decontaminate": _op8_sql()}
