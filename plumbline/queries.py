"""Queries over the shared tables, one or more per operator, and the SQL that gives the same rows.

Scores are rounded to 6 decimals where they are returned, and to 9 before a cutoff is compared with them, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import ResponseFrame
from .operators import index_flags as IF
from .operators import indices as I
from .operators import timing as T
from .plans import composite as C
from .plans import registry as R
from .plans import screen as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CODES = ("click", "error", "purchase", "signup", "view")

# --- matrices -------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "user_id AS r", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS i",
        "CAST(CASE event_type " + " ".join(f"WHEN '{c}' THEN {k + 1}" for k, c in enumerate(CODES)) + " END AS DOUBLE) AS v", "value AS t",
    )


def ev(spark: SparkSession, sf: str, value: str = "v") -> ResponseFrame:
    """All events of each user; as many items as the longest row has, the rest of the others is missing."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    items = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return ResponseFrame.from_long(_events(spark, sf), "r", "i", value, items)


def li(spark: SparkSession, sf: str) -> ResponseFrame:
    df = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("r"), (F.col("l_linenumber") - 1).alias("i"))
    return ResponseFrame.from_long(df.agg(F.ceil(F.max("l_quantity") / 10).cast("double").alias("v")), "r", "i", "v", 7)


def totals(spark: SparkSession, sf: str) -> ResponseFrame:
    """Two items for each order: what its lines have in quantity and in price."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("a"), F.round(F.sum("l_extendedprice"), 2).alias("b"))
    row = F.array(F.col("a").cast("double"), F.col("b").cast("double"))
    return ResponseFrame(df.select(F.col("l_orderkey").cast("string").alias("respondent_id"), F.col("l_orderkey").alias("ord"), row.alias("responses")), 2)


def emb(spark: SparkSession, sf: str) -> ResponseFrame:
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("respondent_id"), F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("responses")
    )
    return ResponseFrame(df, 64)


def oa(spark: SparkSession, sf: str) -> ResponseFrame:
    df = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("a0"), F.round(F.sum("l_extendedprice"), 2).alias("a1"), F.max("l_quantity").alias("a2"), F.max("l_extendedprice").alias("a3"),
        F.min("l_quantity").alias("a4"), F.min("l_extendedprice").alias("a5"), (51 - F.max("l_quantity")).alias("a6"), (51 - F.min("l_quantity")).alias("a7"),
    )
    row = F.array(*[F.col(f"a{k}").cast("double") for k in range(8)])
    return ResponseFrame(df.select(F.col("l_orderkey").cast("string").alias("respondent_id"), F.col("l_orderkey").alias("ord"), row.alias("responses")), 8)


_CODE = "CAST(CASE event_type " + " ".join(f"WHEN '{c}' THEN {k + 1}" for k, c in enumerate(CODES)) + " END AS DOUBLE)"
_EV = f"SELECT user_id AS r, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS i, {_CODE} AS v, value AS t FROM events"


def M_EV(value: str = "v") -> str:
    return f"m AS (SELECT r, i, {value} AS v FROM ({_EV}))"


M_LI = "m AS (SELECT l_orderkey AS r, CAST(l_linenumber - 1 AS INT) AS i, CAST(ceil(max(l_quantity) / 10) AS DOUBLE) AS v FROM lineitem GROUP BY ALL)"


M_EMB = "m AS (SELECT vec_id AS r, CAST(k AS INT) AS i, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS g(k))"
M_TOTALS = """w AS (SELECT l_orderkey AS r, sum(l_quantity) AS a, round(sum(l_extendedprice), 2) AS b FROM lineitem GROUP BY l_orderkey),
m AS (SELECT r, CAST(k AS INT) AS i, CAST([a, b][k + 1] AS DOUBLE) AS v FROM w, range(2) AS g(k))"""


M_OA = """w AS (SELECT l_orderkey AS r, sum(l_quantity) AS a0, round(sum(l_extendedprice), 2) AS a1, max(l_quantity) AS a2, max(l_extendedprice) AS a3,
min(l_quantity) AS a4, min(l_extendedprice) AS a5, 51 - max(l_quantity) AS a6, 51 - min(l_quantity) AS a7 FROM lineitem GROUP BY l_orderkey),
m AS (SELECT r, CAST(k AS INT) AS i, CAST([a0, a1, a2, a3, a4, a5, a6, a7][k + 1] AS DOUBLE) AS v FROM w, range(8) AS g(k))"""

# --- helpers --------------------------------------------------------------------------------------------------------


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def _scored(frame: ResponseFrame, **columns: Column) -> DataFrame:
    return frame.df.select(F.col("ord").alias("r"), *[_r(c).alias(k) for k, c in columns.items()])


def score(name: str, matrix: Callable, column: Callable[[ResponseFrame], Column], sql: str | None = None) -> None:
    """A query of r and score; sql: the CTEs up to s(r, score)."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        frame = matrix(spark, sf)
        return _scored(frame, score=column(frame))

    QUERIES[name] = run
    if sql:
        SQL[name] = f"WITH {sql} SELECT r, round(score, 6) + 0.0 AS score FROM s"


def flagged(name: str, matrix: Callable, flags: Callable[[ResponseFrame], DataFrame], sql: str, direction: str, threshold: float | None = None, percentile: float | None = None, inclusive: bool | None = None, null_flag: bool = False) -> None:
    """A query of r, score and flag; what follows sql tells the SQL what `flags` does."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return flags(matrix(spark, sf)).select(F.col("ord").alias("r"), _r(F.col("score")).alias("score"), "flag")

    QUERIES[name] = run
    p = (5.0 if direction == "low" else 95.0) if percentile is None else percentile
    cut = str(threshold) if threshold is not None else f"(SELECT coalesce(quantile_cont(q, {p / 100}), 0.0) FROM z)"
    equal = "=" if (threshold is not None if inclusive is None else inclusive) else ""
    test = f"coalesce(q {'<' if direction == 'low' else '>'}{equal} {cut}, {'true' if null_flag else 'false'})"
    SQL[name] = f"WITH {sql}, z AS (SELECT r, round(score, 9) + 0.0 AS q FROM s) SELECT r, round(q, 6) + 0.0 AS score, {test} AS flag FROM z"


def summarised(name: str, matrix: Callable, summary: Callable, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: summary(matrix(spark, sf)).select(
        *[_r(F.col(k)).alias(k) for k in ("mean", "std", "min", "max", "median")], "n_total", "n_valid"
    )
    SQL[name] = f"""WITH {sql} SELECT round(avg(score), 6) + 0.0 AS mean, round(stddev_pop(score), 6) + 0.0 AS std, round(min(score), 6) + 0.0 AS min, round(max(score), 6) + 0.0 AS max,
round(quantile_cont(score, 0.5), 6) + 0.0 AS median, count(*) AS n_total, count(score) AS n_valid FROM s"""


# --- SQL of the indices: CTEs from m(r, i, v) to s(r, score) ----------------------------------------------------------

U = "u AS (SELECT DISTINCT r FROM m)"
BOUNDS = "b AS (SELECT min(v) AS lo, max(v) AS hi FROM m)"
CORR = "CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(x) = 0 OR var_pop(y) = 0 THEN {zero} ELSE greatest(-1, least(1, corr(x, y))) END"
IRV = "s AS (SELECT r, stddev_pop(v) AS score FROM m GROUP BY r)"
LONGSTRING = """k AS (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY i) - row_number() OVER (PARTITION BY r, v ORDER BY i) AS g FROM m),
s AS (SELECT r, CAST(max(n) AS DOUBLE) AS score FROM (SELECT r, count(*) AS n FROM k GROUP BY r, v, g) GROUP BY r)"""
MARKOV = """n AS (SELECT r, v AS a, lead(v) OVER (PARTITION BY r ORDER BY i) AS b FROM m),
c AS (SELECT r, a, b, count(*) AS c FROM n WHERE b IS NOT NULL GROUP BY ALL),
f AS (SELECT r, sum(c) AS n, sum(c * log2(c)) AS x FROM c GROUP BY r),
h AS (SELECT r, sum(c * log2(c)) AS y FROM (SELECT r, a, sum(c) AS c FROM c GROUP BY r, a) GROUP BY r),
s AS (SELECT u.r AS r, (y - x) / n AS score FROM (SELECT DISTINCT r FROM m) u LEFT JOIN f ON u.r = f.r LEFT JOIN h ON u.r = h.r)"""
U3 = f"{BOUNDS}, s AS (SELECT r, avg(CASE WHEN v = lo OR v = hi THEN 1.0 ELSE 0.0 END) AS score FROM m, b GROUP BY r)"
MIDPOINT = "s AS (SELECT r, avg(CASE WHEN abs(v - 3) <= 0.5 THEN 1.0 ELSE 0.0 END) AS score FROM m GROUP BY r)"
ACQUIESCENCE = f"{BOUNDS}, s AS (SELECT r, greatest(0, least(1, (avg(v) - any_value(lo)) / (any_value(hi) - any_value(lo)))) AS score FROM m, b GROUP BY r)"
PERSON_TOTAL = f"""t AS (SELECT i, avg(v) AS y FROM m GROUP BY i),
s AS (SELECT r, {CORR.format(zero='NULL')} AS score FROM (SELECT r, v AS x, y FROM m JOIN t USING (i)) GROUP BY r)"""


def PSYCH(test: str) -> str:
    return f"""pr AS (SELECT a.i AS i, b.i AS j FROM m a JOIN m b ON a.r = b.r AND a.i > b.i GROUP BY a.i, b.i HAVING corr(a.v, b.v) {test}),
s AS (SELECT r, coalesce({CORR.format(zero='0.0')}, 0.0) AS score FROM (SELECT a.r AS r, a.v AS x, b.v AS y FROM pr JOIN m a ON a.i = pr.i JOIN m b ON b.i = pr.j AND b.r = a.r) GROUP BY r)"""


def GUTTMAN(normal: bool) -> str:
    below = "/ (any_value(n) * (any_value(n) - 1) / 2)" if normal else ""
    return f"""o AS (SELECT i, row_number() OVER (ORDER BY avg(v), i) AS k FROM m GROUP BY i),
q AS (SELECT r, k, v, count(*) OVER (PARTITION BY r) AS n FROM m JOIN o USING (i)),
s AS (SELECT a.r AS r, CAST(count(*) FILTER (a.v < b.v) AS DOUBLE) {below} AS score FROM (SELECT r, k, v FROM q) a JOIN q b ON a.r = b.r AND a.k < b.k GROUP BY a.r)"""


def INFREQUENCY(items: list[int], expected: list[float], missing: str, proportion: bool) -> str:
    want = "CASE k " + " ".join(f"WHEN {i} THEN {e}" for i, e in zip(items, expected, strict=True)) + " END"
    part = {"pass": "0.0", "fail": "1.0"}.get(missing, "0.0")
    base = "count(v)" if missing == "omit" else "count(*)"
    whole = f"sum(CASE WHEN v IS NULL THEN {part} WHEN v <> {want} THEN 1.0 ELSE 0.0 END)" + (f" / nullif({base}, 0)" if proportion else "")
    guard = {"omit": "CASE WHEN count(v) > 0 THEN {} END", "propagate": "CASE WHEN count(v) = count(*) THEN {} END"}.get(missing, "{}")
    return f"{U}, e AS (SELECT u.r AS r, k, v FROM u CROSS JOIN (SELECT unnest({items}) AS k) LEFT JOIN m ON m.r = u.r AND m.i = k), s AS (SELECT r, {guard.format(whole)} AS score FROM e GROUP BY r)"


def PAIRS(pairs: list[tuple[int, int]], gap: str) -> str:
    """d(r, gap): mean gap over the pairs of which both are there; lo and hi are known."""
    listed = ", ".join(f"({a}, {b})" for a, b in pairs)
    return f"{U}, {BOUNDS}, d AS (SELECT a.r AS r, avg({gap}) AS gap FROM (VALUES {listed}) AS pr(i, j) JOIN m a ON a.i = pr.i JOIN m c ON c.i = pr.j AND c.r = a.r, b GROUP BY a.r)"


def MAD(pairs) -> str:
    return PAIRS(pairs, "abs(a.v - (lo + hi - c.v))") + ", s AS (SELECT u.r AS r, gap AS score FROM u LEFT JOIN d ON u.r = d.r)"


def SEMANTIC(pairs, opposite: bool) -> str:
    gap = "abs(a.v - (lo + hi - c.v))" if opposite else "abs(a.v - c.v)"
    return PAIRS(pairs, gap) + """, e AS (SELECT r, stddev_pop(v) AS sd FROM m GROUP BY r),
s AS (SELECT u.r AS r, CASE WHEN gap IS NULL OR sd IS NULL THEN NULL WHEN sd > 0 THEN greatest(-1, least(1, 1 - gap / sd)) WHEN gap <= 1e-8 THEN 1.0 ELSE -1.0 END AS score
FROM u LEFT JOIN d ON u.r = d.r LEFT JOIN e ON u.r = e.r)"""


def EVENODD(size: int, count: bool = False) -> str:
    return f"""q AS (SELECT r, i // {size} AS f, (i % {size}) // 2 AS k, i % {size} % 2 AS odd, v FROM m),
f AS (SELECT r, f, {CORR.format(zero='0.0')} AS c FROM (SELECT a.r AS r, a.f AS f, a.v AS x, b.v AS y FROM q a JOIN q b ON a.r = b.r AND a.f = b.f AND a.k = b.k AND a.odd = 0 AND b.odd = 1) GROUP BY r, f),
{U}, s AS (SELECT u.r AS r, coalesce(avg(c), 0.0) AS score, CAST(count(c) AS DOUBLE) AS n FROM u LEFT JOIN f ON u.r = f.r GROUP BY u.r)"""


def PATTERN(most: int = 5) -> str:
    parts = []
    for k in range(2, most + 1):
        parts.append(f"""SELECT r, max({k} + stop - t) AS c FROM (
  SELECT r, t, n, varied, hit, coalesce(min(CASE WHEN NOT hit THEN t END) OVER (PARTITION BY r ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n - {k} + 1) AS stop
  FROM (SELECT r, t, n, coalesce(v = lead(v, {k}) OVER w, false) AS hit, min(v) OVER x <> max(v) OVER x AS varied FROM c
        WINDOW w AS (PARTITION BY r ORDER BY t), x AS (PARTITION BY r ORDER BY t ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)))
  WHERE hit AND varied AND n // 2 >= {k} AND n >= 4 GROUP BY r""")
    return f"""c AS (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY i) AS t, count(*) OVER (PARTITION BY r) AS n FROM m),
{U}, a AS ({' UNION ALL '.join(parts)}), s AS (SELECT u.r AS r, CAST(coalesce(max(a.c), 0) AS DOUBLE) AS score FROM u LEFT JOIN a ON u.r = a.r GROUP BY u.r)"""


def ONSET(window: int = 10, least: int = 20) -> str:
    return f"""c AS (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS t, count(*) OVER (PARTITION BY r) AS n FROM m),
d AS (SELECT r, t, n - {window} + 1 AS w, stddev_pop(v) OVER (PARTITION BY r ORDER BY t ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS s FROM c WHERE n >= {least}),
e AS (SELECT r, t AS k, w, s, sum(s) OVER o AS p, sum(s * s) OVER o AS q, sum(s) OVER (PARTITION BY r) AS whole FROM d WHERE t < w AND w >= 3 WINDOW o AS (PARTITION BY r ORDER BY t)),
f AS (SELECT r, k, w, p, whole, lag(p) OVER (PARTITION BY r ORDER BY k) AS p1, lag(q) OVER (PARTITION BY r ORDER BY k) AS q1 FROM e),
g AS (SELECT r, k, pow(p - (k + 1) / w * whole, 2) / greatest(q1 - p1 * p1 / k, 1e-10) AS stat FROM f WHERE k >= greatest(1, w // 10) AND k < w - greatest(1, w // 10)),
h AS (SELECT r, k, stat, row_number() OVER (PARTITION BY r ORDER BY round(stat, 9) DESC, k) AS n FROM g),
{U}, s AS (SELECT u.r AS r, CASE WHEN stat > 1.358 THEN CAST(k + {window} - 1 AS DOUBLE) END AS score FROM u LEFT JOIN h ON u.r = h.r AND h.n = 1)"""


SPLITS, SPLIT_SEED = 100, 17


def RELIABILITY(items: int) -> str:
    rng, half, rows = np.random.RandomState(SPLIT_SEED), items // 2, []
    for n in range(SPLITS):
        o = rng.permutation(items).tolist()
        rows += [f"({n}, {a}, {b})" for a, b in zip(o[:half], o[half : 2 * half], strict=True)]
    return f"""pr(n, a, b) AS (VALUES {', '.join(rows)}),
f AS (SELECT r, n, {CORR.format(zero='NULL')} AS c FROM (SELECT x.r AS r, n, x.v AS x, y.v AS y FROM pr JOIN m x ON x.i = a JOIN m y ON y.i = b AND y.r = x.r) GROUP BY r, n),
{U}, g AS (SELECT u.r AS r, avg(c) AS c FROM u LEFT JOIN f ON u.r = f.r GROUP BY u.r), s AS (SELECT r, 2 * c / nullif(1 + c, 0) AS score FROM g)"""


MAHAD2 = """x AS (SELECT r, max(v) FILTER (i = 0) AS x, max(v) FILTER (i = 1) AS y FROM m GROUP BY r),
g AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c FROM x),
s AS (SELECT r, sqrt((vy * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + vx * (y - my) * (y - my)) / (vx * vy - c * c)) AS score FROM x, g)"""


def TIME(f: str) -> str:
    return f"s AS (SELECT r, {f} AS score FROM m GROUP BY r)"


# --- registered indices -----------------------------------------------------------------------------------------------

PAIR_LIST = [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9)]
LI_PAIRS = [(0, 6), (1, 5), (2, 4)]
times = lambda s, d: ev(s, d, "t")

score("irv", li, I.irv, f"{M_LI}, {IRV}")
SPLIT_SQL = "{items}, q AS (SELECT r, {part} AS k, stddev_pop(v) AS sd FROM m, n GROUP BY ALL), s AS (SELECT r, CASE WHEN count(*) = {parts} THEN sum(sd) / {parts} END AS score FROM q GROUP BY r)"
ITEMS = "n AS (SELECT max(i) + 1 AS p FROM m)"
score("irv_split", ev, lambda f: I.irv(f, split=True, num_split=3), f"{M_EV()}, {SPLIT_SQL.format(items=ITEMS, parts=3, part='CASE WHEN i < (p % 3) * (p // 3 + 1) THEN i // (p // 3 + 1) ELSE p % 3 + (i - (p % 3) * (p // 3 + 1)) // (p // 3) END')}")
score("irv_split_points", ev, lambda f: I.irv(f, split=True, split_points=[0, 10, f.n_items]), f"{M_EV()}, {SPLIT_SQL.format(items=ITEMS, parts=2, part='CASE WHEN i < 10 THEN 0 ELSE 1 END')}")
score("longstring_scores", li, I.longstring_scores, f"{M_LI}, {LONGSTRING}")
score("longstring_pattern", ev, I.longstring_pattern, f"{M_EV()}, {PATTERN()}")
score("markov", li, I.markov, f"{M_LI}, {MARKOV}")
flagged("markov_flag", ev, lambda f: IF.markov_flag(f, digits=9), f"{M_EV()}, {MARKOV}", "low")
summarised("markov_summary", ev, IF.markov_summary, f"{M_EV()}, {MARKOV}")
score("missing_rate", li, I.missing_rate, f"{M_LI}, s AS (SELECT r, 1 - count(*) / 7 AS score FROM m GROUP BY r)")
flagged("missing_rate_flag", li, lambda f: IF.missing_rate_flag(f, threshold=0.7, digits=9), f"{M_LI}, s AS (SELECT r, (7 - count(*)) / 7 AS score FROM m GROUP BY r)", "high", threshold=0.7)


def _masked(spark: SparkSession, sf: str) -> ResponseFrame:
    """Even items apply to all, odd ones to respondents with an even number."""
    f = li(spark, sf)
    mask = F.array(*[F.lit(True) if k % 2 == 0 else F.col("ord") % 2 == 0 for k in range(7)])
    return ResponseFrame(f.df.withColumn("applicable", mask), 7)


score(
    "missing_rate_mask", _masked, lambda f: I.missing_rate(f, applicable=True),
    f"{M_LI}, {U}, s AS (SELECT u.r AS r, count(*) FILTER (v IS NULL) / count(*) AS score FROM u CROSS JOIN range(7) AS g(k) LEFT JOIN m ON m.r = u.r AND m.i = k WHERE k % 2 = 0 OR u.r % 2 = 0 GROUP BY u.r)",
)
score("u3_poly", li, I.u3_poly, f"{M_LI}, {U3}")
score("midpoint", li, lambda f: I.midpoint_responding(f, 1, 5, 0.5), f"{M_LI}, {MIDPOINT}")
score("acquiescence", li, I.acquiescence, f"{M_LI}, {ACQUIESCENCE}")
flagged("acquiescence_flag", ev, lambda f: IF.acquiescence_flag(f, digits=9), f"{M_EV()}, {ACQUIESCENCE}", "high")
score(
    "acquiescence_balanced", li, lambda f: I.acquiescence(f, positive_items=[0, 1, 2], negative_items=[6, 5, 4]),
    f"{M_LI}, {PAIRS(LI_PAIRS, '(a.v + (hi + lo - c.v)) / 2')}, s AS (SELECT u.r AS r, CASE WHEN gap IS NOT NULL THEN greatest(0, least(1, (gap - lo) / (hi - lo))) END AS score FROM u LEFT JOIN d ON u.r = d.r, b)",
)
for _policy in ("pass", "fail", "omit", "propagate"):
    score(
        f"infrequency_{_policy}", li, lambda f, p=_policy: I.infrequency(f, [0, 3], [5, 1], proportion=p != "fail", missing=p),
        f"{M_LI}, {INFREQUENCY([0, 3], [5, 1], _policy, _policy != 'fail')}",
    )
flagged("infrequency_flag", li, lambda f: IF.infrequency_flag(f, [0, 3], [5, 1], digits=9), f"{M_LI}, {INFREQUENCY([0, 3], [5, 1], 'pass', False)}", "high", threshold=1.0)
score("mad", li, lambda f: I.mad(f, [0, 1, 2], [6, 5, 4]), f"{M_LI}, {MAD(LI_PAIRS)}")
flagged("mad_flag", ev, lambda f: IF.mad_flag(f, item_pairs=PAIR_LIST, digits=9), f"{M_EV()}, {MAD(PAIR_LIST)}", "high")
score("semantic_syn", ev, lambda f: I.semantic_syn(f, PAIR_LIST), f"{M_EV()}, {SEMANTIC(PAIR_LIST, False)}")
score("semantic_ant", li, lambda f: I.semantic_ant(f, LI_PAIRS), f"{M_LI}, {SEMANTIC(LI_PAIRS, True)}")
flagged("semantic_syn_flag", ev, lambda f: IF.semantic_syn_flag(f, PAIR_LIST, percentile=10.0, digits=9), f"{M_EV()}, {SEMANTIC(PAIR_LIST, False)}", "low", percentile=10.0)
flagged("semantic_ant_flag", ev, lambda f: IF.semantic_ant_flag(f, PAIR_LIST, percentile=10.0, digits=9), f"{M_EV()}, {SEMANTIC(PAIR_LIST, True)}", "low", percentile=10.0)
def _tens(items: int) -> list[int]:
    return [10] * (items // 10) + [items % 10] * (items % 10 > 0)


score("evenodd", ev, lambda f: I.evenodd(f, _tens(f.n_items)), f"{M_EV()}, {EVENODD(10)}")
score("evenodd_diag", ev, lambda f: I.evenodd(f, _tens(f.n_items), diag=True)[1], f"{M_EV()}, {EVENODD(10).replace('AS score, CAST(count(c) AS DOUBLE) AS n', 'AS mean, CAST(count(c) AS DOUBLE) AS score')}")
score("person_total", li, I.person_total, f"{M_LI}, {PERSON_TOTAL}")
score("psychsyn", oa, I.psychsyn, f"{M_OA}, {PSYCH('>= 0.6')}")
score("psychant", oa, I.psychant, f"{M_OA}, {PSYCH('<= -0.6')}")
score("psychsyn_diag", oa, lambda f: I.psychsyn(f, diag=True)[1].cast("double"), f"{M_OA}, {PSYCH('>= 0.6')}".rsplit("s AS", 1)[0] + "s AS (SELECT DISTINCT r, CAST((SELECT count(*) FROM pr) AS DOUBLE) AS score FROM m)")
summarised("psychsyn_summary", oa, IF.psychsyn_summary, f"{M_OA}, {PSYCH('>= 0.6')}")
QUERIES["psychsyn_critval"] = lambda s, d: I.psychsyn_critval(oa(s, d), min_correlation=0.1).withColumn("correlation", _r(F.col("correlation")))
SQL["psychsyn_critval"] = f"WITH {M_OA} SELECT a.i AS item_a, b.i AS item_b, round(corr(a.v, b.v), 6) + 0.0 AS correlation FROM m a JOIN m b ON a.r = b.r AND a.i > b.i GROUP BY a.i, b.i HAVING corr(a.v, b.v) >= 0.1"
score("guttman", emb, I.guttman, f"{M_EMB}, {GUTTMAN(True)}")
score("guttman_raw", emb, lambda f: I.guttman(f, normalize=False), f"{M_EMB}, {GUTTMAN(False)}")
flagged("guttman_flag", emb, lambda f: IF.guttman_flag(f, digits=9), f"{M_EMB}, {GUTTMAN(True)}", "high", threshold=0.5, inclusive=False)
score("onset", ev, I.onset, f"{M_EV()}, {ONSET()}")
QUERIES["onset_flag"] = lambda s, d: IF.onset_flag(ev(s, d)).select(F.col("ord").alias("r"), _r(F.col("score")).alias("score"), "flag")
SQL["onset_flag"] = f"WITH {M_EV()}, {ONSET()} SELECT r, score, score IS NOT NULL AS flag FROM s"
score("individual_reliability", li, lambda f: I.individual_reliability(f, SPLITS, SPLIT_SEED), f"{M_LI}, {RELIABILITY(7)}")
flagged("individual_reliability_flag", li, lambda f: IF.individual_reliability_flag(f, random_seed=SPLIT_SEED, digits=9), f"{M_LI}, {RELIABILITY(7)}", "low", threshold=0.3, inclusive=False, null_flag=True)
score("mahad", totals, I.mahad, f"{M_TOTALS}, {MAHAD2}")
summarised("mahad_summary", totals, IF.mahad_summary, f"{M_TOTALS}, {MAHAD2}")
score("mahad_pseudo_inverse", oa, I.mahad)


def _mahad_flag(method: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        f = totals(spark, sf)
        df = I.mahad_flag(f.with_scores(score=_r(I.mahad(f), 9)), 2, 0.95, method)
        return df.select(F.col("ord").alias("r"), _r(F.col("score")).alias("score"), "flag")

    return run


_FLAGS = {
    "chi2": "q > sqrt(-2 * ln(0.05))",  # the quantile with two degrees of freedom in closed form
    "iqr": "q > (SELECT quantile_cont(q, 0.75) + 1.5 * (quantile_cont(q, 0.75) - quantile_cont(q, 0.25)) FROM z) OR q < (SELECT quantile_cont(q, 0.25) - 1.5 * (quantile_cont(q, 0.75) - quantile_cont(q, 0.25)) FROM z)",
    "zscore": "abs(q - (SELECT avg(q) FROM z)) / (SELECT stddev_pop(q) FROM z) > 1.959963984540054",
}
for _method, _test in _FLAGS.items():
    QUERIES[f"mahad_{_method}_flag"] = _mahad_flag(_method)
    SQL[f"mahad_{_method}_flag"] = f"WITH {M_TOTALS}, {MAHAD2}, z AS (SELECT r, round(score, 9) AS q FROM s) SELECT r, round(q, 6) + 0.0 AS score, {_test} AS flag FROM z"
QUERIES["mahad_qqplot"] = lambda s, d: I.mahad_qqplot((f := totals(s, d)).with_scores(score=I.mahad(f)), 2).select("rank", _r(F.col("observed")).alias("observed"), _r(F.col("expected")).alias("expected"))
SQL["mahad_qqplot"] = f"""WITH {M_TOTALS}, {MAHAD2} SELECT rank, round(d, 6) + 0.0 AS observed, round(-2 * ln(1 - (rank - 0.5) / n), 6) + 0.0 AS expected
FROM (SELECT score * score AS d, row_number() OVER (ORDER BY score) AS rank, count(*) OVER () AS n FROM s)"""
score("lz", ev, I.lz)
QUERIES["lz_flag"] = lambda s, d: IF.lz_flag(ev(s, d)).select(F.col("ord").alias("r"), _r(F.col("score")).alias("score"), "flag")
_B = lambda items: [(k % 5 - 2) / 2 for k in range(items)]


def _with_theta(spark: SparkSession, sf: str) -> ResponseFrame:
    f = ev(spark, sf)
    return ResponseFrame(f.df.withColumn("theta", (F.col("ord") % 7 - 3) / 3.0), f.n_items)


score(
    "lz_given_theta", _with_theta, lambda f: I.lz(f, difficulty=_B(f.n_items), discrimination=[1.0] * f.n_items, theta="theta"),
    f"""{M_EV()}, {BOUNDS}, y AS (SELECT r, CASE WHEN v > (lo + hi) / 2 THEN 1 ELSE 0 END AS y, 1 / (1 + exp(-((r % 7 - 3) / 3.0::DOUBLE - (i % 5 - 2) / 2.0::DOUBLE))) AS p FROM m, b),
s AS (SELECT r, (sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) - sum(p * ln(p) + (1 - p) * ln(1 - p))) / sqrt(sum(p * (1 - p) * pow(ln(p / (1 - p)), 2))) AS score FROM y GROUP BY r)""",
)


def _pattern_of_four(spark: SparkSession, sf: str) -> DataFrame:
    f = li(spark, sf)
    return _scored(f, **I.response_pattern(f))


QUERIES["response_pattern"] = _pattern_of_four
SQL["response_pattern"] = f"""WITH {M_LI}, {BOUNDS} SELECT r, round(avg(CASE WHEN v = lo OR v = hi THEN 1.0 ELSE 0.0 END), 6) AS extreme, round(avg(CASE WHEN v = (lo + hi) / 2 THEN 1.0 ELSE 0.0 END), 6) AS midpoint,
round(avg(v), 6) AS acquiescence, round(stddev_pop(v), 6) + 0.0 AS variability FROM m, b GROUP BY r"""


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/events.parquet")
    chars = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.substring("event_type", 1, 1).alias("c")))), lambda x: x["c"])
    return df.groupBy(F.col("user_id").alias("r")).agg(F.array_join(chars, "").alias("t"))


_RUNS = """t AS (SELECT user_id AS r, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type[1] AS c FROM events),
g AS (SELECT r, c, k, k - row_number() OVER (PARTITION BY r, c ORDER BY k) AS g FROM t), n AS (SELECT r, c, count(*) AS n, min(k) AS k FROM g GROUP BY r, c, g)"""
QUERIES["longstring_text"] = lambda s, d: _texts(s, d).select("r", I.longstring_text(F.col("t")).alias("x")).select("r", F.col("x.char").alias("run_char"), F.col("x.length").cast("bigint").alias("run_length"))
SQL["longstring_text"] = f"WITH {_RUNS}, q AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, k) AS o FROM n) SELECT r, c AS run_char, n AS run_length FROM q WHERE o = 1"
QUERIES["longstring_text_avg"] = lambda s, d: _texts(s, d).select("r", _r(I.longstring_text(F.col("t"), avg=True)).alias("score"))
SQL["longstring_text_avg"] = f"WITH {_RUNS} SELECT r, round(avg(n), 6) AS score FROM n GROUP BY r"

# --- response times ---------------------------------------------------------------------------------------------------

for _metric, _f in (("mean", "avg(v)"), ("median", "median(v)"), ("sd", "stddev_pop(v)"), ("min", "min(v)")):
    score(f"response_time_{_metric}", times, lambda f, m=_metric: T.response_time(f, m), f"{M_EV('t')}, {TIME(_f)}")
score("response_time_consistency", times, T.response_time_consistency, f"{M_EV('t')}, {TIME('stddev_pop(v) / nullif(avg(v), 0)')}")
flagged("response_time_flag", times, T.response_time_flag, f"{M_EV('t')}, {TIME('median(v)')}", "low")
flagged("response_time_score_flags", times, lambda f: T.response_time_score_flags(f.with_scores(score=_r(T.response_time(f, "mean"), 9)), cutoff_percentile=90.0, direction="high"), f"{M_EV('t')}, {TIME('avg(v)')}", "high", percentile=90.0)
QUERIES["response_time_mixture"] = lambda s, d: T.response_time_mixture(times(s, d), random_seed=1).select(F.col("ord").alias("r"), _r(F.col("score")).alias("score"))

# --- screening --------------------------------------------------------------------------------------------------------

SCREENED = ("irv", "longstring", "psychsyn", "person_total", "acquiescence")
_PART = {"irv": IRV, "longstring": LONGSTRING, "psychsyn": PSYCH(">= 0.6"), "person_total": PERSON_TOTAL, "acquiescence": ACQUIESCENCE}


def _rounded(spark: SparkSession, sf: str, names=SCREENED) -> DataFrame:
    f = oa(spark, sf)
    columns, errors = R.score_columns(f, names, strict=True)
    return R.score_table(f, {k: _r(c, 9) for k, c in columns.items()})


def _joined(score: str = "round(score, 9) + 0.0") -> str:
    """x(r, irv, longstring, ...): scores, rounded unless told otherwise."""
    made = ", ".join(f"i_{k} AS (WITH {_PART[k]} SELECT r, {score} AS score FROM s)" for k in SCREENED)
    return f"{M_OA}, {made}, x AS (SELECT i_irv.r AS r, " + ", ".join(f"i_{k}.score AS {k}" for k in SCREENED) + " FROM i_irv " + " ".join(f"JOIN i_{k} ON i_{k}.r = i_irv.r" for k in SCREENED[1:]) + ")"


def _screen_sql(percentile: float = 95.0, min_flags: int = 2, least: int = 0, fixed: dict | None = None, own: dict | None = None, summary: bool = False) -> str:
    cuts, tests = [], {}
    for k in SCREENED:
        high = R.INDICES[k].direction == "high"
        p = (own or {}).get(k, percentile)
        cuts.append(f"{fixed[k]} AS {k}" if k in (fixed or {}) else f"coalesce(quantile_cont({k}, {(p if high else 100 - p) / 100}), 0.0) AS {k}")
        tests[k] = f"coalesce(x.{k} {'>' if high else '<'}{'=' if k in (fixed or {}) else ''} cuts.{k}, false)"
    head = f"WITH {_joined()}, cuts AS (SELECT {', '.join(cuts)} FROM x), f AS (SELECT x.*, " + ", ".join(f"{t} AS flag_{k}" for k, t in tests.items()) + " FROM x, cuts)"
    if summary:
        return head + " " + " UNION ALL ".join(
            f"""SELECT '{k}' AS "index", round(avg({k}), 6) + 0.0 AS mean, round(stddev_pop({k}), 6) + 0.0 AS std, round(min({k}), 6) + 0.0 AS min, round(max({k}), 6) + 0.0 AS max, count({k}) AS n_valid,
count(*) - count({k}) AS n_unavailable, count(*) FILTER (flag_{k}) AS n_flagged, round(count(*) FILTER (flag_{k}) / count({k}), 6) AS flag_rate FROM f""" for k in SCREENED
        )
    count, valid = " + ".join(f"CAST(flag_{k} AS INT)" for k in SCREENED), " + ".join(f"CAST({k} IS NOT NULL AS INT)" for k in SCREENED)
    return head + f" SELECT r, {', '.join(f'flag_{k}' for k in SCREENED)}, CAST({count} AS INT) AS flag_count, CAST({valid} AS INT) AS valid_index_count, ({valid}) >= {least} AND ({count}) >= {min_flags} AS consensus_flag FROM f"


_held: list[S.ScreenResult | C.CompositeResult] = []


def _one(result):
    """A result whose scores are held until the next query has one: a table that a query returns is computed later."""
    while _held:
        _held.pop().release()
    _held.append(result)
    return result


def _screen(**settings) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = _one(S.screen_scores(_rounded(spark, sf), **settings)).table
        return t.select(F.col("ord").alias("r"), *[F.col(f"flag__{k}").alias(f"flag_{k}") for k in SCREENED], "flag_count", "valid_index_count", "consensus_flag")

    return run


for _name, _spark, _sql in (
    ("screen_flags", {}, {}),
    ("screen_scores", {"percentile": 90.0, "min_flags": 1}, {"percentile": 90.0, "min_flags": 1}),
    ("screen_fixed_thresholds", {"thresholds": {"irv": 20000.0, "longstring": 2.0}}, {"fixed": {"irv": 20000.0, "longstring": 2.0}}),
    ("screen_percentile_overrides", {"percentiles": {"irv": 80.0, "person_total": 99.0}}, {"own": {"irv": 80.0, "person_total": 99.0}}),
    ("screen_min_valid", {"min_valid_indices": 5, "min_flags": 1}, {"least": 5, "min_flags": 1}),
):
    QUERIES[_name], SQL[_name] = _screen(**_spark), _screen_sql(**_sql)
QUERIES["screen_summary"] = lambda s, d: _one(S.screen_scores(_rounded(s, d))).summary.select(
    "index", *[_r(F.col(k)).alias(k) for k in ("mean", "std", "min", "max")], "n_valid", "n_unavailable", "n_flagged", _r(F.col("flag_rate")).alias("flag_rate")
)
SQL["screen_summary"] = _screen_sql(summary=True)


def _screen_frame(spark: SparkSession, sf: str) -> DataFrame:
    t = _one(S.screen(oa(spark, sf), SCREENED, percentile=90.0)).table
    return t.select(F.col("ord").alias("r"), *[F.col(f"flag__{k}").alias(f"flag_{k}") for k in SCREENED], "flag_count", "valid_index_count", "consensus_flag")


QUERIES["screen_frame"], SQL["screen_frame"] = _screen_frame, _screen_sql(percentile=90.0)
QUERIES["screen_default"] = lambda s, d: _one(S.screen(emb(s, d))).table.select(F.col("ord").alias("r"), "flag_count", "valid_index_count", "consensus_flag")

# --- composites -------------------------------------------------------------------------------------------------------

COMBINED = ("irv", "longstring", "psychsyn", "person_total")
WEIGHTS = {"irv": 2.0, "person_total": 0.5}


def _composite_sql(method: str = "mean", standardize: bool = True, weights: dict | None = None, least: int | None = None, last: str = "SELECT r, round(c, 6) + 0.0 AS composite FROM y", score: str = "round(score, 9) + 0.0") -> str:
    sign = {k: R.INDICES[k].sign for k in COMBINED}
    z = {k: f"({sign[k]}.0 * " + (f"CASE WHEN sd_{k} > 0 THEN ({k} - mu_{k}) / sd_{k} WHEN {k} IS NOT NULL THEN 0.0 END" if standardize else k) + ")" for k in COMBINED}
    w = dict.fromkeys(COMBINED, 1.0) | (weights or {})
    parts = ", ".join(f"{e} AS z_{k}" for k, e in z.items())
    stats = ", ".join(f"avg({k}) AS mu_{k}, stddev_pop({k}) AS sd_{k}" for k in COMBINED)
    added = " + ".join(f"coalesce(z_{k} * {w[k]}, 0)" for k in COMBINED)
    below = " + ".join(f"CASE WHEN z_{k} IS NULL THEN 0 ELSE {w[k]} END" for k in COMBINED)
    most = "greatest(" + ", ".join(f"z_{k} * {w[k]}" for k in COMBINED) + ")"
    out = {"mean": f"({added}) / nullif({below}, 0)", "sum": added, "max": most}[method]
    valid = " + ".join(f"CAST(z_{k} IS NOT NULL AS INT)" for k in COMBINED)
    if least is not None:
        out = f"CASE WHEN {valid} >= {least} THEN {out} END"
    return f"WITH {_joined(score)}, mu AS (SELECT {stats} FROM x), zs AS (SELECT r, {parts} FROM x, mu), y AS (SELECT r, {out} AS c FROM zs) {last}"


def _composite(**settings) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = _one(C.composite_scores(_rounded(spark, sf, COMBINED), **settings)).table
        return t.select(F.col("ord").alias("r"), _r(F.col("composite")).alias("composite"))

    return run


for _name, _options in (
    ("composite_mean", {}), ("composite_sum", {"method": "sum"}), ("composite_max", {"method": "max"}), ("composite_weighted", {"weights": WEIGHTS}),
    ("composite_raw", {"standardize": False}), ("composite_min_valid", {"min_valid_indices": 4}), ("composite_scores", {"method": "sum", "weights": WEIGHTS}),
):
    QUERIES[_name] = _composite(**_options)
    SQL[_name] = _composite_sql(**{("least" if k == "min_valid_indices" else k): v for k, v in _options.items()})


QUERIES["composite_flag"] = lambda s, d: C.composite_flag(oa(s, d), COMBINED).select(F.col("ord").alias("r"), _r(F.col("composite")).alias("composite"), "flag")
SQL["composite_flag"] = _composite_sql(score="score", last="SELECT r, round(c, 6) + 0.0 AS composite, coalesce(c > (SELECT quantile_cont(c, 0.95) FROM y), false) AS flag FROM y")
QUERIES["composite_probability"] = lambda s, d: C.composite_probability(oa(s, d), COMBINED).select(F.col("ord").alias("r"), _r(F.col("probability")).alias("probability"))
SQL["composite_probability"] = _composite_sql(score="score", last="SELECT r, round(1 / (1 + exp(-c)), 6) AS probability FROM y")


def _composite_summary(spark: SparkSession, sf: str) -> DataFrame:
    found, s = C.composite_summary(oa(spark, sf), COMBINED)
    _one(found)
    return s.select(*[_r(F.col(k)).alias(k) for k in ("mean", "std", "min", "max")], "n_total", "n_valid")


QUERIES["composite_summary"] = _composite_summary
SQL["composite_summary"] = _composite_sql(
    score="score", last="SELECT round(avg(c), 6) + 0.0 AS mean, round(stddev_pop(c), 6) + 0.0 AS std, round(min(c), 6) + 0.0 AS min, round(max(c), 6) + 0.0 AS max, count(*) AS n_total, count(c) AS n_valid FROM y"
)
QUERIES["composite_best_subset"] = lambda s, d: _one(C.composite(ev(s, d), method="best_subset")).table.select(F.col("ord").alias("r"), _r(F.col("composite")).alias("composite"))
QUERIES["index_catalog"] = lambda s, d: R.index_catalog(s).select("index", "direction", "flag_mode", "screen_default", "composite_default", "composite_allowed", F.coalesce("composite_multiplier", F.lit(0)).alias("composite_multiplier"))
SQL["index_catalog"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{s.name}', '{s.direction}', '{s.mode}', {s.screened}, {s.combined}, {bool(s.sign)}, CAST({s.sign} AS INT))" for s in R.INDICES.values()
) + ') AS t("index", direction, flag_mode, screen_default, composite_default, composite_allowed, composite_multiplier)'
