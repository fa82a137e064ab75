"""Exact percentiles and ranks against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import plumbline as P
from plumbline.functions import order

SHARES = [0.0, 0.00005, 0.05, 0.25, 0.5, 0.9, 0.95, 0.99997, 1.0]


def table(spark, columns, n, parts=6):
    """Columns computed from the row number, so that nothing large passes through the driver."""
    return spark.range(n, numPartitions=parts).select(*[F.expr(x).cast("double").alias(k) for k, x in columns.items()])


def exact(values, shares):
    v = np.array([x for x in values if x is not None], float)
    return [float(np.quantile(v, p)) for p in shares] if len(v) else [None] * len(shares)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_small_tables(spark, n):
    df = table(spark, {"a": "sin(id * 12.9898) * 43758", "b": "id % 3", "c": "CASE WHEN id % 4 > 0 THEN id * id END", "d": "CAST(NULL AS DOUBLE)", "e": "7"}, n)
    got, row = order.percentiles(df, {k: (F.col(k), SHARES) for k in df.columns}, [F.count(F.lit(1)).alias("rows"), F.avg("a").alias("mean")])
    rows = df.toPandas()
    for k in df.columns:
        want = exact(rows[k].dropna(), SHARES)
        assert got[k] == (want if want[0] is None else pytest.approx(want, rel=1e-12))
    assert row["rows"] == n and row["mean"] == pytest.approx(rows["a"].mean())


def test_a_million_different_values(spark):
    n = 1_000_000
    df = table(spark, {"a": "pmod(id * 7919, 1000000)", "b": "exp(pmod(id * 104729, 1000000) / 2000.0) * CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END", "c": "CASE WHEN id % 10 < 7 THEN 4 ELSE pmod(id * 31, 1000) END"}, n).persist()
    got, _ = order.percentiles(df, {k: (F.col(k), SHARES) for k in df.columns})
    rows = df.toPandas()
    df.unpersist()
    for k in rows:
        assert got[k] == pytest.approx(exact(rows[k], SHARES), rel=1e-12)


def test_brackets_are_narrowed(spark, monkeypatch):
    """With room for few values, rough sketches and coarse grids, the result is the same."""
    monkeypatch.setattr(order, "HELD", 40)
    monkeypatch.setattr(order, "ACCURACY", 20)
    monkeypatch.setattr(order, "GRID", 4)
    df = table(spark, {"a": "pmod(id * 7919, 20011)", "b": "floor(pmod(id * 7919, 20011) / 5000)"}, 20011).persist()
    got, _ = order.percentiles(df, {k: (F.col(k), SHARES) for k in df.columns})
    rows = df.toPandas()
    df.unpersist()
    for k in rows:
        assert got[k] == pytest.approx(exact(rows[k], SHARES), rel=1e-12)


def test_a_bracket_that_misses_its_rank_is_widened(spark, monkeypatch):
    real = F.percentile_approx
    monkeypatch.setattr(order.F, "percentile_approx", lambda c, shares, *a: real(c, [0.0 if k % 2 else 0.01 for k in range(len(shares))], *a))
    df = table(spark, {"a": "pmod(id * 7, 501)"}, 501)
    got, _ = order.percentiles(df, {"a": (F.col("a"), [0.5])})
    assert got["a"] == [250.0]


@pytest.mark.parametrize("parts", ["1", "4", "300"])
def test_places(spark, parts):
    df = table(spark, {"v": "CASE WHEN id % 3 = 0 THEN 5 ELSE pmod(id * 7919, 900) - 400 END"}, 2000)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["v"]: (r["count"], r["before"]) for r in order.places(df, "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    values = np.sort(df.toPandas()["v"].to_numpy())
    different, counts = np.unique(values, return_counts=True)
    assert got == {v: (c, int(np.searchsorted(values, v))) for v, c in zip(different, counts, strict=True)}
    assert order.places(df.filter("false"), "v").count() == 0


def test_quantile_plot_over_many_partitions(spark):
    """Ranks of ties are those of their run; the plan doesn't grow with the partitions."""
    df = table(spark, {"score": "CASE WHEN id % 4 = 0 THEN 2 ELSE pmod(id * 31, 97) / 10 END"}, 5000)
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        plotted = P.mahad_qqplot(df, 3)
        assert len(plotted._jdf.queryExecution().analyzed().toString()) < 200_000
        got = sorted(map(tuple, plotted.coalesce(4).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = np.sort(df.toPandas()["score"].to_numpy() ** 2)
    assert [r[0] for r in got] == list(range(1, 5001)) and np.allclose([r[1] for r in got], want)
    assert (np.diff([r[2] for r in got]) > 0).all()


def test_long_cells_become_rows_of_their_own_length(spark):
    import time

    from plumbline.frame import ResponseFrame

    cells = spark.createDataFrame([(7, 4, 1.0), (7, 0, 2.0), (7, 2, None), (9, 1, 5.0), (9, 99, 1.0), (3, 0, float("nan"))], "r long, i int, v double")
    got = {r["ord"]: r["responses"] for r in ResponseFrame.from_long(cells, "r", "i", "v", 5).df.collect()}
    assert got == {7: [2.0, None, None, None, 1.0], 9: [None, 5.0], 3: [None]}
    f = ResponseFrame.from_long(cells, "r", "i", "v", 5)
    scores = f.with_scores(a=P.missing_rate(f), b=P.irv(f, na_rm=False), c=P.longstring_scores(f), d=P.markov(f), e=P.person_total(f)).orderBy("ord").collect()
    assert [r["a"] for r in scores] == [1.0, 0.6, 0.8] and [r["b"] for r in scores] == [None] * 3 and [r["c"] for r in scores] == [0, 1, 1]
    with pytest.raises(Exception, match="(?i)duplicate"):
        ResponseFrame.from_long(cells.union(cells), "r", "i", "v", 5).df.collect()
    many = spark.range(20 * 4000).selectExpr("id % 20 AS r", "CAST(id DIV 20 AS INT) AS i", "CAST(id % 5 AS DOUBLE) AS v")
    began = time.time()
    assert ResponseFrame.from_long(many, "r", "i", "v", 4000).df.selectExpr("sum(size(responses))").first()[0] == 80_000
    assert time.time() - began < 5
