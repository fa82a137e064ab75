"""Delimited records over line ends and blocks, JSON in one pass, kernels in one node, fair signs."""

import csv
import gzip
import io
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plumbline as P
from plumbline import queries as Q
from plumbline.frame import ResponseFrame
from plumbline.operators import kernels as K
from plumbline.plans.screen import screen
from plumbline.sources import files, sinks


def by_states(text):
    out, held, open_ = [], [], False
    for line in text.split("\n"):
        held.append(line)
        open_ = files.ends_open(line, ",", open_)
        if not open_:
            out.append("\n".join(held))
            held = []
    return [*out, "\n".join(held)] if held else out


def test_states_of_quotes_are_those_of_the_csv_module():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice('",,ab \n""') for _ in range(rng.randrange(1, 30)))
        want = list(csv.reader(io.StringIO(text, newline=""), skipinitialspace=True))
        got = [next(csv.reader([r], skipinitialspace=True), []) for r in by_states(text)]
        if not text.endswith("\n") or got[-1]:
            assert got == want, text
        else:
            assert got[:-1] == want, text


@pytest.mark.parametrize("kind", ["csv", "csv.gz"])
@pytest.mark.parametrize("block", ["37", "128m"])
def test_cells_over_line_ends(spark, tmp_path, kind, block):
    rng = random.Random(int(block.rstrip("m")))
    names = [f'{k} "x"\n\nand, {rng.random()}\n' * rng.randrange(0, 4) + f"n{k}" for k in range(60)]
    with (gzip.open if kind.endswith("gz") else open)(tmp_path / f"a.{kind}", "wt", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["id", "first\nitem", "q2"])
        for k, n in enumerate(names):
            out.writerow([n, k, "" if k % 3 else 5])
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        f = files.read_delimited(spark, str(tmp_path / f"a.{kind}"), id_column="id")
        got = f.df.orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert f.item_names == ("first\nitem", "q2")
    assert [r["respondent_id"] for r in got] == [n.strip() for n in names]
    assert [r["responses"] for r in got] == [[float(k), None if k % 3 else 5.0] for k in range(60)]


def test_width_is_checked_with_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"1\n",2\n3\n')
    with pytest.raises(Exception, match="2 cells"):
        files.read_delimited(spark, str(tmp_path / "a.csv")).df.collect()


def test_json_reads_the_table_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    df = spark.range(3000, numPartitions=3).selectExpr("id AS ord", "id / 7 AS x", "id % 2 = 0 AS b", "concat('é\"', id) AS `na me`", "CAST(NULL AS DOUBLE) AS z").coalesce(1)
    text = "".join(sinks.json_pieces(df.mapInPandas(count, df.schema).coalesce(1), {"n": 1}))
    rows = df.collect()
    assert json.loads(text)["columns"] == {c: [r[c] for r in rows] for c in df.columns}
    assert '"x": [0.0, 0.14285714285714285, ' in text and '"b": [true, false, ' in text
    assert reads.value <= 2 * 3000  # the sort looks at its input before it deals it


def test_the_default_screen_has_one_python_node(spark):
    f = Q.emb(spark, "/root/testdata/sf0.001")
    found = screen(f)
    plan = found.scores.select("*")._jdf.queryExecution().optimizedPlan().toString()
    found.release()
    plan = found.scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("one(") >= 5


def test_rising_pairs():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.integers(0, rng.integers(1, 9), (rng.integers(1, 6), rng.integers(1, 24))).astype(float)
        x[rng.random(x.shape) < 0.2] = np.nan
        assert K.rising_pairs(x).tolist() == [sum(r[i] < r[j] for i in range(len(r)) for j in range(i + 1, len(r))) for r in x]


def test_wide_batches_are_cut(spark, monkeypatch):
    monkeypatch.setattr(K, "CELLS", 50)
    rows = [[float((i * j) % 5) for j in range(20)] for i in range(9)]
    import pyarrow as pa

    cut = [m.shape for m in K.matrices(pa.array(rows), 20)]
    assert cut == [(2, 20)] * 4 + [(1, 20)]
    ragged = pa.array([[1.0, None], None, [], [3.0, 4.0, 5.0]])
    assert np.array_equal(K.matrix(ragged, 4), [[1, np.nan, np.nan, np.nan], [np.nan] * 4, [np.nan] * 4, [3, 4, 5, np.nan]], equal_nan=True)
    assert np.array_equal(K.matrix(ragged.slice(2)), [[np.nan] * 3, [3, 4, 5]], equal_nan=True)


def test_resampled_signs_are_fair_and_the_same_in_any_partitions(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(1, 6, (600, 6)).astype(float)
    x[::2, 0] = np.nan  # half of the rows lack an item; pairs of correlation 0 are let in
    f = ResponseFrame.from_rows(spark, x)
    get = lambda frame, seed: np.array([r["s"] for r in frame.with_scores(s=P.psychsyn(frame, 0.0, resample_na=True, random_seed=seed)).orderBy("ord").collect()])
    one, again, other = get(f, 7), get(ResponseFrame(f.df.repartition(5), 6), 7), get(f, 8)
    assert np.allclose(one, again, rtol=1e-12) and not np.allclose(one, other)
    plain = np.array([r["s"] for r in f.with_scores(s=P.psychsyn(f, 0.0)).orderBy("ord").collect()])
    assert (plain[::2] == 0).all() and np.allclose(plain[1::2], one[1::2])
    mean, pairs = abs(plain[1::2].mean()), None
    score, used = P.psychsyn(f, 0.0, diag=True, resample_na=True)
    pairs = f.df.select(used.alias("n")).distinct().collect()[0][0]
    drawn = one[::2] / mean
    steps = (drawn * pairs + pairs) / 2
    assert np.allclose(steps, steps.round()) and abs(drawn.mean()) < 4 / np.sqrt(300 * pairs)
    assert abs(drawn.var() * pairs - 1) < 0.4
    signs = np.array([r[0] for r in spark.range(20_000).select(K.mean_signs(F.col("id"), 1, 99)).collect()])
    assert set(signs) == {-1.0, 1.0} and abs(signs.mean()) < 0.03 and abs(np.corrcoef(signs[1:], signs[:-1])[0, 1]) < 0.03


def test_infinite_stored_scores_are_refused(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 1, float("inf"))], "respondent_id string, ord long, score__irv double")
    for call in (P.screen_scores, P.composite_scores, lambda d: P.composite_scores(d, standardize=False)):
        with pytest.raises(ValueError, match="finite"):
            call(df)


def test_item_parameters_take_one_pass_without_exploding(spark):
    f = Q.ev(spark, "/root/testdata/sf0.001")
    plan = f.with_scores(s=P.lz(f))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
