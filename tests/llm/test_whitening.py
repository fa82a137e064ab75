"""Whitening against NumPy in exact and double arithmetic."""

import math
from fractions import Fraction

import numpy as np

from plumbline.llm import whitening as M


def brute(vectors, k=4):
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    distinct = [list(t) for t in {tuple(v) for v in x}]
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = lambda v: np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)])
    rows = np.stack([centred(v) for v in distinct])
    e, q = np.linalg.eigh(rows.T @ rows / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    trace = (rows**2).sum() / n
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x], np.stack([centred(v) for v in x]) @ q / np.sqrt(e), e / trace


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, "label", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, x int")


def test_against_numpy(spark):
    rng = np.random.default_rng(2)
    good = (rng.normal(0, 0.3, (300, 9)) * np.linspace(1, 3, 9)).astype(np.float32).tolist()
    good += good[:40] * 3  # copies, which the fit list has once
    bad = [None, [], [None] * 9, [float("nan")] + [0.0] * 8, [float("inf")] + [0.0] * 8, [1.0] * 8, [0.1] * 8 + [None]]
    got = M.whiten(table(spark, good + bad)).toPandas()
    n, deviation, whitened, explained = brute(good)
    assert set(got["vec_id"]) == set(range(len(good))) and len(got) == 4 * len(good) and set(got["n"]) == {n}
    for j in range(4):
        part = got[got["component"] == j + 1].sort_values("vec_id")
        w = part["whitened"].to_numpy()
        assert part["deviation"].tolist() == deviation
        assert min(np.abs(w - whitened[:, j]).max(), np.abs(w + whitened[:, j]).max()) < 1e-9
        assert np.allclose(part["explained"], explained[j], rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and 0 <= got["identity_error"].iloc[0] < 1e-9


def test_short_flat_single_and_empty(spark):
    flat = M.whiten(table(spark, [[0.5, 0.25], [0.5, 0.5], [0.5, 0.5]])).toPandas()  # no variance in the first place
    assert len(flat) == 6 and set(flat["component"]) == {1, 2}
    second = flat[flat["component"] == 2]
    assert (second["whitened"] == 0).all() and (second["explained"] == 0).all() and (flat[flat["component"] == 1]["whitened"].abs().round(9) == 1).all()
    one = M.whiten(table(spark, [[0.5] * 6] * 3, [1, 1, None])).toPandas()
    assert len(one) == 12 and (one["n"] == 1).all() and (one["deviation"] == 0).all() and (one["whitened"] == 0).all() and (one["identity_error"] == 0).all()
    assert one["vec_id"].isna().sum() == 4
    empty = M.whiten(table(spark, [None, []]))
    assert empty.columns == flat.columns.tolist() and empty.count() == 0


def test_large_entries_stay_exact(spark):
    big = [[float(2**k), float(-(2**k)), 1.0] for k in range(20, 45)] + [[1.5, -0.5, 0.0]] * 4
    got = M.whiten(table(spark, big)).filter("component = 1").orderBy("vec_id").collect()
    n, deviation, _, _ = brute(big)
    assert [r["deviation"] for r in got] == [d if d < 2**63 else None for d in deviation] and any(d >= 2**63 for d in deviation)


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(6)
    df = table(spark, rng.normal(size=(200, 5)).tolist())
    one, many = (M.whiten(df.repartition(k)).orderBy("vec_id", "component").toPandas() for k in (1, 9))
    assert (one["deviation"] == many["deviation"]).all() and np.allclose(one["whitened"], many["whitened"], atol=1e-9)
