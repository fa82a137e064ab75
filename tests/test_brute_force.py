"""What SQL can't express, against plain NumPy: the mixture, composites of fitted scores, pseudo-inverse distances, the default screen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import plumbline as P
from plumbline import queries as Q
from plumbline.operators import timing
from plumbline.plans.screen import screen

SF = "/root/testdata/sf0.001"


def column(df, name):
    return np.array([np.nan if r[0] is None else r[0] for r in df.orderBy("ord").select(name).collect()])


def matrix(frame):
    rows = [r[0] for r in frame.df.orderBy("ord").select("responses").collect()]
    return np.array([[np.nan if v is None else v for v in r] + [np.nan] * (frame.n_items - len(r)) for r in rows], float)


def mixture(x, k, seed, rounds=100, tolerance=1e-6):
    use = np.log(x[x > 0])
    n = len(use)
    parts = np.array_split(np.sort(use), k)
    mean = np.array([p.mean() for p in parts]) + np.random.default_rng(seed).normal(0, 0.01, k)
    var, w, before = np.full(k, max(use.var() / k, 1e-10)), np.full(k, 1 / k), -np.inf
    density = lambda v: np.log(w) - 0.5 * np.log(2 * np.pi * var) - (v[:, None] - mean) ** 2 / (2 * var)
    for _ in range(rounds):
        d = density(use)
        total = np.logaddexp.reduce(d, axis=1)
        r = np.exp(d - total[:, None])
        mass = r.sum(axis=0)
        mean = (r * use[:, None]).sum(axis=0) / mass
        var, w = np.maximum((r * (use[:, None] - mean) ** 2).sum(axis=0) / mass, 1e-10), mass / n
        if abs(total.sum() - before) < tolerance:
            break
        before = total.sum()
    d = density(np.log(np.where(x > 0, x, 1)))
    out = np.exp(d - np.logaddexp.reduce(d, axis=1)[:, None])[:, np.argmin(mean)]
    return np.where(x > 0, out, np.nan)


@pytest.mark.parametrize("different", [0, 200_000])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_mixture(frame, monkeypatch, different, k):
    monkeypatch.setattr(timing, "DIFFERENT", different)
    rng = np.random.default_rng(k)
    x = np.exp(np.where(rng.random(60) < 0.4, rng.normal(0, 0.3, 60), rng.normal(2, 0.5, 60))).round(2)
    x[:5], x[7] = x[5], 0.0
    f = frame([[v, v, v] for v in x])
    rounds = 8 if different == 0 else 100
    got = column(P.response_time_mixture(f, k, random_seed=3, rounds=rounds), "score")
    assert np.allclose(got, mixture(x, k, 3, rounds), atol=1e-7, equal_nan=True)


def test_mixture_query(spark):
    f = Q.times(spark, SF)
    x = np.nanmedian(matrix(f), axis=1)
    got = column(P.response_time_mixture(f, random_seed=1), "score")
    assert np.allclose(got, mixture(x, 2, 1), atol=1e-7, equal_nan=True)


def test_pseudo_inverse_query(spark):
    x = matrix(Q.oa(spark, SF))
    d = x - x.mean(axis=0)
    cov = np.cov(x, rowvar=False)
    u, s, vt = np.linalg.svd(cov)
    keep = s > np.finfo(float).eps * len(s) * s[0]
    want = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, (vt.T[:, keep] / s[keep]) @ u.T[keep], d), 0))
    got = np.array([r["score"] for r in Q.QUERIES["mahad_pseudo_inverse"](spark, SF).orderBy("r").collect()])
    assert np.allclose(got, want, atol=2e-6)


def test_best_subset_query(spark):
    f = Q.ev(spark, SF)
    z = []
    for score, sign in ((P.irv(f), -1), (P.longstring_scores(f), 1), (P.lz(f), -1)):
        s = column(f.with_scores(score=score), "score")
        z.append(sign * (s - np.nanmean(s)) / np.nanstd(s))
    got = np.array([r["composite"] for r in Q.QUERIES["composite_best_subset"](spark, SF).orderBy("r").collect()])
    assert np.allclose(got, np.nanmean(z, axis=0), atol=1e-6)


def plain_lz(x):
    """Parameters, abilities and fit from the definitions, by bisection instead of Newton steps."""
    p = np.clip(np.nanmean(x, axis=0), 0.001, 0.999)
    b, total = -np.log(p / (1 - p)), np.nansum(x, axis=1)
    a = []
    for v in x.T:
        ok = ~np.isnan(v)
        varied = ok.sum() > 1 and v[ok].std() > 0 and total[ok].std() > 0
        r = np.clip(np.corrcoef(v[ok], total[ok])[0, 1], -0.99, 0.99) if varied else None
        a.append(np.clip(1.7 * r / np.sqrt(1 - r * r), 0.2, 3) if varied else 1.0)
    a, want = np.array(a), []
    for v in x:
        ok = ~np.isnan(v)
        prob = lambda t: 1 / (1 + np.exp(-a[ok] * (t - b[ok])))  # noqa: B023, E731
        if v[ok].all() or not v[ok].any():
            t = 3.0 if v[ok].all() else -3.0
        else:
            lo, hi = -4.0, 4.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (a[ok] * (v[ok] - prob(mid))).sum() > 0 else (lo, mid)
            t = (lo + hi) / 2
        q = np.clip(prob(t), 1e-10, 1 - 1e-10)
        fit = np.where(v[ok] == 1, np.log(q), np.log(1 - q)).sum() - (q * np.log(q) + (1 - q) * np.log(1 - q)).sum()
        want.append(fit / np.sqrt((q * (1 - q) * np.log(q / (1 - q)) ** 2).sum()))
    return np.array(want)


def test_lz_of_missing_answers(frame):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (40, 12)).astype(float)
    x[rng.random(x.shape) < 0.15] = np.nan
    want = plain_lz(x)
    f = frame(x.tolist())
    got = column(f.with_scores(score=P.lz(f)), "score")
    assert np.allclose(got, want, atol=1e-6)
    flags = P.lz_flag(f, -0.5).orderBy("ord").collect()
    assert [r["flag"] for r in flags] == [s < -0.5 for s in want]


def test_lz_queries(spark):
    x = matrix(Q.ev(spark, SF))
    want = plain_lz(np.where(np.isnan(x), np.nan, x > (np.nanmin(x) + np.nanmax(x)) / 2))
    got = {r["r"]: r["score"] for r in Q.QUERIES["lz"](spark, SF).collect()}
    flags = {r["r"]: (r["score"], r["flag"]) for r in Q.QUERIES["lz_flag"](spark, SF).collect()}
    order = sorted(got)
    assert np.allclose([got[r] for r in order], want, atol=2e-6)
    assert [flags[r] for r in order] == [(got[r], bool(w < -1.96)) for r, w in zip(order, want, strict=True)]


def test_mahad_of_many_items(spark):
    """All 64 dimensions of the embeddings, whose covariance is well conditioned, and the flags of each method."""
    f = Q.emb(spark, SF)
    x = matrix(f)
    d = x - x.mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x, rowvar=False)), d))
    scores = f.with_scores(score=P.mahad(f))
    assert np.allclose(column(scores, "score"), want, atol=1e-8)
    q1, q3 = np.percentile(want, [25, 75])
    assert column(P.mahad_flag(scores, 64, method="iqr"), "flag").tolist() == ((want > q3 + 1.5 * (q3 - q1)) | (want < q1 - 1.5 * (q3 - q1))).tolist()
    assert P.mahad_summary(f).first()["median"] == pytest.approx(np.median(want))


def test_default_screen_query(spark):
    """Flags and their counts from the scores themselves."""
    t = screen(Q.emb(spark, SF)).table.orderBy("ord").toPandas()
    got = {r["r"]: r for r in Q.QUERIES["screen_default"](spark, SF).collect()}
    names = [c.removeprefix("score__") for c in t.columns if c.startswith("score__")]
    low = {"irv", "psychsyn", "person_total", "markov"}
    count = np.zeros(len(t), int)
    for k in names:
        s = t[f"score__{k}"].to_numpy(float)
        cut = np.nanpercentile(s, 5 if k in low else 95) if (~np.isnan(s)).any() else 0.0
        with np.errstate(invalid="ignore"):
            count += (s < cut) if k in low else (s > cut)
    assert [got[r]["flag_count"] for r in t["ord"]] == count.tolist()
    assert [got[r]["consensus_flag"] for r in t["ord"]] == (count >= 2).tolist()


def test_flags_of_single_indices(frame):
    f = frame([[1, 1, 1, 1], [1, 5, 2, 4], [5, 5, 1, 1], [None, None, 3, None]])
    flags = lambda df: [r["flag"] for r in df.orderBy("ord").collect()]
    assert flags(P.missing_rate_flag(f, threshold=0.75)) == [False, False, False, True]
    assert flags(P.infrequency_flag(f, [0, 1], [1, 1])) == [False, True, True, False]
    assert flags(P.individual_reliability_flag(f, n_splits=5, random_seed=1))[0] is True  # without a score
    assert flags(P.onset_flag(f)) == [False] * 4
    with pytest.raises(ValueError):
        P.missing_rate_flag(f, threshold=1.5)
    with pytest.raises(ValueError):
        P.infrequency_flag(f, [0], [1], threshold=-1)
    row = P.markov_summary(f).first()
    assert row["n_total"] == 4 and row["n_valid"] == 3


def test_correlations_of_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [2.0, 1.0, 5.0]), ([1.0, 1.0], [2.0, 3.0]), ([1.0, None, 2.0], [1.0, 5.0, None])], "x array<double>, y array<double>")
    got = [r[0] for r in df.select(P.calculate_correlations(F.col("x"), F.col("y"))).collect()]
    assert got[0] == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 5])[0, 1]) and got[1] == 0.0 and got[2] is None
    z = lambda v: (np.array(v) - np.mean(v)) / np.std(v)
    parts = df.limit(1).select(P.compute_person_correlations(F.col("x"), F.col("y"))).first()[0]
    assert np.allclose(parts, z([1, 2, 4]) * z([2, 1, 5]))
