"""Locked values of small matrices, missing answers, and edges."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.functions import numeric
from plumbline.operators import indices as I
from plumbline.operators import kernels as K

FIVE = [[1, 1, 1, 1, 1], [1, 2, 3, 4, 5], [5, 5, 5, 1, 2], [1, 2, 2, 2, 2], [1, 2, 1, 2, 1]]
EIGHT = [[1, 2, 3, 4, 5, 4], [2, 3, 4, 5, 4, 3], [3] * 6, [5, 1, 5, 1, 5, 1], [1] * 6, [4, 4, 2, 2, 4, 4], [2, 2, 4, 4, 2, 2], [3, 4, 3, 4, 3, 4]]
N = None


def near(got, want, tolerance=1e-9):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None), (got, want)
        assert w is None or abs(g - w) < tolerance, (got, want)


def test_spread_and_runs(frame, values):
    f = frame(FIVE)
    near(values(f, I.irv(f)), [0, 1.4142135623730951, 1.7435595774162693, 0.4, 0.4898979485566356])
    near(values(f, I.longstring_scores(f)), [5, 1, 3, 4, 1])
    near(values(f, I.longstring_pattern(f, 3)), [0, 0, 0, 0, 5])


EXPECTED = {
    "mahad": [2.4748737341529177, 2.474873734152922, 0.7245688373094724, 2.4272755646334576, 2.427275564633457, 2.006240264773889, 2.0062402647738895, 1.546501427954941],
    "psychsyn": [0.1893885047696426, -0.4166547104932136, 0, 1, 0, -0.5, -0.5, 1],
    "guttman": [0.7333333333333333, 0.6666666666666666, 0, 0.4666666666666667, 0, 0.13333333333333333, 0.4, 0.13333333333333333],
    "markov": [0, 0.4, 0, 0, 0, 0.9509775004326937, 0.9509775004326937, 0],
    "person_total": [0.7635899174405921, 0.6863485850246135, N, 0.4842001247062523, N, -0.39129279043561477, 0.39129279043561477, -0.4842001247062523],
    "midpoint": [1 / 6, 1 / 3, 1, 0, 0, 0, 0, 0.5],
    "lz": [1.1901012063680725, 1.376379500972372, 0.5659327404151528, -0.18770575500943293, 0.5659327404151528, -0.46960760961907766, 0.15231814658842585, -1.0950615670859407],
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_locked_values(frame, values, name):
    f = frame(EIGHT)
    made = {
        "mahad": lambda: I.mahad(f), "psychsyn": lambda: I.psychsyn(f, 0.4), "guttman": lambda: I.guttman(f), "markov": lambda: I.markov(f),
        "person_total": lambda: I.person_total(f), "midpoint": lambda: I.midpoint_responding(f, 1, 5), "lz": lambda: I.lz(f),
    }
    near(values(f, made[name]()), EXPECTED[name], 1e-7)


def test_evenodd_and_onset(frame, values):
    f = frame([list(range(1, 11)), [3] * 10, [1, 5] * 5, [1, 1, 5, 5, 1, 1, 5, 5, 1, 1]])
    near(values(f, I.evenodd(f, [5, 5])), [1, 0, 0, 0])
    rng = np.random.default_rng(3)
    f = frame([[*rng.integers(1, 6, 20).tolist(), *[3] * 20], [3] * 40])
    got = values(f, I.onset(f, 5, 20))
    assert got[0] is not None and 8 <= got[0] <= 22 and got[1] is None


def test_reliability(frame, values):
    f = frame([[1, 2, 1, 2, 1, 2], [1, 5, 2, 4, 1, 5], [3] * 6, [5, 4, 3, 2, 1, 2]])
    near(values(f, I.individual_reliability(f, 25, 17)), [0.0833333333333335, 0.22658493155154946, N, -0.11400136903312826])
    f = frame([[1, N, 1, 2, 1, 2], [1, 5, 2, 4, N, 5], [3] * 6, [N, 4, 3, 2, 1, 2]])
    near(values(f, I.individual_reliability(f, 25, 17)), [0.16666666666666652, 0.1818181818181818, N, 0.16666666666666655])


def test_missing_answers(frame, values):
    f = frame([[1, N, 1, 2], [N] * 4, [5, 5, N, 5]])
    near(values(f, I.irv(f)), [math.sqrt(2 / 9), N, 0])
    near(values(f, I.irv(f, na_rm=False)), [N, N, N])
    near(values(f, I.longstring_scores(f)), [2, 0, 3])
    near(values(f, I.missing_rate(f)), [0.25, 1, 0.25])
    near(values(f, I.u3_poly(f)), [2 / 3, N, 1])
    near(values(f, I.acquiescence(f)), [(4 / 3 - 1) / 4, N, 1])
    near(values(f, I.infrequency(f, [1, 3], [5, 2], missing="propagate")), [N, N, 1])
    near(values(f, I.infrequency(f, [1, 3], [5, 2], proportion=True, missing="omit")), [0, N, 0.5])
    with pytest.raises(ValueError):
        I.longstring_scores(f, na_rm=False)
    with pytest.raises(ValueError):
        I.mahad(f)


def test_constant_scale_is_neutral(frame, values):
    f = frame([[3, 3], [3, N]])
    near(values(f, I.acquiescence(f)), [0.5, 0.5])


def test_bad_requests(frame):
    f = frame(EIGHT)
    for call in (
        lambda: I.irv(f, split_points=[0, 3]), lambda: I.evenodd(f, [2, 2]), lambda: I.psychsyn(f, -0.3), lambda: I.psychant(f, 0.3), lambda: I.missing_rate(f, []),
        lambda: I.missing_rate(f, [0, 0]), lambda: I.missing_rate(f, [True]), lambda: I.missing_rate(f, [6]), lambda: I.mad(f, [0], None), lambda: I.semantic_syn(f, [(0, 0)]),
        lambda: I.u3_poly(f, 5, 1), lambda: I.infrequency(f, [0], [1, 2]), lambda: I.infrequency(f, [0], [1], missing="x"), lambda: I.onset(f, 1), lambda: I.onset(f, 5, 3),
        lambda: I.longstring_pattern(f, 1), lambda: I.individual_reliability(f, 0), lambda: I.lz(f, model="3pl"), lambda: I.lz(f, difficulty=[1]),
    ):
        with pytest.raises(ValueError):
            call()


def test_text_runs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("aabbb",), ("",), (None,), ("xx yy",)], "t string")
    got = df.select(I.longstring_text(F.col("t")).alias("x"), I.longstring_text(F.col("t"), avg=True).alias("a")).collect()
    assert (got[0]["x"]["char"], got[0]["x"]["length"], got[0]["a"]) == ("b", 3, 2.5)
    assert got[1]["x"] is None and got[1]["a"] == 0.0 and got[2]["x"] is None and got[2]["a"] is None
    assert got[3]["x"]["char"] == "x"


def test_quantiles():
    for df, p, want in ((1, 0.95, 3.841458820694124), (2, 0.5, 1.386294361119891), (10, 0.99, 23.209251158954356), (100, 0.05, 77.92946516501726), (3, 1e-6, 2.41810e-4)):
        assert abs(numeric.chi_square_quantile(p, df) / want - 1) < (2e-4 if p == 1e-6 else 1e-10)
    with pytest.raises(ValueError):
        numeric.chi_square_quantile(1.0, 3)


def test_ability_stays_in_range():
    y = np.array([[1, 1, 1.0], [0, 0, 0], [1, 0, np.nan], [np.nan] * 3])
    t = K.ability(y, np.ones(3), np.zeros(3))
    assert t[0] == 3 and t[1] == -3 and abs(t[2]) < 1e-9 and np.isnan(t[3])


def naive_pattern(v, longest):
    best = 0
    m = len(v)
    if m < 4:
        return 0
    for k in range(2, min(longest, m // 2) + 1):
        for s in range(m - k + 1):
            if len(set(v[s : s + k])) == 1:
                continue
            run = 0
            while s + run + k < m and v[s + run + k] == v[s + run]:
                run += 1
            if run:
                best = max(best, k + run)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=14), st.integers(2, 5))
def test_pattern_is_the_naive_one(v, longest):
    assert K.longest_pattern(np.array([v], float), longest)[0] == naive_pattern(v, longest)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(1, 5), st.just(float("nan"))), min_size=5, max_size=5), min_size=1, max_size=6))
def test_guttman_is_bounded(rows):
    x = np.array(rows, float)
    e = K.guttman_errors(x, np.arange(5), True, True)
    assert all(np.isnan(v) or 0 <= v <= 1 for v in e)
