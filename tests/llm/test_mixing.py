"""Mixing against plain water-filling and against all subsets."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import mixing as M


def level(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Targets by sharing out again what is above, over and over."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, left, out = set(names), sum(sizes.values()) * share, {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= over
    return {s: float(t) for s, t in out.items()}


def test_knapsack_finds_the_nearest_sum():
    rng = random.Random(1)
    for _ in range(300):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randrange(1, 5))))
        counts = np.array([rng.randrange(0, 4) for _ in lengths])
        goal = rng.randrange(0, 150)
        out = M.knapsack(lengths, counts, goal)
        sums = {sum(k * s for k, s in zip(ks, lengths.tolist(), strict=True)) for ks in itertools.product(*[range(c + 1) for c in counts])}
        assert (out >= 0).all() and (out <= counts).all()
        assert abs(int((out * lengths).sum()) - goal) == min(abs(s - goal) for s in sums)


def test_fit_spreads_over_lengths_and_ends_near():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 3000, 400))
    counts = rng.integers(1, 60, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (0, 1, 17, total // 3, total // 2, total - 1, total):
        out = M.fit(lengths, counts, budget)
        assert (out >= 0).all() and (out <= counts).all() and abs(int((out * lengths).sum()) - budget) <= 1
    half = M.fit(lengths, counts, total // 2)
    assert abs(half[lengths > 1500].sum() / counts[lengths > 1500].sum() - 0.5) < 0.02  # long documents have their share
    assert M.fit(np.array([1000]), np.array([1]), 700).tolist() == [1] and M.fit(np.array([1000]), np.array([1]), 300).tolist() == [0]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 5, 8, 40, 300, 900])), rng.choice(["a", "b", "B", "é", "z", None])) for i in range(1500)]
    rows += [(10_000 + i, "the same seven words in this text", "hot") for i in range(4000)]  # one length holds most rows
    rows += [(20_000, None, "a"), (20_001, "", "none"), (20_002, " \t\n", "none"), (None, "two words", "b"), (None, "two words", "b"), (7, "again seven", "z"), (20_003, "w " * 90_000, "long")]
    return rows


def test_mix(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS draw", "'x' AS target", "3 AS salt")
    got = M.mix(df).toPandas()
    assert len(got) == len(corpus)
    sizes = {}
    for _, text, source in corpus:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = level(sizes)
    key = [None if s is None or s != s else s for s in got["source"]]
    assert {s: t for s, t in zip(key, got["target"], strict=True)} == pytest.approx(want)
    assert all(sizes[s] == n for s, n in zip(key, got["source_size"], strict=True))
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    taken = {}
    for s, t in zip(key, got["taken"], strict=True):
        taken[s] = taken.get(s, 0) + t
    for s, t in want.items():
        assert abs(taken[s] - t) <= (45_000 if s == "long" else 4 if s == "hot" else 1), s
    again = M.mix(df.repartition(7)).toPandas()
    order = lambda d: sorted(map(tuple, d.astype(object).where(d.notna(), None).astype(str).values.tolist()))
    assert order(got) == order(again)
    hot = got[got["source"] == "hot"]
    other = M.mix(df, seed=1).toPandas()
    other = other[other["source"] == "hot"]
    assert other["taken"].sum() == hot["taken"].sum() and set(other[other["taken"] > other["taken"].min()]["doc_id"]) != set(hot[hot["taken"] > hot["taken"].min()]["doc_id"]) or hot["taken"].nunique() == 1


def test_one_length_is_drawn_exactly(spark):
    df = spark.createDataFrame([(i, "four words are here", "s" if i % 3 else "t") for i in range(9000)], "doc_id long, text string, source string")
    got = M.mix(df, weights=(5, 2)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 2 for r in got)


def test_many_sources_are_ranked_over_tasks(spark):
    rng = random.Random(12)
    sizes = {f"s{i:03d}{rng.choice('aZé')}": rng.randrange(0, 60) for i in range(400)} | {None: 5}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(level(sizes))


def test_empty_and_wordless(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    got = M.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 2
