"""Flags, screens and composites."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.flags import flag_scores
from plumbline.plans import composite as C
from plumbline.plans import registry as R
from plumbline.plans import screen as S
from plumbline.streaming.rowlocal import frozen_cutoffs, screen_stream


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(str(k), k, *v) for k, v in enumerate([(1.0, 5.0, None), (2.0, 4.0, 3.0), (3.0, None, None), (4.0, 2.0, None), (5.0, 1.0, None)])]
    return spark.createDataFrame(rows, "respondent_id string, ord bigint, score__irv double, score__longstring double, score__onset double")


def flags(df, name="flag"):
    return [r[0] for r in df.orderBy("ord").select(name).collect()]


def test_fixed_cutoffs_include_and_percentiles_dont(scores):
    assert flags(flag_scores(scores, "score__irv", 2.0, direction="low")) == [True, True, False, False, False]
    assert flags(flag_scores(scores, "score__irv", percentile=25, direction="low")) == [True, False, False, False, False]
    assert flags(flag_scores(scores, "score__longstring", 4.0)) == [True, True, False, False, False]
    for bad in ({"percentile": 101.0}, {"threshold": float("nan")}, {"percentile": True}, {"direction": "up"}):
        with pytest.raises(ValueError):
            flag_scores(scores, "score__irv", **bad)


def test_consensus(scores):
    r = S.screen_scores(scores, thresholds={"irv": 2.0, "longstring": 4.0}, min_flags=2, min_valid_indices=2)
    got = r.table.orderBy("ord").select("flag_count", "valid_index_count", "consensus_flag").collect()
    assert [tuple(x) for x in got] == [(2, 2, True), (3, 3, True), (0, 1, False), (0, 2, False), (0, 2, False)]
    summary = {x["index"]: x for x in r.summary.collect()}
    assert summary["longstring"]["n_unavailable"] == 1 and summary["onset"]["flag_rate"] == 1.0 and r.cutoffs["onset"] is None
    for bad in ({"thresholds": {"onset": 1.0}}, {"thresholds": {"mad": 1.0}}, {"thresholds": {"irv": 1.0}, "percentiles": {"irv": 5.0}}, {"min_flags": 0}, {"min_valid_indices": 4}):
        with pytest.raises(ValueError):
            S.screen_scores(scores, **bad)


def test_soft_errors(frame):
    f = frame([[1, 2, 3, 4, 5], [2, 2, 3, 3, 1]])
    r = S.screen(f, ["irv", "mahad", "evenodd"])
    assert set(r.errors) == {"mahad", "evenodd"} and set(r.cutoffs) == {"irv"}
    with pytest.raises(ValueError, match="mahad"):
        S.screen(f, ["irv", "mahad"], strict=True)
    for bad in (["irv", "irv"], ["nothing"], []):
        with pytest.raises(ValueError):
            S.screen(f, bad)


def test_composite_rules(scores):
    two = scores.drop("score__onset")
    raw = C.composite_scores(two, "mean", False).table.orderBy("ord").collect()
    assert [r["composite"] for r in raw] == [2.0, 1.0, -3.0, -1.0, -2.0]
    summed = C.composite_scores(two, "sum", False, weights={"longstring": 2.0}, min_valid_indices=2).table.orderBy("ord").collect()
    assert [r["composite"] for r in summed] == [9.0, 6.0, None, 0.0, -3.0]
    none = two.withColumns({"score__irv": F.lit(None).cast("double"), "score__longstring": F.lit(None).cast("double")})
    assert C.composite_scores(none, "sum").table.first()["composite"] == 0.0 and C.composite_scores(none, "mean").table.first()["composite"] is None
    for bad in ({"method": "median"}, {"weights": {"irv": 0.0}}, {"weights": {"mad": 1.0}}, {"standardize": 1}):
        with pytest.raises(ValueError):
            C.composite_scores(two, **bad)
    with pytest.raises(ValueError):
        C.composite_scores(scores)  # onset can't be combined


def test_catalog():
    assert len(R.INDICES) == 21
    assert R.default_screen_indices() == "irv longstring longstring_pattern mahad psychsyn person_total markov u3_poly midpoint acquiescence guttman".split()
    assert R.default_composite_indices() == "irv longstring mahad psychsyn person_total".split()


def test_stream_matches_table(spark, frame, tmp_path):
    f = frame([[1, 1, 1, 1, 2], [1, 2, 3, 4, 5], [5, 5, 5, 1, 2], [3, 3, 3, 3, 3]])
    r = S.screen(f, ["irv", "longstring"], min_flags=1)
    still = screen_stream(f, frozen_cutoffs(r), min_flags=1)
    f.df.write.parquet(str(tmp_path / "in"))
    from plumbline.frame import ResponseFrame

    live = ResponseFrame(spark.readStream.schema(f.df.schema).parquet(str(tmp_path / "in")), 5)
    q = screen_stream(live, frozen_cutoffs(r), min_flags=1).writeStream.format("memory").queryName("screened").start()
    q.processAllAvailable()
    q.stop()
    columns = ["ord", "flag_count", "consensus_flag"]
    assert spark.table("screened").select(columns).orderBy("ord").collect() == still.select(columns).orderBy("ord").collect() == r.table.select(columns).orderBy("ord").collect()
    with pytest.raises(ValueError):
        screen_stream(f, {"mahad": 1.0})
