"""Flags of single indices: each takes a frame and gives respondent_id, ord, score and flag.

A percentile cutoff is strict, a fixed one includes the cutoff, unless the function says otherwise. Unavailable scores aren't flagged, but
for individual_reliability_flag. digits: scores are rounded to so many decimals first, so that noise can't decide at the cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import ResponseFrame
from . import indices as I
from .flags import check_threshold, flag_scores


def _scored(frame: ResponseFrame, score: Column, digits: int | None) -> DataFrame:
    return frame.with_scores(score=score if digits is None else F.round(score, digits) + F.lit(0.0))


def _flagged(frame: ResponseFrame, score: Column, threshold, percentile, direction: str, inclusive: bool | None = None, digits: int | None = None) -> DataFrame:
    return flag_scores(_scored(frame, score, digits), "score", threshold, percentile, direction, inclusive)


def acquiescence_flag(frame: ResponseFrame, scale_min=None, scale_max=None, positive_items=None, negative_items=None, na_rm: bool = True, threshold: float | None = None, percentile: float = 95.0, digits: int | None = None) -> DataFrame:
    return _flagged(frame, I.acquiescence(frame, scale_min, scale_max, positive_items, negative_items, na_rm), threshold, percentile, "high", digits=digits)


def guttman_flag(frame: ResponseFrame, threshold: float = 0.5, na_rm: bool = True, digits: int | None = None) -> DataFrame:
    """Beyond the threshold, which itself isn't flagged."""
    return _flagged(frame, I.guttman(frame, na_rm), threshold, None, "high", False, digits)


def individual_reliability_flag(frame: ResponseFrame, threshold: float = 0.3, n_splits: int = 100, random_seed: int | None = None, digits: int | None = None) -> DataFrame:
    """Below the threshold, or without a score."""
    df = _flagged(frame, I.individual_reliability(frame, n_splits, random_seed), threshold, None, "low", False, digits)
    return df.withColumn("flag", F.col("flag") | F.col("score").isNull())


def infrequency_flag(frame: ResponseFrame, item_indices, expected_responses, threshold: float = 1.0, proportion: bool = False, missing: str = "pass", digits: int | None = None) -> DataFrame:
    """At least the threshold: a number of failed checks, or a share from 0 to 1 with proportion."""
    if check_threshold(threshold) < 0 or (proportion and threshold > 1):
        raise ValueError("threshold must not be negative, nor above 1 for a proportion")
    return _flagged(frame, I.infrequency(frame, item_indices, expected_responses, proportion, missing), threshold, None, "high", True, digits)


def lz_flag(frame: ResponseFrame, threshold: float = -1.96, digits: int | None = None, **options) -> DataFrame:
    """Below the threshold, which itself isn't flagged."""
    return _flagged(frame, I.lz(frame, **options), threshold, None, "low", False, digits)


def mad_flag(frame: ResponseFrame, positive_items=None, negative_items=None, item_pairs=None, scale_max=None, na_rm: bool = True, *, scale_min=None, threshold: float | None = None, percentile: float = 95.0, digits: int | None = None) -> DataFrame:
    return _flagged(frame, I.mad(frame, positive_items, negative_items, item_pairs, scale_max, na_rm, scale_min=scale_min), threshold, percentile, "high", digits=digits)


def markov_flag(frame: ResponseFrame, threshold: float | None = None, percentile: float = 5.0, na_rm: bool = True, digits: int | None = None) -> DataFrame:
    return _flagged(frame, I.markov(frame, na_rm), threshold, percentile, "low", digits=digits)


def missing_rate_flag(frame: ResponseFrame, threshold: float | None = None, percentile: float = 95.0, item_indices=None, applicable: bool = False, digits: int | None = None) -> DataFrame:
    if threshold is not None and not 0 <= check_threshold(threshold) <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    return _flagged(frame, I.missing_rate(frame, item_indices, applicable), threshold, percentile, "high", digits=digits)


def onset_flag(frame: ResponseFrame, window_size: int = 10, min_items: int = 20, na_rm: bool = True) -> DataFrame:
    """Whether there is an onset at all."""
    df = frame.with_scores(score=I.onset(frame, window_size, min_items, na_rm))
    return df.withColumn("flag", F.col("score").isNotNull())


def semantic_syn_flag(frame: ResponseFrame, item_pairs, anto: bool = False, threshold: float | None = None, percentile: float = 5.0, digits: int | None = None, **scale) -> DataFrame:
    return _flagged(frame, I.semantic_syn(frame, item_pairs, anto, **scale), threshold, percentile, "low", digits=digits)


def semantic_ant_flag(frame: ResponseFrame, item_pairs, threshold: float | None = None, percentile: float = 5.0, digits: int | None = None, **scale) -> DataFrame:
    return _flagged(frame, I.semantic_ant(frame, item_pairs, **scale), threshold, percentile, "low", digits=digits)


def markov_summary(frame: ResponseFrame, na_rm: bool = True) -> DataFrame:
    """One row: mean, std, min, max and median of the available scores, n_total, n_valid."""
    return I.summary(frame.with_scores(score=I.markov(frame, na_rm)))


def psychsyn_summary(frame: ResponseFrame, critval: float = 0.6, anto: bool = False) -> DataFrame:
    return I.summary(frame.with_scores(score=I.psychsyn(frame, critval, anto)))


def mahad_summary(frame: ResponseFrame, confidence: float = 0.95, na_rm: bool = False) -> DataFrame:
    """The same with n_flagged, by the chi-square cutoff at this confidence."""
    scores = I.mahad_flag(frame.with_scores(score=I.mahad(frame, na_rm)), frame.n_items, confidence)
    return I.summary(scores).crossJoin(scores.agg(F.count_if("flag").alias("n_flagged")))  # one row each
