"""Cutoffs and flags for a score column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import flag
from ..functions.order import percentiles


def check_percentile(p, name: str = "percentile") -> float:
    if isinstance(p, bool) or not isinstance(p, (int, float)) or not math.isfinite(p) or not 0 <= p <= 100:
        raise ValueError(f"{name} must be a number from 0 to 100")
    return float(p)


def check_threshold(t, name: str = "threshold") -> float:
    if isinstance(t, bool) or not isinstance(t, (int, float)) or not math.isfinite(t):
        raise ValueError(f"{name} must be a finite number")
    return float(t)


def resolve_cutoff(df: DataFrame, score: str, threshold: float | None, percentile: float) -> float:
    """The threshold, or else the percentile of the available scores; 0 if there are none."""
    if threshold is not None:
        return check_threshold(threshold)
    share = check_percentile(percentile) / 100
    held = df.select(F.col(score).cast("double").alias("score")).persist()
    try:
        found = percentiles(held, {"cut": (F.col("score"), [share])})[0]["cut"][0]
    finally:
        held.unpersist()
    return 0.0 if found is None else float(found)


def flag_scores(df: DataFrame, score: str = "score", threshold: float | None = None, percentile: float | None = None, direction: str = "high", inclusive: bool | None = None, name: str = "flag") -> DataFrame:
    """df with a Boolean column. Percentile cutoffs are strict; fixed ones include the cutoff unless told otherwise."""
    if direction not in ("low", "high"):
        raise ValueError("direction must be 'low' or 'high'")
    percentile = (5.0 if direction == "low" else 95.0) if percentile is None else percentile
    cutoff = resolve_cutoff(df, score, threshold, percentile)
    return df.withColumn(name, flag(F.col(score), cutoff, direction, (threshold is not None) if inclusive is None else inclusive))
