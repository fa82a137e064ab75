"""Composite scores: standardised, directed and weighted indices in one number."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import ResponseFrame
from ..functions.exprs import logistic
from ..operators.flags import check_threshold, flag_scores
from .registry import INDICES, IndexOptions, composite_index_names, default_composite_indices, score_columns, score_table, validate_index_names, validate_min_valid

METHODS = ("mean", "sum", "max", "best_subset")


@dataclass(frozen=True)
class CompositeResult:
    """table: score__<index>, component__<index>, valid_index_count, composite."""

    table: DataFrame
    names: list[str]
    errors: dict[str, str] = field(default_factory=dict)
    scores: DataFrame | None = None

    def release(self) -> None:
        """Let go of the scores that are held for the table; it can still be computed."""
        if self.scores is not None:
            self.scores.unpersist()


def _weights(given: Mapping[str, float] | None, names: Sequence[str]) -> dict[str, float]:
    out = dict.fromkeys(names, 1.0)
    for k, w in (given or {}).items():
        if k not in names:
            raise ValueError(f"weights: {k} isn't selected")
        if check_threshold(w, "weights") <= 0:
            raise ValueError("weights must be positive")
        out[k] = float(w)
    return out


def combine(scores: DataFrame, names: Sequence[str], method: str = "mean", standardize: bool = True, weights=None, min_valid_indices: int | None = None, selected: int | None = None, errors=None) -> CompositeResult:
    """The composite of a table with a column score__<index> for each name: one aggregation, one projection."""
    if method not in METHODS[:3]:
        raise ValueError("method must be mean, sum or max")
    if not isinstance(standardize, bool):
        raise ValueError("standardize must be true or false")
    validate_min_valid(min_valid_indices, selected or len(names))
    w = _weights(weights, names)
    if not names:
        raise ValueError("no index could be scored: " + "; ".join(f"{k}: {v}" for k, v in sorted((errors or {}).items())))
    if standardize:
        scores = scores.persist()  # read for the statistics and by whoever takes the table; result.release() lets it go
        wild = lambda c: F.count_if(~(F.abs(c) < float("inf")))
        seen = scores.agg(*[f(F.col(f"score__{k}")).alias(f"{k}__{n}") for k in names for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop), ("wild", wild))]).first()
        if infinite := [k for k in names if seen[f"{k}__wild"]]:
            scores.unpersist()
            raise ValueError(f"scores of {', '.join(infinite)} aren't finite")
    parts: dict[str, Column] = {}
    for k in names:
        c = F.col(f"score__{k}")
        if standardize and seen[f"{k}__n"] > 1:
            sd = seen[f"{k}__sd"]
            c = (c - seen[f"{k}__mean"]) / sd if sd > 0 else F.when(c.isNotNull(), 0.0)
        parts[k] = c * float(INDICES[k].sign)
    table = scores.withColumns({f"component__{k}": c for k, c in parts.items()})
    cells = {k: F.col(f"component__{k}") for k in names}
    valid = sum((c.isNotNull().cast("int") for c in cells.values()), F.lit(0))
    added = sum((F.coalesce(c * w[k], F.lit(0.0)) for k, c in cells.items()), F.lit(0.0))
    if method == "mean":
        out = F.try_divide(added, sum((F.when(c.isNotNull(), w[k]).otherwise(0.0) for k, c in cells.items()), F.lit(0.0)))
    elif method == "sum":
        out = added
    else:
        each = [c * w[k] for k, c in cells.items()]
        out = F.greatest(*each) if len(each) > 1 else each[0]
    table = table.withColumn("valid_index_count", valid)
    if min_valid_indices is not None:
        out = F.when(F.col("valid_index_count") >= min_valid_indices, out)
    return CompositeResult(table.withColumn("composite", out), list(names), dict(errors or {}), scores)


def composite(frame: ResponseFrame, indices: Sequence[str] | None = None, method: str = "mean", standardize: bool = True, *, options: IndexOptions | None = None, weights=None, min_valid_indices: int | None = None, strict: bool = False, workers: int = 1, return_diagnostics: bool = False) -> CompositeResult | tuple[CompositeResult, dict[str, str]]:
    """The composite of a frame's indices. return_diagnostics: also, by itself, why indices weren't scored (the result's errors)."""
    if method not in METHODS:
        raise ValueError("method must be mean, sum, max or best_subset")
    options = options or IndexOptions()
    if method == "best_subset":
        both = options.mad_positive_items is not None and options.mad_negative_items is not None
        indices, method = (["mad"] if both else []) + ["irv", "longstring", "lz"], "mean"
    names = validate_index_names(default_composite_indices() if indices is None else indices, composite_index_names())
    validate_min_valid(min_valid_indices, len(names))
    w = _weights(weights, names)
    columns, errors = score_columns(frame, names, options, strict, workers)
    found = combine(score_table(frame, columns), list(columns), method, standardize, {k: v for k, v in w.items() if k in columns}, min_valid_indices, len(names), errors)
    return (found, dict(errors)) if return_diagnostics else found


def composite_scores(scores: DataFrame, method: str = "mean", standardize: bool = True, *, weights=None, min_valid_indices: int | None = None) -> CompositeResult:
    """The composite of stored scores."""
    names = validate_index_names([c.removeprefix("score__") for c in scores.columns if c.startswith("score__")], composite_index_names())
    if not standardize and not scores.filter(" OR ".join(f"NOT abs(`score__{k}`) < double('infinity')" for k in names)).isEmpty():
        raise ValueError("there are scores that aren't finite")
    return combine(scores, names, method, standardize, weights, min_valid_indices)


def composite_flag(frame: ResponseFrame, *args, threshold: float | None = None, percentile: float = 95.0, return_diagnostics: bool = False, **options) -> DataFrame | tuple[DataFrame, dict[str, str]]:
    """The composite's table with a flag."""
    found = composite(frame, *args, **options)
    try:
        flagged = flag_scores(found.table, "composite", threshold, percentile, "high")
    finally:
        found.release()
    return (flagged, found.errors) if return_diagnostics else flagged


def composite_summary(frame: ResponseFrame, *args, **options) -> tuple[CompositeResult, DataFrame]:
    """The composite and one row: mean, std, min, max, n_total, n_valid."""
    found = composite(frame, *args, **options)
    c = F.col("composite")
    return found, found.table.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(F.lit(1)).alias("n_total"), F.count(c).alias("n_valid"))


def composite_probability(frame: ResponseFrame, *args, **options) -> DataFrame:
    """The composite of standardised scores, through the logistic function."""
    found = composite(frame, *args, **{**options, "standardize": True})
    found.release()
    return found.table.withColumn("probability", logistic(F.col("composite")))
