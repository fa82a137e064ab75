"""Consensus screening: cutoffs of several indices, flags, and how many of them a respondent has."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import ResponseFrame
from ..functions.exprs import flag
from ..functions.order import percentiles as percentiles_of
from ..operators.flags import check_percentile, check_threshold
from .registry import INDICES, IndexOptions, default_screen_indices, score_columns, score_table, validate_count, validate_index_names, validate_min_valid


@dataclass(frozen=True)
class ScreenResult:
    """table: scores, flag__<index>, flag_count, valid_index_count, consensus_eligible, consensus_flag. summary: a row per index."""

    table: DataFrame
    summary: DataFrame
    cutoffs: dict[str, float | None]
    errors: dict[str, str] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)
    scores: DataFrame | None = None

    def release(self) -> None:
        """Let go of the scores that are held for the table; it can still be computed."""
        if self.scores is not None:
            self.scores.unpersist()


def _overrides(given: Mapping[str, float] | None, names: Sequence[str], check, what: str) -> dict[str, float]:
    out = {}
    for k, v in (given or {}).items():
        if k not in INDICES:
            raise ValueError(f"{what}: unknown index {k}")
        if k not in names:
            raise ValueError(f"{what}: {k} isn't selected")
        if INDICES[k].mode == "presence":
            raise ValueError(f"{what}: {k} is flagged by presence and has no cutoff")
        out[k] = check(v, what)
    return out


def decide(scores: DataFrame, names: Sequence[str], percentile: float = 95.0, min_flags: int = 2, min_valid_indices: int | None = None, thresholds=None, percentiles=None, selected: int | None = None, errors=None) -> ScreenResult:
    """The decisions on a table with a column score__<index> for each name.

    The cutoffs come from exact percentiles of all indices at once, the summary figures from their first pass, the flags from one projection, and
    one more aggregation counts them.
    """
    check_percentile(percentile)
    validate_count(min_flags, "min_flags")
    validate_min_valid(min_valid_indices, selected or len(names))
    fixed, own = _overrides(thresholds, names, check_threshold, "thresholds"), _overrides(percentiles, names, check_percentile, "percentiles")
    if both := set(fixed) & set(own):
        raise ValueError(f"both a threshold and a percentile for {', '.join(sorted(both))}")
    scores = scores.persist()  # read for the cutoffs, for the counts and by whoever takes the table; result.release() lets it go
    columns = {k: F.col(f"score__{k}") for k in names}
    aggs: list[Column] = [F.count(F.lit(1)).alias("n"), *[F.count_if(~(F.abs(c) < float("inf"))).alias(f"{k}__wild") for k, c in columns.items()]]
    wanted: dict[str, tuple[Column, list[float]]] = {}
    for k, c in columns.items():
        p = own.get(k, percentile)
        p = p if INDICES[k].direction == "high" else 100 - p
        wanted[k] = (c, [p / 100] if k not in fixed and INDICES[k].mode != "presence" else [])
        aggs += [F.avg(c).alias(f"{k}__mean"), F.stddev_pop(c).alias(f"{k}__std"), F.min(c).alias(f"{k}__min"), F.max(c).alias(f"{k}__max"), F.count(c).alias(f"{k}__valid")]
    try:
        cuts, seen = percentiles_of(scores, wanted, aggs)
        if wild := [k for k in names if seen[f"{k}__wild"]]:
            raise ValueError(f"scores of {', '.join(wild)} aren't finite")
    except Exception:
        scores.unpersist()
        raise
    cutoffs: dict[str, float | None] = {}
    flags: dict[str, Column] = {}
    for k, c in columns.items():
        spec = INDICES[k]
        if spec.mode == "presence":
            cutoffs[k], flags[k] = None, c.isNotNull()
            continue
        found = cuts[k][0] if cuts[k] else None
        cutoffs[k] = fixed.get(k, 0.0 if found is None else found)
        flags[k] = flag(c, cutoffs[k], spec.direction, k in fixed)
    table = scores.withColumns({f"flag__{k}": f for k, f in flags.items()})
    count = sum((F.col(f"flag__{k}").cast("int") for k in names), F.lit(0))
    valid = sum((c.isNotNull().cast("int") for c in columns.values()), F.lit(0))
    table = table.withColumns({"flag_count": count, "valid_index_count": valid})
    table = table.withColumn("consensus_eligible", F.col("valid_index_count") >= (min_valid_indices or 0))
    table = table.withColumn("consensus_flag", F.col("consensus_eligible") & (F.col("flag_count") >= min_flags))
    flagged = table.agg(*[F.sum(F.col(f"flag__{k}").cast("bigint")).alias(k) for k in names]).first()
    rows = []
    for k in names:
        v, f = seen[f"{k}__valid"], int(flagged[k] or 0)
        rows.append((k, *(seen[f"{k}__{s}"] for s in ("mean", "std", "min", "max")), v, seen["n"] - v, f, f / v if v else None))
    schema = "index string, mean double, std double, min double, max double, n_valid bigint, n_unavailable bigint, n_flagged bigint, flag_rate double"
    sources = {k: "presence" if INDICES[k].mode == "presence" else "fixed" if k in fixed else "percentile" for k in names}
    used = {k: own.get(k, percentile) if sources[k] == "percentile" else None for k in names}
    settings = {"percentile": percentile, "min_flags": min_flags, "min_valid_indices": min_valid_indices, "cutoff_sources": sources, "percentiles": used}
    return ScreenResult(table, scores.sparkSession.createDataFrame(rows, schema), cutoffs, dict(errors or {}), settings, scores)


def screen(frame: ResponseFrame, indices: Sequence[str] | None = None, *, options: IndexOptions | None = None, percentile: float = 95.0, min_flags: int = 2, min_valid_indices: int | None = None, thresholds=None, percentiles=None, strict: bool = False, workers: int = 1) -> ScreenResult:
    check_percentile(percentile)
    validate_count(min_flags, "min_flags")
    names = validate_index_names(default_screen_indices() if indices is None else indices, list(INDICES))
    validate_min_valid(min_valid_indices, len(names))
    for given, check, what in ((thresholds, check_threshold, "thresholds"), (percentiles, check_percentile, "percentiles")):
        _overrides(given, names, check, what)
    columns, errors = score_columns(frame, names, options, strict, workers)
    scores = score_table(frame, columns)
    keep = lambda given: {k: v for k, v in (given or {}).items() if k in columns}
    return decide(scores, list(columns), percentile, min_flags, min_valid_indices, keep(thresholds), keep(percentiles), len(names), errors)


def screen_scores(scores: DataFrame, names: Sequence[str] | None = None, **settings) -> ScreenResult:
    """The same decisions on stored scores: every column score__<index>, or those of the names given."""
    found = [c.removeprefix("score__") for c in scores.columns if c.startswith("score__")] if names is None else list(names)
    return decide(scores, validate_index_names(found, list(INDICES)), **settings)
