"""Names for annotations: what the public functions take and give."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, Literal, TypeAlias, TypedDict

import numpy as np
import numpy.typing as npt
from pyspark.sql import DataFrame

#: What ResponseFrame.from_rows() takes: lists of rows, a NumPy array, or a data frame of pandas or polars.
MatrixLike: TypeAlias = Sequence[Sequence[float | None]] | npt.NDArray[Any]
FloatArray: TypeAlias = npt.NDArray[np.float64]
IntArray: TypeAlias = npt.NDArray[np.int_]
BoolArray: TypeAlias = npt.NDArray[np.bool_]

CompositeMethod: TypeAlias = Literal["mean", "sum", "max", "best_subset"]
InfrequencyMissingPolicy: TypeAlias = Literal["pass", "fail", "omit", "propagate"]
ResponseTimeMetric: TypeAlias = Literal["mean", "median", "sd", "min", "consistency", "mixture"]
ResponseTimeFlagDirection: TypeAlias = Literal["high", "low"]
ScoreArchiveResultType: TypeAlias = Literal["screen", "composite"]

#: Scores and flags are columns of one table here: score__<index>, flag__<index>.
IndexScoreMap: TypeAlias = DataFrame
IndexFlagMap: TypeAlias = DataFrame
#: Why an index wasn't scored.
IndexErrorMap: TypeAlias = Mapping[str, str]


class IndexMetadata(TypedDict):
    """What index_catalog() tells of an index."""

    direction: Literal["high", "low"]
    flag_mode: Literal["percentile", "presence"]
    screen_default: bool
    composite_default: bool
    composite_allowed: bool
    composite_multiplier: int | None
    required_options: list[str]


IndexCatalog: TypeAlias = Mapping[str, IndexMetadata]


class ScreenIndexSummary(TypedDict):
    """A row of ScreenResult.summary."""

    index: str
    mean: float | None
    std: float | None
    min: float | None
    max: float | None
    n_valid: int
    n_unavailable: int
    n_flagged: int
    flag_rate: float | None


class CompositeSummary(TypedDict):
    """The row of composite_summary()."""

    mean: float | None
    std: float | None
    min: float | None
    max: float | None
    n_total: int
    n_valid: int
