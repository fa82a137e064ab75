"""Screening a stream: row-local indices with fixed cutoffs, and cutoffs frozen from a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ResponseFrame
from ..functions.exprs import flag
from ..plans.registry import INDICES, IndexOptions
from ..plans.screen import ScreenResult

#: Indices that need nothing but the row; those in SCALED also need scale_min and scale_max in the options.
ROW_LOCAL = ("irv", "longstring", "longstring_pattern", "markov", "missing_rate", "onset", "evenodd", "individual_reliability", "infrequency", "semantic_syn")
SCALED = ("u3_poly", "midpoint", "acquiescence", "semantic_ant")


def screen_stream(frame: ResponseFrame, cutoffs: Mapping[str, float | None], options: IndexOptions | None = None, min_flags: int = 2, inclusive: bool = False) -> DataFrame:
    """frame's rows, of a stream or a table, with score__, flag__, flag_count and consensus_flag.

    cutoffs: a cutoff for each index (None for an index flagged by presence); frozen_cutoffs() takes them from a screened table.
    """
    options = options or IndexOptions()
    names = list(cutoffs)
    scaled = options.scale_min is not None and options.scale_max is not None
    for n in names:
        if n not in ROW_LOCAL and not (n in SCALED and scaled):
            raise ValueError(f"{n} needs figures of the whole table, which a stream doesn't have")
    df = frame.df.withColumns({f"score__{n}": INDICES[n].score(frame, options, None) for n in names})
    tests = {}
    for n in names:
        c, spec = F.col(f"score__{n}"), INDICES[n]
        tests[f"flag__{n}"] = c.isNotNull() if spec.mode == "presence" else flag(c, cutoffs[n], spec.direction, inclusive)
    df = df.withColumns(tests).withColumn("flag_count", sum((F.col(t).cast("int") for t in tests), F.lit(0)))
    return df.withColumn("consensus_flag", F.col("flag_count") >= min_flags)


def frozen_cutoffs(result: ScreenResult) -> dict[str, float | None]:
    return dict(result.cutoffs)
