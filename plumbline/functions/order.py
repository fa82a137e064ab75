"""Exact order statistics and ranks without a task that holds a column.

Percentiles: a sketch of bounded size brackets each wanted rank, counts tell where the bracket lies and whether it does hold the rank, and what
lies in a large bracket is bracketed again, until its different values are few enough to be counted one by one. Ranks: different values and
their counts are dealt to buckets whose bounds are constants of the plan, so that a task that runs again deals them in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranks that a sketch tells are off by n / ACCURACY at most.
ACCURACY = 10_000
#: Rows of all brackets together that are counted value by value.
HELD = 50_000
#: Parts that a larger bracket is cut into.
GRID = 64


@dataclass
class _Bracket:
    """The values from low to high hold the rows of ranks first to last (from 0)."""

    column: Column
    first: int
    last: int
    low: float
    high: float
    below: int
    inside: int
    done: bool = False

    @property
    def holds(self) -> bool:
        return self.below <= self.first and self.last < self.below + self.inside

    def try_bounds(self, low: float, high: float) -> tuple:
        before = (self.low, self.high, self.below, self.inside)
        self.low, self.high = low, high
        return before


def _shares(p: float) -> list[float]:
    return [max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY)]


def percentiles(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[float]]], also: Sequence[Column] = ()) -> tuple[dict[str, list[float | None]], Row]:
    """For each name the exact percentiles (shares from 0 to 1, interpolated) of a column of doubles without NaN, nulls left out; None where
    there is no value. also: aggregates that the first pass takes along; the second result is a row of them.

    df should be persisted: it is read three times, and twice more for each time that brackets are narrowed (beyond some 10^8 rows).
    """
    aggs: list[Column] = []
    for k, (c, shares) in enumerate(wanted.values()):
        cut = F.percentile_approx(c, [s for p in shares for s in _shares(p)], ACCURACY) if shares else F.lit(None)
        aggs += [F.count(c).alias(f"_n{k}"), F.min(c).alias(f"_low{k}"), F.max(c).alias(f"_high{k}"), cut.alias(f"_cut{k}")]
    seen = df.agg(*aggs, *also).first()
    brackets: dict[tuple[str, int], _Bracket] = {}
    tries: list[tuple[_Bracket, tuple]] = []
    for k, (name, (c, shares)) in enumerate(wanted.items()):
        n, low, high, cut = (seen[f"_{x}{k}"] for x in ("n", "low", "high", "cut"))
        for j, p in enumerate(shares if n else ()):
            place = p * (n - 1)
            b = brackets[name, j] = _Bracket(c, math.floor(place), math.ceil(place), low, high, 0, n)
            tries.append((b, b.try_bounds(cut[2 * j] if p > 2 / ACCURACY else low, cut[2 * j + 1] if p < 1 - 2 / ACCURACY else high)))
    every = list(brackets.values())
    while tries:
        got = df.agg(*[f for b, _ in tries for f in (F.count_if(b.column < b.low), F.count_if(b.column.between(b.low, b.high)))]).first()
        for k, (b, before) in enumerate(tries):
            b.below, b.inside = got[2 * k], got[2 * k + 1]
            if not b.holds:  # the sketch was off by more than it says: the bracket of before holds it
                b.low, b.high, b.below, b.inside = before
                b.done = True
        wide = [b for b in every if b.low < b.high and not b.done and b.inside > HELD // len(every)]
        tries = _narrowed(df, wide) if wide else []
    values = _ranked(df, every)
    out: dict[str, list[float | None]] = {}
    for k, (name, (_, shares)) in enumerate(wanted.items()):
        out[name] = []
        for j, p in enumerate(shares):
            b = brackets.get((name, j))
            low, high = values[id(b)] if b else (None, None)
            place = p * (seen[f"_n{k}"] - 1)
            out[name].append(low if low == high else (b.last - place) * low + (place - b.first) * high)
    return out, seen


def _narrowed(df: DataFrame, wide: list[_Bracket]) -> list[tuple[_Bracket, tuple]]:
    """Bounds from a sketch of what each bracket holds; its end values, however often they occur, are told apart by their counts."""
    steps = [j / GRID for j in range(GRID + 1)]
    aggs = []
    for k, b in enumerate(wide):
        c = b.column
        aggs += [F.percentile_approx(F.when(c.between(b.low, b.high), c), steps, ACCURACY).alias(f"g{k}"), F.count_if(c == b.low).alias(f"l{k}"), F.count_if(c == b.high).alias(f"h{k}")]
        aggs += [F.min(F.when(c > b.low, c)).alias(f"u{k}"), F.max(F.when(c < b.high, c)).alias(f"d{k}")]
    seen, out = df.agg(*aggs).first(), []
    for k, b in enumerate(wide):
        grid, lows, highs, after, before = (seen[f"{x}{k}"] for x in "glhud")
        first, last = b.first - b.below, b.last - b.below
        if last < lows:
            bounds = b.low, b.low
        elif first >= b.inside - highs:
            bounds = b.high, b.high
        elif first < lows:  # two values, however many rows
            bounds, b.done = (b.low, after), True
        elif last >= b.inside - highs:
            bounds, b.done = (before, b.high), True
        else:
            low, high = math.floor(_shares(first / (b.inside - 1))[0] * GRID), math.ceil(_shares(last / (b.inside - 1))[1] * GRID)
            bounds = max(after, grid[low]), min(before, grid[high])
        out.append((b, b.try_bounds(*bounds)))
    return out


def _ranked(df: DataFrame, brackets: list[_Bracket]) -> dict[int, tuple[float, float]]:
    """The values of first and last of each bracket, from counts of the different values that it holds."""
    open_ = {k: b for k, b in enumerate(brackets) if b.low < b.high}
    found: dict[int, list[tuple[float, int]]] = {k: [] for k in open_}
    if open_:
        cells = F.array(*[F.when(b.column.between(b.low, b.high), F.struct(F.lit(k).alias("k"), b.column.alias("v"))) for k, b in open_.items()])
        for r in df.select(F.explode(F.array_compact(cells)).alias("c")).groupBy("c.k", "c.v").count().collect():
            found[r["k"]].append((r["v"], r["count"]))
    out = {}
    for k, b in enumerate(brackets):
        pair = []
        for rank in (b.first, b.last):
            left = rank - b.below
            for v, n in sorted(found[k]) if k in found else [(b.low, b.inside)]:
                if left < n:
                    pair.append(v)
                    break
                left -= n
        out[id(b)] = tuple(pair)
    return out


def places(df: DataFrame, value: str) -> DataFrame:
    """The different values of a column of doubles (no null, no NaN): value, count, and before, the number of rows with a smaller value.

    Equal values are one row, so ties need no order, and a value of any number of rows is counted before it is dealt.
    """
    spark = df.sparkSession
    counts = df.groupBy(F.col(f"`{value}`").alias(value)).agg(F.count(F.lit(1)).alias("count")).filter(F.col(f"`{value}`").isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(f"`{value}`", [k / parts for k in range(1, parts)] or [0.5])).first()[0]
    splits = [-math.inf, *sorted(set(bounds or [0.0])), math.inf]
    dealt = Bucketizer(splits=splits, inputCol=value, outputCol="_bucket").transform(counts)
    totals = dealt.groupBy("_bucket").agg(F.sum("count").alias("_rows"))
    earlier = F.coalesce(F.sum("_rows").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a bucket
    starts = F.broadcast(totals.select("_bucket", earlier.alias("_start")))
    inside = F.coalesce(F.sum("count").over(W.partitionBy("_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", inside).join(starts, "_bucket").select(value, "count", (F.col("_start") + F.col("_inside")).alias("before"))
