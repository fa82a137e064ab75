"""Response-time operators. A frame's responses are the times."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import ResponseFrame
from ..functions import exprs as E
from ..functions.order import places
from .flags import flag_scores

#: So many different medians (16 bytes each) may be held by the driver.
DIFFERENT = 200_000


def response_time(frame: ResponseFrame, metric: str = "median") -> Column:
    made = {"mean": E.row_mean, "median": E.row_median, "sd": E.row_sd, "min": E.row_min}
    if metric not in made:
        raise ValueError("metric must be mean, median, sd or min")
    return made[metric](F.col("responses"))


def response_time_consistency(frame: ResponseFrame) -> Column:
    """Standard deviation over mean; null where the mean is 0."""
    frame.need(2, "response_time_consistency")
    x = F.col("responses")
    return F.try_divide(E.row_sd(x), E.row_mean(x))


def response_time_score_flags(scores: DataFrame, threshold: float | None = None, cutoff_percentile: float | None = None, direction: str = "low", score: str = "score") -> DataFrame:
    return flag_scores(scores, score, threshold, cutoff_percentile, direction)


def response_time_flag(frame: ResponseFrame, threshold: float | None = None, method: str = "median", cutoff_percentile: float = 5) -> DataFrame:
    return flag_scores(frame.with_scores(score=response_time(frame, method)), "score", threshold, cutoff_percentile, "low")


def response_time_mixture(frame: ResponseFrame, n_components: int = 2, log_transform: bool = True, random_seed: int | None = None, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """respondent_id, ord, score: probability of belonging to the fastest component of a Gaussian mixture of median times.

    Expectation-maximisation from equal parts of the sorted values. Up to DIFFERENT different values, the driver iterates over them and
    their counts; beyond that each round is one aggregation over the medians, and only the sums of each component reach the driver. Both
    ways give the same.
    """
    if isinstance(n_components, bool) or n_components < 1:
        raise ValueError("n_components must be at least 1")
    k = n_components
    scored = frame.with_scores(median=response_time(frame))
    value = F.when((F.col("median") > 0) & (F.col("median") < float("inf")), F.log("median") if log_transform else F.col("median"))
    scored = scored.withColumn("x", value).persist()
    try:
        x = F.col("x")
        usable = scored.filter(x.isNotNull())
        n, variance = usable.agg(F.count(x), F.var_pop(x)).first()
        if n < k:
            raise ValueError("there are fewer usable times than components")
        counts = usable.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
        few = counts.limit(DIFFERENT + 1).toPandas() if n <= 50 * DIFFERENT else None
        if few is not None and len(few) <= DIFFERENT:
            few = few.sort_values("x")
            values, times = few["x"].to_numpy(float), few["c"].to_numpy(float)
            start = _part_means(values, times, k)
            sums = lambda m, v, w: _sums(values, times, m, v, w)
        else:
            start = _part_means_of(usable, n, k)
            sums = lambda m, v, w: _sums_of(usable, m, v, w)
        mean = start + np.random.default_rng(random_seed).normal(0, 0.01, k)
        var, weight = np.full(k, max(variance / k, 1e-10)), np.full(k, 1 / k)
        before = -np.inf
        for _ in range(rounds):
            likelihood, mass, one, two = sums(mean, var, weight)
            ok = mass >= 1e-10
            step = np.where(ok, one / np.where(ok, mass, 1), 0)
            mean = mean + step
            var = np.where(ok, np.maximum(two / np.where(ok, mass, 1) - step * step, 1e-10), var)
            weight = np.where(ok, mass / n, weight)
            if abs(likelihood - before) < tolerance:
                break
            before = likelihood
        r, _ = _shares(x, [F.lit(float(m)) for m in mean], *_scales(var, weight, F.lit))
        return scored.select("respondent_id", "ord", F.when(x.isNotNull(), r[int(np.argmin(mean))]).alias("score"))
    finally:
        scored.unpersist()


def _scales(var: np.ndarray, weight: np.ndarray, make) -> tuple[list, list]:
    """Of each component the log weight of its density, and what the squared distance is multiplied by."""
    return [make(float(np.log(max(w, 1e-300)) - 0.5 * np.log(2 * np.pi * v))) for v, w in zip(var, weight, strict=True)], [make(float(1 / (2 * v))) for v in var]


def _shares(x: Column, mean: list[Column], height: list[Column], steep: list[Column]) -> tuple[list[Column], Column]:
    """Of each component its share in x, and the log likelihood."""
    logs = [h - (x - m) * (x - m) * s for m, h, s in zip(mean, height, steep, strict=True)]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    below = sum((F.exp(c - top) for c in logs), F.lit(0.0))
    return [F.exp(c - top) / below for c in logs], top + F.log(below)


def _part_means(values: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """Means of k equal parts of the sorted values, the first parts one longer where they don't divide evenly."""
    n = int(times.sum())
    ends = np.cumsum([n // k + (c < n % k) for c in range(k)])
    upto = np.cumsum(times)
    total = np.concatenate([[0.0], np.cumsum(values * times)])

    def first(rank: int) -> float:
        """Sum of the `rank` smallest."""
        i = int(np.searchsorted(upto, rank))
        return total[i] + (rank - (upto[i - 1] if i else 0)) * values[i] if rank else 0.0

    below = np.array([first(0), *(first(int(e)) for e in ends)])
    return np.diff(below) / np.diff([0, *ends])


def _sums(values: np.ndarray, times: np.ndarray, mean: np.ndarray, var: np.ndarray, weight: np.ndarray):
    """Log likelihood, and of each component the sums of its shares, and of these times the distance and the squared distance."""
    d = values[:, None] - mean
    logs = np.log(np.maximum(weight, 1e-300)) - 0.5 * np.log(2 * np.pi * var) - d * d / (2 * var)
    top = logs.max(axis=1, keepdims=True)
    share = np.exp(logs - top)
    below = share.sum(axis=1, keepdims=True)
    share = share / below * times[:, None]
    return float(((top + np.log(below))[:, 0] * times).sum()), share.sum(axis=0), (share * d).sum(axis=0), (share * d * d).sum(axis=0)


def _part_means_of(usable: DataFrame, n: int, k: int) -> np.ndarray:
    """The same over a table: each different value falls into the parts that its run of ranks meets."""
    ends = np.cumsum([0, *(n // k + (c < n % k) for c in range(k))]).tolist()
    first, last = F.col("before"), F.col("before") + F.col("count")
    met = [F.greatest(F.lit(0), F.least(last, F.lit(b)) - F.greatest(first, F.lit(a))) for a, b in zip(ends, ends[1:], strict=False)]
    got = places(usable.select("x"), "x").agg(*[F.sum(F.col("x") * m) for m in met]).first()
    return np.array(list(got)) / np.diff(ends)


def _sums_of(usable: DataFrame, mean: np.ndarray, var: np.ndarray, weight: np.ndarray):
    """The same over a table: one aggregation. The parameters are a row that is joined, so the plan's code is the same in each round."""
    k, spark = len(mean), usable.sparkSession
    heights, steeps = _scales(var, weight, float)
    row = [*map(float, mean), *heights, *steeps]
    names = [f"{t}{c}" for t in "mhs" for c in range(k)]
    given = F.broadcast(spark.createDataFrame([row], ", ".join(f"{c} double" for c in names)))
    x, of = F.col("x"), lambda t: [F.col(f"{t}{c}") for c in range(k)]
    shares, likelihood = _shares(x, of("m"), of("h"), of("s"))
    sums = [F.sum(likelihood)]
    for r, m in zip(shares, of("m"), strict=True):
        sums += [F.sum(r), F.sum(r * (x - m)), F.sum(r * (x - m) * (x - m))]
    got = usable.select("x").join(given).agg(*sums).first()  # one row of parameters
    return got[0], np.array(got[1::3]), np.array(got[2::3]), np.array(got[3::3])
