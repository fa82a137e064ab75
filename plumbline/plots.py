"""Pictures of a screen, drawn from counts that Spark makes; matplotlib is optional."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.screen import ScreenResult


def _pyplot():
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("plots need matplotlib") from e
    return plt


def histogram(table: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, left, right, n of a column's available values."""
    c = F.col(column)
    lo, hi = table.agg(F.min(c), F.max(c)).first()
    if lo is None:
        return table.sparkSession.createDataFrame([], "bin int, left double, right double, n bigint")
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((c - lo) / width), F.lit(bins - 1)).cast("int")
    out = table.filter(c.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("bin", (F.col("bin") * width + lo).alias("left"), ((F.col("bin") + 1) * width + lo).alias("right"), "n").orderBy("bin")


def flag_counts(result: ScreenResult) -> DataFrame:
    return result.table.groupBy("flag_count").agg(F.count(F.lit(1)).alias("n")).orderBy("flag_count")


def plot_distributions(result: ScreenResult, bins: int = 30):
    plt, names = _pyplot(), list(result.cutoffs)
    figure, axes = plt.subplots(len(names), 1, figsize=(7, 2 * len(names)), squeeze=False)
    for ax, k in zip(axes[:, 0], names, strict=True):
        for r in histogram(result.table, f"score__{k}", bins).collect():
            ax.bar(r["left"], r["n"], r["right"] - r["left"], align="edge")
        if result.cutoffs[k] is not None:
            ax.axvline(result.cutoffs[k], linestyle="--")
        ax.set_title(k)
    return figure


def plot_flagged_heatmap(result: ScreenResult, rows: int = 50):
    """The respondents with the most flags."""
    plt, names = _pyplot(), list(result.cutoffs)
    found = result.table.orderBy(F.col("flag_count").desc(), "ord").limit(rows).collect()
    figure, ax = plt.subplots()
    ax.imshow([[int(r[f"flag__{k}"]) for k in names] for r in found], aspect="auto")
    ax.set_xticks(range(len(names)), names, rotation=90)
    ax.set_yticks(range(len(found)), [r["respondent_id"] for r in found])
    return figure


def plot_flag_counts(result: ScreenResult):
    plt = _pyplot()
    figure, ax = plt.subplots()
    found = flag_counts(result).collect()
    ax.bar([r["flag_count"] for r in found], [r["n"] for r in found])
    return figure


def plot_mahad_qq(qq: DataFrame, points: int = 5000):
    """A sample of at most about `points` of the points, evenly over the ranks."""
    plt = _pyplot()
    step = max(1, qq.count() // points)
    found = qq.filter(F.col("rank") % step == 0).collect()
    figure, ax = plt.subplots()
    ax.scatter([r["expected"] for r in found], [r["observed"] for r in found], s=4)
    return figure
