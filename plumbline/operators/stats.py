"""Whole-table statistics that some indices need: small, gathered by partial aggregation, kept on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ResponseFrame
from ..functions.exprs import whole
from .kernels import matrices


def gram(df: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sum over rows of the outer products of (responses - centre), missing answers counting as the centre.

    Each partition adds up one small matrix; the matrices are summed cell by cell in a shuffle, and only items² cells reach the
    driver.
    """
    p = len(centre)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            for x in matrices(batch.column(0), p) if len(batch) else ():
                d = np.nan_to_num(x - centre)
                total += d.T @ d
        yield pa.RecordBatch.from_pydict({"cell": np.arange(p * p), "s": total.ravel()})

    cells = df.select("responses").mapInArrow(part, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros(p * p)
    out[cells["cell"]] = cells["s"]
    return out.reshape(p, p)


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, items and values of the available answers, from the flat buffer of the lists."""
    rows = batch.column(0)
    sizes = np.diff(rows.offsets.to_numpy())
    if rows.null_count:
        sizes = np.where(rows.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    values = rows.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    item = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seen = ~np.isnan(values)
    return np.repeat(np.arange(len(rows)), sizes)[seen], item[seen], values[seen]


class MatrixStats:
    """Figures of a frame, each group computed by one job when first asked for."""

    def __init__(self, frame: ResponseFrame):
        self.frame = frame

    @cached_property
    def _items(self) -> pd.DataFrame:
        """A row for each item; each partition gives one row an item, so cells are never exploded."""
        p = self.frame.n_items

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, there, total, lo, hi, odd = 0, np.zeros(p, int), np.zeros(p), np.full(p, np.inf), np.full(p, -np.inf), np.zeros(p, int)
            for batch in batches:
                _, item, v = _cells(batch)
                n += len(batch)
                there += np.bincount(item, minlength=p)
                total += np.bincount(item, v, p)
                np.minimum.at(lo, item, v)
                np.maximum.at(hi, item, v)
                odd += np.bincount(item[(v != 0) & (v != 1)], minlength=p)
            yield pa.RecordBatch.from_pydict({"item": np.arange(p, dtype=np.int32), "n": np.full(p, n), "there": there, "sum": total, "lo": lo, "hi": hi, "odd": odd})

        form = "item int, n bigint, there bigint, sum double, lo double, hi double, odd bigint"
        sums = [F.sum(c).alias(c) for c in ("n", "there", "sum")]
        cells = self.frame.df.select("responses").mapInArrow(part, form).groupBy("item").agg(*sums, F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("odd").alias("odd"))
        out = cells.toPandas().sort_values("item", ignore_index=True)
        out = out[out["n"] > 0].reset_index(drop=True)
        none = out["there"] == 0
        out["binary"] = (out["odd"] == 0).astype(object).where(~none, None)
        out.loc[none, ["lo", "hi"]] = np.nan
        return out

    @property
    def n(self) -> int:
        return int(self._items["n"].iloc[0]) if len(self._items) else 0

    @property
    def means(self) -> np.ndarray:
        """Of available answers; NaN for an item without any."""
        with np.errstate(invalid="ignore"):
            return self._items["sum"].to_numpy(float) / np.where(self._items["there"] > 0, self._items["there"], np.nan)

    @property
    def complete(self) -> np.ndarray:
        return (self._items["there"] == self._items["n"]).to_numpy()

    @property
    def any_missing(self) -> bool:
        return not self.complete.all()

    @property
    def bounds(self) -> tuple[float, float] | None:
        lo, hi = self._items["lo"].min(), self._items["hi"].max()
        return None if pd.isna(lo) else (float(lo), float(hi))

    @property
    def binary(self) -> bool:
        return bool(self._items["binary"].dropna().all())

    def scale(self, lo: float | None, hi: float | None) -> tuple[float, float] | None:
        """Given bounds, or else the observed ones; None if nothing was observed."""
        if lo is None or hi is None:
            seen = self.bounds
            if seen is None:
                return None
            lo, hi = seen[0] if lo is None else lo, seen[1] if hi is None else hi
        if hi < lo:
            raise ValueError("scale_max must not be below scale_min")
        return float(lo), float(hi)

    @cached_property
    def correlations(self) -> np.ndarray:
        """Item correlations; 0 for items with missing answers or without variance."""
        g = gram(self.frame.df, np.nan_to_num(self.means))
        ok = self.complete & (np.diag(g) > 0)
        s = np.sqrt(np.where(ok, np.diag(g), 1.0))
        r = np.clip(g / s[:, None] / s, -1, 1)
        r[~ok, :] = 0
        r[:, ~ok] = 0
        return r

    @cached_property
    def covariance(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of complete rows, their means and their sample covariance."""
        rows = self.frame.df.filter(whole(F.col("responses"), self.frame.n_items))
        if self.any_missing:
            inner = MatrixStats(ResponseFrame(rows, self.frame.n_items))
            n, mean = inner.n, inner.means if inner.n else np.zeros(0)
        else:
            n, mean = self.n, self.means
        if n < 2:
            return n, mean, np.zeros((self.frame.n_items,) * 2)
        return n, mean, gram(rows, mean) / (n - 1)

    def pairs(self, critical: float, opposite: bool) -> np.ndarray:
        """Item pairs (larger index first) whose correlation reaches the critical value."""
        r = self.correlations
        i, j = np.tril_indices(len(r), -1)
        keep = r[i, j] <= critical if opposite else r[i, j] >= critical
        return np.stack([i[keep], j[keep]], axis=1)

    @cached_property
    def item_response(self) -> tuple[np.ndarray, np.ndarray, float | None]:
        """Discrimination, difficulty, and the cut between 0 and 1 (None for answers that are 0 or 1 already)."""
        p = self.frame.n_items
        if self.bounds is None:
            return np.ones(p), np.zeros(p), None
        cut = None if self.binary else sum(self.bounds) / 2
        names = ("n", "y", "t", "tt", "yt")

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums, over the rows that answer an item, of right answers (y), of rows' numbers of them (t), and of products: whole numbers."""
            total = np.zeros((len(names), p), np.int64)
            for batch in batches:
                row, item, v = _cells(batch)
                y = (v if cut is None else v > cut).astype(float)
                t = np.bincount(row, y, len(batch))[row]
                total += np.stack([np.bincount(item, w, p) for w in (np.ones(len(y)), y, t, t * t, y * t)]).round().astype(np.int64)
            yield pa.RecordBatch.from_pydict({"item": np.arange(p, dtype=np.int32), **dict(zip(names, total, strict=True))})

        cells = self.frame.df.select("responses").mapInArrow(part, "item int, " + ", ".join(f"{k} bigint" for k in names))
        a, b = np.ones(p), np.zeros(p)
        for r in cells.groupBy("item").agg(*[F.sum(k).alias(k) for k in names]).filter("n > 0").collect():
            n, y, t, tt, yt = (r[k] for k in names)
            share = min(max(y / n, 0.001), 0.999)
            b[r["item"]] = -np.log(share / (1 - share))
            below = (n * y - y * y) * (n * tt - t * t)  # whole numbers as long as they need be, so nothing cancels
            if below > 0:
                c = min(max((n * yt - y * t) / math.sqrt(below), -0.99), 0.99)
                a[r["item"]] = min(max(1.7 * c / np.sqrt(1 - c * c), 0.2), 3.0)
        return a, b, cut
