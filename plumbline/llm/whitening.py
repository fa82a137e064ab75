"""Embedding whitening: principal components of exactly centred rows, from MLlib's Gramian, applied in Arrow batches.

Entries are taken to whole numbers, floor(256 c). The statistics are those of each different vector once (the fit list): its size n and the
sums S are whole numbers, so n x - S is exact, and a centred row is that over n, rounded once. RowMatrix adds up the Gramian over
partitions; only dimension² numbers reach the driver, whose eigenvectors are broadcast (dimension times the number of components).

Defined cases: rows whose vector is null or has a null, NaN or infinite entry are left out, and so are those whose length isn't the commonest
(the shortest of equally common ones), an empty vector among them; vectors shorter than the number of components have fewer; a component
without variance (beyond rounding) gives 0 for whitened and explained, and is left out of the identity error; a deviation beyond 64 bits is
null; an eigenvector's largest entry is positive. Ids may be null or repeated. Further columns, whatever their names, are left
out; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Steps of a whole number.
SCALE = 256
#: Variances below this share of the largest are rounding.
NEGLIGIBLE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list; a column and a variance for each component; trace of the covariance; error: the largest absolute entry
    of the whitened covariance minus the identity, over the components with variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float
    error: float = 0.0

    @property
    def scales(self) -> np.ndarray:
        """What projections are multiplied by."""
        there = self.variances > 0
        return np.where(there, 1 / np.sqrt(np.where(there, self.variances, 1)), 0.0)


def whole_vectors(df: DataFrame, vector: str = "embedding", name: str = "x") -> DataFrame:
    """df's rows with a usable vector, and the vector as whole numbers in a column of its own; rows of an uncommon length go."""
    c = F.col(f"`{vector}`")
    sound = ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    df = df.filter(c.isNotNull() & (F.size(c) > 0) & sound)
    lengths = df.groupBy(F.size(c).alias("k")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "k").limit(1).collect()
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE))
    return df.filter(F.size(c) == (lengths[0]["k"] if lengths else 0)).withColumn(name, x)


def _gramian(rows: Column, df: DataFrame) -> np.ndarray:
    """Sum of the outer products of an array column."""
    vectors = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(rows).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _sums(distinct: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Rows, and exact sums of each dimension: one row from each partition."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_list()).astype(np.int64)
                n += len(x)
                high += (x >> 32).sum(axis=0)  # halves, so that sums of 64-bit numbers fit
                low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pd.DataFrame({"at": np.arange(dimension), "n": n, "high": high, "low": low})

    cells = distinct.select("x").mapInPandas(part, "at int, n long, high long, low long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("at").collect()
    return (cells[0]["n"] if cells else 0), [(r["high"] << 32) + r["low"] for r in cells]


def _off(x: Column, n: int, sums: list[int]) -> Column:
    """n x - S, null beyond 64 bits."""
    given = F.array(*[F.lit(s).cast("long") for s in sums])
    return F.zip_with(x, given, lambda v, s: F.try_subtract(F.try_multiply(v, F.lit(n).cast("long")), s))


def fit(whole: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of a table with whole vectors x, all of one length; None without rows."""
    first = whole.select(F.size("x")).first()
    if first is None:
        return None
    p = first[0]
    distinct = materialise(whole.select("x").distinct(), "whitening-fit")
    n, sums = _sums(distinct, p)
    centred = F.transform(_off(F.col("x"), n, sums), lambda d: d.cast("double") / n)
    v = _gramian(centred, distinct) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    k = min(components, p)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    trace = float(np.trace(v))
    values = np.where(values > max(NEGLIGIBLE * values[0], 0), values, 0.0)
    made = Whitening(n, sums, vectors, values, trace)
    there = int((values > 0).sum())
    error = 0.0
    if there:
        cells = F.array(*[F.col(f"w.w{j}") for j in range(there)])
        again = _gramian(cells, _projected(distinct.select("x"), made, "w")) / n
        error = float(np.abs(again - np.eye(there)).max())
    discard(distinct)
    return Whitening(n, sums, vectors, values, trace, error)


def _projected(df: DataFrame, made: Whitening, name: str) -> DataFrame:
    """df, without x, with a struct of whitened coordinates w0, w1, ..."""
    held = df.sparkSession.sparkContext.broadcast((made.n, np.array(made.sums, dtype=object), made.vectors, made.scales))
    k = made.vectors.shape[1]
    kept = [c for c in df.columns if c != "x"]
    others = df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, vectors, scales = held.value
        small = max((abs(s) for s in sums), default=0) < 2**61
        for pdf in batches:
            out = pdf[kept].copy()
            if len(pdf):
                x = np.stack(pdf["x"].to_list()).astype(np.int64)
                if small and np.abs(x).max(initial=0) < 2**61 // n:
                    off = (x * n - sums.astype(np.int64)).astype(float)
                else:
                    off = (x.astype(object) * n - sums).astype(float)
                w = off / n @ vectors * scales
            else:
                w = np.zeros((0, k))
            for j in range(k):
                out[f"{name}.w{j}"] = w[:, j]
            yield out

    flat = ", ".join(f"`{name}.w{j}` double" for j in range(k))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    made_rows = df.mapInPandas(run, ", ".join(filter(None, (schema, flat))))
    pack = F.struct(*[F.col(f"`{name}.w{j}`").alias(f"w{j}") for j in range(k)]).alias(name)
    return made_rows.select(*[F.col(f"`{c}`") for c in kept], pack)


def whiten(df: DataFrame, vector: str = "embedding", ident: str = "vec_id", components: int = 4) -> DataFrame:
    """A row for each usable vector and component: ident, component (from 1), n, deviation (squared distance of n x from S), whitened, explained
    (the component's share of all variance) and identity_error."""
    whole = whole_vectors(df.select(F.col(f"`{ident}`").alias("i"), F.col(f"`{vector}`").alias("v")), "v").select("i", "x")
    made = fit(whole, components)
    if made is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]
        return whole.select(F.col("i").alias(ident), *none)
    squares = F.transform(_off(F.col("x"), made.n, made.sums), lambda d: F.try_multiply(d, d))
    deviation = F.aggregate(squares, F.lit(0).cast("long"), lambda a, b: F.try_add(a, b))
    # As text, since pandas would turn ids and deviations with a null among them into doubles.
    rows = whole.select(F.col("i").cast("string").alias("i"), deviation.cast("string").alias("d"), "x")
    share = made.variances / made.trace if made.trace > 0 else np.zeros(len(made.variances))
    parts = F.array(*[F.struct(F.lit(j + 1).alias("component"), F.col(f"w.w{j}").alias("whitened"), F.lit(float(s)).alias("explained")) for j, s in enumerate(share)])
    long = _projected(rows, made, "w").select(F.col("i").cast(whole.schema["i"].dataType).alias(ident), F.col("d").cast("long").alias("deviation"), F.explode(parts).alias("p"))
    return long.select(
        F.col(f"`{ident}`"), F.col("p.component").alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation",
        F.col("p.whitened").alias("whitened"), F.col("p.explained").alias("explained"), F.lit(made.error).alias("identity_error"),
    )
