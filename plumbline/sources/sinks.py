"""Writing results: distributed CSV and Parquet, strict JSON and text reports."""

from __future__ import annotations

import contextlib
import gzip
import json
import math
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(table: DataFrame) -> DataFrame:
    """Booleans as 0 and 1; numbers that aren't finite as null, which CSV leaves empty."""
    out = []
    for name, kind in table.dtypes:
        c = F.col(f"`{name}`")
        out.append((c.cast("int") if kind == "boolean" else F.when(F.abs(c) < float("inf"), c) if kind in ("double", "float") else c).alias(name))
    return table.select(*out)


def write_csv(table: DataFrame, path: str) -> None:
    """A folder of CSV files, written by the executors; compressed for a path that ends in .gz."""
    rows = plain(table).orderBy("ord") if "ord" in table.columns else plain(table)
    rows.write.mode("overwrite").csv(path, header=True, compression="gzip" if path.endswith(".gz") else "none")


def text_file(path: str):
    """A text file to write, compressed for a path that ends in .gz."""
    return gzip.open(path, "wt", encoding="utf-8") if path.endswith(".gz") else open(path, "w", encoding="utf-8")


def _json_value(v):
    return None if isinstance(v, float) and not math.isfinite(v) else v


def _columns_as_json(ordered: DataFrame) -> Iterator[tuple[int, str]]:
    """Column numbers and the JSON of stretches of their values, without brackets, made by the executors in one pass over the rows."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                texts = [json.dumps([_json_value(v) for v in c.to_pylist()], allow_nan=False, default=str)[1:-1] for c in batch.columns]
                yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(texts)), pa.int32()), "text": texts})

    return ((r["k"], r["text"]) for r in ordered.mapInArrow(encode, "k int, text string").toLocalIterator())


def json_pieces(table: DataFrame, metadata: dict) -> Iterator[str]:
    """One JSON object: the metadata and an array for each column. The table is read once; columns come together in files that the driver has
    for the time being, of which it holds a stretch."""
    head = json.dumps({k: _json_value(v) for k, v in metadata.items()}, allow_nan=False, default=lambda o: {k: _json_value(v) for k, v in dict(o).items()})
    yield head[:-1] + (", " if metadata else "") + '"columns": {'
    with contextlib.ExitStack() as stack:
        parts = [stack.enter_context(tempfile.TemporaryFile("w+", encoding="utf-8", newline="")) for _ in table.columns]
        for k, text in _columns_as_json(table.orderBy("ord") if "ord" in table.columns else table):
            parts[k].write((", " if parts[k].tell() else "") + text)
        for n, (name, part) in enumerate(zip(table.columns, parts, strict=True)):
            yield (", " if n else "") + json.dumps(name) + ": ["
            part.seek(0)
            while stretch := part.read(1 << 20):
                yield stretch
            yield "]"
    yield "}}\n"


def write_json(table: DataFrame, path: str, metadata: dict | None = None) -> None:
    """One file, put in place when it is complete."""
    temporary = f"{path}.{uuid.uuid4().hex}" + ".gz" * path.endswith(".gz")
    with text_file(temporary) as f:
        f.writelines(json_pieces(table, metadata or {}))
    os.replace(temporary, path)


def write_npz(table: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Columns as arrays, gathered on the driver: for tables that fit there."""
    import numpy as np

    pdf = (table.orderBy("ord") if "ord" in table.columns else table).toPandas()
    arrays = {c: pdf[c].to_numpy(float) if pdf[c].dtype.kind in "fiub" else pdf[c].astype(str).to_numpy(str) for c in pdf}
    with open(temporary := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        np.savez(f, metadata=np.array(json.dumps(metadata or {})), **arrays)
    os.replace(temporary, path)


def top(table: DataFrame, by: str, n: int) -> list:
    """The n rows of the greatest value; of equal ones the later respondent first."""
    return table.orderBy(F.col(by).desc_nulls_last(), F.col("ord").desc()).limit(n).collect()
