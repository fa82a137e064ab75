"""Reading response tables: delimited text, NumPy arrays, any table that Spark reads."""

from __future__ import annotations

import csv
import os
import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..frame import ResponseFrame

HEADERS = ("auto", "present", "absent")
#: Characters that a record with quoted cells may have.
LONGEST = 1 << 24


def check_missing_tokens(tokens: Sequence[str] | None) -> list[str]:
    out = [t.strip() for t in tokens or ()]
    if any(not t for t in out) or len(set(out)) != len(out):
        raise ValueError("missing-value tokens must be unique and not blank")
    return out


def _is_missing(cell: str, tokens: Sequence[str]) -> bool:
    return not cell.strip() or cell.strip() in tokens


def _numeric(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return False
    return True


def sniff(head: str, delimiter: str | None = None) -> str | None:
    """The delimiter of a text's beginning: comma, tab or semicolon; None for white space."""
    if delimiter is not None:
        if len(delimiter) != 1 or delimiter in '\r\n"':
            raise ValueError("a delimiter is one character")
        return delimiter
    first = ""
    for line in head.splitlines():
        first += line
        if line.strip() and first.count('"') % 2 == 0:  # else a cell in quotes goes on
            break
    best = max(",\t;", key=first.count)
    return best if best in first else None


def ends_open(line: str, sep: str, open_: bool) -> bool:
    """Whether a cell in quotes is still open at the end of a line. open_: one is open at its beginning.

    A quote opens a cell where the cell begins, after blanks; two within it are one character; after the one that closes it, quotes up to the
    next delimiter are plain characters.
    """
    k, n = 0, len(line)
    while True:
        if open_:
            q = line.find('"', k)
            if q < 0:
                return True
            if line.startswith('"', q + 1):
                k = q + 2
                continue
            k = q + 1
        else:
            while k < n and line[k] == " " != sep:
                k += 1
            if line.startswith('"', k):
                open_, k = True, k + 1
                continue
        k = line.find(sep, k) + 1
        if not k:
            return False
        open_ = False


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    rows = chain.from_iterable(b.to_pylist() for b in batches)
    return groupby(rows, lambda r: (r["file"], r["block"]))


def _open_blocks(lines: DataFrame, sep: str) -> DataFrame:
    """file and block of the blocks at whose beginning a cell is open.

    Each block tells where it leads from either state, so all are read at once. The state at a block is what the last block before it that
    leads to one state from both has led to, turned over by as many blocks as turn it over since.
    """

    def moves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (file, block), rows in _by_block(batches):
            state = [False, True]
            for r in rows:
                if '"' in r["value"]:
                    state = [ends_open(r["value"], sep, x) for x in state]
            out.append({"file": file, "block": block, "closed": state[0], "opened": state[1]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("block", pa.int64()), ("closed", pa.bool_()), ("opened", pa.bool_())]))

    found = lines.mapInArrow(moves, "file string, block long, closed boolean, opened boolean")
    upto = W.partitionBy("file").orderBy("block")
    turns = F.col("closed") & ~F.col("opened")
    found = found.withColumn("turned", F.sum(turns.cast("int")).over(upto))
    settled = F.when(F.col("closed") == F.col("opened"), F.struct("closed", "turned"))
    found = found.withColumn("last", F.last(settled, ignorenulls=True).over(upto.rowsBetween(W.unboundedPreceding, -1)))
    since = F.col("turned") - turns.cast("int") - F.coalesce("last.turned", F.lit(0))
    return found.filter(F.coalesce("last.closed", F.lit(False)).cast("int") != F.pmod(since, F.lit(2))).select("file", "block", F.lit(True).alias("open"))


def records(lines: DataFrame, sep: str) -> DataFrame:
    """Lines (value, file, block) put together where a cell in quotes goes on over their end, as a column value, in order.

    The blocks of a file are read by different tasks; a record that goes on in the next block is put together afterwards from its parts. The
    input is read three times.
    """
    form = "file string, block long, at long, kind int, value string"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a record; 1: the end of one from the blocks before, or its middle; 2: the beginning of one that goes on."""
        shape = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("value", pa.string())])
        out: list[dict] = []
        for (file, block), rows in _by_block(batches):
            held, size, begun, open_, at = [], 0, False, None, 0
            for r in rows:
                line = r["value"]
                if open_ is None:
                    begun = open_ = bool(r["open"])
                held.append(line)
                size += len(line) + 1
                if size > LONGEST:
                    raise ValueError("a quoted cell isn't closed")
                if '"' in line:
                    open_ = ends_open(line, sep, open_)
                if not open_:
                    out.append({"file": file, "block": block, "at": at, "kind": int(begun), "value": "\n".join(held)})
                    held, size, begun, at = [], 0, False, at + 1
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_pylist(out, shape)
                        out = []
            if held:
                out.append({"file": file, "block": block, "at": at, "kind": 1 if begun else 2, "value": "\n".join(held)})
        yield pa.RecordBatch.from_pylist(out, shape)

    marked = lines.join(F.broadcast(_open_blocks(lines, sep)), ["file", "block"], "left")  # a row a block at most
    pieces = marked.select("value", "file", "block", "open").mapInArrow(cut, form)
    order = W.partitionBy("file").orderBy("block", "at")
    parts = pieces.filter("kind > 0").withColumn("first", F.last(F.when(F.col("kind") == 2, F.col("block")), ignorenulls=True).over(order))
    texts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    joined = parts.groupBy("file", "first").agg(F.array_join(F.transform(texts, lambda x: x["value"]), "\n").alias("value"))
    joined = joined.select("file", F.col("first").alias("block"), F.lit(2**62).alias("at"), "value")  # the last of its first block
    return pieces.filter("kind = 0").select("file", "block", "at", "value").union(joined).orderBy("file", "block", "at").select("value")


def _quoted_cells(sep: str):
    @F.arrow_udf("array<string>")
    def cells(values: pa.Array) -> pa.Array:
        out = [[c.strip() for c in next(csv.reader([v], delimiter=sep, skipinitialspace=True))] for v in values.to_pylist()]
        return pa.array(out, pa.list_(pa.string()))

    return cells


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, header: str = "auto", id_column: str | None = None, item_columns: Sequence[str] | None = None, missing_tokens: Sequence[str] | None = None) -> ResponseFrame:
    """A frame from delimited text, gzip included; "-" reads standard input.

    The first rows are looked at on the driver to find delimiter and header; the rows themselves are read by the executors.
    Columns without a header are named c0, c1, ... Rows of another width than the first, or cells that are no number, raise. Cells in
    double quotes may hold delimiters, doubled quotes and line ends. The header is the first row; where a path has several files,
    rows equal to it are headers, too.
    """
    if header not in HEADERS:
        raise ValueError("header must be auto, present or absent")
    tokens = check_missing_tokens(missing_tokens)
    csv.field_size_limit(LONGEST)
    if path == "-":
        given = sys.stdin.read().splitlines()
        lines = spark.createDataFrame([(x, "-", 0) for x in given], "value string, file string, block long").coalesce(1)
    else:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    filled = F.trim("value") != ""
    first_lines = [r[0] for r in lines.filter(filled).select("value").limit(20).collect()]
    if not first_lines:
        raise ValueError("the input is empty")
    sep = sniff("\n".join(first_lines), delimiter)
    quoted = sep is not None and not lines.filter(F.contains("value", F.lit('"'))).isEmpty()
    rows = (records(lines, sep) if quoted else lines.select("value")).filter(filled)
    head = rows.limit(1).collect()[0][0] if quoted else first_lines[0]
    cut = lambda line: line.split() if sep is None else next(csv.reader([line], delimiter=sep, skipinitialspace=True))
    first = [c.strip() for c in cut(head)]
    named = header == "present" or header == "auto" and any(not _is_missing(c, tokens) and not _numeric(c) for c in first[:1] + ([first[1]] if id_column and len(first) > 1 else []))
    names = first if named else [f"c{k}" for k in range(len(first))]
    if len(set(names)) != len(names):
        raise ValueError("column names must be unique")
    for c in [*([id_column] if id_column else []), *(item_columns or ())]:
        if c not in names:
            raise ValueError(f"no column is named {c}")
    df = rows
    if named and len(lines.inputFiles()) > 1:
        df = rows.filter(F.col("value") != head)
    elif named:  # the first row of the first partition
        df = rows.withColumn("_at", F.monotonically_increasing_id()).filter("_at > 0").select("value")
    if sep is None:
        cells = F.split(F.trim("value"), r"\s+")
    elif quoted:
        cells = _quoted_cells(sep)("value")
    else:
        cells = F.transform(F.split("value", re.escape(sep), -1), lambda c: F.trim(c))
    df = df.select(cells.alias("_c"))
    wide = F.when(F.size("_c") == len(names), F.col("_c")).otherwise(F.raise_error(f"a row doesn't have {len(names)} cells"))
    df = df.select(wide.alias("_c"))
    df = df.select(*[F.get("_c", F.lit(k)).alias(n) for k, n in enumerate(names)])
    items = list(item_columns) if item_columns else [n for n in names if n != id_column]
    if id_column:
        check_ids(df, id_column)
    return ResponseFrame.from_wide(df, items, id_column, tokens)


def check_ids(df: DataFrame, id_column: str) -> None:
    c = F.trim(F.col(f"`{id_column}`"))
    if not df.filter(c.isNull() | (c == "")).limit(1).isEmpty():
        raise ValueError("a respondent id is blank")
    if not df.groupBy(c).count().filter("count > 1").limit(1).isEmpty():
        raise ValueError("a respondent id occurs twice")


def read_npy(spark: SparkSession, path: str) -> ResponseFrame:
    """A two-dimensional numeric array file, mapped into memory on the driver; larger data belong in Parquet."""
    import numpy as np

    x = np.load(path, mmap_mode="r", allow_pickle=False)
    if x.dtype.kind not in "fiub" or x.ndim != 2:
        raise ValueError("the array must be two-dimensional and of real numbers")
    return ResponseFrame.from_rows(spark, np.asarray(x, float))


def read_frame(spark: SparkSession, path: str, id_column: str | None = None, item_columns: Sequence[str] | None = None, **text) -> ResponseFrame:
    """By suffix: .npy, .parquet, .orc, .json, else delimited text. Column selection reaches the scan of columnar files."""
    kind = os.path.splitext(path.rstrip("/"))[1]
    if kind == ".npy":
        return read_npy(spark, path)
    if kind in (".parquet", ".orc", ".json"):
        df = spark.read.format(kind[1:]).load(path)
        if id_column:
            check_ids(df.withColumn(id_column, F.col(id_column).cast("string")), id_column)
        return ResponseFrame.from_wide(df, list(item_columns or [c for c in df.columns if c != id_column]), id_column)
    return read_delimited(spark, path, id_column=id_column, item_columns=item_columns, **text)
