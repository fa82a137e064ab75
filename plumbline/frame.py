"""The respondent-by-item table: one row per respondent, one array of answers, null where an answer is missing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCHEMA = T.StructType(
    [T.StructField("respondent_id", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("responses", T.ArrayType(T.DoubleType()))]
)


@dataclass(frozen=True)
class ResponseFrame:
    """df has respondent_id (string), ord (bigint, the order of respondents), responses (array of at most n_items doubles, null = missing; what
    is missing at the end may be left off) and possibly applicable (array of Booleans) and further columns, which operators keep."""

    df: DataFrame
    n_items: int
    item_names: tuple[str, ...] = ()

    @staticmethod
    def from_wide(df: DataFrame, items: Sequence[str], id_column: str | None = None, missing_tokens: Sequence[str] = ()) -> ResponseFrame:
        """One column per item. Blank strings, the tokens and NaN are missing; other text that is no number raises."""
        if len(set(items)) != len(items) or not items:
            raise ValueError("item columns must be given and unique")
        if id_column in items:
            raise ValueError("the id column can't be an item column")
        kinds = dict(df.dtypes)

        def cell(c: str):
            x = F.col(f"`{c}`")
            if kinds[c] == "string":
                t = F.trim(x)
                x = F.when((t == "") | t.isin(list(missing_tokens)), None).otherwise(t)
            return F.nanvl(x.cast("double"), F.lit(None).cast("double"))

        order = F.monotonically_increasing_id()
        name = F.col(f"`{id_column}`").cast("string") if id_column else order.cast("string")
        return ResponseFrame(df.select(name.alias("respondent_id"), order.alias("ord"), F.array(*map(cell, items)).alias("responses")), len(items), tuple(items))

    @staticmethod
    def from_long(df: DataFrame, respondent: str, item: str, value: str, n_items: int) -> ResponseFrame:
        """One row per answer; absent items are missing. Items are numbered from 0; respondents are ordered by their value.

        A respondent's cells are sorted and the gaps between them filled, so a row costs what it holds and ends with its last answer.
        An item that a respondent has twice raises.
        """
        cells = df.filter(F.col(item).between(0, n_items - 1)).select(
            F.col(respondent).alias("r"), F.struct(F.col(item).cast("int").alias("i"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("v")).alias("c")
        )
        found = cells.groupBy("r").agg(F.sort_array(F.collect_list("c")).alias("m"))

        def placed(m):
            """Each cell with as many nulls before it as items are absent."""
            before = lambda k: F.when(k > 0, F.get(m, k - 1)["i"]).otherwise(-1)
            cells = F.transform(m, lambda c, k: F.concat(F.array_repeat(F.lit(None).cast("double"), c["i"] - before(k) - 1), F.array(c["v"])))
            return F.when(F.size(F.map_from_entries(m)) > 0, F.flatten(cells))  # a map raises for a key that it gets twice

        row = placed(F.col("m"))
        return ResponseFrame(found.select(F.col("r").cast("string").alias("respondent_id"), F.col("r").cast("bigint").alias("ord"), row.alias("responses")), n_items)

    @staticmethod
    def from_rows(spark: SparkSession, rows, ids: Sequence[str] | None = None, item_names: Sequence[str] = ()) -> ResponseFrame:
        """Lists, arrays or pandas frames that the driver holds."""
        if rows is None:
            raise ValueError("no data were given")
        if hasattr(rows, "columns") and not item_names:
            item_names = [str(c) for c in rows.columns]
        lists = np.asarray(rows.to_numpy() if hasattr(rows, "to_numpy") else rows, dtype=float)
        if lists.ndim != 2 or not lists.size:
            raise ValueError("data must be two-dimensional and not empty")
        if ids is not None and (len(ids) != len(lists) or len(set(ids)) != len(ids) or not all(str(i).strip() for i in ids)):
            raise ValueError("respondent ids must be unique, not blank, and one for each row")
        data = [(str(i) if ids is None else str(ids[i]), i, [None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(lists)]
        return ResponseFrame(spark.createDataFrame(data, _SCHEMA), lists.shape[1], tuple(item_names))

    def need(self, least: int, what: str) -> None:
        if self.n_items < least:
            raise ValueError(f"{what} needs at least {least} items")

    def check_items(self, items: Sequence[int], what: str) -> list[int]:
        out = list(items)
        if not out:
            raise ValueError(f"{what}: no items were given")
        if any(isinstance(i, bool) or not isinstance(i, (int, np.integer)) or not 0 <= i < self.n_items for i in out):
            raise ValueError(f"{what}: items must be whole numbers from 0 to {self.n_items - 1}")
        if len(set(out)) != len(out):
            raise ValueError(f"{what}: items must be unique")
        return [int(i) for i in out]

    def with_scores(self, **columns) -> DataFrame:
        """respondent_id, ord and the given columns."""
        return self.df.select("respondent_id", "ord", *[c.alias(k) for k, c in columns.items()])

    def long(self) -> DataFrame:
        """ord, item, resp: cells that rows hold."""
        return self.df.select("ord", F.posexplode("responses").alias("item", "resp"))
