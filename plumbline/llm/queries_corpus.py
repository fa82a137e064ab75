"""Queries op2 and op5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import packing, suffix_dedup
from .common import table


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_packing": op2_packing, "op5_suffix_dedup": op5_suffix_dedup}
