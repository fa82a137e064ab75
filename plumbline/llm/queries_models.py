"""Queries op4 and op10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_model, toxicity
from .common import table


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = _remainder(5) == 0
    df = quality_model.classify(docs.select("doc_id", "text"), labels, ~held_out)
    return df.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = _remainder(4) == 2
    df = toxicity.classify(docs.select("doc_id", "text"), labels, ~held_out)
    return df.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op4_quality_model": op4_quality_model, "op10_toxicity": op10_toxicity}
