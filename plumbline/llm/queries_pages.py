"""Queries op3, op6 and op9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, simhash, warc
from .common import table


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_archives(spark, manifest, folder)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return df.withColumn("n_chars", F.length("text").cast("long"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "fingerprint", "component_id")


QUERIES = {"op3_warc": op3_warc, "op6_html_extraction": op6_html_extraction, "op9_simhash": op9_simhash}
#: Payload digests, sizes and which record a page revisits, told from the table itself.
SQL = {
    "op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to FROM m
"""
}
