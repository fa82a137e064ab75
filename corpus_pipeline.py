"""The corpus pipeline: quality rules, near-duplicates, repeated strings, benchmark decontamination, packing.

Each stage takes what the one before kept, as a stored table, and all but the last return the columns of documents. run() writes
every stage to the shared folder, so that a lost executor costs a stage at most.

Defined cases, stage by stage: quality rules reject a null, empty or short text; near-duplicates keep, of equal or near texts, the row of
the smallest doc_id (nulls last; of these the first as stored), and documents without a word are copies of each other; repeated strings leave a null text null
and never drop a row, even one whose whole text goes; decontamination keeps documents without words; packing gives them their closing
id. Columns beyond those of documents pass through all stages but the last, whatever their names; a missing n_chars stays
missing. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, packing, quality_rules, simhash, suffix_dedup
from plumbline.llm.common import materialise, table

#: Below the bytes of the shortest passages of 50 words of running text; op5_suffix_dedup keeps its own 400.
PASSAGE = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more (five-word shingles) stays: that of the smallest doc_id."""
    return simhash.deduplicate_similar(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes that occur twice are cut out of every document; n_chars follows the text."""
    df = suffix_dedup.remove_repeats(docs, length=PASSAGE)
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", pack),
]
#: Fingerprints, repeated byte strings and packing have no SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
