"""Score archives: a folder with the scores as Parquet and a metadata file, checked when saved and when loaded.

Writing goes to a folder beside the target, which then takes the target's place.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import flag
from ..operators.flags import check_threshold
from ..plans.registry import INDICES, composite_index_names

VERSION = 1
METRICS = {"mean": "low", "median": "low", "min": "low", "sd": "low", "consistency": "low", "mixture": "high"}


@dataclass(frozen=True)
class Archive:
    """table: respondent_id, ord and score__<index>, or score and flag for response times."""

    table: DataFrame
    metadata: dict = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return self.metadata.get("index_names", [])

    @property
    def errors(self) -> dict[str, str]:
        return self.metadata.get("errors", {})


def _replace(spark: SparkSession, table: DataFrame, metadata: dict, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    table.write.parquet(f"{beside.toString()}/scores")
    spark.createDataFrame([(json.dumps(metadata, allow_nan=False),)], "value string").coalesce(1).write.text(f"{beside.toString()}/metadata")
    aside = None
    if files.exists(target):  # the old archive is there until the new one is in its place, and gives it its mode
        files.setPermission(beside, files.getFileStatus(target).getPermission())
        aside = jvm.org.apache.hadoop.fs.Path(f"{beside.toString()}.old")
        if not files.rename(target, aside):
            raise OSError(f"can't move the archive at {path}")
    if not files.rename(beside, target):
        if aside is not None:
            files.rename(aside, target)
        raise OSError(f"can't put the archive at {path}")
    if aside is not None:
        files.delete(aside, True)


def _load(spark: SparkSession, path: str, kind: str) -> Archive:
    metadata = json.loads("".join(r[0] for r in spark.read.text(f"{path}/metadata").collect()))
    if metadata.get("schema_version") != VERSION:
        raise ValueError("the archive has another schema version")
    if metadata.get("kind") != kind:
        raise ValueError(f"the archive isn't one of {kind}")
    return Archive(spark.read.parquet(f"{path}/scores"), metadata)


def _check_scores(table: DataFrame, columns: list[str]) -> int:
    bad = [F.sum((F.abs(F.col(c)) == float("inf")).cast("int")) for c in columns] + [F.sum(F.isnan(c).cast("int")) for c in columns]
    seen = table.agg(F.count(F.lit(1)), F.count_distinct("respondent_id"), F.count(F.when(F.trim("respondent_id") != "", 1)), *bad).first()
    if seen[0] == 0:
        raise ValueError("an archive needs at least one respondent")
    if seen[1] != seen[0] or seen[2] != seen[0]:
        raise ValueError("respondent ids must be unique and not blank")
    if any(seen[3:]):
        raise ValueError("scores must be finite, or null where unavailable")
    return seen[0]


def save_score_archive(table: DataFrame, path: str, result_type: str = "screen", errors: dict[str, str] | None = None) -> None:
    """Save every score__<index> column of a screen's or composite's table."""
    names = [c.removeprefix("score__") for c in table.columns if c.startswith("score__")]
    _check_names(names, result_type, errors or {})
    kept = table.select("respondent_id", "ord", *[f"score__{n}" for n in names])
    n = _check_scores(kept, [f"score__{n}" for n in names])
    metadata = {"schema_version": VERSION, "kind": "scores", "result_type": result_type, "n_respondents": n, "index_names": names, "errors": errors or {}}
    _replace(table.sparkSession, kept, metadata, path)


def _check_names(names: list[str], result_type: str, errors: dict[str, str]) -> None:
    if result_type not in ("screen", "composite"):
        raise ValueError("result_type must be screen or composite")
    allowed = list(INDICES) if result_type == "screen" else composite_index_names()
    if not names or len(set(names)) != len(names) or set(names) - set(allowed):
        raise ValueError("index names must be known, unique and at least one")
    if set(errors) & set(names) or set(errors) - set(allowed) or any(not isinstance(v, str) or not v for v in errors.values()):
        raise ValueError("errors must belong to known indices without scores and say something")


def load_score_archive(spark: SparkSession, path: str) -> Archive:
    found = _load(spark, path, "scores")
    _check_names(found.names, found.metadata["result_type"], found.errors)
    if set(found.table.columns) != {"respondent_id", "ord", *(f"score__{n}" for n in found.names)}:
        raise ValueError("the archive's columns aren't those of its metadata")
    if _check_scores(found.table, [f"score__{n}" for n in found.names]) != found.metadata["n_respondents"]:
        raise ValueError("the archive has another number of respondents than its metadata says")
    return found


def _check_times(table: DataFrame, metric: str, direction: str, threshold: float) -> int:
    if METRICS.get(metric) != direction:
        raise ValueError("metric and flag direction don't belong together")
    check_threshold(threshold)
    n = _check_scores(table, ["score"])
    off = [F.sum((F.col("flag") != flag(F.col("score"), threshold, direction, inclusive)).cast("int")) for inclusive in (True, False)]
    if all(table.agg(*off).first()):
        raise ValueError("the flags follow from neither an inclusive nor a strict cutoff")
    return n


def save_response_time_archive(table: DataFrame, path: str, metric: str, threshold: float, direction: str = "low") -> None:
    kept = table.select("respondent_id", "ord", "score", "flag")
    n = _check_times(kept, metric, direction, threshold)
    metadata = {"schema_version": VERSION, "kind": "response times", "metric": metric, "flag_direction": direction, "threshold": float(threshold), "n_respondents": n}
    _replace(table.sparkSession, kept, metadata, path)


def load_response_time_archive(spark: SparkSession, path: str) -> Archive:
    found = _load(spark, path, "response times")
    m = found.metadata
    if _check_times(found.table, m["metric"], m["flag_direction"], m["threshold"]) != m["n_respondents"]:
        raise ValueError("the archive has another number of respondents than its metadata says")
    return found
