"""The registered indices, their options, and the projection that scores several of them at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from ..frame import ResponseFrame
from ..operators import indices as I
from ..operators.stats import MatrixStats


@dataclass(frozen=True)
class IndexOptions:
    """Options that registered indices share. missing_applicable_mask: use the frame's applicable column."""

    na_rm: bool = True
    psychsyn_critval: float = 0.6
    psychant_critval: float = -0.6
    evenodd_factors: Sequence[int] | None = None
    mad_positive_items: Sequence[int] | None = None
    mad_negative_items: Sequence[int] | None = None
    mad_scale_min: float | None = None
    mad_scale_max: float | None = None
    scale_min: float | None = None
    scale_max: float | None = None
    acquiescence_positive_items: Sequence[int] | None = None
    acquiescence_negative_items: Sequence[int] | None = None
    longstring_max_pattern_length: int = 5
    midpoint_tolerance: float = 0.0
    guttman_normalize: bool = True
    onset_window_size: int = 10
    onset_min_items: int = 20
    reliability_n_splits: int = 100
    reliability_random_seed: int | None = None
    semantic_item_pairs: Sequence[tuple[int, int]] | None = None
    infrequency_item_indices: Sequence[int] | None = None
    infrequency_expected_responses: Sequence[float] | None = None
    infrequency_proportion: bool = False
    infrequency_missing: str = "pass"
    missing_item_indices: Sequence[int] | None = None
    missing_applicable_mask: bool = False


@dataclass(frozen=True)
class IndexSpec:
    """high or low: which end is suspicious; presence: any value is. sign: how the index enters a composite, 0 if it can't."""

    name: str
    score: Callable[[ResponseFrame, IndexOptions, MatrixStats], Column]
    direction: str
    screened: bool = False
    combined: bool = False
    sign: int = 0
    mode: str = "percentile"
    required: tuple[str, ...] = ()


def _scale(o: IndexOptions) -> dict:
    return {"scale_min": o.scale_min, "scale_max": o.scale_max}


_SPECS = (
    IndexSpec("irv", lambda f, o, s: I.irv(f, o.na_rm), "low", True, True, -1),
    IndexSpec("longstring", lambda f, o, s: I.longstring_scores(f, o.na_rm, s), "high", True, True, 1),
    IndexSpec("longstring_pattern", lambda f, o, s: I.longstring_pattern(f, o.longstring_max_pattern_length, o.na_rm, s), "high", True, False, 1),
    IndexSpec("mahad", lambda f, o, s: I.mahad(f, o.na_rm, s), "high", True, True, 1),
    IndexSpec("psychsyn", lambda f, o, s: I.psychsyn(f, o.psychsyn_critval, stats=s), "low", True, True, -1),
    IndexSpec("psychant", lambda f, o, s: I.psychant(f, o.psychant_critval, stats=s), "low", False, False, -1),
    IndexSpec("person_total", lambda f, o, s: I.person_total(f, o.na_rm, s), "low", True, True, -1),
    IndexSpec("markov", lambda f, o, s: I.markov(f, o.na_rm), "low", True, False, -1),
    IndexSpec("missing_rate", lambda f, o, s: I.missing_rate(f, o.missing_item_indices, o.missing_applicable_mask), "high", False, False, 1),
    IndexSpec("u3_poly", lambda f, o, s: I.u3_poly(f, **_scale(o), stats=s), "high", True),
    IndexSpec("midpoint", lambda f, o, s: I.midpoint_responding(f, **_scale(o), tolerance=o.midpoint_tolerance, stats=s), "high", True),
    IndexSpec(
        "acquiescence",
        lambda f, o, s: I.acquiescence(f, **_scale(o), positive_items=o.acquiescence_positive_items, negative_items=o.acquiescence_negative_items, na_rm=o.na_rm, stats=s),
        "high", True,
    ),
    IndexSpec("guttman", lambda f, o, s: I.guttman(f, o.na_rm, o.guttman_normalize, s), "high", True, False, 1),
    IndexSpec("individual_reliability", lambda f, o, s: I.individual_reliability(f, o.reliability_n_splits, o.reliability_random_seed), "low", False, False, -1),
    IndexSpec("onset", lambda f, o, s: I.onset(f, o.onset_window_size, o.onset_min_items, o.na_rm, s), "high", mode="presence"),
    IndexSpec("evenodd", lambda f, o, s: I.evenodd(f, o.evenodd_factors), "low", False, False, -1, required=("evenodd_factors",)),
    IndexSpec(
        "mad",
        lambda f, o, s: I.mad(f, o.mad_positive_items, o.mad_negative_items, scale_min=o.mad_scale_min, scale_max=o.mad_scale_max, na_rm=o.na_rm, stats=s),
        "high", False, False, 1, required=("mad_positive_items", "mad_negative_items"),
    ),
    IndexSpec("lz", lambda f, o, s: I.lz(f, na_rm=o.na_rm, stats=s), "low", False, False, -1),
    IndexSpec("semantic_syn", lambda f, o, s: I.semantic(f, o.semantic_item_pairs, False, **_scale(o), stats=s), "low", False, False, -1, required=("semantic_item_pairs",)),
    IndexSpec("semantic_ant", lambda f, o, s: I.semantic(f, o.semantic_item_pairs, True, **_scale(o), stats=s), "low", False, False, -1, required=("semantic_item_pairs",)),
    IndexSpec(
        "infrequency",
        lambda f, o, s: I.infrequency(f, o.infrequency_item_indices, o.infrequency_expected_responses, o.infrequency_proportion, o.infrequency_missing),
        "high", False, False, 1, required=("infrequency_item_indices", "infrequency_expected_responses"),
    ),
)
INDICES: dict[str, IndexSpec] = {s.name: s for s in _SPECS}


def default_screen_indices() -> list[str]:
    return [s.name for s in _SPECS if s.screened]


def default_composite_indices() -> list[str]:
    return [s.name for s in _SPECS if s.combined]


def composite_index_names() -> list[str]:
    return [s.name for s in _SPECS if s.sign]


def index_catalog(spark: SparkSession | None = None):
    """What is registered: a dict, or with a session a table."""
    rows = {
        s.name: {
            "direction": s.direction, "flag_mode": s.mode, "screen_default": s.screened, "composite_default": s.combined,
            "composite_allowed": bool(s.sign), "composite_multiplier": s.sign or None, "required_options": list(s.required),
        }
        for s in _SPECS
    }
    if spark is None:
        return rows
    schema = "index string, direction string, flag_mode string, screen_default boolean, composite_default boolean, composite_allowed boolean, composite_multiplier int, required_options array<string>"
    return spark.createDataFrame([(k, *v.values()) for k, v in rows.items()], schema)


def validate_index_names(names: Sequence[str], allowed: Sequence[str]) -> list[str]:
    out = list(names)
    if not out:
        raise ValueError("no index was selected")
    unknown = sorted(set(out) - set(allowed))
    if unknown:
        raise ValueError(f"unknown or unsuitable indices: {', '.join(unknown)}")
    if len(set(out)) != len(out):
        raise ValueError("an index was selected twice")
    return out


def validate_count(value, name: str, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}")
    return value


def validate_min_valid(value: int | None, selected: int) -> int | None:
    if value is not None and validate_count(value, "min_valid_indices") > selected:
        raise ValueError("min_valid_indices is more than the number of selected indices")
    return value


def score_columns(frame: ResponseFrame, names: Sequence[str], options: IndexOptions | None = None, strict: bool = False, workers: int = 1) -> tuple[dict[str, Column], dict[str, str]]:
    """A column for each index that can be scored, in order, and the errors of the others.

    What can fail depends on the options and on whole-table statistics only, so it fails here, not in executors. workers is
    checked and otherwise left to Spark: one projection scores all indices.
    """
    validate_count(workers, "workers")
    options, stats = options or IndexOptions(), MatrixStats(frame)
    columns: dict[str, Column] = {}
    errors: dict[str, str] = {}
    for name in names:
        spec = INDICES[name]
        try:
            absent = [r for r in spec.required if getattr(options, r) is None]
            if absent:
                raise ValueError(f"{name} needs {' and '.join(absent)}")
            columns[name] = spec.score(frame, options, stats)
        except (ValueError, RuntimeError, TypeError) as e:
            if strict:
                raise ValueError(f"index '{name}' failed: {e}") from e
            errors[name] = str(e)
    return columns, errors


def score_table(frame: ResponseFrame, columns: dict[str, Column]) -> DataFrame:
    """respondent_id, ord and score__<index>, with scores that aren't finite made null."""
    from pyspark.sql import functions as F

    finite = lambda c: F.when(F.abs(c) < float("inf"), c.cast("double"))
    return frame.with_scores(**{f"score__{k}": finite(c) for k, c in columns.items()})
