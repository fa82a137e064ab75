"""The careless-responding indices as columns: each takes a frame (and its statistics) and gives one double per respondent.

Scores are null where unavailable. `scores(frame, name=column)` or frame.with_scores makes tables of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import ResponseFrame
from ..functions import exprs as E
from ..functions import numeric
from ..functions.order import percentiles, places
from . import kernels as K
from .stats import MatrixStats

X = "responses"
#: Ranks of equal values that are made from one row at a time.
RUN = 100_000


def _x() -> Column:
    return F.col(X)


def _stats(frame: ResponseFrame, stats: MatrixStats | None) -> MatrixStats:
    return stats or MatrixStats(frame)


# --- row-local ------------------------------------------------------------------------------------------------------


def irv(frame: ResponseFrame, na_rm: bool = True, split: bool = False, num_split: int = 1, split_points: Sequence[int] | None = None) -> Column:
    """Standard deviation of a respondent's answers; with split, the mean over consecutive parts of the items."""
    p = frame.n_items
    if split_points is not None:
        points = list(split_points)
        if len(points) < 2 or points[0] != 0 or points[-1] != p or any(a >= b for a, b in zip(points, points[1:], strict=False)):
            raise ValueError("split_points must ascend strictly from 0 to the number of items")
    if not split:
        return E.row_sd(_x(), na_rm, p)
    if split_points is None:
        if isinstance(num_split, bool) or num_split < 1:
            raise ValueError("num_split must be at least 1")
        points = np.cumsum([0, *(len(c) for c in np.array_split(np.arange(p), num_split))]).tolist()
    parts = [E.row_sd(F.slice(_x(), a + 1, b - a), na_rm, b - a) for a, b in zip(points, points[1:], strict=False) if b > a]
    out = parts[0]
    for c in parts[1:]:
        out = out + c
    return out / float(len(parts))


def longstring_text(text: Column, avg: bool = False) -> Column:
    """First longest run of one character, as struct(char, length); with avg, the average length of runs (0 for an empty text)."""
    run = E.longest_text_run(text)
    if avg:
        return F.when(text.isNotNull(), F.coalesce(F.length(text) / run["runs"].cast("double"), F.lit(0.0)))
    return F.when(run.isNotNull(), F.struct(run["char"].alias("char"), run["length"].alias("length")))


def longstring_scores(frame: ResponseFrame, na_rm: bool = True, stats: MatrixStats | None = None) -> Column:
    if not na_rm and _stats(frame, stats).any_missing:
        raise ValueError("there are missing answers and na_rm is false")
    return E.longest_run(_x())


def longstring_pattern(frame: ResponseFrame, max_pattern_length: int = 5, na_rm: bool = True, stats: MatrixStats | None = None) -> Column:
    """Longest stretch that repeats a pattern of two or more answers."""
    frame.need(2, "longstring_pattern")
    if isinstance(max_pattern_length, bool) or max_pattern_length < 2:
        raise ValueError("max_pattern_length must be at least 2")
    if not na_rm and _stats(frame, stats).any_missing:
        raise ValueError("there are missing answers and na_rm is false")
    return K.kernel(lambda x: K.longest_pattern(x, max_pattern_length), _x())


def markov(frame: ResponseFrame, na_rm: bool = True) -> Column:
    """Entropy, in bits, of the next answer given the present one."""
    frame.need(3, "markov")
    out = K.kernel(K.transition_entropy, _x())
    return out if na_rm else F.when(E.whole(_x(), frame.n_items), out)


def missing_rate(frame: ResponseFrame, item_indices: Sequence[int] | None = None, applicable: bool = False) -> Column:
    """Share of missing answers, with applicable only among the items that the frame's mask says apply."""
    items = range(frame.n_items) if item_indices is None else frame.check_items(item_indices, "missing_rate")
    if not applicable and item_indices is None:
        return (F.lit(frame.n_items) - F.size(E.compact(_x()))) / float(frame.n_items)
    if not applicable:
        return F.size(F.filter(F.array(*[F.get(_x(), F.lit(i)) for i in items]), lambda v: v.isNull())) / float(len(list(items)))
    cells = F.array(*[F.struct(F.get(_x(), F.lit(i)).alias("v"), F.coalesce(F.get("applicable", F.lit(i)), F.lit(False)).alias("k")) for i in items])
    asked = F.filter(cells, lambda c: c["k"])
    return E.let(asked, lambda c: F.try_divide(F.size(F.filter(c, lambda y: y["v"].isNull())).cast("double"), F.size(c).cast("double")))


def _bounds(frame: ResponseFrame, stats: MatrixStats | None, lo: float | None, hi: float | None) -> tuple[float, float] | None:
    if lo is not None and hi is not None:
        if hi < lo:
            raise ValueError("scale_max must not be below scale_min")
        return float(lo), float(hi)
    return _stats(frame, stats).scale(lo, hi)


def u3_poly(frame: ResponseFrame, scale_min: float | None = None, scale_max: float | None = None, stats: MatrixStats | None = None) -> Column:
    """Share of answers at either end of the scale."""
    b = _bounds(frame, stats, scale_min, scale_max)
    return E.none() if b is None else E.share(_x(), lambda v: (v == b[0]) | (v == b[1]))


def midpoint_responding(frame: ResponseFrame, scale_min=None, scale_max=None, tolerance: float = 0.0, stats: MatrixStats | None = None) -> Column:
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    b = _bounds(frame, stats, scale_min, scale_max)
    return E.none() if b is None else E.share(_x(), lambda v: F.abs(v - (b[0] + b[1]) / 2) <= tolerance)


def response_pattern(frame: ResponseFrame, scale_min=None, scale_max=None, stats: MatrixStats | None = None) -> dict[str, Column]:
    b = _bounds(frame, stats, scale_min, scale_max)
    extreme, middle = (E.none(), E.none()) if b is None else (u3_poly(frame, *b), E.share(_x(), lambda v: v == (b[0] + b[1]) / 2))
    return {"extreme": extreme, "midpoint": middle, "acquiescence": E.row_mean(_x()), "variability": E.row_sd(_x())}


def acquiescence(frame: ResponseFrame, scale_min=None, scale_max=None, positive_items=None, negative_items=None, na_rm: bool = True, stats: MatrixStats | None = None) -> Column:
    """Mean answer on a scale from 0 to 1; over balanced pairs if positive and negative items are given."""
    if (positive_items is None) != (negative_items is None):
        raise ValueError("positive_items and negative_items go together")
    b = _bounds(frame, stats, scale_min, scale_max)
    if b is None:
        return E.none()
    lo, hi = b
    if hi == lo:
        return F.lit(0.5)
    if positive_items is not None:
        good, bad = frame.check_items(positive_items, "acquiescence"), frame.check_items(negative_items, "acquiescence")
        mean = E.let(E.pair_values(_x(), zip(good, bad, strict=False), lambda p, n: (p + (hi + lo - n)) / 2.0), E.mean_of)
    else:
        mean = E.row_mean(_x())
        if not na_rm:
            mean = F.when(E.whole(_x(), frame.n_items), mean)
    part = (mean - lo) / (hi - lo)
    return F.when(part.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)))


def infrequency(frame: ResponseFrame, item_indices: Sequence[int], expected_responses: Sequence[float], proportion: bool = False, missing: str = "pass") -> Column:
    """Number or share of attention checks that were failed. missing: pass, fail, omit or propagate."""
    items = frame.check_items(item_indices, "infrequency")
    if len(items) != len(list(expected_responses)):
        raise ValueError("each checked item needs one expected response")
    if missing not in ("pass", "fail", "omit", "propagate"):
        raise ValueError("missing must be pass, fail, omit or propagate")
    cells = [F.get(_x(), F.lit(i)) for i in items]
    gap = 1.0 if missing == "fail" else 0.0
    failed = sum((F.when(c.isNull(), gap).when(c != float(e), 1.0).otherwise(0.0) for c, e in zip(cells, expected_responses, strict=True)), F.lit(0.0))
    there = sum((F.when(c.isNull(), 0.0).otherwise(1.0) for c in cells), F.lit(0.0))
    base = there if missing == "omit" else F.lit(float(len(items)))
    out = failed / base if proportion and missing != "omit" else F.try_divide(failed, base) if proportion else failed
    if missing == "omit":
        return F.when(there > 0, out)
    return F.when(there == len(items), out) if missing == "propagate" else out


def mad(frame: ResponseFrame, positive_items=None, negative_items=None, item_pairs=None, scale_max=None, na_rm: bool = True, *, scale_min=None, stats: MatrixStats | None = None) -> Column:
    """Mean absolute difference between items and their reflected opposites."""
    if (item_pairs is None) == (positive_items is None or negative_items is None):
        raise ValueError("give either item_pairs or both lists of items")
    if item_pairs is None:
        pairs = list(zip(frame.check_items(positive_items, "mad"), frame.check_items(negative_items, "mad"), strict=False))
    else:
        pairs = [tuple(frame.check_items(p, "mad")) for p in item_pairs]
    b = _bounds(frame, stats, scale_min, scale_max)
    if b is None:
        return E.none()
    gaps = E.pair_values(_x(), pairs, lambda p, n: F.abs(p - ((b[0] + b[1]) - n)))
    out = E.let(gaps, E.mean_of)
    return out if na_rm else F.when(F.size(gaps) == len(pairs), out)


def semantic(frame: ResponseFrame, item_pairs, opposite: bool = False, scale_min=None, scale_max=None, stats: MatrixStats | None = None) -> Column:
    """Agreement within pairs of items alike (or, reflected, opposite) in meaning, against the row's spread; from -1 to 1."""
    frame.need(2, "semantic")
    pairs = [tuple(frame.check_items(p, "semantic")) for p in item_pairs]
    if not pairs or any(len(p) != 2 for p in pairs):
        raise ValueError("item_pairs must be pairs of different items")
    both = 0.0
    if opposite:
        b = _bounds(frame, stats, scale_min, scale_max)
        if b is None:
            return E.none()
        both = b[0] + b[1]
    gap = E.let(E.pair_values(_x(), pairs, lambda p, q: F.abs(p - ((both - q) if opposite else q))), E.mean_of)

    def against(s: Column) -> Column:
        raw = F.when(s > 0, 1.0 - F.try_divide(gap, s)).otherwise(F.when(gap <= 1e-8, 1.0).otherwise(-1.0))
        return F.when(gap.isNotNull() & s.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))

    return E.let(E.row_sd(_x()), against)


def semantic_syn(frame: ResponseFrame, item_pairs, anto: bool = False, **scale) -> Column:
    return semantic(frame, item_pairs, anto, **scale)


def semantic_ant(frame: ResponseFrame, item_pairs, **scale) -> Column:
    return semantic(frame, item_pairs, True, **scale)


def evenodd(frame: ResponseFrame, factors: Sequence[int], diag: bool = False):
    """Mean over factors of the correlation between even and odd items; with diag also how many factors gave one."""
    sizes = list(factors)
    if not sizes or any(isinstance(f, bool) or f < 1 for f in sizes) or sum(sizes) != frame.n_items:
        raise ValueError("factors must be positive and add up to the number of items")
    if not diag:
        return K.kernel(lambda x: K.even_odd(x, sizes)[0], _x(), frame.n_items)
    both = K.kernels(lambda x: K.even_odd(x, sizes), ("score", "used"), _x(), frame.n_items)
    return both["score"], both["used"]


def onset(frame: ResponseFrame, window_size: int = 10, min_items: int = 20, na_rm: bool = True, stats: MatrixStats | None = None) -> Column:
    """Place (among the answered items) from which on the answers vary differently; null if there is none."""
    if window_size < 2 or min_items < window_size:
        raise ValueError("window_size must be at least 2 and min_items at least window_size")
    if not na_rm and _stats(frame, stats).any_missing:
        raise ValueError("there are missing answers and na_rm is false")
    return K.kernel(lambda x: K.onset_places(x, window_size, min_items), _x())


def individual_reliability(frame: ResponseFrame, n_splits: int = 100, random_seed: int | None = None) -> Column:
    """Split-half correlation over random splits of the items, stepped up to full length."""
    frame.need(4, "individual_reliability")
    if isinstance(n_splits, bool) or n_splits < 1:
        raise ValueError("n_splits must be at least 1")
    rng, half = np.random.RandomState(random_seed), frame.n_items // 2
    orders = [rng.permutation(frame.n_items) for _ in range(n_splits)]
    return K.kernel(lambda x: K.split_half(x, [(o[:half], o[half : 2 * half]) for o in orders]), _x(), frame.n_items)


def calculate_correlations(x: Column, y: Column) -> Column:
    """Pearson correlation of two arrays, over the places where both have a value, up to the shorter one's end. 0 where either is
    constant; null for fewer than two such places."""

    def of(pairs: Column) -> Column:
        mean = lambda k: E.mean_of(F.transform(pairs, lambda p: p[k]))
        dot = lambda j, mj, k, mk: E.total(F.transform(pairs, lambda p: (p[j] - mj) * (p[k] - mk)))

        def centred(m: Column) -> Column:
            below = F.sqrt(dot("a", m["a"], "a", m["a"]) * dot("b", m["b"], "b", m["b"]))
            r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot("a", m["a"], "b", m["b"]), below)))
            return F.when(F.size(pairs) > 1, F.when(below > 0, r).otherwise(0.0))

        return E.let(F.struct(mean("a").alias("a"), mean("b").alias("b")), centred)

    both = F.zip_with(x, y, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    return E.let(F.filter(both, lambda p: p["a"].isNotNull() & p["b"].isNotNull()), of)


def compute_person_correlations(x: Column, y: Column) -> Column:
    """Products of the z-scores (population standard deviation) of two arrays, place by place; 0 for all places if either is constant, null
    where either is missing."""

    def z(v: Column) -> Column:
        there = E.compact(v)
        return E.let(F.struct(E.mean_of(there).alias("m"), E.sd_of(there).alias("s")), lambda f: F.transform(v, lambda a: F.when(f["s"] > 0, F.try_divide(a - f["m"], f["s"])).when(a.isNotNull(), 0.0)))

    return F.zip_with(z(x), z(y), lambda a, b: a * b)


# --- with statistics of the whole table -----------------------------------------------------------------------------


def person_total(frame: ResponseFrame, na_rm: bool = True, stats: MatrixStats | None = None) -> Column:
    """Correlation of a respondent's answers with the item means."""
    frame.need(2, "person_total")
    s = _stats(frame, stats)
    if not na_rm and s.any_missing:
        return E.none()
    means = s.means
    return K.kernel(lambda x: numeric.row_correlations(x, np.broadcast_to(means, x.shape), np.nan), _x(), frame.n_items)


def _pairwise(frame: ResponseFrame, critval: float, opposite: bool, stats: MatrixStats | None, diag: bool, resample_na: bool, seed: int | None):
    frame.need(2, "psychsyn")
    if (critval > 0) if opposite else (critval < 0):
        raise ValueError("the critical value has the wrong sign")
    s = _stats(frame, stats)
    pairs = s.pairs(critval, opposite)
    n = len(pairs)
    if not n:
        return (E.none(), F.lit(0)) if diag else E.none()
    used = np.unique(pairs)
    there = F.lit(True)
    score = K.kernel(lambda x: K.pair_correlation(x, pairs), _x(), frame.n_items)
    if not s.complete[used].all():  # only pairs of correlation 0 can have missing answers
        there = F.forall(F.array(*[F.get(_x(), F.lit(int(i))) for i in used]), lambda v: v.isNotNull())
        score = F.when(there, score)
        if resample_na:
            mean = abs(frame.df.select(score.alias("s")).agg(F.avg("s")).first()[0] or 0.0)
            key = int(np.random.SeedSequence(seed).generate_state(1, np.uint64)[0])  # a new one without a seed
            score = F.coalesce(score, K.mean_signs(F.col("ord"), n, key) * mean)
        score = F.coalesce(score, F.lit(0.0))
    return (score, F.when(there | resample_na, n).otherwise(0)) if diag else score


def psychsyn(frame: ResponseFrame, critval: float = 0.6, anto: bool = False, diag: bool = False, resample_na: bool = False, random_seed: int | None = None, stats: MatrixStats | None = None):
    """Correlation, over strongly correlated pairs of items, of a respondent's answers; 0 where one of them is missing.

    resample_na: instead the mean size of the others' scores, times the mean of one fair sign a pair. The signs come from Philox keyed by the
    seed and the row's order, so partitions don't matter. diag: the number of pairs as well, 0 where answers are missing and not resampled.
    """
    return _pairwise(frame, critval, anto, stats, diag, resample_na, random_seed)


def psychant(frame: ResponseFrame, critval: float = -0.6, diag: bool = False, resample_na: bool = False, random_seed: int | None = None, stats: MatrixStats | None = None):
    return _pairwise(frame, critval, True, stats, diag, resample_na, random_seed)


def psychsyn_critval(frame: ResponseFrame, anto: bool = False, min_correlation: float = 0.0, stats: MatrixStats | None = None) -> DataFrame:
    """Item pairs by falling (anto: rising) correlation: item_a > item_b, correlation."""
    r = _stats(frame, stats).correlations
    i, j = np.tril_indices(len(r), -1)
    rows = [(int(a), int(b), float(r[a, b])) for a, b in zip(i, j, strict=True) if (r[a, b] <= -abs(min_correlation) if anto else r[a, b] >= min_correlation)]
    df = frame.df.sparkSession.createDataFrame(rows, "item_a int, item_b int, correlation double")
    return df.orderBy(F.col("correlation").asc() if anto else F.col("correlation").desc(), "item_a", "item_b")


def guttman(frame: ResponseFrame, na_rm: bool = True, normalize: bool = True, stats: MatrixStats | None = None) -> Column:
    """Pairs of items answered against the order of the item means."""
    frame.need(2, "guttman")
    order = np.argsort(_stats(frame, stats).means)
    return K.kernel(lambda x: K.guttman_errors(x, order, na_rm, normalize), _x(), frame.n_items)


def mahad(frame: ResponseFrame, na_rm: bool = False, stats: MatrixStats | None = None) -> Column:
    """Mahalanobis distance from the mean of the complete rows; null for other rows."""
    s = _stats(frame, stats)
    if s.any_missing and not na_rm:
        raise ValueError("there are missing answers and na_rm is false")
    n, mean, cov = s.covariance
    if n == 0:
        raise ValueError("no row is complete")
    if n < frame.n_items:
        raise ValueError("there are fewer complete rows than items")
    inverse = numeric.pseudo_inverse(cov)
    return K.kernel(lambda x: K.mahalanobis(x, mean, inverse), _x(), frame.n_items)


def mahad_flag(scores: DataFrame, n_items: int, confidence: float = 0.95, method: str = "chi2", score: str = "score", flag: str = "flag") -> DataFrame:
    """scores with a flag: beyond the chi-square quantile, 1.5 interquartile ranges, or the normal quantile of z."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    c = F.col(score)
    if method == "chi2":
        return scores.withColumn(flag, E.flag(c, float(np.sqrt(numeric.chi_square_quantile(confidence, n_items)))))
    if method == "iqr":
        q1, q3 = percentiles_of(scores, score, [0.25, 0.75])
        if q1 is None:
            return scores.withColumn(flag, F.lit(False))
        reach = 1.5 * (q3 - q1)
        return scores.withColumn(flag, E.flag(c, q3 + reach) | E.flag(c, q1 - reach, "low"))
    if method == "zscore":
        mean, sd = scores.agg(F.avg(c), F.stddev_pop(c)).first()
        if not sd:
            return scores.withColumn(flag, F.lit(False))
        z = numeric.normal_quantile(1 - (1 - confidence) / 2)
        return scores.withColumn(flag, F.coalesce(F.abs((c - mean) / sd) > z, F.lit(False)))
    raise ValueError("method must be chi2, iqr or zscore")


def mahad_qqplot(scores: DataFrame, n_items: int, score: str = "score") -> DataFrame:
    """rank, observed (squared distance) and expected (chi-square quantile). Equal distances take the ranks of their run."""
    df = scores.filter(F.col(score).isNotNull()).select((F.col(score) * F.col(score)).alias("observed"))
    n = df.count()
    @F.pandas_udf("double")
    def expected(rank):
        import pandas as pd

        return pd.Series([numeric.chi_square_quantile((k - 0.5) / n, n_items) for k in rank])

    starts = F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(RUN).cast("long"))  # long runs of ties in blocks, so that no array grows with them
    blocks = places(df, "observed").withColumn("at", F.explode(starts))
    last = F.col("before") + F.least(F.col("count"), F.col("at") + RUN)
    ranked = blocks.select(F.explode(F.sequence(F.col("before") + F.col("at") + 1, last)).alias("rank"), "observed")
    return ranked.select("rank", "observed", expected("rank").alias("expected"))


def lz(frame: ResponseFrame, difficulty=None, discrimination=None, theta=None, model: str = "2pl", na_rm: bool = True, stats: MatrixStats | None = None) -> Column:
    """Standardised log likelihood of the answers, split at the middle of the scale, under a logistic item-response model.

    theta: an array or a column name; else estimated for each respondent.
    """
    if model not in ("1pl", "2pl"):
        raise ValueError("model must be 1pl or 2pl")
    s = _stats(frame, stats)
    if not na_rm and s.any_missing:
        raise ValueError("there are missing answers and na_rm is false")
    a, b, cut = s.item_response
    a = np.ones(frame.n_items) if model == "1pl" else a
    a = a if discrimination is None else np.asarray(discrimination, float)
    b = b if difficulty is None else np.asarray(difficulty, float)
    if len(a) != frame.n_items or len(b) != frame.n_items:
        raise ValueError("there must be one parameter for each item")

    def split(x: np.ndarray) -> np.ndarray:
        return x if cut is None else np.where(np.isnan(x), np.nan, x > cut)

    if theta is None:
        return K.kernel(lambda x: K.person_fit(y := split(x), a, b, K.ability(y, a, b)), _x(), frame.n_items)
    return K.kernel(lambda x, t: K.person_fit(split(x), a, b, t), _x(), frame.n_items, F.col(theta))


def percentiles_of(scores: DataFrame, score: str, shares: Sequence[float]) -> list[float | None]:
    """Exact percentiles of one column, which is held meanwhile."""
    held = scores.select(F.col(score).cast("double").alias("score")).persist()
    try:
        return percentiles(held, {"score": (F.col("score"), shares)})[0]["score"]
    finally:
        held.unpersist()


def summary(scores: DataFrame, score: str = "score", suffix: str = "") -> DataFrame:
    """mean, std, min, max and median of the available scores, with counts: one row."""
    held = scores.select(F.col(score).cast("double").alias("score")).persist()
    c = F.col("score")
    also = [F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(F.lit(1)).alias("n_total"), F.count(c).alias("n_valid")]
    try:
        found, seen = percentiles(held, {"score": (c, [0.5])}, also)
    finally:
        held.unpersist()
    values = {k + suffix: seen[k] for k in ("mean", "std", "min", "max")} | {"median" + suffix: found["score"][0]} | {k: seen[k] for k in ("n_total", "n_valid")}
    kinds = ", ".join(f"`{k}` {'bigint' if k.startswith('n_') else 'double'}" for k in values)
    return scores.sparkSession.createDataFrame([tuple(values.values())], kinds)
