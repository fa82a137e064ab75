"""Vectorised kernels over batches of rows. Each takes a matrix with NaN for missing answers and gives a vector.

A kernel is an Arrow function of the answers. Arrow functions over one column that are selected together run in one Python node, so a screen sends its
answers to Python once; matrices are made from the flat buffer of the lists, without Python lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import row_correlations

#: Cells of a matrix that kernels work on at a time.
CELLS = 1 << 22


def matrix(rows: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Lists of doubles as a matrix with NaN where a value is missing or a list has ended. width: else that of the longest list."""
    sizes = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False)  # a null list has no cells
    sizes = np.where(rows.is_null().to_numpy(zero_copy_only=False), 0, sizes) if rows.null_count else sizes
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.astype(float, copy=False).reshape(len(sizes), width)
    out = np.full((len(sizes), width), np.nan)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def matrices(rows: pa.ListArray, width: int | None) -> Iterator[np.ndarray]:
    """Consecutive rows of at most CELLS cells, or one row."""
    wide = width or int(np.diff(rows.offsets.to_numpy()).max(initial=1))
    step = max(1, CELLS // max(wide, 1))
    yield from (matrix(rows.slice(k, step), width) for k in range(0, len(rows), step))


def _run(body: Callable, rows: pa.ListArray, width: int | None, others: tuple[pa.Array, ...]) -> list[tuple[np.ndarray, ...]]:
    """What the body gives for consecutive rows, as tuples of vectors."""
    out, at = [], 0
    for m in matrices(rows, width) if len(rows) else ():
        given = [o.slice(at, len(m)).to_numpy(zero_copy_only=False).astype(float) for o in others]
        made = body(m, *given)
        out.append(made if isinstance(made, tuple) else (made,))
        at += len(m)
    return out


def _column(parts: list[np.ndarray]) -> pa.Array:
    out = np.concatenate([np.asarray(p, float) for p in parts]) if parts else np.zeros(0)
    return pa.array(out, mask=np.isnan(out))


def kernel(body: Callable[..., np.ndarray], x: Column, width: int | None = None, *others: Column) -> Column:
    """body over Arrow batches of x and of columns of numbers; NaN comes back as null. width: columns of the matrix, where places matter; else
    those of its longest row."""

    def run(rows, *more):
        return _column([p[0] for p in _run(body, rows, width, more)])

    if others:

        @F.arrow_udf("double")
        def two(rows: pa.Array, given: pa.Array) -> pa.Array:
            return run(rows, given)

        return two(x, *others)

    @F.arrow_udf("double")
    def one(rows: pa.Array) -> pa.Array:
        return run(rows)

    return one(x)


def kernels(body: Callable[..., tuple[np.ndarray, ...]], names: tuple[str, ...], x: Column, width: int | None = None) -> Column:
    """A struct of what one body gives."""

    @F.arrow_udf(", ".join(f"{k} double" for k in names))
    def many(rows: pa.Array) -> pa.Array:
        parts = _run(body, rows, width, ())
        return pa.StructArray.from_arrays([_column([p[k] for p in parts]) for k in range(len(names))], list(names))

    return many(x)


def mean_signs(row: Column, n: int, key: int) -> Column:
    """Mean of n fair signs, from the bits that Philox gives for the key and the row."""

    @F.arrow_udf("double")
    def drawn(rows: pa.Array) -> pa.Array:
        out = np.empty(len(rows))
        for k, r in enumerate(rows.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)):
            words = np.random.Philox(key=np.array([key, r], np.uint64)).random_raw((n + 63) // 64)
            out[k] = 2 * np.unpackbits(words.view(np.uint8))[:n].mean() - 1
        return pa.array(out)

    return drawn(row)


def _packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The available answers of each row moved to its left, NaN after them, and their numbers."""
    gone = np.isnan(x)
    return np.take_along_axis(x, np.argsort(gone, axis=1, kind="stable"), axis=1), (~gone).sum(axis=1)


def _ahead(hit: np.ndarray) -> np.ndarray:
    """For each place of each row the number of hits in a row from there on."""
    size = hit.shape[1]
    place = np.arange(size)
    stop = np.minimum.accumulate(np.where(hit, size, place)[:, ::-1], axis=1)[:, ::-1]
    return stop - place


def longest_pattern(x: np.ndarray, longest: int) -> np.ndarray:
    v, m = _packed(x)
    out = np.zeros(len(v))
    if v.shape[1] < 4:
        return out
    same = _ahead(v[:, 1:] == v[:, :-1])  # equal neighbours ahead of each place
    for k in range(2, min(longest, v.shape[1] // 2) + 1):
        match = _ahead(v[:, k:] == v[:, :-k])
        varied = same[:, : match.shape[1]] < k - 1
        found = np.where(varied, match, 0).max(axis=1)
        out = np.where((found > 0) & (m >= 4) & (k <= m // 2), np.maximum(out, k + found), out)
    return out


def _bits(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row the sum of c log2 c over the counts of its different keys."""
    different, n = np.unique(np.stack([row, keys]), axis=1, return_counts=True)
    return np.bincount(different[0], n * np.log2(n), rows)


def transition_entropy(x: np.ndarray) -> np.ndarray:
    v, m = _packed(x)
    values, code = np.unique(v, return_inverse=True)
    code = code.reshape(v.shape).astype(np.int64)
    row, at = np.nonzero(~np.isnan(v[:, 1:]))
    start, end = code[row, at], code[row, at + 1]
    bits = _bits(start, row, len(v)) - _bits(start * len(values) + end, row, len(v))
    return np.where(m > 1, bits / np.maximum(m - 1, 1) + 0.0, np.nan)


def _ranks(v: np.ndarray) -> np.ndarray:
    """Dense ranks within each row from 1; 0 for NaN."""
    order = np.argsort(v, axis=1, kind="stable")
    ordered = np.take_along_axis(v, order, axis=1)
    step = np.ones(v.shape, np.int32)
    step[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    out = np.empty(v.shape, np.int32)
    np.put_along_axis(out, order, np.cumsum(step, axis=1, dtype=np.int32), axis=1)
    out[np.isnan(v)] = 0
    return out


def rising_pairs(v: np.ndarray) -> np.ndarray:
    """For each row the number of pairs of which the later value is greater; NaN takes no part.

    Sorted runs are merged two by two in all rows at once. Before a merge, the values of the right run are looked up in the left one, where the
    runs of all rows stand one after the other as one sorted vector.
    """
    packed, m = _packed(v)
    width = int(m.max(initial=0))
    rows, size = len(v), 1
    count = np.zeros(rows, np.int64)
    if width < 2:
        return count
    full = 1 << (width - 1).bit_length()
    keys = np.zeros((rows, full), np.int64)  # 0 stands after all values, and nothing is less
    keys[:, :width] = _ranks(packed[:, :width])
    while size < full:
        runs = keys.reshape(-1, 2, size)
        base = np.arange(len(runs), dtype=np.int64)[:, None] * (full + 2)
        left, right = (runs[:, 0] + base).ravel(), (runs[:, 1] + base).ravel()
        below = np.searchsorted(left, right, "left").reshape(len(runs), size) - np.arange(len(runs))[:, None] * size
        count += np.where(runs[:, 1] > 0, below, 0).reshape(rows, -1).sum(axis=1)
        keys = np.sort(keys.reshape(-1, 2 * size), axis=1, kind="stable").reshape(rows, full)
        size *= 2
    return count


def guttman_errors(x: np.ndarray, order: np.ndarray, na_rm: bool, normalize: bool) -> np.ndarray:
    a = x[:, order]
    errors = rising_pairs(a).astype(float)
    if not normalize:
        return errors
    m = (~np.isnan(a)).sum(axis=1) if na_rm else np.full(len(a), a.shape[1])
    pairs = m * (m - 1) / 2
    return np.where(pairs > 0, errors / np.maximum(pairs, 1), np.nan)


def split_half(x: np.ndarray, splits: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Mean correlation over the splits that give one, stepped up to full length."""
    total, used = np.zeros(len(x)), np.zeros(len(x))
    for a, b in splits:
        r = row_correlations(x[:, a], x[:, b], np.nan)
        ok = ~np.isnan(r)
        total += np.where(ok, r, 0)
        used += ok
    with np.errstate(invalid="ignore", divide="ignore"):
        r = total / used
        out = 2 * r / (1 + r)
    return np.where(np.isfinite(out), out, np.nan)


def onset_places(x: np.ndarray, window: int, least: int) -> np.ndarray:
    v, m = _packed(x)
    out = np.full(len(v), np.nan)
    for size in np.unique(m[m >= max(least, window)]):  # rows of as many answers together
        mine = np.nonzero(m == size)[0]
        w = int(size) - window + 1
        trim = max(1, w // 10)
        k = np.arange(trim, w - trim)
        if w < 3 or not len(k):
            continue
        s = np.lib.stride_tricks.sliding_window_view(v[mine, :size], window, axis=1)
        s = np.sqrt(((s - s.mean(axis=2, keepdims=True)) ** 2).mean(axis=2))
        p, q = np.cumsum(s, axis=1), np.cumsum(s * s, axis=1)
        variance = np.maximum(q[:, k - 1] - p[:, k - 1] ** 2 / k, 1e-10)
        stat = (p[:, k] - (k + 1) / w * p[:, -1:]) ** 2 / variance
        best = stat.argmax(axis=1)
        out[mine] = np.where(stat[np.arange(len(mine)), best] > 1.358, k[best] + window - 1, np.nan)
    return out


def even_odd(x: np.ndarray, factors: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean correlation over factors, and how many factors gave one."""
    total, used, at = np.zeros(len(x)), np.zeros(len(x)), 0
    for size in factors:
        part = x[:, at : at + size]
        at += size
        if size < 2:
            continue
        r = row_correlations(part[:, 0::2], part[:, 1::2], 0.0)
        total += np.where(np.isnan(r), 0, r)
        used += ~np.isnan(r)
    mean = np.where(used > 0, total / np.maximum(used, 1), 0.0)
    return (mean if max(factors) >= 2 else np.full(len(x), np.nan)), used


def pair_correlation(x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """0 where there is none."""
    r = row_correlations(x[:, pairs[:, 0]], x[:, pairs[:, 1]], 0.0)
    return np.where(np.isnan(r), 0.0, r)


def mahalanobis(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d), 0))  # rows with missing answers give NaN


def ability(y: np.ndarray, a: np.ndarray, b: np.ndarray, low: float = -4.0, high: float = 4.0) -> np.ndarray:
    """Maximum-likelihood ability of each row of 0, 1 and NaN, by Newton steps kept inside a shrinking bracket."""
    seen = ~np.isnan(y)
    n, right = seen.sum(axis=1), np.nansum(y, axis=1)
    share = np.clip(right / np.maximum(n, 1), 0.01, 0.99)
    t = np.log(share / (1 - share))
    lo, hi = np.full(len(y), low), np.full(len(y), high)
    live = (n > 0) & (right > 0) & (right < n)
    y0 = np.where(seen, y, 0.0)
    for _ in range(64):
        if not live.any():
            break
        p = 1 / (1 + np.exp(-np.clip(a * (t[:, None] - b), -700, 700)))
        slope = (np.where(seen, a * (y0 - p), 0)).sum(axis=1)
        bend = (np.where(seen, a * a * p * (1 - p), 0)).sum(axis=1)
        lo, hi = np.where(live & (slope > 0), t, lo), np.where(live & (slope <= 0), t, hi)
        step = np.where(bend > 0, slope / np.where(bend > 0, bend, 1), 0)
        new = t + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        done = (np.abs(slope) <= 1e-12) | (np.abs(new - t) <= 1e-12)
        t = np.where(live & (np.abs(slope) > 1e-12), new, t)
        live &= ~done
    t = np.where(right >= n, 3.0, np.where(right <= 0, -3.0, t))
    return np.where(n > 0, t, np.nan)


def person_fit(y: np.ndarray, a: np.ndarray, b: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Standardised log likelihood."""
    seen = ~np.isnan(y)
    with np.errstate(invalid="ignore"):
        p = np.clip(1 / (1 + np.exp(-np.clip(a * (theta[:, None] - b), -700, 700))), 1e-10, 1 - 1e-10)
    odds = np.log(p / (1 - p))
    fit = np.where(seen, np.where(y == 1, np.log(p), np.log(1 - p)), 0).sum(axis=1)
    expected = np.where(seen, p * np.log(p) + (1 - p) * np.log(1 - p), 0).sum(axis=1)
    variance = np.where(seen, p * (1 - p) * odds**2, 0).sum(axis=1)
    out = np.where(variance > 0, (fit - expected) / np.sqrt(np.where(variance > 0, variance, 1)), 0.0)
    return np.where(seen.any(axis=1), out, np.nan)
