"""Native expressions over arrays of doubles in which null is a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def none() -> Column:
    return F.lit(None).cast("double")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compact(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull())


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, b: a + b)


def mean_of(v: Column) -> Column:
    """Mean of an array without nulls; null if it is empty."""
    return F.try_divide(total(v), F.size(v).cast("double"))


def sd_of(v: Column) -> Column:
    """Population standard deviation of an array without nulls, in two passes."""
    return let(mean_of(v), lambda m: F.sqrt(mean_of(F.transform(v, lambda a: (a - m) * (a - m)))))


def row_mean(x: Column) -> Column:
    return let(compact(x), mean_of)


def whole(x: Column, size: int) -> Column:
    """Whether all of `size` values are there; a row may end early."""
    return F.size(compact(x)) == size


def row_sd(x: Column, na_rm: bool = True, size: int | None = None) -> Column:
    """na_rm: else any missing one of `size` values makes it unavailable."""
    out = let(compact(x), sd_of)
    return out if na_rm else F.when(whole(x, size), out)


def row_median(x: Column) -> Column:
    def middle(v: Column) -> Column:
        n = F.size(v)
        low, high = F.get(v, F.floor((n - 1) / 2).cast("int")), F.get(v, F.floor(n / 2).cast("int"))
        return (low + high) / 2.0

    return let(F.array_sort(compact(x)), middle)


def row_min(x: Column) -> Column:
    return F.array_min(compact(x))


def share(x: Column, test) -> Column:
    """Share of the available values for which test holds; null if there is none."""
    return let(compact(x), lambda v: F.try_divide(F.size(F.filter(v, test)).cast("double"), F.size(v).cast("double")))


def longest_run(x: Column) -> Column:
    """Length of the longest run of equal values after missing ones are left out; 0 for none."""
    state = lambda p, c, b: F.struct(p.alias("p"), c.alias("c"), b.alias("b"))

    def step(s: Column, v: Column) -> Column:
        c = F.when(s["p"] == v, s["c"] + 1).otherwise(F.lit(1))
        return state(v, c, F.greatest(s["b"], c))

    return F.aggregate(compact(x), state(none(), F.lit(0), F.lit(0)), step, lambda s: s["b"].cast("double"))


def pair_values(x: Column, pairs, body) -> Column:
    """body(a, b) for pairs of items of which both are available."""
    cells = [F.struct(F.get(x, F.lit(int(i))).alias("a"), F.get(x, F.lit(int(j))).alias("b")) for i, j in pairs]
    there = F.filter(F.array(*cells), lambda c: c["a"].isNotNull() & c["b"].isNotNull())
    return F.transform(there, lambda c: body(c["a"], c["b"]))


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def flag(score: Column, cutoff, direction: str = "high", inclusive: bool = False) -> Column:
    """Unavailable scores are never flagged."""
    cutoff = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    tests = {("high", True): score >= cutoff, ("high", False): score > cutoff, ("low", True): score <= cutoff, ("low", False): score < cutoff}
    if (direction, inclusive) not in tests:
        raise ValueError("direction must be 'low' or 'high'")
    return F.coalesce(tests[direction, inclusive], F.lit(False))


def longest_text_run(text: Column) -> Column:
    """struct(char, length, runs, size) of a text's first longest run of one character; null for an empty text."""
    state = lambda p, c, b, k, n: F.struct(p.alias("p"), c.alias("c"), b.alias("b"), k.alias("k"), n.alias("n"))

    def step(s: Column, v: Column) -> Column:
        same = F.coalesce(s["p"] == v, F.lit(False))
        c = F.when(same, s["c"] + 1).otherwise(F.lit(1))
        more = c > s["b"]
        return state(v, c, F.when(more, c).otherwise(s["b"]), F.when(more, v).otherwise(s["k"]), s["n"] + F.when(same, 0).otherwise(1))

    start = state(F.lit(None).cast("string"), F.lit(0), F.lit(0), F.lit(None).cast("string"), F.lit(0))
    done = lambda s: F.struct(s["k"].alias("char"), s["b"].alias("length"), s["n"].alias("runs"))
    return F.when(F.length(text) > 0, F.aggregate(F.split(text, ""), start, step, done))
