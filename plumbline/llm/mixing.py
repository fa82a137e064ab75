"""Mixing sources to target weights by fitting subset sums.

A source's budget is its share of all words by weight, at most `most` times its own words; what it can't use is shared out among the others
by weight. It is filled with whole documents: as many whole passes over the source as fit, then some documents of each length. How many of
a length is told from the counts of documents by exact length: first the same share of every length, from the longest to the shortest, what
is left of a length passing to the next; then some short documents are put back, and a bounded knapsack over the lengths that are left
finds the sum nearest to what remains of the budget. Which documents of a length is told by a seeded hash: its BUCKETS upper bits are
counted, all documents of lower buckets are taken, and only those of the one bucket where the count ends are ranked.

No task holds a source: sizes are counted by (source, length, bucket) before anything is dealt, the fit of a source holds its different
lengths (at most the square root of twice its words), and documents meet their length's decision in a join whose other side has one row a
key, so that the adaptive skew join can split a length of any number of documents.

Defined cases: a null text has no words; a null source is a source, the last; documents without words take nothing and are never chosen;
sources without words have target 0; equal rows are interchangeable; ids may be null or repeated. Further columns, whatever their
names, are left out; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, materialise, words

#: Parts of the hash by which documents of one length are counted.
BUCKETS = 1024
#: Words' worth of chosen short documents that the knapsack may choose anew.
ROOM = 4096


def sizes(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", seed: int = 42) -> DataFrame:
    """A stored table of doc_id, source, size (words), draw (the seeded hash, 0 or more)."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{ident}`"), F.col(f"`{text}`")), 1)
    return materialise(docs.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"), hashed.alias("draw")), "mixing-sizes")


def targets(lengths: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """Of a table of source, size and n: source, source_size, target. Weights go round the sources by code point, null last.

    A level is looked for such that the sum of min(cap, weight x level) is the budget: each round one aggregation tells what sources that
    reach their cap leave to the others, until none is added. The places of sources come from a sort by ranges that is stored with its
    partitions, so no task holds all sources.
    """
    total = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    parts = int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("source").isNull(), F.col("source"))
    dealt = total.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = materialise(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "mixing-sources")
    starts = dealt.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    ranked = dealt.join(F.broadcast(starts.select("part", (before - F.col("first")).alias("shift"))), "part")
    place = F.pmod(F.col("at") + F.col("shift"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place + 1).cast("int"))
    ranked = materialise(ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap")), "mixing-weights")
    budget = ranked.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0]
    budget = int(budget or 0) * share
    wide = lambda v: F.lit(str(v)).cast("decimal(20,0)")
    level, full = Fraction(0), -1
    while True:
        reaches = F.col("cap").cast("decimal(18,0)") * wide(level.denominator) <= F.col("weight").cast("decimal(18,0)") * wide(level.numerator)
        capped = reaches if full >= 0 else F.lit(False)
        got = ranked.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap")).otherwise(0).cast("decimal(38,0)")), F.sum(F.when(~capped, F.col("weight")))).first()
        if got[0] == full or not got[2]:
            break
        full, level = got[0], (budget - int(got[1] or 0)) / Fraction(int(got[2]))
    up, down = float(level.numerator), float(level.denominator)
    share_of = F.col("weight") * F.lit(up) / F.lit(down)
    out = ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), share_of if got[2] else F.col("cap").cast("double")).alias("target"))
    discard(dealt)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, no more than there are, so that their words come near the budget.

    lengths: different and positive, rising. The budget is at most all words. The same share of every length, but for rounding and the
    few that the knapsack changes.
    """
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), np.int64)
    if not total or budget <= 0:
        return taken
    part, left = Fraction(budget, total), Fraction(0)
    for i in range(len(lengths) - 1, -1, -1):
        size, there = int(lengths[i]), int(counts[i])
        want = there * part + left / size
        taken[i] = min(int(want), there)
        left = (want - int(taken[i])) * size
    rest, room = budget - int((lengths * taken).sum()), 0
    for i in range(len(lengths)):  # put short ones back
        if room >= ROOM:
            break
        back = min(int(taken[i]), -(-(ROOM - room) // int(lengths[i])))
        taken[i] -= back
        room += back * int(lengths[i])
    return taken + knapsack(lengths, counts - taken, rest + room)


def knapsack(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many of each length, no more than there are, make the sum nearest to the goal, of two as near the smaller.

    Of each sum up to twice the goal, the table keeps what was added last to reach it first, so that the way back never uses a part twice.
    """
    out = np.zeros(len(lengths), np.int64)
    if goal <= 0:
        return out
    top = 2 * goal
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    last = np.full(top + 1, -1, np.int64)
    parts: list[tuple[int, int]] = []
    for i in range(len(lengths)):
        size, there, k = int(lengths[i]), min(int(counts[i]), top // int(lengths[i])), 1
        while there > 0 and not reached[goal]:
            k = min(k, there)
            add = k * size
            fresh = reached[: top + 1 - add] & ~reached[add:]
            last[add:][fresh] = len(parts)
            reached[add:] |= fresh
            parts.append((i, k))
            there -= k
            k *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - goal).argmin()])
    while at:
        i, k = parts[last[at]]
        out[i] += k
        at -= k * int(lengths[i])
    return out


def plan(lengths: DataFrame, goals: DataFrame) -> DataFrame:
    """Of each source and positive length: passes (times that every document is taken), chosen (documents taken once more) and n."""

    def of_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        total, budget = int(pdf["source_size"].iloc[0]), round(pdf["target"].iloc[0])
        passes = budget // total
        return pdf[["source", "size", "n", "source_size", "target"]].assign(passes=passes, chosen=fit(size, n, budget - passes * total))

    rows = lengths.filter("size > 0").withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).select("source", "size", "n", "source_size", "target")
    return rows.groupBy("source").applyInPandas(of_source, "source string, size long, n long, source_size long, target double, passes long, chosen long")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 42, text: str = "text", source: str = "source", ident: str = "doc_id") -> DataFrame:
    """doc_id, source, size, source_size, target and taken, the words that the mix takes of each document, whole passes."""
    sized = sizes(docs, text, source, ident, seed)
    bucket = F.shiftright(F.col("draw"), 63 - (BUCKETS - 1).bit_length()).cast("int")
    counted = materialise(sized.groupBy("source", "size", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "mixing-counts")
    lengths = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = materialise(targets(lengths, weights, share, most), "mixing-targets")
    planned = materialise(plan(lengths, goals), "mixing-plan")
    # The bucket of each length in which the count ends, and how many of it are taken.
    some = planned.filter("chosen > 0 and chosen < n").select(F.col("source").alias("s"), F.col("size").alias("z"), "chosen")
    upto = F.sum("n").over(W.partitionBy("source", "size").orderBy("bucket"))
    ends = counted.join(some, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).withColumn("upto", upto)
    ends = ends.filter((F.col("upto") >= F.col("chosen")) & (F.col("upto") - F.col("n") < F.col("chosen")))
    ends = ends.select("s", "z", F.col("bucket").alias("end"), (F.col("chosen") - F.col("upto") + F.col("n")).alias("rest"), (F.col("upto") == F.col("chosen")).alias("all"))
    nothing = goals.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("z"), F.lit(0).cast("long").alias("passes"), F.lit(-1).alias("end"), F.lit(None).cast("long").alias("rest"))
    decided = planned.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").select(
        F.col("source").alias("s"), F.col("size").alias("z"), "passes", F.when(F.col("chosen") == F.col("n"), BUCKETS).when(F.col("chosen") == 0, -1).otherwise(F.when(F.col("all"), F.col("end") + 1).otherwise(F.col("end"))).alias("end"),
        F.when(~F.col("all"), F.col("rest")).alias("rest"),
    )
    decided = decided.unionByName(nothing)
    decided = decided.join(goals.withColumnRenamed("source", "g"), F.col("s").eqNullSafe(F.col("g"))).drop("g")
    decided = materialise(decided, "mixing-decisions")
    found = sized.withColumn("bucket", bucket).join(decided, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    at_end = F.col("rest").isNotNull() & (F.col("bucket") == F.col("end"))
    once = F.coalesce(F.col("bucket") < F.col("end"), F.lit(False))
    rank = F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("draw", "doc_id"))

    def out(df: DataFrame, more: Column) -> DataFrame:
        return df.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.coalesce("passes", F.lit(0)) + more.cast("long"))).alias("taken"))

    found = materialise(found, "mixing-found")
    rest = F.coalesce(at_end, F.lit(False))
    made = materialise(out(found.filter(~rest), once).unionByName(out(found.filter(rest).withColumn("rank", rank), F.col("rank") <= F.col("rest"))), "mixing")
    for t in (sized, counted, goals, planned, decided, found):
        discard(t)
    return made
