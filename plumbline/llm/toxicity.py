"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Texts are lower-cased and framed by spaces; the n-grams of their characters (N code points) fall into SLOTS hashed slots, present or not.
Learning uses a bounded sample: the SAMPLE labelled rows of the smallest hash of their id (all, if fewer), whose ids are broadcast,
so that no text moves. The documents of either class that have a slot are counted on the executors. The KEPT slots of the
greatest log-likelihood ratio are features; each is scaled by its log-count ratio, and a regularised logistic regression over
them is fitted on the driver, which only the numbers of the sample's features reach.

Defined cases: a null or empty text has the n-grams of two spaces at most, and is scored like any other; labels other than 0 and
1 are left out; several labels of one document all count; with no usable label every score is 0.5, with one class it is the
smoothed share; n-grams count once for each text however often they occur; repeated rows are scored alike; an empty table gives
an empty table. Working columns carry a leading ``_t_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below_share

N, SLOT_BITS, KEPT, SAMPLE, LEAST_DOCS, ALPHA, PENALTY = (3, 5), 18, 768, 24_000, 4, 1.0, 1.0
#: What a toxic row counts in the regression, against 1 for another.
EMPHASIS = 1.5
SLOTS = 1 << SLOT_BITS


def slots(text: str | None, grams: tuple[int, ...] = N) -> np.ndarray:
    """The slot of every n-gram of the whole text, repeats included."""
    b = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in grams:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, np.uint32)
            for k in range(n):
                h *= np.uint32(16777619)
                h += b[k : len(b) - n + 1 + k]
            h *= np.uint32(2654435761)
            out.append(h >> np.uint32(32 - SLOT_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _count(batches: Iterator[pd.DataFrame], grams: tuple[int, ...]) -> Iterator[pd.DataFrame]:
    counts, docs = np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
    seen = np.zeros(SLOTS, bool)
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            s = slots(text, grams)
            seen[s] = True
            there = np.nonzero(seen)[0] if len(s) > SLOTS // 8 else np.unique(s)
            seen[s] = False
            counts[label, there] += 1
            docs[label] += 1
    there = np.nonzero(counts.sum(axis=0))[0]
    yield pd.DataFrame({"slot": np.append(there, -1), "bad": np.append(counts[1, there], docs[1]), "good": np.append(counts[0, there], docs[0])})


@dataclass
class Linear:
    weight: np.ndarray  # of each slot
    bias: float
    grams: tuple[int, ...] = N

    def score(self, text: str | None) -> float:
        s = slots(text, self.grams)
        s = np.unique(s[self.weight[s] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[s].sum(), -30, 30))))


def _likelihood_ratio(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """G of the table of class and presence."""
    out = np.zeros(len(bad))
    both = bad + good
    for seen, n in ((bad, n_bad), (good, n_good)):
        for part, whole in ((seen, both), (n - seen, n_bad + n_good - both)):
            expected = whole * n / (n_bad + n_good)
            out += np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return out


def regression(x: np.ndarray, y: np.ndarray, start: float, penalty: float = PENALTY, rounds: int = 200, emphasis: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with a squared penalty, by accelerated gradient steps. emphasis: what a row of class 1 counts."""
    share = np.where(y == 1, emphasis, 1.0).astype(np.float32)
    share /= max(float(share.max(initial=1.0)), 1.0)  # so that the bound of the step holds
    w, b = np.zeros(x.shape[1], np.float32), start
    v, c = w.copy(), b
    n = max(len(y), 1)
    u = np.ones(x.shape[1], np.float32)
    for _ in range(8):  # the largest eigenvalue bounds the step
        u = x.T @ (x @ u)
        u /= max(float(np.linalg.norm(u)), 1e-12)
    rate = 1 / (0.25 * (float(np.linalg.norm(x.T @ (x @ u))) / n + 1) + penalty / n)
    for k in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y) * share
        w2, b2 = v - rate * ((x.T @ g) / n + penalty / n * v), c - rate * float(g.mean())
        m = k / (k + 3)
        v, c, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w, b


def learn(marked: DataFrame, grams: tuple[int, ...] = N, kept: int = KEPT, least_docs: int = LEAST_DOCS, penalty: float = PENALTY, emphasis: float = EMPHASIS) -> Linear:
    """marked, a bounded table: text, label (0 or 1)."""
    counted = marked.select("text", "label").mapInPandas(lambda batches: _count(batches, grams), "slot bigint, bad bigint, good bigint")
    counts = counted.groupBy("slot").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()  # at most SLOTS + 1 rows
    whole, counts = counts[counts["slot"] == -1], counts[counts["slot"] >= 0]
    n_bad, n_good = float(whole["bad"].sum()), float(whole["good"].sum())
    bias = float(np.log((n_bad + 0.5) / (n_good + 0.5)))
    counts = counts[counts["bad"] + counts["good"] >= least_docs].sort_values("slot")
    bad, good = counts["bad"].to_numpy(float), counts["good"].to_numpy(float)
    weight = np.zeros(SLOTS, np.float32)
    if not n_bad or not n_good or not len(counts):
        return Linear(weight, bias, grams)
    best = np.sort(np.argsort(-_likelihood_ratio(bad, good, n_bad, n_good), kind="stable")[:kept])
    at, bad, good = counts["slot"].to_numpy()[best], bad[best], good[best]
    ratio = np.log((bad + ALPHA) / (n_bad + 2 * ALPHA)) - np.log((good + ALPHA) / (n_good + 2 * ALPHA))
    number = np.full(SLOTS, -1, np.int32)
    number[at] = np.arange(len(at))

    @F.pandas_udf("array<int>")
    def present(texts: pd.Series) -> pd.Series:
        found = (number[slots(t, grams)] for t in texts)
        return pd.Series([np.unique(f[f >= 0]) for f in found])

    rows = marked.select("label", present("text").alias("features")).toPandas()
    x = np.zeros((len(rows), len(at)), np.float32)
    for k, f in enumerate(rows["features"]):
        x[k, f] = ratio[f]
    w, bias = regression(x, rows["label"].to_numpy(np.float32), bias, penalty, emphasis=emphasis)
    weight[at] = w * ratio
    return Linear(weight, bias, grams)


def classify(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3, size: int = SAMPLE, **features) -> DataFrame:
    """docs without text, with score and predicted. allowed: which labels may be learned from, told from doc_id. features: options of learn()."""
    others = [c for c in docs.columns if c not in (text, "score", "predicted")]
    marks = labels.filter(F.col(label).isin(0, 1)).filter(allowed).select(F.col(doc_id).alias("_t_id"), F.col(label).cast("int").alias("label"))
    order = F.xxhash64(F.col("_t_id").cast("string"))
    marks = marks.filter(below_share(order, size, marks.count())).orderBy(order, "label").limit(size)  # at most `size` rows: small enough to broadcast
    named = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("_t_doc"))
    model = learn(named.join(F.broadcast(marks), F.col("_t_doc") == F.col("_t_id")).select("text", "label"), **features)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)

    df = docs.select(*[F.col(f"`{c}`") for c in others], score(F.col(text)).alias("score"))
    return df.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
