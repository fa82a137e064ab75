"""Quality classifier: a generalised additive model with pairwise interactions.

Features are native expressions over the whole text. The model is a table of additions for each feature and for each of a few
pairs of features, learned by cyclic boosting: in turn, each feature gets a shallow tree over its bins, fitted to the gradient
that is left, at a small rate; pairs are ranked by what a two-way table would still gain and boosted in the same way. Scoring
looks up a bin for each feature and adds.

Learning uses a bounded sample: the labelled rows whose id has the smallest hashes, at most SAMPLE (all, if fewer). The rows are counted
first, so that only about as many leave the executors, whatever the number of partitions. Everything else covers all rows.

Defined cases: null and empty texts have all counts 0 and are scored like any other; an undefined ratio is a missing value with
a bin of its own; labels other than 0 and 1, and labels without a document, are left out; several labels of one document all
count; with no usable label every score is 0.5; repeated rows are scored alike; an empty table gives an empty table. Working
columns carry a leading ``_m_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below_share, materialise
from .quality_rules import quality_metrics

SAMPLE, BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, LEAVES = 20_000, 48, 8, 6, 150, 0.08, 4
FEATURES = (
    "words", "mean_word_chars", "symbols", "stop", "duplicate_lines", "upper", "exclamations", "repeats", "distinct", "adjacent", "line_words", "digits",
)


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text and with the FEATURES, each under _m_ and its name."""
    others = [c for c in docs.columns if c != text]
    df = quality_metrics(docs, text, prefix="_m_q_", keep_text=False, extra=_extra)
    n = F.col("_m_q_n_words").cast("double")
    of = lambda a, b: F.try_divide(F.col("_m_q_" + a).cast("double"), b)
    made = {
        "words": F.log1p(n),
        "mean_word_chars": F.col("_m_q_mean_word_chars"),
        "symbols": F.col("_m_q_symbol_ratio"),
        "stop": of("n_stop", n),
        "duplicate_lines": F.col("_m_q_dup_line_ratio"),
        "upper": F.col("_m_q_upper_ratio"),
        "exclamations": F.col("_m_q_exclamation_ratio"),
        "repeats": of("n_repeat_words", n),
        "distinct": of("n_distinct", n),
        "adjacent": of("n_adjacent", n),
        "line_words": F.log1p(of("n_words", F.col("_m_q_n_lines").cast("double"))),
        "digits": of("n_digits", F.col("_m_q_word_chars").cast("double")),
    }
    return df.select(*[F.col(f"`{c}`") for c in others], *[made[f].cast("double").alias("_m_" + f) for f in FEATURES])


def _extra(words: Column, text: Column) -> dict[str, Column]:
    same = lambda w, i: F.coalesce(w == F.get(words, i - 1), F.lit(False))
    return {
        "n_distinct": F.size(F.array_distinct(words)),
        "n_adjacent": F.size(F.filter(words, same)),
        "n_digits": F.length(F.regexp_replace(text, "[^0-9]+", "")),
    }


@dataclass
class Additive:
    """base + the table entry of each feature's bin + that of each pair's bins; bin 0 is for missing values."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    @staticmethod
    def place(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts, np.nan_to_num(x), side="right"))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            out += table[self.place(x[:, k], self.cuts[k])]
        for i, j, table in self.pairs:
            out += table[self.place(x[:, i], self.pair_cuts[i]), self.place(x[:, j], self.pair_cuts[j])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _step(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES, least: float = 1.0) -> np.ndarray:
    """A shallow tree over ordered bins: at most `leaves` runs of bins, each with its Newton step."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    runs = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for n, (a, b) in enumerate(runs):
            at = np.arange(a + 1, b)
            at = at[(ch[at] - ch[a] >= least) & (ch[b] - ch[at] >= least)]
            if len(at):
                gain = value(a, at) + value(at, b) - value(a, b)
                best = max(best, (float(gain.max()), (n, int(at[gain.argmax()]))), key=lambda x: x[0])
        if best[1] is None:
            break
        n, cut = best[1]
        a, b = runs[n]
        runs[n : n + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _cut(x: np.ndarray, bins: int) -> np.ndarray:
    x = x[~np.isnan(x)]
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, n_pairs: int = PAIRS) -> Additive:
    width = x.shape[1]
    cuts, coarse = [_cut(x[:, k], BINS) for k in range(width)], [_cut(x[:, k], PAIR_BINS) for k in range(width)]
    model = Additive(cuts, [np.zeros(len(c) + 2) for c in cuts], coarse)
    if not len(y):
        return model
    p = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(p / (1 - p)))
    places = [model.place(x[:, k], cuts[k]) for k in range(width)]
    score = np.full(len(y), model.base)

    def left() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-score))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for k in range(width):
            g, h = left()
            n = len(model.tables[k])
            gb, hb = np.bincount(places[k], g, n), np.bincount(places[k], h, n)
            step = np.zeros(n)
            step[0] = gb[0] / (hb[0] + 1)  # missing values stand apart
            step[1:] = _step(gb[1:], hb[1:])
            model.tables[k] += rate * step
            score += rate * step[places[k]]
    rough = [model.place(x[:, k], coarse[k]) for k in range(width)]
    g, h = left()
    gains = []
    for i in range(width):
        for j in range(i + 1, width):
            n = len(coarse[j]) + 2
            key = rough[i] * n + rough[j]
            gb, hb = np.bincount(key, g), np.bincount(key, h)
            gains.append((float((gb**2 / (hb + 5)).sum()), i, j))
    chosen = [(i, j, np.zeros((len(coarse[i]) + 2, len(coarse[j]) + 2))) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    for _ in range(rounds // 3):
        for i, j, table in chosen:
            g, h = left()
            key = rough[i] * table.shape[1] + rough[j]
            gb, hb = (np.bincount(key, v, table.size).reshape(table.shape) for v in (g, h))
            # A tree of depth two: the best cut of i, then of j on either side.
            rows = _step(gb.sum(1), hb.sum(1), 2)
            step = np.zeros(table.shape)
            for r in np.unique(rows):
                own = rows == r
                step[own] = _step(gb[own].sum(0), hb[own].sum(0), 2)
            table += rate * step
            score += rate * step[rough[i], rough[j]]
    model.pairs = chosen
    return model


def sample(features: DataFrame, labels: DataFrame, label: str, doc_id: str, allowed: Column, size: int = SAMPLE) -> pd.DataFrame:
    """At most `size` labelled rows, those of the smallest hash of their id."""
    marks = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_m_id"), F.col(label).cast("int").alias("_m_label"))
    df = features.filter(allowed).join(marks, F.col(doc_id) == F.col("_m_id"))
    order = F.xxhash64(F.col("_m_id").cast("string"))
    df = df.filter(below_share(order, size, df.count()))
    return df.orderBy(order, *[F.col("_m_" + f) for f in FEATURES]).limit(size).select("_m_label", *["_m_" + f for f in FEATURES]).toPandas()


def classify(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3, size: int = SAMPLE) -> DataFrame:
    """docs without text, with score and predicted. allowed: which rows' labels may be learned from."""
    columns = ["_m_" + f for f in FEATURES]
    others = [c for c in docs.columns if c not in (text, "score", "predicted")]
    df = materialise(text_features(docs.select(*[F.col(f"`{c}`") for c in others], F.col(text).alias("_m_t")), "_m_t"), "features")
    learn = sample(df, labels, label, doc_id, allowed, size)
    model = fit(learn[columns].to_numpy(float), learn["_m_label"].to_numpy(float))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(np.stack([c.to_numpy(float) for c in batch], axis=1)))

    df = df.withColumn("score", score(*[F.col(c) for c in columns]))
    return df.select(*[F.col(f"`{c}`") for c in others], "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
