"""The toxicity classifier against a plain version: n-grams one by one, counts in dictionaries, the regression by Newton's method."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import toxicity as T


def plain_slots(text, grams):
    s, out = f" {text or ''} ".lower(), set()
    for n in grams:
        for i in range(len(s) - n + 1):
            h = n
            for c in s[i : i + n]:
                h = (h * 16777619 + ord(c)) % 2**32
            out.add(h * 2654435761 % 2**32 >> (32 - T.SLOT_BITS))
    return out


def plain_scores(texts, labels, asked, grams, kept, least, emphasis, penalty):
    seen = [plain_slots(t, grams) for t in texts]
    bad, good = {}, {}
    for s, y in zip(seen, labels, strict=True):
        for k in s:
            (bad if y else good)[k] = (bad if y else good).get(k, 0) + 1
    n1, n0 = sum(labels), len(labels) - sum(labels)

    def gain(k):
        total, n = 0.0, n1 + n0
        a, b = bad.get(k, 0), good.get(k, 0)
        for x, row, column in ((a, a + b, n1), (b, a + b, n0), (n1 - a, n - a - b, n1), (n0 - b, n - a - b, n0)):
            total += x * math.log(x * n / (row * column)) if x else 0.0
        return total

    slots = sorted(k for k in bad.keys() | good.keys() if bad.get(k, 0) + good.get(k, 0) >= least)
    slots = sorted(sorted(slots, key=lambda k: -gain(k))[:kept])
    ratio = np.array([math.log((bad.get(k, 0) + 1) / (n1 + 2)) - math.log((good.get(k, 0) + 1) / (n0 + 2)) for k in slots])
    rows = lambda sets: np.array([[r if k in s else 0.0 for k, r in zip(slots, ratio, strict=True)] + [1.0] for s in sets])
    x, y = rows(seen), np.array(labels, float)
    share = np.where(y == 1, emphasis, 1.0) / emphasis
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + np.diag(ridge + 1e-9), x.T @ (share * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return 1 / (1 + np.exp(-rows([plain_slots(t, grams) for t in asked]) @ w))


def test_scores_are_those_of_the_plain_version(spark):
    rng = random.Random(6)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 6)))
    texts, labels = [], []
    for k in range(160):
        y = int(k % 5 == 0)
        texts.append(" ".join([word("abcdeé") for _ in range(rng.randint(1, 12))] + [word("xyzЖ") for _ in range(3 * y * (rng.random() < 0.8) + (rng.random() < 0.1))]))
        labels.append(y)
    asked = [*texts, None, "", "ÀÉ xyz", "a" * 5000]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    for grams, emphasis in (((3, 5), 1.5), ((2, 3), 1.0)):
        got = T.classify(docs, marks, F.lit(True), grams=grams, kept=40, least_docs=3, emphasis=emphasis, penalty=20.0).orderBy("doc_id").toPandas()
        want = plain_scores(texts, labels, asked, grams, 40, 3, emphasis, 20.0)
        assert np.abs(got["score"].to_numpy() - want).max() < 0.01
        assert (got["predicted"] == (got["score"] >= 0.3)).all()
