"""SimHash links by the similarity of sets against all pairs in plain Python, and the pipeline's stage."""

import random

import pytest

import corpus_pipeline
from plumbline.llm import simhash
from plumbline.llm.common import materialise


def stored(spark, texts, tmp_path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3, "doc_id").write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def slow(texts):
    """The smallest number of each text's component."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(sets))}


def corpus(seed):
    """Edited copies on both sides of the limit, chains of edits, a crowd of near copies, a common passage, edges."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    line = some(30)
    texts = []
    for _ in range(30):
        base = some(rng.randint(3, 150)) + (line if rng.random() < 0.5 else [])
        texts.append(base)
        for _ in range(rng.randint(0, 6)):
            base = list(base)
            for _ in range(rng.randint(1, 5)):
                base[rng.randrange(len(base))] = some(1)[0]
            texts.append(base)
    base = some(100)
    for k in range(40):
        texts.append(base[:50] + some(k % 4 + 1) + base[50:])
    texts = [" ".join(t) for t in texts]
    return texts + [texts[0], texts[1].upper(), None, "", " ", "one", "One", "one two three four", "one two  three four"]


@pytest.mark.parametrize("large", [4, 256])
def test_components_are_brute_force(spark, tmp_path, large):
    texts = corpus(large)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(stored(spark, texts, tmp_path), large=large).collect()}
    assert got == slow(texts)


def test_crowds_of_near_copies(spark, tmp_path):
    """Many copies of one text with a few edits, and as many of half of it: centres, then blocks, lose no link."""
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, texts = some(120), []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = some(1)[0]
        texts.append(" ".join(t))
    texts += [" ".join(base[:60] + some(30)) for _ in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(stored(spark, texts, tmp_path), large=6).collect()}
    assert got == slow(texts)


def test_edges(spark):
    """Nulls, clashing names, equal and null ids, a very long text, an empty table."""
    long = " ".join(f"w{k}" for k in range(150_000))
    rows = [(None, None, 1, "x"), (5, "", 2, "x"), (5, long, 3, "y"), (2, long + " end", 4, "z"), (None, "alone in here", 5, None)]
    docs = materialise(spark.createDataFrame(rows, "doc_id int, text string, node int, root string"), "edges-of-similar")
    kept = simhash.deduplicate_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r["node"] for r in kept.collect()) == [2, 4, 5]
    assert simhash.deduplicate_similar(materialise(docs.limit(0), "none")).count() == 0


def test_stage_drops_edited_copies(spark, tmp_path):
    """An edited copy of similarity 0.8 or more goes, one below stays: fingerprints within two bits kept nearly all."""
    texts = corpus(11)
    kept = corpus_pipeline.near_duplicates(spark, stored(spark, texts, tmp_path), "")
    assert kept.columns == ["doc_id", "text"]
    assert {r["doc_id"] for r in kept.collect()} == set(slow(texts).values())
