"""Repeated passages of a little over 50 words in the pipeline's stage."""

import random

import corpus_pipeline


def test_short_passages_are_cut_and_clean_texts_stay(spark, tmp_path):
    """55 words in under 400 bytes, and in 50 bytes over the limit; 199 bytes in common stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, small, below = text(55), text(100)[:250], text(100)[:199]
    assert 200 < len(passage) < 400
    texts = [text(80) for _ in range(10)]
    texts += [f"{text(40)} A{passage}B {text(40)}", f"{text(20)} C{passage}D {text(60)}", f"{text(30)}E{small}F{text(30)}", f"{text(50)}G{small}H{text(10)}"]
    texts += [f"{text(30)}I{below}J{text(30)}", f"{text(50)}K{below}L{text(10)}", "short", "", None]
    form = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], form).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = {r["doc_id"]: r for r in corpus_pipeline.repeated_strings(spark, docs, "").collect()}
    for i, t in enumerate(texts):
        want = t.replace(passage, "").replace(small, "") if t else t
        assert got[i]["text"] == want, i
        assert t is None or got[i]["n_chars"] == len(want)
