"""The pipeline on small tables: stages against their operators' own definitions, and planted cases."""

import random

import pytest

import corpus_pipeline
from plumbline.llm.common import materialise, table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    syllable = ["an", "er", "th", "on", "re", "ti", "in", "ou", "ha", "st"]
    word = lambda: "".join(rng.choice(syllable) for _ in range(rng.randint(2, 5)))
    text = lambda n: " ".join(rng.choice(("the", "of", "and", "to", "in")) if rng.random() < 0.4 else word() for _ in range(n)).capitalize() + "."
    clean = [text(120) for _ in range(25)]
    passage, leak = text(90), text(30)
    texts = clean + [clean[0], clean[0], clean[1][:-5] + "other."]  # 25, 26 copies; 27 nearly
    texts += [text(60) + passage + text(60), text(70) + passage]  # 28, 29 share over 400 bytes
    texts += [text(50) + " " + leak + " " + text(50)]  # 30 has a passage of the benchmark
    texts += ["buy now " * 50, None, "", "short"]  # 31 to 34 are junk
    d = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), texts, passage


def test_stages(spark, folder):
    sf, texts, passage = folder
    docs, after = table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "test")
        after[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: set(after[name]["doc_id"])
    assert ids("quality rules") == set(range(31))
    assert ids("near-duplicates") == set(range(31)) - {25, 26} or ids("near-duplicates") == set(range(31)) - {25, 26, 27}
    kept = after["repeated strings"].set_index("doc_id")["text"]
    assert passage not in kept[28] and passage not in kept[29] and kept[2] == texts[2] and len(kept) == len(ids("near-duplicates"))
    assert ids("decontamination") == ids("repeated strings") - {30}
    assert ids("packing") == ids("decontamination")


def test_run_covers_what_the_stages_kept(spark, folder):
    sf, _, _ = folder
    rows = corpus_pipeline.run(spark, sf).toPandas()
    assert (rows.groupby("doc_id")["length"].sum() == rows.groupby("doc_id")["doc_tokens"].first()).all()
    assert {25, 26, 30, 31, 32, 33, 34}.isdisjoint(rows["doc_id"]) and set(range(25)) <= set(rows["doc_id"])


def test_empty_tables(spark, folder):
    sf, _, _ = folder
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, materialise(table(spark, sf, "documents").limit(0), "empty"), sf).count() == 0, name


def test_columns_of_any_name_ties_and_long_texts_pass_every_stage(spark, folder):
    """Names that operators use within, a dotted one, null and repeated ids, and a text of half a million characters."""
    sf, texts, passage = folder
    rng = random.Random(9)
    long = " ".join(f"{rng.choice(('the', 'of', 'and'))} {rng.choice('bdfgl')}{k}{rng.choice('aeiou')}" for k in range(60_000)) + "."
    rows = [(i, t, "en", "s", len(t or ""), *[k] * 9) for k, (i, t) in enumerate([*enumerate(texts), (100, long), (100, long), (None, texts[3]), (None, texts[4][::-1])])]
    extra = ["ranges", "shorter", "parts", "hits", "kept", "fingerprint", "key", "row", "a.b"]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in extra))
    docs = materialise(df, "clash")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "clash")
        got = docs.toPandas()
        if name == "packing":
            assert (got.dropna(subset="doc_id").groupby("doc_id")["length"].sum() == got.dropna(subset="doc_id").groupby("doc_id")["doc_tokens"].first()).all()
            assert 100 in set(got["doc_id"])
            continue
        assert docs.columns == df.columns, name
        for c in extra:  # each row keeps its own values
            assert got[c].tolist() == got[extra[0]].tolist() and got[c].is_unique
        assert (got["doc_id"] == 100).sum() == (2 if name == "quality rules" else 1), name
    assert (got["doc_tokens"] > 0).all()
