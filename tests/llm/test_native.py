"""Quality rules, URL filter, decontamination: SQL on the shared tables, edges on small ones."""

import pytest
from oracle import check

from plumbline.llm import decontaminate, quality_rules, queries, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, n_words string, kept string"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.SQL[name], SF)


def test_native_plans_have_no_python(spark):
    for name in ("op1_quality_rules", "op7_url_filter", "op8_decontaminate"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def test_quality_edges(spark):
    good = "The cat is on the mat and it was not in the house of my friend that day but she had been there before"
    long = " ".join(f"word{i}" for i in range(60_000))
    texts = [None, "", " \n\t", "one", good, good, "a b c d e " * 2, long, "!!! " * 30, "x\nx\nx\ny", None]
    df = docs_of(spark, texts).drop("n_words", "kept")
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert len(got) == len(texts)
    assert got[0]["n_words"] == 0 and got[0]["base_failed"] and not got[0]["kept"]
    assert got[4]["kept"] and got[5]["kept"] and got[6]["n_repeat_words"] == 10 and got[6]["base_failed"]
    assert got[7]["n_words"] == 60_000 and got[7]["n_repeat_words"] == 0
    assert got[9]["n_dup_lines"] == 2
    named = docs_of(spark, texts)  # columns of the input may be called like metrics
    kept = quality_rules.filter_quality(named)
    assert kept.columns == named.columns and [r[0] for r in kept.orderBy("doc_id").collect()] == [4, 5]
    assert quality_rules.filter_quality(named.limit(0)).count() == 0


def test_repeated_windows_are_those_of_brute_force(spark):
    import random

    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.judge(docs_of(spark, texts).select("doc_id", "text")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        assert got[i] == len({p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 5)})


def test_url_edges(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/x", "http://x.org/fr/1", "http://xorg/fr/1", "http://www.Example.COM/de/7?x=http://b.net/",
        "http://example.net/en/a", "http://example.net/fr/a", "http://a.b/c/d/e/f/g/h/i/j#k", "http://a.b/" + "s/" * 3000, "http://a.net/x", "http://org/fr/", "http://q.org/fr",
    ]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(urls)
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"]) == ("", "", None) for i in range(4))
    assert (got[4]["host"], got[4]["path"], got[4]["rule"]) == ("a.net", "", None)  # an empty path doesn't start with a slash
    assert [got[i]["rule"] for i in (5, 6, 7, 8, 9, 10, 14, 15)] == ["net/", "org/fr/", None, "example.com/de/", "example.net/en/", "net/", "org/fr/", None]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.x/shop/{i}", 1) for i in range(30)] + [(100 + i, f"http://h.x/news/item{i}", 0) for i in range(30)] + [(200, "http://h.x/shop/999", None), (201, "http://h.x/news/other", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, spam int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, rules=(), bad="spam").collect()}
    assert got[200]["verdict"] == "block" and got[201]["verdict"] == "allow" and got[201]["template"] == got[100]["template"]


def hits(spark, texts, items, **options):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = decontaminate.contamination(docs_of(spark, texts).select("doc_id", "text"), bench, **options).collect()
    return {r["doc_id"]: r for r in rows}


def test_decontamination_edges(spark):
    import hashlib

    passage = "one two three four five six seven eight nine ten eleven"
    texts = [None, "", "nothing here", f"x {passage.upper()} y", "One, two; THREE four-five six seven eight nine ten!", "short", "É é short é", passage, passage + " " + passage]
    for options in ({}, {"verify": True}):
        got = hits(spark, texts, [passage, "Short", None, "...", "é é", passage], **options)
        assert len(got) == len(texts)
        sha = lambda *i: hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()
        assert got[0]["n_words"] == 0 and not got[0]["contaminated"] and got[0]["items_sha256"] == sha()
        assert (got[3]["n_hit"], got[3]["n_items"], got[3]["items_sha256"]) == (11, 2, sha(0, 5))
        assert got[4]["n_hit"] == 10 and got[5]["n_hit"] == 1 and got[8]["n_hit"] == 22
        assert got[6]["n_hit"] == 1  # upper-case É isn't é here
    assert not any(r["contaminated"] for r in hits(spark, texts, []).values())
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [0, 1, 2, 5, 6]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[3] == "x y" and cut[2] == "nothing here" and cut[0] is None


def test_a_large_benchmark_takes_the_other_way(spark, monkeypatch):
    texts, items = ["a b c d", "b c x", "c"], ["b c", "x"]
    small = hits(spark, texts, items)
    monkeypatch.setattr(decontaminate, "FILTER_HASHES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert hits(spark, texts, items) == small
