"""Clashing names that stay in the input, very long texts, pages that break parsers, templates that decide."""

import time

from oracle import check

from plumbline.llm import decontaminate, html_extract, quality_model, quality_rules, queries, url_filter, warc
from plumbline.llm.common import below_share

PASSAGE = "one two three four five six seven eight nine ten eleven"


def test_clashing_columns_give_way(spark):
    rows = [(1, "a few words " * 3 + PASSAGE, "x", 7, "k", "i", True, None), (2, None, "y", 8, "k", "i", False, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_words string, hits int, kept string, items string, base_failed boolean, contaminated int")
    judged = quality_rules.judge(docs)
    assert len(set(judged.columns)) == len(judged.columns) and {"hits", "items", "text"} <= set(judged.columns)
    got = {r["doc_id"]: r for r in judged.collect()}
    assert got[1]["n_words"] == 20 and got[2]["n_words"] == 0 and got[2]["base_failed"] and got[2]["kept"] is False and got[1]["hits"] == 7
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id int, text string")
    df = decontaminate.contamination(docs, bench)
    assert len(set(df.columns)) == len(df.columns)
    got = {r["doc_id"]: r for r in df.collect()}
    assert got[1]["contaminated"] is True and got[1]["n_hit"] == 11 and got[1]["hits"] == 7 and got[1]["items"] == "i" and got[2]["n_words"] == 0
    found = {r["doc_id"]: r for r in decontaminate.find_hits(docs, bench).collect()}
    assert len(found[1]["hits"]) == 2 and found[1]["items"] == ["1"]
    assert decontaminate.remove_documents(docs, bench).columns == docs.columns
    assert quality_rules.filter_quality(docs).columns == docs.columns


def test_very_long_texts(spark):
    text = " ".join(f"w{k % 5003}x{k}" for k in range(120_000)) + " " + PASSAGE
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id int, text string")
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id int, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert got[1]["n_hit"] == 11 and got[1]["n_words"] == 120_011
    pages = spark.createDataFrame([(1, "u", "<p>" + "long page " * 400_000), (2, "u", None)], "page_id bigint, url string, html string")
    folder = warc.archive_folder(spark)
    back = {r["page_id"]: r for r in warc.read_archives(spark, warc.write_archives(pages, folder), folder).collect()}
    assert back[1]["payload_bytes"] == 4_000_003 and back[2]["payload_bytes"] == 0


def test_broken_markup_takes_linear_time():
    model = html_extract.default_model()
    for unit, n in (("<a ", 350_000), ('<a href="', 110_000), ("<", 1_000_000), ("<!--", 250_000), ('<a x=">" ', 120_000), ("<div>", 200_000), ("<div><li>", 100_000), ("<script>", 120_000)):
        began = time.time()
        html_extract.extract_many([unit * n], model)
        assert time.time() - began < 20, unit


def test_main_text_of_written_pages():
    """Pages written by hand, with the text that a reader would take."""
    model = html_extract.default_model()
    prose = "The river rose in the night, and by the morning the lower fields were under water. Nobody had seen it so high since the old bridge fell."
    more = "The farmers moved their animals to the hill, where they stayed for a week, and then came back to mend the fences and the walls."
    pages = {
        f"Loose text of the article: {prose}<p>{more}</p>": f"Loose text of the article: {prose}\n{more}",
        f'<html><head><title>T</title></head><body><nav><a href="/">Home</a> <a href="/b">About</a></nav><article><h1>Flood</h1><p>{prose}<p>{more}</article><footer>Copyright</footer>': f"Flood\n{prose}\n{more}",
        f'<body><div class="header"><ul><li><a href="/">Home</a><li><a href="/x">News</a></ul></div><div id="content"><h1>Flood &amp; after</h1><p>{prose}</p><div class="ad"><p>Buy now.</p></div><blockquote><p>{more}</p></blockquote></div><div class="comments"><div class="comment"><p>I was there.</p></div></div><script>var x = "<p>no</p>";</script>': f"Flood & after\n{prose}\n{more}",
        f"<main>{'<div>' * 300}<p>{prose}</p>{'</div>' * 300}<p>{more}</p></main>": f"{prose}\n{more}",
        # Controls and formulas within sentences, or without an end tag; raw text without one.
        f"<article><h1>Flood</h1><p>{prose}</p><button>Go<p>{more}</p></article>": f"Flood\n{prose}\n{more}",
        f"<article><p>{prose}</p><svg viewBox='0 0 1 1'><path d=1><p>{more}</p></article>": f"{prose}\n{more}",
        f"<article><p>{prose}</p><select><option>a<p>{more}</p></article>": f"{prose}\n{more}",
        f"<article><p>{prose} Let <math><mi>x</mi></math> be real.</p><p>{more}</p></article>": f"{prose} Let x be real.\n{more}",
        f"<article><p>{prose} Press <button>OK</button> to go on.</p><p>{more}</p></article>": f"{prose} Press OK to go on.\n{more}",
        f"<article><p>{prose}</p><button>Share</button><p>{more}</p></article>": f"{prose}\n{more}",
        f"<article><p>{prose}</p><script>var a = 1; <p>{more}</p></article>": f"{prose}\n{more}",
    }
    got = html_extract.extract_many(list(pages), model)
    for found, want in zip(got, pages.values(), strict=True):
        assert found == want


def test_url_templates_decide_on_hosts_without_labels(spark, tmp_path):
    """A template that is bad wherever it is labelled is rejected on a host without labels, and the whole path counts."""
    rows = [(i, f"http://h{i % 5}.net/offers/{i}", "x") for i in range(40)] + [(100 + i, f"http://a{i % 5}.org/fr/news/{i}", "x") for i in range(40)]
    rows += [(200, "http://new.com/offers/7", "x"), (201, "http://new.com/fr/news/7", "x"), (202, "http://other.com/a/b/c/d/e/f", "x")]
    rows += [(300 + i, f"http://deep{i % 3}.net/a/b/c/d/e/{i}", "x") for i in range(20)] + [(400, "http://new.com/a/b/c/d/e/5", None), (401, None, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, template string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    assert got[200]["verdict"] == "block" and got[200]["rule"] is None and got[201]["verdict"] == "allow" and got[202]["verdict"] == "allow"
    assert len(got) == len(rows)
    df.drop("template").write.parquet(str(tmp_path / "pages.parquet"))
    check(spark, queries.QUERIES["op7_url_filter"], queries.SQL["op7_url_filter"], str(tmp_path))


def test_samples_are_cut_before_they_are_sorted(spark):
    df = spark.range(20_000).withColumn("h", __import__("pyspark").sql.functions.xxhash64("id"))
    cut = df.filter(below_share(df["h"], 500, 20_000))
    assert 500 <= cut.count() <= 900
    assert {r[0] for r in cut.orderBy("h").limit(500).collect()} == {r[0] for r in df.orderBy("h").limit(500).collect()}
    assert df.filter(below_share(df["h"], 500, 400)).count() == 20_000
    assert quality_model.SAMPLE == 20_000
