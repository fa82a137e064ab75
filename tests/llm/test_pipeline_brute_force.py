"""Every stage of the pipeline against a plain version, each on what the stage before it really kept, and edges in every column."""

import itertools
import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm.common import materialise
from plumbline.llm.packing import tokenizer_path
from plumbline.llm.quality_rules import STOP_WORDS

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "n_words", "hits", "key", "_x", "Text2"]


def judged(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    seen = Counter(windows)
    repeated = len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)})
    if n < 10 or 100 * repeated > 20 * n:
        return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, words))
    stop = {f for s in STOP_WORDS for f in (s, s.capitalize(), s.upper())}
    return (
        2.0 <= chars / n <= 15.0
        and len(re.findall(r"[#*$%&|<>]", text)) / n <= 0.3
        and (n < 20 or sum(w in stop for w in words) / n >= 0.06)
        and (len(lines) - len(set(lines))) / len(lines) <= 0.5
        and len(re.findall("[A-Z]", text)) / chars <= 0.4
        and text.count("!") / n <= 0.3
    )


def first_of_groups(docs):
    """Ids of the documents that are the smallest of all that links of similarity 0.8 reach."""
    sets = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        shared, both = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if 5 * shared >= 4 * both:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return {i for i in sets if root(i) == i}


def without_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for t, d in zip(texts, data, strict=True):
        cover = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                cover[k : k + length] = b"\x01" * length
        out.append(t if not any(cover) else bytes(b for b, c in zip(d, cover, strict=True) if not c).decode("utf-8", "ignore"))
    return out


def leaks(texts, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    known = {}
    for w in map(split, items):
        for k in range(max(1, len(w) - 9)) if w else ():
            known.setdefault(min(10, len(w)), set()).add(tuple(w[k : k + 10]))
    return [any(tuple(w[k : k + n]) in g for n, g in known.items() for k in range(len(w) - n + 1)) for w in map(split, texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All documents of sf0.001, and copies, near copies, shared passages, leaks, odd texts; columns whose names clash."""
    rng, docs, bench = random.Random(11), pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    long_ones = [t for t in docs["text"] if len(t) > 1500]
    more = []
    for t in rng.sample(long_ones, 12):
        words = t.split(" ")
        more += [t, " ".join("Ändern" if k % 97 == 5 else w for k, w in enumerate(words)), " ".join("new" if k % 11 == 5 else w for k, w in enumerate(words))]
    a, b, c = rng.sample(long_ones, 3)
    passage = " ".join(f"the wörd{k} of" for k in range(19))  # 57 words
    more += [a[:700] + " " + passage + " " + b[:700], c[:600] + " " + passage, passage + " " + b[-650:]]
    more += [b[:500] + " " + bench["text"].iloc[0] + " " + c[-500:], None, None, "", "   \n", "short", "one two three four five six seven eight nine ten of the"]
    more += [(a + " ") * 2, "\n".join(f"line {k} of the very long text in row {k * 7919 % 10007} is here" for k in range(6000))]
    texts = [*docs["text"], *more]
    rows = [(i, t, "en" if i % 3 else None, "hot" if i % 2 else None, len(t) if t else None, i, "h", None, 1, "T") for i, t in enumerate(texts)]
    d = tmp_path_factory.mktemp("brute")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, hits string, key string, _x int, Text2 string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*bench[["item_id", "text"]].astype({"item_id": str}).itertuples(index=False, name=None), ("e", None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), [*bench["text"], None]


def test_every_stage_is_brute_force(spark, folder):
    sf, items = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, dropped = docs.toPandas(), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "brute")
        after = docs.toPandas()
        texts = [t if isinstance(t, str) else None for t in before["text"]]
        if name == "packing":
            break
        assert docs.columns == COLUMNS
        if name == "repeated strings":
            want = dict(zip(before["doc_id"], without_repeats(texts, corpus_pipeline.PASSAGE), strict=True))
            assert dict(zip(after["doc_id"], after["text"], strict=True)) == want
            assert sum(len(t) for t in want.values()) < sum(map(len, texts)) and (after["n_chars"] == after["text"].str.len()).all()
        else:
            if name == "quality rules":
                want = [i for i, t in zip(before["doc_id"], texts, strict=True) if judged(t)]
            elif name == "near-duplicates":
                want = first_of_groups(list(zip(before["doc_id"], texts, strict=True)))
            else:
                want = [i for i, hit in zip(before["doc_id"], leaks(texts, items), strict=True) if not hit]
            assert sorted(after["doc_id"]) == sorted(want), name
            assert dict(zip(after["doc_id"], after["text"], strict=True)).items() <= dict(zip(before["doc_id"], texts, strict=True)).items()
        dropped[name] = len(before) - len(after)
        before = after
    assert dropped["quality rules"] >= 7 and dropped["near-duplicates"] >= 20 and dropped["decontamination"] >= 1
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in zip(before["doc_id"], texts, strict=True)}
    places = {i: 0 for i in ids}
    for r in after.sort_values(["doc_id", "start"]).itertuples():
        assert r.start == places[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        places[r.doc_id] += r.length
        raw = b"".join(x.to_bytes(4, "little") for x in ids[r.doc_id][r.start : r.start + r.length])
        assert zlib.crc32(raw) == r.ids_crc32
    assert places == {i: len(x) for i, x in ids.items()}
    sizes = after.groupby("sequence_id")["length"].sum()
    assert (sizes <= 4096).all() and all(n == 4096 or n & (n - 1) == 0 for n in sizes)


def test_run_is_the_chain_of_stages(spark, folder):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), "brute")
    kept = {r[0] for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in got.select("doc_id").distinct().collect()} == kept and got.groupBy("sequence_id", "offset").count().filter("count > 1").count() == 0


def test_a_table_without_lengths(spark, folder):
    sf, _ = folder
    docs = materialise(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "brute")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), "brute")
        assert docs.columns == ["doc_id", "text"], name
