"""The other operators against brute force, round trips and held-out accuracy; edges."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from plumbline.llm import html_extract, packing, quality_model, queries, simhash, suffix_dedup, toxicity, warc

SF = "/root/testdata/sf0.01"
EDGES = [None, "", " ", "one", "one two", "one two three", "One  TWO\tthree", "é É ß", "x" * 3000, "w " * 30_000]


def docs_of(spark, texts, tmp_path=None):
    df = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, fingerprint string, score double")
    if tmp_path is None:
        return df
    df.repartition(3, "doc_id").write.mode("overwrite").parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


# --- SimHash ----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, prints, radius=2):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a[i] ^ a[:i]) <= radius)[0]:
            x, y = root(i), root(int(j))
            up[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(a)):
        groups.setdefault(root(i), []).append(ids[i])
    return {d: min(g) for g in groups.values() for d in g}


def test_simhash_query_is_brute_force(spark):
    pdf = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = queries.QUERIES["op9_simhash"](spark, SF).toPandas().set_index("doc_id")
    prints = [slow_fingerprint(t) for t in pdf["text"]]
    assert [got["fingerprint"][d] for d in pdf["doc_id"]] == [f"{p:016x}" for p in prints]
    assert got["component_id"].to_dict() == slow_components(pdf["doc_id"].tolist(), prints)


def test_simhash_edges(spark, tmp_path):
    docs = docs_of(spark, EDGES + EDGES, tmp_path)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    n = len(EDGES)
    assert got[0]["fingerprint"] == "0" * 16 and got[n]["component_id"] == 0 and got[2]["component_id"] == 0
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and all(got[i]["component_id"] == got[i + n]["component_id"] for i in range(n))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == sorted({r["component_id"] for r in got.values()})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c")], "doc_id bigint, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(same).collect()] == [7, 7, 7]
    assert simhash.deduplicate(same).count() == 1


@pytest.mark.parametrize("large", [3, 512])
def test_links_in_crowded_shards(spark, large):
    """Chains of fingerprints two bits apart, in shards that are dealt again (large = 3) or not."""
    rng = random.Random(4)
    prints = set()
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            p ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.link(spark.createDataFrame([(p,) for p in signed], "fp bigint"), large)
    from plumbline.llm.components import components

    root = {r["node"]: r["root"] for r in components(edges).collect()}
    want = slow_components(signed, prints)
    groups = lambda of: sorted(sorted(k for k in signed if of(k) == v) for v in {of(k) for k in signed})
    assert groups(lambda k: root.get(k, k)) == groups(want.get)


def test_bk_tree():
    rng = random.Random(1)
    values = [rng.getrandbits(10) for _ in range(200)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 37):
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


# --- repeated strings -------------------------------------------------------------------------------------------------


def slow_mask(texts, length):
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m)
    return out


def expected(texts, length):
    out = []
    for t, m in zip(texts, slow_mask(texts, length), strict=True):
        edge = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        out.append((len(t), int(m.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_suffixes_are_brute_force(block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(25):
        length, word = rng.choice([(64, 16), (64, 2), (80, 20)])
        seeds = [bytes(rng.choice(b"ab" if rng.random() < 0.3 else b"abcdefgh ") for _ in range(rng.randint(1, 200))) for _ in range(3)]
        pieces = [b"".join(rng.choice(seeds)[rng.randint(0, 5) :] for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 7))]
        for starts, mask in zip(suffix_dedup.repeated_windows(pieces, length, word), slow_mask(pieces, length), strict=True):
            got = np.zeros(len(mask), bool)
            for s in starts:
                got[s : s + length] = True
            assert (got == mask).all()


def test_suffix_query_is_brute_force(spark):
    pdf = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    want = dict(zip(pdf["doc_id"], expected([t.encode() for t in pdf["text"]], 400), strict=True))
    got = {r[0]: tuple(r[1:5]) for r in queries.QUERIES["op5_suffix_dedup"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("options", [{}, {"hot": 500, "chunk": 2000}])
def test_suffix_edges(spark, tmp_path, options, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1500)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    common, other = word(700), word(430)
    texts = EDGES + [common, common, word(90) + common[20:600] + word(50), other + word(10) + other, word(399), "ab" * 900, "ab" * 700, *(word(60) + common[100:560] + word(80) for _ in range(12))]
    docs = docs_of(spark, texts, tmp_path)
    got = {r[0]: tuple(r[1:5]) for r in suffix_dedup.digests(docs, **options).collect()}
    assert got == dict(enumerate(expected([(t or "").encode() for t in texts], 400)))
    cleaned = suffix_dedup.remove_repeats(docs, **options)
    assert cleaned.columns == docs.columns
    out = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert out[0] is None and out[10] == "" and out[14] == texts[14]
    assert suffix_dedup.digests(docs.limit(0)).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------------


def test_packing_keeps_every_token(spark, tmp_path):
    from tokenizers import Tokenizer

    odd = ["a.b,c...d 's it's don't.", "x̂. İ ΣΑΣ. <|endoftext|> z", "ab\x1cc\x0bd e_.f", "A" * 3000 + ".b", "Don't,Stop.It's 12.5,3!."]
    real = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = EDGES + odd + real
    docs = docs_of(spark, texts, tmp_path)
    said = Tokenizer.from_file(packing.tokenizer_path())
    for shard_bytes in (50_000, 10**9):
        rows = packing.pack(docs, shard_bytes=shard_bytes).toPandas().sort_values(["doc_id", "start"])
        assert rows["doc_id"].nunique() == len(texts)
        for d, q in rows.groupby("doc_id"):
            ids = np.array(said.encode(texts[d] or "", add_special_tokens=False).ids + [2], "<u4")
            assert b"".join(q["ids"]) == ids.tobytes() and (q["start"] == q["length"].cumsum() - q["length"]).all() and (q["doc_tokens"] == len(ids)).all()
            assert all(zlib.crc32(x) == c for x, c in zip(q["ids"], q["ids_crc32"], strict=True))
        padding = 0
        for _, q in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            n = int(q["length"].sum())
            assert (q["offset"] == q["length"].cumsum() - q["length"]).all() and n <= 4096
            padding += 0 if n & (n - 1) == 0 else 4096 - n
        assert padding == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_neighbours_are_those_of_brute_force_bm25():
    rng = np.random.default_rng(0)
    pieces = [rng.integers(0, 60, rng.integers(5, 40)).astype(np.uint32) for _ in range(40)]
    index = packing.Index(pieces)
    n, mean = len(pieces), np.mean([len(p) for p in pieces])
    df = {t: sum(t in p for p in pieces) for t in range(60)}
    for q in (0, 7, 39):
        idf = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) for t in set(pieces[q].tolist()) if 2 <= df[t] <= max(2, packing.COMMON * n)}
        terms = sorted(idf, key=lambda t: -idf[t] * (pieces[q] == t).sum())[: packing.QUERY_TERMS]
        score = np.zeros(n)
        for i, p in enumerate(pieces):
            for t in terms:
                tf = (p == t).sum()
                score[i] += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(p) / mean))
        got = index.neighbours(q)
        assert set(got) == set(np.nonzero(score)[0]) and (np.diff(score[got]) < 1e-5).all()


def test_keys_are_the_first_places_among_a_pieces_tokens():
    rng = np.random.default_rng(1)
    pieces = [rng.integers(0, 60, rng.integers(1, 40)).astype("<u4") for _ in range(50)]
    place = packing.picks(60)
    assert sorted(place) == list(range(60))
    keys = np.stack(packing.keys_of([p.tobytes() for p in pieces], place), axis=1)
    for p, k in zip(pieces, keys, strict=True):
        want = sorted({int(place[t]) for t in p})[: packing.KEYS]
        assert list(k) == want + [60] * (packing.KEYS - len(want))


def test_index_with_frequencies_of_the_whole_corpus():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(0, 60, rng.integers(5, 40)).astype(np.uint32) for _ in range(40)]
    df = np.array([sum(t in p for p in pieces) for t in range(60)])
    alone, told = packing.Index(pieces), packing.Index(pieces, (df, 40, np.mean([len(p) for p in pieces])))
    assert np.allclose(alone.weight, told.weight) and (alone.idf == told.idf).all()
    half = packing.Index(pieces[:20], (df, 40, 20.0))
    assert (half.idf == told.idf[np.isin(told.terms, half.terms)]).all()


def test_copies_share_sequences_whatever_lies_between(spark, tmp_path):
    rng = np.random.default_rng(3)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(150))
    twins = [text() for _ in range(12)]
    texts = twins + [text() for _ in range(150)] + twins
    rows = packing.pack(docs_of(spark, texts, tmp_path), shard_bytes=40_000, with_ids=False).toPandas()
    of = rows.groupby("doc_id")["sequence_id"].agg(set)
    assert sum(bool(of[i] & of[162 + i]) for i in range(12)) >= 10


# --- archives ---------------------------------------------------------------------------------------------------------


def test_archives_come_back(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/1", big), (2, "http://a/2\n", big), (3, None, "s"), (4, "u", "s"), (None, "v", big), (5, "w", None), (6, "é ü", big + "é"), (2**53 + 1, "z", "y" * 1000)]
    rows += [(100 + i, f"http://b/{i}", f"<html>page {i} " * 200) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(pages, folder)
    got = warc.read_archives(spark, manifest, folder).collect()
    assert len(got) == len(rows) == sum(r["records"] for r in manifest.collect())
    by = {r["page_id"]: r for r in got}
    assert (by[1]["record_type"], by[1]["refers_to"], by[2]["record_type"], by[2]["refers_to"]) == ("revisit", 2, "response", None)
    assert by[None]["refers_to"] == 2 and by[3]["record_type"] == by[4]["record_type"] == "response" and by[5]["payload_bytes"] == 0
    for i, _, html in rows:
        assert by[i]["payload_digest"] == hashlib.sha1((html or "").encode()).hexdigest() and by[i]["payload_bytes"] == len((html or "").encode())
    folder = warc.archive_folder(spark)
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0), folder), folder).count() == 0


def test_a_file_has_its_dictionary_and_single_records(tmp_path):
    import struct

    import zstandard
    from pyarrow import fs

    records = [warc._record(str(i), f"http://a/{i}", (f"<html>page {i} about the weather " * 30).encode(), None, "") for i in range(400)]
    f = warc._File(fs.LocalFileSystem(), str(tmp_path), "a.warc.zst", warc.train(records))
    for r in records:
        f.add(r)
    f.close()
    raw = (tmp_path / "a.warc.zst").read_bytes()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D and raw[8:12] == b"\x37\xa4\x30\xec"
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj()
    assert one.decompress(raw[8 + size :]) == records[0] and one.eof
    with open(tmp_path / "a.warc.zst", "rb") as s:
        assert [h["X-Page"] for h, _ in warc.read_file(s)] == [str(i) for i in range(400)]
    for cut in (100, len(raw) - 3):
        (tmp_path / "cut").write_bytes(raw[:cut])
        with open(tmp_path / "cut", "rb") as s, pytest.raises(ValueError):
            list(warc.read_file(s))


# --- main text --------------------------------------------------------------------------------------------------------


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p><b>First   paragraph,\n of some length.<br><p>Second one, with &eacute; and <a href="x">a link</a>.
    <div class="ad">Buy now</div><p>Third paragraph. It goes on, and on.</article><section id="comments"><div class="comment"><p>Nice text, thanks.</p></div></section><footer>&copy; me</footer></body></html>"""
    pages = [page, None, "", "just text", "<p>", "<div" * 500, "<div>" * 5000 + "deep text, quite long and full of words." + "</div>" * 5000, page]
    df = spark.createDataFrame([(i, "u", p, "clash") for i, p in enumerate(pages)], "page_id bigint, url string, html string, text string")
    out = html_extract.extract(df)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[0] == got[7] == "Head & line\nFirst paragraph, of some length.\nSecond one, with é and a link.\nThird paragraph. It goes on, and on."
    assert got[1] == got[2] == got[4] == "" and got[3] == "just text" and len(got) == len(pages)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_decoding_never_contradicts_itself():
    rng = np.random.default_rng(0)
    for _ in range(50):
        nodes = [html_extract.Node("body", -1, 0, "")]
        for _ in range(9):
            p = int(rng.integers(0, len(nodes)))
            nodes.append(html_extract.Node("div", p, nodes[p].depth + 1, ""))
        score = rng.normal(size=10)
        keep = html_extract.decode(nodes, score)
        assert all(keep[n.parent] for n, k in zip(nodes[1:], keep[1:], strict=True) if k)
        best = max(
            sum(score[i] for i in range(1, 10) if m >> i & 1)
            for m in range(1, 1024, 2)
            if all(m >> nodes[i].parent & 1 for i in range(1, 10) if m >> i & 1)
        )
        assert abs(score[1:][keep[1:]].sum() - best) < 1e-9


def test_nodes_of_unseen_pages():
    model, rng, wrong, total = html_extract.default_model(), random.Random(123), 0, 0
    for _ in range(100):
        nodes, _ = html_extract.parse(html_extract._training_page(rng))
        want, got = html_extract._labels(nodes), html_extract.decode(nodes, model.score(html_extract.features(nodes)))
        wrong, total = wrong + int((got[1:] != want[1:].astype(bool)).sum()), total + len(nodes) - 1
    assert wrong < 0.03 * total


# --- classifiers ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name, label, least", [("op4_quality_model", "quality", 0.95), ("op10_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1" if label == "toxic" else SF
    marks = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    for d, h in zip(got["doc_id"][:200], got["held_out"][:200], strict=True):
        assert h == (zlib.crc32(str(d).encode()) % (5 if label == "quality" else 4) == (0 if label == "quality" else 2))
    held = got[got["held_out"]].merge(marks, on="doc_id")
    good, bad = held["score"][held[label] == 1].to_numpy(), held["score"][held[label] == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > least
    if label == "toxic":
        assert (good >= 0.3).mean() >= 0.88 and (good >= 0.3).sum() >= 0.85 * (held["score"] >= 0.3).sum()


@pytest.mark.parametrize("module, label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, module, label):
    from pyspark.sql import functions as F

    docs = docs_of(spark, EDGES + EDGES)
    schema = f"doc_id bigint, {label} int"
    for rows in ([], [(3, 1), (4, None), (5, 7), (None, 1), (99, 0)], [(i, i % 2) for i in range(20)] + [(3, 1)]):
        got = module.classify(docs, spark.createDataFrame(rows, schema), F.lit(True))
        pdf = got.toPandas().sort_values("doc_id")
        assert len(pdf) == len(docs.collect()) and pdf["score"].between(0, 1).all() and "fingerprint" in pdf
        n = len(EDGES)
        assert (pdf["score"].to_numpy()[:n] == pdf["score"].to_numpy()[n:]).all()
        if not rows:
            assert (pdf["score"] == 0.5).all()
    assert module.classify(docs.limit(0), spark.createDataFrame([(1, 1)], schema), F.lit(True)).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_model.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs)
