"""Both lengths of the digests against brute force on texts with shared passages of many lengths, and hot keys."""

import hashlib
import random
import tracemalloc
from collections import Counter

import pytest

from plumbline.llm import suffix_dedup
from plumbline.llm.common import materialise


def slow(texts, length):
    """For each text the runs of bytes covered by strings of this length that start at two places."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for k in range(len(d) - length + 1):
            seen[d[k : k + length]] = seen.get(d[k : k + length], 0) + 1
    out = []
    for d in data:
        runs = []
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + length
                else:
                    runs.append([k, k + length])
        out.append(runs)
    return data, out


@pytest.mark.parametrize(("hot", "levels"), [(2_000, 4), (600_000, 4), (1_000, 1), (1_000, 2)])
def test_two_lengths(spark, hot, levels):
    rng = random.Random(hot)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, texts = text(70), []
    for _ in range(40):
        parts = [text(rng.randint(0, 60))]
        if rng.random() < 0.6:
            a = rng.randint(0, 200)
            parts.append(common[a : a + rng.randint(100, 600)])
        if texts and rng.random() < 0.4:
            other = rng.choice(texts)
            a = rng.randint(0, len(other))
            parts.append(other[a : a + rng.randint(150, 900)])
        texts.append(" ".join([*parts, text(rng.randint(0, 40))]))
    texts += [texts[0], "ab" * 500, "x" * 399, "y" * 401, "", None]
    docs = materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), "two-lengths")
    got = {r["doc_id"]: r for r in suffix_dedup.digests(docs, hot=hot, levels=levels).collect()}
    data, long_ = slow(texts, 400)
    _, short = slow(texts, 200)
    for i, d in enumerate(data):
        kept = b"".join(d[b:a] for b, a in zip([0, *(r[1] for r in long_[i])], [*(r[0] for r in long_[i]), len(d)], strict=True))
        want = (len(d), sum(b - a for a, b in long_[i]), len(long_[i]), hashlib.sha256(kept).hexdigest(), len(short[i]), sum(b - a for a, b in short[i]))
        assert tuple(got[i])[1:] == want, i


def test_windows_of_near_copies_part_at_every_level():
    """Copies of one passage that differ in a byte each share a key; each level splits it, and the last leaves one window a key."""
    rng = random.Random(3)
    passage = bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(700))
    pieces = [passage[:k] + b"#" + passage[k + 1 :] for k in range(0, 700, 7)]
    parts, largest = [(0, p) for p in pieces], [len(pieces)]
    for level in range(1, 5):
        out = []
        for old, data in parts:
            key, start, n = suffix_dedup.finer(data, old, level)
            assert n.sum() == len(data) - 399
            out += [(int(k), data[s : s + c + 399]) for k, s, c in zip(key, start, n, strict=True)]
        parts = list(dict.fromkeys(out))
        largest.append(max(Counter(k for k, _ in parts).values()))
    assert largest[-1] == 1 and largest[1] <= largest[0] and largest[3] < largest[0] / 2


def test_hot_keys_read_no_text_again(spark):
    """Splitting hot keys, at any number of levels, costs what they hold: every text is read twice, as without hot keys."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(700))
    texts = [passage[:k] + "#" + passage[k + 1 :] for k in range(0, 700, 7)] + ["".join(rng.choice("qrstuvwxyz ") for _ in range(500)) for _ in range(50)]
    stored = materialise(spark.createDataFrame(list(enumerate(texts)), "_x_row bigint, text string").repartition(2), "hot-keys")
    got, reads = {}, {}
    for hot in (10**9, 2_000):
        read = spark.sparkContext.accumulator(0)

        def counted(batches, read=read):
            for pdf in batches:
                read.add(len(pdf))
                yield pdf

        rows = suffix_dedup.repeated_ranges(stored.mapInPandas(counted, stored.schema), hot=hot).collect()
        got[hot], reads[hot] = {r[0]: suffix_dedup.removed(700, r["ranges"]) for r in rows}, read.value
    assert got[2_000] == got[10**9]
    assert got[2_000].keys() == {i for i, k in enumerate(range(0, 700, 7)) if k >= 400 or k < 300}
    assert reads[2_000] == reads[10**9] == 2 * len(texts)


def test_a_collection_takes_memory_for_a_few_numbers_a_byte():
    """Two tasks of an executor hold a collection each, beside the JVM: no more than 64 bytes for each of its bytes."""
    rng = random.Random(13)
    pieces = []
    for _ in range(3000):
        b = rng.randbytes(399)
        k = rng.randrange(399)
        pieces += [b, b[:k] + bytes([b[k] ^ 1]) + b[k + 1 :]]
    tracemalloc.start()
    found = suffix_dedup.repeated_windows(pieces, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * sum(map(len, pieces))
    for k in range(0, len(pieces), 500):  # the windows that don't hold the changed byte
        at = next(i for i, (x, y) in enumerate(zip(pieces[k], pieces[k + 1], strict=True)) if x != y)
        assert found[k].tolist() == found[k + 1].tolist() == [i for i in range(200) if not i <= at < i + 200]
