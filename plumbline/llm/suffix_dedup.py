"""Removal of repeated byte strings by a multi-document suffix array, built column by column.

Every string of LENGTH bytes that starts at two places anywhere is found, and the bytes that it covers are removed.

1. Dealing out. A window of LENGTH bytes is keyed by its minimizer, the leftmost smallest hash of its GRAM-byte strings. Windows
   in a row with one minimizer form a segment of at most 2 * LENGTH - GRAM bytes. Equal windows have equal keys, so only segments
   that share a key need meet. Equal segments (64-bit hash, within a key) are collapsed into one with a count before anything is gathered;
   keys that are met once are dropped. Of each different segment that is left the bytes are fetched once. A key with more than HOT bytes
   of them is dealt again by three minimizers (of the whole window, of its first and of its last quarter), under another hash each time, up to LEVELS - 1 times; what is still
   hot then is dealt by its windows themselves, so that no key gathers more than copies of one. A level takes the hot keys' different
   segments for its texts, so it costs what they hold; the documents and the other keys aren't read again. Where repeated windows of fewer bytes
   are known, only what they cover is looked at: each window of LENGTH bytes that is found twice consists of them.
2. Construction. In each task, the segments of whole keys form collections of about CHUNK bytes. A segment stands for WORD
   documents, one for each phase, whose symbols are the hashes of its WORD-byte words: a suffix of whole words for every byte.
   Each round inserts one symbol per document, from the right: a new suffix's place follows from its symbol and the place of the
   suffix that it extends, as in the Burrows-Wheeler transform's last-to-first mapping; the table of suffixes (place of the
   rest, common prefix with the predecessor) lies in files that are read and written from front to back, once a round.
3. Decision. Neighbours with LENGTH / WORD words in common are equal windows.

Equality rests on hashes of 64 bits for words, of which LENGTH / WORD in a row must agree, and for segments that share a 64-bit key.

Defined cases: a null text is empty; texts shorter than LENGTH bytes keep all; matches never cross documents; every copy loses
the string, the first included; equal rows are copies of each other; an empty table gives an empty table. docs must be a
stored table, as its rows are numbered by scan order twice. Working columns carry a leading ``_x_``.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release

LENGTH, GRAM, WORD = 400, 48, 100
#: Below the bytes of passages of 50 words of running text.
PASSAGE = 200
CHUNK, HOT, LEVELS, BLOCK = 3_000_000, 1_000_000, 4, 1 << 18
#: Texts are looked at in pieces of so many bytes, which overlap by LENGTH - 1.
PIECE = 1 << 23
_P = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bytes(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Mixed polynomial hash of every string of `width` bytes."""
    with np.errstate(over="ignore"):
        # Only the hashes of the power of two at hand are held, and those of the ends of the strings, which grow to the left.
        power, factor, k = _TABLE[data], _P, 1
        out, got, before = None, 0, np.uint64(1)
        while True:
            if width & k:
                n = len(data) - got - k + 1
                out = power if out is None else power[:n] * before + out[k:]
                got, before = got + k, before * factor
            if 2 * k > width:
                break
            longer = power[:-k] * factor
            longer += power[k:]
            power, factor, k = longer, factor * factor, 2 * k
        del power
        out = out ^ (out >> np.uint64(29))
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` hashes the place of its leftmost smallest (by the upper 40 bits)."""
    n = len(hashes)
    value = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    if n == width:
        return np.array([int(value.min() & np.uint64(0xFFFFFF))])
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = value
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - width + 1], before[width - 1 : n])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs over which all keys are constant."""
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    start = np.nonzero(change)[0]
    return start, np.diff(np.append(start, len(change)))


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, first windows and numbers of windows of a text's segments, piece by piece."""
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        piece = np.frombuffer(data, np.uint8)[at : at + PIECE + length - 1]
        if len(piece) >= length:
            h = rolling(piece, gram)
            m = minimizers(h, length - gram + 1)
            start, n = _runs(m)
            yield h[m[start]], start + at, n


def finer(data: bytes, old: int, level: int, length: int = LENGTH, gram: int = GRAM, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a segment of the hot key `old`, by three minimizers; at the last level every window is a segment of its own."""
    view = np.frombuffer(data, np.uint8)
    n, quarter = len(data) - length + 1, length // 4
    before = np.uint64(old * int(_P) & (2**64 - 1))
    if level >= levels:
        return before ^ rolling(view, length), np.arange(n), np.ones(n, np.int64)
    h = rolling(view, gram)
    other = (h ^ _TABLE[level]) * _TABLE[level + 16]
    other ^= other >> np.uint64(31)
    inner = h if level == 1 else other
    a = minimizers(other, length - gram + 1)
    ends = minimizers(inner, quarter - gram + 1)
    b, c = ends[:n], ends[length - quarter : length - quarter + n]
    start, count = _runs(a, b, c)
    key = ((before ^ other[a[start]]) * _P + inner[b[start]]) * _P + inner[c[start]]
    return key ^ (key >> np.uint64(31)), start, count


_OCCURRENCE = "_x_row bigint, key bigint, h1 bigint, start bigint, n int"


def _names(data: bytes, start: np.ndarray, n: np.ndarray, length: int) -> list[int]:
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return [digest(view[s : s + k - 1 + length]) for s, k in zip(start.tolist(), n.tolist(), strict=True)]


def _table(rows: list[tuple[int, np.ndarray, list[int], np.ndarray, np.ndarray]]) -> pd.DataFrame:
    signed = lambda x: np.asarray(x, np.uint64).view(np.int64)
    cat = lambda k, t: np.concatenate([np.asarray(r[k], t) for r in rows]) if rows else np.zeros(0, t)
    return pd.DataFrame(
        {
            "_x_row": np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[3]) for r in rows]),
            "key": signed(cat(1, np.uint64)), "h1": signed(cat(2, np.uint64)), "start": cat(3, np.int64), "n": cat(4, np.int32),
        }
    )


def _scanner(length: int, gram: int, inner: int = 0):
    """Texts to segments; with inner, only what the windows of `inner` bytes in column ranges cover."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for row, text, ranges in zip(pdf["_x_row"], pdf["text"], pdf["ranges"] if inner else [None] * len(pdf), strict=True):
                data = _bytes(text)
                for a, b in _joined(ranges, inner) if inner else [(0, len(data))]:
                    if b - a < length:
                        continue
                    piece = data[a:b] if inner else data
                    for key, start, n in segments(piece, length, gram):
                        rows.append((row, key, _names(piece, start, n, length), start + a, n))
                        size += len(n)
                if size > 200_000:
                    yield _table(rows)
                    rows, size = [], 0
            yield _table(rows)

    return scan


def _joined(ranges, length: int) -> list[tuple[int, int]]:
    """The bytes, as (start, end), whose every window of `length` bytes is in the ranges of starts."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b + length) for a, b in out]


def _refiner(length: int, gram: int, level: int, levels: int):
    """Segments of hot keys (_x_row, key, text) to occurrences of finer keys in them."""

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for row, old, text in pdf[["_x_row", "key", "text"]].itertuples(index=False, name=None):
                data = _bytes(text)
                key, start, n = finer(data, old, level, length, gram, levels)
                rows.append((row, key, _names(data, start, n, length), start, n))
                size += len(n)
                if size > 200_000:
                    yield _table(rows)
                    rows, size = [], 0
            yield _table(rows)

    return refine


def _fetcher(length: int):
    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for text, parts in zip(pdf["text"], pdf["parts"], strict=True):
                data = _bytes(text)
                for p in parts:
                    piece = data[p["start"] : p["start"] + p["n"] - 1 + length]
                    out.append((p["key"], p["h1"], p["n"], p["hot"], piece))
                    size += len(piece)
                if size > 4_000_000:
                    yield pd.DataFrame(out, columns=["key", "h1", "n", "hot", "data"])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=["key", "h1", "n", "hot", "data"])

    return fetch


# --- the collection's suffixes --------------------------------------------------------------------------------------


class _Columns:
    """The table of suffixes in order, one file for each column, read and written from front to back."""

    TYPES = {"key": np.int64, "at": np.int32, "common": np.uint8}

    def __init__(self, folder: str):
        self.folder, self.round, self.size = folder, 0, 0

    def path(self, name: str, round_: int) -> str:
        return os.path.join(self.folder, f"{name}-{round_}")

    def blocks(self) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        files = {c: open(self.path(c, self.round), "rb") for c in self.TYPES} if self.size else {}
        try:
            for a in range(0, self.size, BLOCK):
                yield a, {c: np.fromfile(f, self.TYPES[c], BLOCK) for c, f in files.items()}
        finally:
            for f in files.values():
                f.close()

    def replace(self, blocks: Iterator[dict[str, np.ndarray]]) -> None:
        files, size = {c: open(self.path(c, self.round + 1), "wb") for c in self.TYPES}, 0
        for b in blocks:
            for c, f in files.items():
                b[c].astype(self.TYPES[c], copy=False).tofile(f)
            size += len(b["key"])
        for f in files.values():
            f.close()
        if self.size:
            for c in self.TYPES:
                os.remove(self.path(c, self.round))
        self.round, self.size = self.round + 1, size


_REST = 1 << 32


def repeated_windows(pieces: list[bytes], length: int = LENGTH, word: int = WORD) -> list[np.ndarray]:
    """For each piece the starts of its windows of `length` bytes that start at another place of the collection, too."""
    sizes = np.array([len(p) for p in pieces])
    base = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    total, need = len(data), length // word
    if total < length:
        return [np.zeros(0, np.int64) for _ in pieces]
    hashes = rolling(data, word)
    order = np.argsort(hashes)
    hashes = hashes[order]
    number = np.zeros(len(order), np.int32)
    np.cumsum(hashes[1:] != hashes[:-1], out=number[1:])
    symbol = np.full(total, -1, np.int32)
    symbol[order] = number
    del hashes, order, number
    # The end of the piece that each byte is in; a word at `at` exists if at + word <= end.
    end = np.repeat(base[1:].astype(np.int32), sizes)
    # Documents: a piece's phases. Each begins with its rightmost word.
    place = np.concatenate([np.arange(max(a, b - 2 * word + 1), b - word + 1) for a, b in zip(base[:-1], base[1:], strict=True) if b - a >= word])
    rest = np.arange(len(place), dtype=np.int64)  # the empty suffixes come first, in order of the documents
    documents = len(place)
    first = np.repeat(base[:-1].astype(np.int32), sizes)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words in common, up to `need`, of the suffixes at a and b."""
        out = np.zeros(len(a), np.uint8)
        live = np.arange(len(a))
        for k in range(need):
            x, y = a[live] + k * word, b[live] + k * word
            ok = (x + word <= end[a[live]]) & (y + word <= end[b[live]])
            live, x, y = live[ok], x[ok], y[ok]
            live = live[symbol[x] == symbol[y]]
            out[live] = k + 1
            if not len(live):
                break
        return out

    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
        table = _Columns(folder)
        while len(place):
            key = symbol[place].astype(np.int64) * _REST + rest
            order = np.argsort(key, kind="stable")
            new_key, new_at = key[order], place[order]
            # Where the new suffixes go, in old places, block by block.
            goes, k = np.zeros(len(new_key), np.int64), 0
            for a, b in table.blocks():
                upto = len(new_key) if a + len(b["key"]) == table.size else int(np.searchsorted(new_key, b["key"][-1], "left"))
                if upto > k:
                    goes[k:upto] = a + np.searchsorted(b["key"], new_key[k:upto], "left")
                    k = upto
            shift = np.cumsum(np.bincount(goes, minlength=table.size + 1), dtype=np.int64)  # for old place r: new ones at or before it

            def moved(keys: np.ndarray, shift=shift) -> np.ndarray:
                r = keys % _REST
                deep = r >= documents
                r[deep] += shift[r[deep] - documents]
                return keys - keys % _REST + r

            def merged(goes=goes, new_key=new_key, new_at=new_at, moved=moved) -> Iterator[dict[str, np.ndarray]]:
                k, last = 0, None  # last: the suffix before the block
                for a, b in table.blocks() if table.size else [(0, {c: np.zeros(0, t) for c, t in _Columns.TYPES.items()})]:
                    n = len(b["key"])
                    upto = len(goes) if a + n >= table.size else int(np.searchsorted(goes, a + n, "left"))
                    where = goes[k:upto] - a
                    at = np.insert(b["at"].astype(np.int64), where, new_at[k:upto])
                    keys = np.insert(moved(b["key"]), where, moved(new_key[k:upto]))
                    shared = np.insert(b["common"], where, 0)
                    mine = where + np.arange(len(where))
                    fresh = np.zeros(len(at), bool)
                    fresh[mine] = True
                    after = np.zeros(len(at), bool)
                    after[1:] = fresh[:-1]
                    again = np.nonzero(fresh | after)[0]
                    if after_last[0] and len(at):
                        again = np.union1d(again, [0])
                    inner = again[again > 0]
                    shared[inner] = common(at[inner - 1], at[inner])
                    if len(again) and again[0] == 0:
                        shared[0] = common(np.array([last]), at[:1])[0] if last is not None else 0
                    if len(at):
                        last, after_last[0] = int(at[-1]), bool(fresh[-1])
                    k = upto
                    yield {"key": keys, "at": at, "common": shared}

            after_last = [False]
            table.replace(merged())
            # The documents that go on: each one's next word to the left, whose rest is the suffix just inserted.
            put = goes + np.arange(len(goes))
            onward = new_at - word >= first[new_at]
            place, rest = new_at[onward] - word, documents + put[onward]
        found, before = np.zeros(total, bool), None
        for _, b in table.blocks():
            equal = b["common"] >= need
            found[b["at"][equal]] = True
            earlier = np.concatenate([[before if before is not None else 0], b["at"][:-1]])
            found[earlier[equal]] = True
            before = b["at"][-1]
    return [np.nonzero(found[a:b])[0] for a, b in zip(base[:-1], base[1:], strict=True)]


def _ranges(starts: np.ndarray) -> list[dict[str, int]]:
    """First and last of the runs of consecutive starts."""
    if not len(starts):
        return []
    cut = np.nonzero(np.diff(starts) > 1)[0]
    return [{"a": int(a), "b": int(b)} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]


def _finder(length: int, word: int, chunk: int):
    """Segments sorted by key to the ranges of their repeated windows."""

    def work(rows: list[tuple]) -> pd.DataFrame:
        found = repeated_windows([bytes(r[3]) for r in rows], length, word)
        out = [(*r[:3], _ranges(f)) for r, f in zip(rows, found, strict=True) if len(f)]
        return pd.DataFrame(out, columns=["key", "h1", "n", "ranges"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for r in pdf[["key", "h1", "n", "data"]].itertuples(index=False, name=None):
                if size > chunk and r[0] != rows[-1][0]:
                    yield work(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        if rows:
            yield work(rows)

    return find


def _parts(df: DataFrame) -> DataFrame:
    """_x_row, parts: what to cut out of each document."""
    return df.groupBy("_x_row").agg(F.collect_list(F.struct("key", "h1", "start", "n", "hot")).alias("parts"))


def _reaches(length: int, inner: int):
    """Whether a document's ranges have enough starts for one window of `length` bytes; they may lie in several ranges."""
    return F.aggregate("ranges", F.lit(0).cast("bigint"), lambda n, r: n + r["b"] - r["a"] + 1) > length - inner


_NAME = ("key", "h1", "n")


def _contents(occurrences: DataFrame, length: int) -> DataFrame:
    """Different segments with their number of occurrences and one of these, without those of keys that are met once."""
    first = F.min(F.struct("_x_row", "start")).alias("one")
    found = occurrences.groupBy(*_NAME).agg(F.count(F.lit(1)).alias("times"), first)
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.sum("times").alias("all"), F.sum(F.col("n") + (length - 1)).alias("size"))
    return found.join(keys.filter("all > 1").drop("all"), "key")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, word: int = WORD, chunk: int = CHUNK, hot: int = HOT, levels: int = LEVELS, within: DataFrame | None = None, inner: int = 0) -> DataFrame:
    """_x_row, ranges (array of first and last start of repeated windows); docs has _x_row and text.

    within: what this function gave for the same docs and the smaller length `inner`.
    """
    if length % word or word < 2 or length // 4 < gram:
        raise ValueError("length must be a multiple of word and at least four times gram")
    spark = docs.sparkSession
    if within is not None:  # from here on only the texts that can have such a window
        docs = materialise(docs.join(within.filter(_reaches(length, inner)), "_x_row"), "texts")
        release(spark)
    every = materialise(docs.mapInPandas(_scanner(length, gram, inner if within is not None else 0), _OCCURRENCE), "segments")
    met = materialise(every.groupBy("key").agg(F.count(F.lit(1)).alias("all")).filter("all > 1").select("key"), "keys")
    occurrences = materialise(every.join(met, "key", "left_semi").select(*every.columns), "segments")  # a hot key can be split
    discard(every)
    discard(met)
    release(spark)
    out = _ranges_in(docs, occurrences, length, gram, word, chunk, hot, levels)
    if within is not None:
        discard(docs)
        release(spark)
    return out


def _ranges_in(docs: DataFrame, occurrences: DataFrame, length: int, gram: int, word: int, chunk: int, hot: int, levels: int, level: int = 1) -> DataFrame:
    """_x_row, ranges of docs, whose segments are `occurrences` (deleted here). Keys that are hot are split by the hashes of `level`."""
    spark = docs.sparkSession
    contents = materialise(_contents(occurrences, length), "contents")
    release(spark)
    several = contents.filter("different > 1").withColumn("hot", F.lit(level <= levels) & (F.col("size") > hot))
    parts = _parts(several.select(*_NAME, "hot", "one._x_row", "one.start"))
    cut = docs.select("_x_row", "text").join(parts, "_x_row").mapInPandas(_fetcher(length), "key bigint, h1 bigint, n int, hot boolean, data binary")
    cut = materialise(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    release(spark)
    found = cut.filter("NOT hot").select(*_NAME, "data").repartition("key").sortWithinPartitions("key").mapInPandas(
        _finder(length, word, chunk), "key bigint, h1 bigint, n int, ranges array<struct<a:int,b:int>>"
    )
    found = materialise(found, "found")
    release(spark)
    made, known = [occurrences, contents, cut, found], found
    if not several.filter("hot").isEmpty():
        pieces = cut.filter("hot").select(F.col("piece").alias("_x_row"), *_NAME, F.col("data").alias("text"))
        finer_ones = materialise(pieces.select("_x_row", "key", "text").mapInPandas(_refiner(length, gram, level, levels), _OCCURRENCE), "segments")
        inner = _ranges_in(pieces.select("_x_row", "text"), finer_ones, length, gram, word, chunk, hot, levels, level + 1)
        split = pieces.select("_x_row", *_NAME).join(inner, "_x_row").select(*_NAME, F.col("ranges").cast("array<struct<a:int,b:int>>").alias("ranges"))
        known = found.unionByName(split)
        made.append(inner)
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))).alias("ranges")
    copies = contents.filter("times > 1").select(*_NAME, whole)
    single = known.join(contents.filter("times > 1").select(*_NAME), list(_NAME), "left_anti")
    ranges = occurrences.join(single.unionByName(copies).drop("n"), ["key", "h1"])
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    out = materialise(ranges.groupBy("_x_row").agg(F.flatten(F.collect_list(moved)).alias("ranges")), "ranges")
    for t in made:
        discard(t)
    release(spark)
    return out


def removed(size: int, ranges, length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal runs of covered bytes, as (start, end)."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"] + length) for r in (ranges if ranges is not None else ())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def _keep(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _numbered(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    whole = docs.withColumn("_x_row", F.monotonically_increasing_id())
    return whole, whole.select("_x_row", F.col(f"`{text}`").alias("text"))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", passage: int = PASSAGE, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document, and n_passages and passage_bytes: the maximal runs of bytes
    that repeated strings of `passage` bytes cover, which the text keeps unless they are in longer ones."""
    length = options.get("length", LENGTH)
    whole, plain = _numbered(docs, text)
    if passage >= length:
        raise ValueError("passage must be below length")
    shorter = repeated_ranges(plain, **options | {"length": passage})
    ranges = repeated_ranges(plain, **options, within=shorter, inner=passage)
    df = whole.select("_x_row", F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    df = df.join(shorter.withColumnRenamed("ranges", "shorter"), "_x_row", "left").join(ranges, "_x_row", "left")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, t, r, q in pdf[["doc_id", "text", "ranges", "shorter"]].itertuples(index=False, name=None):
                data = _bytes(t)
                spans, short = removed(len(data), r, length), removed(len(data), q, passage)
                sizes = [sum(b - a for a, b in x) for x in (spans, short)]
                out.append((doc, len(data), sizes[0], len(spans), hashlib.sha256(_keep(data, spans)).hexdigest(), len(short), sizes[1]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in form.split(", ")])

    form = "doc_id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, passage_bytes bigint"
    out = df.select("doc_id", "text", "ranges", "shorter").mapInPandas(finish, form)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def remove_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with the repeated bytes cut out of text; a character of which only a part is left goes, too."""
    length = options.get("length", LENGTH)
    whole, plain = _numbered(docs, text)
    ranges = repeated_ranges(plain, **options)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for t, r in zip(texts, ranges, strict=True):
            if r is None or not len(r):
                out.append(t)
            else:
                data = _bytes(t)
                out.append(_keep(data, removed(len(data), r, length)).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    df = whole.join(ranges.withColumnRenamed("ranges", "_x_ranges"), "_x_row", "left")
    return df.select(*[clean(F.col(f"`{text}`"), F.col("_x_ranges")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
