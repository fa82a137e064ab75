"""Benchmark decontamination: a broadcast hash set of test n-grams against the token windows of training documents.

A window is WIDTH consecutive words of a benchmark item (a shorter item is one window). Document windows are hashed where
they stand; those whose first words start no benchmark window are dropped inside the row, the rest meet the set in a join on a
64-bit hash and are verified word by word. While the filter holds, little but hits is shuffled. The set is broadcast while it has at
most BROADCAST_WINDOWS rows and BROADCAST_BYTES bytes, both counted first; beyond that, and this departs from the dealt method, windows
and set are joined by a shuffle, in which every document window that the filter lets through moves: the result is the same.

Defined cases: null and empty texts have no words and no hits; an item without words has no window; an item that occurs in the
set more than once, or twice under one id, counts once per id; an item with a null id can be hit but isn't listed; repeated
documents are judged alike, each on its own; very long texts are searched whole; an empty benchmark hits nothing; columns of docs named
like a column that is made give way. Working columns carry a leading ``_d_``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 10
#: ASCII characters that no word has.
_OTHER = "".join(c for c in map(chr, range(128)) if c not in string.digits + string.ascii_lowercase)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The in-row filter looks at so many words of a window, and holds at most so many of their hashes; with a larger
#: benchmark it lets all windows through to the join.
FILTER_WORDS, FILTER_HASHES = 3, 100_000
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 128_000_000
FOUND = "array<struct<h:bigint,i:int,gram:array<string>>>"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def content_words(text: Column) -> Column:
    """Runs of lower-cased letters, digits and all characters beyond ASCII."""
    inner = F.btrim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_OTHER))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, NOT_WORD))


def _hash(words: Column, i: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, i + k if k else i) for k in range(width)])


def _start(words: Column, i: Column, width: int) -> Column:
    return F.hash(*[F.get(words, i + k if k else i) for k in range(min(width, FILTER_WORDS))])


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """_d_hash, _d_gram (words), _d_items: one row for each distinct window of the benchmark."""
    df = benchmark.select(F.col(item_id).cast("string").alias("_d_item"), content_words(F.col(text)).alias("_d_w"))
    n = F.size("_d_w")
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (width - 1))))
    df = df.select("_d_item", F.explode(F.transform(starts, lambda i: F.slice(F.col("_d_w"), i, F.lit(width)))).alias("_d_gram"))
    return df.groupBy("_d_gram").agg(F.collect_set("_d_item").alias("_d_items"))


def _find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, verify: bool = True) -> DataFrame:
    """docs (without text) with _d_row (the row's number in the scan of docs), _d_n_words, _d_hits and _d_items."""
    grams = benchmark_windows(benchmark, item_id, item_text, width)
    grams = grams.withColumn("_d_n", F.size("_d_gram"))
    # Bounded look at the benchmark: how many windows, which lengths (at most `width`).
    size = F.octet_length(F.array_join("_d_gram", " ")) + F.octet_length(F.array_join("_d_items", " ")) + 100
    about = grams.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.sort_array(F.collect_set("_d_n")).alias("lengths")).first()
    lengths = list(about["lengths"])
    hashed = F.lit(None).cast("bigint")
    for k in lengths:
        hashed = F.when(F.col("_d_n") == k, _hash(F.col("_d_gram"), F.lit(0), k)).otherwise(hashed)
    grams = grams.withColumn("_d_hash", hashed)
    starts = {}
    if about["n"] <= FILTER_HASHES:
        for k in lengths:
            rows = grams.filter(F.col("_d_n") == k).select(_start(F.col("_d_gram"), F.lit(0), k)).distinct().collect()
            starts[k] = [r[0] for r in rows]

    others = [c for c in docs.columns if c != text]
    df = docs.select(*[F.col(f"`{c}`") for c in others], F.monotonically_increasing_id().alias("_d_row"), content_words(F.col(text)).alias("_d_w"))

    def windows(k: int) -> Column:
        w, n = F.col("_d_w"), F.size("_d_w")
        at = F.sequence(F.lit(0), n - k)
        if k in starts:
            at = F.filter(at, lambda i: _start(w, i, k).isin(starts[k]))
        at = F.transform(at, lambda i: F.struct(_hash(w, i, k).alias("h"), i.alias("i"), F.slice(w, i + 1, F.lit(k)).alias("gram")))
        return F.when(n >= k, at).otherwise(F.array().cast(FOUND))

    found = F.concat(*[windows(k) for k in lengths]) if lengths else F.array().cast(FOUND)
    df = df.select(
        *[F.col(f"`{c}`") for c in others], "_d_row", F.size("_d_w").cast("long").alias("_d_n_words"),
        found.alias("_d_f"),
    )
    df = df.select(*[F.col(f"`{c}`") for c in others], "_d_row", "_d_n_words", F.explode_outer("_d_f").alias("_d_x"))
    known = grams.select("_d_hash", "_d_gram", "_d_items")
    small = about["n"] <= BROADCAST_WINDOWS and (about["bytes"] or 0) <= BROADCAST_BYTES
    known = F.broadcast(known) if small else known.hint("merge")
    df = df.join(known, (F.col("_d_x.h") == F.col("_d_hash")) & ((F.col("_d_x.gram") == F.col("_d_gram")) if verify else F.lit(True)), "left")
    hit = F.when(F.col("_d_gram").isNotNull(), F.struct(F.col("_d_x.i").alias("start"), F.size("_d_gram").alias("length")))
    df = df.groupBy("_d_row", *[F.col(f"`{c}`") for c in others], "_d_n_words").agg(
        F.sort_array(F.collect_set(hit)).alias("_d_hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("_d_items")))).alias("_d_items")
    )
    return df


def _named(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """df with columns of these names in place of its own, without working columns."""
    kept = [c for c in df.columns if c not in made and not c.startswith("_d_")]
    return df.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in made.items()])


def find_hits(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs (without text) with n_words, hits (sorted array of struct(start, length), starts from 0) and items (sorted ids)."""
    return _named(_find(docs, benchmark, **options), {k: F.col("_d_" + k) for k in ("n_words", "hits", "items")})


def covered(hits: Column) -> Column:
    """Number of words in the union of hits, which are sorted by start."""
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], x["start"] + x["length"]).alias("end")
    )
    return F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs (without text) with n_words, n_hit, n_items, items_sha256 and contaminated."""
    made = {
        "n_words": F.col("_d_n_words"),
        "n_hit": covered(F.col("_d_hits")).cast("long"),
        "n_items": F.size("_d_items").cast("long"),
        "items_sha256": F.sha2(F.array_join("_d_items", ","), 256),
        "contaminated": F.size("_d_hits") > 0,
    }
    return _named(_find(docs, benchmark, **options), made)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents of a stored table without any hit, with the columns of docs."""
    hit = _find(docs.select(F.col(f"`{text}`")), benchmark, text=text, **options).filter(F.size("_d_hits") > 0).select("_d_row")
    df = docs.withColumn("_d_row", F.monotonically_increasing_id()).join(hit, "_d_row", "left_anti")
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs, a stored table, with the hit words of each text replaced by nothing: its other words, joined by single spaces, if
    anything was hit; untouched else."""
    hits = _find(docs.select(F.col(f"`{text}`")), benchmark, text=text, **options).filter(F.size("_d_hits") > 0).select("_d_row", "_d_hits")
    df = docs.withColumn("_d_row", F.monotonically_increasing_id()).join(hits, "_d_row", "left")
    w = content_words(F.col(f"`{text}`"))
    kept = F.filter(w, lambda x, i: ~F.exists("_d_hits", lambda h: (h["start"] <= i) & (i < h["start"] + h["length"])))
    cleaned = F.when(F.col("_d_hits").isNotNull(), F.array_join(kept, " ")).otherwise(F.col(f"`{text}`"))
    return df.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
