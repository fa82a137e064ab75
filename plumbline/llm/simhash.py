"""SimHash near-duplicates with BK-trees over shards of fingerprints.

A text's fingerprint is the bitwise majority over the 64-bit hashes of its word shingles. Two fingerprints that differ in at
most RADIUS = 2 of 64 bits agree in two of four blocks of 16 bits, so the distinct fingerprints are dealt into six families of
shards keyed by two blocks; a shard of more than LARGE fingerprints is dealt again by two of the four bytes that are left, after
which 48 bits are fixed and a shard has at most 2^16 members. In each shard a BK-tree (children keyed by their integer Hamming
distance to the parent) is searched along the edges within the radius. What it finds is joined in a forest, so a shard
of n members gives fewer than n edges, never all pairs. Trees travel with their shard, not by broadcast: their number grows
with the corpus and has no bound.

`similar` is the same for sets of words: five-word shingles, a wide radius, and links only where the exact Jaccard similarity is
UP / DOWN = 0.8 or more. No blocks of a fingerprint are equal at such a distance, so shards are keyed by the least shingles
instead: TABLES keys of three shingles each, the least under as many orders. A linked pair shares none of them with a probability
of 0.488 ** TABLES = 1e-5 at similarity 0.8 and less above. In each shard a BK-tree finds what lies within WIDE bits; at 0.8 the
expected distance is 9.7 bits, and sets of fewer than FEW shingles, whose fingerprints are noisy, are not held to a distance. Pairs
are sifted by their sets' 16-bit hashes (what is in one set of hashes only stands for different shingles that are in one set only, so
no link is lost), then verified on whole sets. A group of copies costs its size: each cluster of a shard is compared with its centre
first (the member nearest to the bitwise majority), and only what is in different components by then is compared further, inside the
shard, of which none but sifted pairs come out. Shards of more than LARGE members are never gathered: their centres are aggregates, and
what their centre left out meets the others in blocks.

Defined cases: a null or empty text has fingerprint zero and links like any other; texts shorter than a shingle are one shingle;
a bit set in exactly half of the hashes is 0; copies share a fingerprint and thus a component; repeated rows and rows with equal
doc_id each keep their own row; a null doc_id never names a component unless all of its rows are null; an empty table gives an
empty table. For `similar`, null and empty texts are empty sets and linked with each other alone. Equality of shingles rests on 64-bit
hashes, of sets on 128 bits. docs must be a stored table where rows are numbered by scan order. Working columns carry a
leading ``_s_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, release
from .components import components

RADIUS, SHINGLE, SEED, LARGE = 2, 3, 42, 512
#: Of `similar`: words in a shingle, least similarity as UP / DOWN, keys of each document, bits of radius.
WORDS, UP, DOWN, TABLES, WIDE, TIGHT, FEW = 5, 4, 5, 16, 24, 8, 40
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    elif shingle == 3:
        parts = [b"%b %b %b" % w for w in zip(words, words[1:], words[2:], strict=False)]
    else:
        parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    digest = xxhash.xxh64_intdigest
    n = len(parts)
    hashes = np.fromiter((digest(p, seed) for p in parts), np.uint64, n).view(np.uint8).reshape(n, 8)
    if n < 200:
        ones = np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0)
    else:
        ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
        yield pd.Series(out.view(np.int64))


class BKTree:
    """Fingerprints under Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                return
            at = self.children[at][d]

    def within(self, value: int, radius: int = RADIUS) -> list[int]:
        """Places of all members within the radius."""
        found, open_ = [], [0] if self.values else []
        values, children = self.values, self.children
        while open_:
            at = open_.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children[at].items():
                if d - radius <= edge <= d + radius:
                    open_.append(child)
        return found


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (member, root) that connect what is within the radius, transitively."""
    if len(values) == 2:
        return [(values[1], values[0])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, up = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        edges = [e for members in pdf["members"] for e in forest(np.sort(np.asarray(members, np.int64).view(np.uint64)).tolist())]
        yield pd.DataFrame(np.array(edges, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


def _pairs_of(value, width: int) -> list:
    """Keys of two of four blocks of `width` bits, each with the number of its pair."""
    part = [F.shiftrightunsigned(value, width * k).bitwiseAND(F.lit((1 << width) - 1)) for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return [F.struct(F.lit(n).alias("n"), (part[i] * F.lit(1 << width) + part[j]).alias("k")) for n, (i, j) in enumerate(pairs)]


def _left_over(value, pair) -> object:
    """The 32 bits of the two blocks that are not in the pair."""
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    out = F.lit(None).cast("bigint")
    block = lambda k: F.shiftrightunsigned(value, 16 * k).bitwiseAND(F.lit(0xFFFF))
    for n, p in enumerate(pairs):
        i, j = (k for k in range(4) if k not in p)
        out = F.when(pair == n, block(i) * F.lit(1 << 16) + block(j)).otherwise(out)
    return out


def link(nodes: DataFrame, large: int = LARGE) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints `fp` of nodes: their transitive closure is that of all links."""
    keyed = nodes.select("fp", F.explode(F.array(*_pairs_of(F.col("fp"), 16))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    keyed = keyed.join(sizes, "key")
    plain = keyed.filter(F.col("size") <= large).groupBy("key").agg(F.collect_list("fp").alias("members")).select("members")
    again = keyed.filter(F.col("size") > large).select(
        "fp", "key", F.explode(F.array(*_pairs_of(_left_over(F.col("fp"), F.col("key.n")), 8))).alias("sub")
    )
    again = again.groupBy("key", "sub").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1).select("members")
    return plain.union(again).mapInPandas(_link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", large: int = LARGE) -> DataFrame:
    """_s_row, doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id of the component), keeper (Boolean).

    _s_row is the row's number in docs as scanned, so docs must be a stored table if it is used. Each component has one keeper:
    the row of the smallest doc_id, nulls last, of these the first.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_s_row"), F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text)).alias("fp"))
    rows = materialise(rows, "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_s_row")
    nodes = materialise(rows.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    roots = components(link(nodes, large))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    named = named.join(best, "root").select("fp", "best")
    return rows.join(named, "fp").select(
        "_s_row", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"), (F.col("_s_row") == F.col("best._s_row")).alias("keeper"),
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, a stored table, with one row of each component, columns unchanged."""
    keep = near_duplicates(docs, text, doc_id).filter("keeper").select("_s_row")
    return docs.withColumn("_s_row", F.monotonically_increasing_id()).join(keep, "_s_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


# --- links by the similarity of sets ----------------------------------------------------------------------------------

_ORDERS = np.random.default_rng(20240611).integers(1, 2**63, 3 * TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a text shorter than a shingle is one, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    digest = xxhash.xxh64_intdigest
    return np.sort(np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts)))


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of 64-bit numbers."""
    bits = hashes.astype("<u8").view(np.uint8).reshape(len(hashes), 8)
    ones = np.concatenate([np.bincount(bits[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _keys(h: np.ndarray) -> np.ndarray:
    """One key for each table: the three least shingles under three orders."""
    least = np.full(len(_ORDERS), np.uint64(2**64 - 1))
    for k in range(0, len(h), 4096):
        some = h[k : k + 4096, None] * _ORDERS
        np.minimum(least, (some ^ (some >> np.uint64(32))).min(axis=0), out=least)
    three = least.reshape(TABLES, 3)
    key = (three[:, 0] * _ORDERS[0] + three[:, 1]) * _ORDERS[1] + three[:, 2] + np.arange(TABLES, dtype=np.uint64)
    return key ^ (key >> np.uint64(31))


def _short(h: np.ndarray) -> np.ndarray:
    """The different 16-bit hashes of a set, in order."""
    return np.unique((h >> np.uint64(20)).astype(np.uint16))


def _allowed(n, m, short_n, short_m, shared):
    """Whether sets of n and m shingles can be linked if their 16-bit hashes share so many."""
    least = -(-UP * (n + m) // (UP + DOWN))
    return (np.minimum(n, m) * DOWN >= np.maximum(n, m) * UP) & (short_n + short_m - 2 * shared <= n + m - 2 * least)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["_s_row", "doc_id", "h1", "h2", "n", "fp", "keys", "short"]
    for pdf in batches:
        out = []
        for row, doc, text in pdf[["_s_row", "doc_id", "text"]].itertuples(index=False, name=None):
            h = shingles(text)
            name = xxhash.xxh3_128_intdigest(h.tobytes())
            fp, h1, h2 = np.array([_majority(h) if len(h) else 0, name >> 64, name & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64).tolist()
            out.append((row, doc, h1, h2, len(h), fp, (_keys(h) if len(h) else h).view(np.int64), _short(h).tobytes()))
        yield pd.DataFrame(out, columns=columns)


def _root(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


class _Shard:
    """Members of one shard with their BK-tree, which is built over different fingerprints."""

    def __init__(self, members) -> None:
        column = lambda k, t: np.array([m[k] for m in members], t)
        self.node, self.n = column("node", np.int64), column("n", np.int64)
        self.fp = column("fp", np.int64).view(np.uint64)
        self.values, self.of = np.unique(self.fp, return_inverse=True)
        self.tree = BKTree()
        for v in self.values.tolist():
            self.tree.add(v)
        self.order = np.argsort(self.of, kind="stable")
        self.bounds = np.searchsorted(self.of[self.order], np.arange(len(self.values) + 1))
        self.shared = None

    def within(self, i: int, radius: int) -> np.ndarray:
        """Members whose fingerprint is within the radius of member i's and whose number of shingles allows a link."""
        if min(self.n[i], self.n.min()) < FEW:
            near = np.arange(len(self.n))
        else:
            places = self.tree.within(int(self.fp[i]), radius)
            near = np.concatenate([self.order[self.bounds[k] : self.bounds[k + 1]] for k in places])
        m = self.n[near]
        return near[np.minimum(m, self.n[i]) * DOWN >= np.maximum(m, self.n[i]) * UP]

    def read(self, members, rows: np.ndarray) -> None:
        """Count the 16-bit hashes that each of these rows shares with each member."""
        short = [np.frombuffer(m["short"], np.uint16) for m in members]
        self.short_n = np.array([len(x) for x in short])
        member, value = np.repeat(np.arange(len(short)), self.short_n), np.concatenate(short)
        self.place = {int(i): k for k, i in enumerate(rows)}
        self.shared = np.zeros((len(rows), len(short)), np.float32)
        values, column = np.unique(value, return_inverse=True)
        order = np.argsort(column, kind="stable")
        member, column = member[order], column[order]
        for c in range(0, len(values), 4096):  # bounded memory
            a, b = np.searchsorted(column, [c, c + 4096])
            there = np.zeros((len(short), min(4096, len(values) - c)), np.float32)
            there[member[a:b], column[a:b] - c] = 1
            self.shared += there[rows] @ there.T

    def sifted(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that member i, one of the rows that were read, can be linked with."""
        shared = self.shared[self.place[int(i)], others]
        return others[_allowed(self.n[i], self.n[others], self.short_n[i], self.short_n[others], shared)]

    def centres(self) -> list[tuple[int, np.ndarray]]:
        """For each cluster within TIGHT bits the member nearest to the majority, and the others."""
        up = list(range(len(self.values)))
        for k, v in enumerate(self.values.tolist()):
            for j in self.tree.within(v, TIGHT):
                a, b = _root(up, k), _root(up, j)
                up[max(a, b)] = min(a, b)
        cluster = np.array([_root(up, k) for k in range(len(up))])[self.of]
        out = []
        for c in np.unique(cluster):
            at = np.nonzero(cluster == c)[0]
            if len(at) > 1:
                far = np.bitwise_count(self.fp[at] ^ np.uint64(_majority(self.fp[at])))
                best = np.lexsort((self.node[at], far))[0]
                out.append((int(at[best]), np.delete(at, best)))
        return out


def _frame(pairs: list[np.ndarray]) -> pd.DataFrame:
    both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    return pd.DataFrame(np.sort(both, axis=1), columns=["a", "b"])


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pairs = []
        for members in pdf["members"]:
            s = _Shard(members)
            for c, others in s.centres():
                ok = others[np.minimum(s.n[others], s.n[c]) * DOWN >= np.maximum(s.n[others], s.n[c]) * UP]
                pairs.append(np.column_stack([s.node[ok], np.full(len(ok), s.node[c])]))
        yield _frame(pairs)


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sifted pairs within the radius, of different components, at least one of them on side 1 (left out by the centre)."""
    for pdf in batches:
        pairs, size = [], 0
        for members in pdf["members"]:
            s = _Shard(members)
            root = np.array([m["root"] for m in members], np.int64)
            side = np.array([m["side"] for m in members], np.int64)
            rows = np.nonzero(side == 1)[0]
            for i in rows:
                j = s.within(i, WIDE)
                j = j[(root[j] != root[i]) & ((side[j] == 0) | (j < i))]
                if len(j):
                    if s.shared is None:
                        s.read(members, rows)
                    j = s.sifted(i, j)
                    pairs.append(np.column_stack([s.node[j], np.full(len(j), s.node[i])]))
                    size += len(j)
                if size > 500_000:
                    yield _frame(pairs)
                    pairs, size = [], 0
        yield _frame(pairs)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"node": pdf["_s_row"], "set": [shingles(t).tobytes() for t in pdf["text"]]})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for x, y in zip(pdf["x"], pdf["y"], strict=True):
            both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(DOWN * shared >= UP * (len(both) - shared))
        yield pdf.loc[np.array(keep, bool), ["a", "b"]]


def _sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n, m = pdf["n_a"].to_numpy(np.int64), pdf["n_b"].to_numpy(np.int64)
        x, y = ([np.frombuffer(v, np.uint16) for v in pdf[c]] for c in ("short_a", "short_b"))
        shared = np.array([len(p) + len(q) - len(np.union1d(p, q)) for p, q in zip(x, y, strict=True)], np.int64)
        ok = _allowed(n, m, np.array([len(v) for v in x], np.int64), np.array([len(v) for v in y], np.int64), shared)
        yield pdf.loc[ok, ["a", "b"]]


def _sifted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose 16-bit hashes allow a link."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("short").alias(f"short_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_sift, "a bigint, b bigint")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, sift: bool = True) -> DataFrame:
    """The linked of candidate pairs (a, b)."""
    pairs = materialise(_sifted(pairs.distinct(), nodes) if sift else pairs.distinct(), "candidates")
    ids = pairs.select(F.col("a").alias("_s_row")).union(pairs.select("b")).distinct()
    sets = materialise(docs.join(ids, "_s_row", "left_semi").mapInPandas(_sets, "node bigint, set binary"), "sets")
    release(docs.sparkSession)
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    out = materialise(both.select("a", "b", "x", "y").mapInPandas(_verify, "a bigint, b bigint"), "links")
    discard(sets)
    discard(pairs)
    release(docs.sparkSession)
    return out


def _apart(x, y):
    return F.bit_count(x.bitwiseXOR(y))


def _crowd_centres(crowd: DataFrame) -> DataFrame:
    """key, centre, centre_n: the member of each key that is nearest to the bitwise majority; two aggregations."""
    ones = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(f"o{b}") for b in range(64)]
    bits = crowd.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *ones)
    whole = F.lit(0).cast("bigint")
    for b in range(64):
        whole = whole.bitwiseOR(F.when(F.col(f"o{b}") * 2 > F.col("m"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    middle = bits.select("key", whole.alias("middle"))
    best = F.min(F.struct(_apart(F.col("fp"), F.col("middle")).alias("d"), "node", "n")).alias("best")
    return crowd.join(middle, "key").groupBy("key").agg(best).select("key", F.col("best.node").alias("centre"), F.col("best.n").alias("centre_n"))


def _blocks(crowd: DataFrame, roots: DataFrame, centres: DataFrame, large: int) -> DataFrame:
    """Members of crowded keys, dealt in blocks: each block of those that their centre left out meets each block of all."""
    named = crowd.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    middle = centres.join(roots, centres["centre"] == roots["node"], "left").select("key", F.coalesce("root", "centre").alias("centre_root"))
    named = named.join(middle, "key").withColumn("out", F.col("root") != F.col("centre_root"))
    counts = named.filter("out").groupBy("key").agg(F.count(F.lit(1)).alias("outside"))
    named = named.join(counts, "key")
    rows, columns = F.ceil(F.col("size") / large).cast("int"), F.ceil(F.col("outside") / large).cast("int")
    salt = lambda k: F.pmod(F.xxhash64("node", F.lit(7)), k).cast("int")
    every = named.select("key", "node", "n", "fp", "root", F.lit(0).alias("side"), salt(rows).alias("i"), F.explode(F.sequence(F.lit(0), columns - 1)).alias("j"))
    left_out = named.filter("out").select("key", "node", "n", "fp", "root", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"), salt(columns).alias("j"))
    return every.union(left_out)


def links(nodes: DataFrame, docs: DataFrame, large: int = LARGE) -> DataFrame:
    """Links (a, b) between different sets (node, n, fp, keys, short): their transitive closure is that of all links."""
    dealt = materialise(nodes.filter("n > 0").select("node", "n", "fp", F.explode("keys").alias("key")), "dealt")
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = materialise(dealt.join(sizes, "key"), "met")
    discard(dealt)
    release(docs.sparkSession)
    small, crowd = met.filter(F.col("size") <= large), met.filter(F.col("size") > large)
    whole = F.collect_list(F.struct("node", "n", "fp")).alias("members")
    first = small.groupBy("key").agg(whole).select("members").mapInPandas(_stars, "a bigint, b bigint")
    crowded = not crowd.isEmpty()
    if crowded:
        centres = materialise(_crowd_centres(crowd), "centres")
        near = (F.least("n", "centre_n") * DOWN >= F.greatest("n", "centre_n") * UP) & (F.col("node") != F.col("centre"))
        spokes = crowd.join(centres, "key").filter(near)
        first = first.union(spokes.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")))
    found = _verified(first, nodes, docs)
    roots = components(found)
    rooted = small.join(roots, "node", "left").select("key", "node", "n", "fp", F.coalesce("root", "node").alias("root"), F.lit(1).alias("side"))
    split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    dealt = rooted.join(split, "key").select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    if crowded:
        blocks = _blocks(crowd, roots, centres, large)
        dealt = dealt.union(blocks.select(*dealt.columns))
    members = F.collect_list(F.struct("node", "n", "fp", "root", "side", "short")).alias("members")
    rest = dealt.join(nodes.select("node", "short"), "node").groupBy("key", "i", "j").agg(members).select("members")
    more = _verified(rest.mapInPandas(_across, "a bigint, b bigint"), nodes, docs, sift=False)
    discard(met)
    return found.union(more)


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", large: int = LARGE) -> DataFrame:
    """_s_row, doc_id, component_id (smallest doc_id of the component), keeper (Boolean), as near_duplicates() has them."""
    plain = docs.select(F.monotonically_increasing_id().alias("_s_row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    form = f"_s_row bigint, doc_id {docs.schema[doc_id].dataType.simpleString()}, h1 bigint, h2 bigint, n int, fp bigint, keys array<bigint>, short binary"
    rows = materialise(plain.mapInPandas(_sketch, form), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_s_row")
    names = materialise(rows.groupBy("h1", "h2").agg(F.min(first).alias("first"), F.min("_s_row").alias("node")), "names")
    nodes = rows.join(names.select(F.col("node").alias("_s_row")), "_s_row", "left_semi")
    nodes = materialise(nodes.select(F.col("_s_row").alias("node"), "n", "fp", "keys", "short"), "nodes")
    roots = components(links(nodes, plain, large))
    named = names.join(roots, "node", "left").select("h1", "h2", "first", F.coalesce("root", "node").alias("root"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    named = named.join(best, "root").select("h1", "h2", "best")
    return rows.select("_s_row", "doc_id", "h1", "h2").join(named, ["h1", "h2"]).select(
        "_s_row", "doc_id", F.col("best.doc_id").alias("component_id"), (F.col("_s_row") == F.col("best._s_row")).alias("keeper")
    )


def deduplicate_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, a stored table, with one row of each component of `similar`, columns unchanged."""
    keep = similar(docs, text, doc_id).filter("keeper").select("_s_row")
    return docs.withColumn("_s_row", F.monotonically_increasing_id()).join(keep, "_s_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
