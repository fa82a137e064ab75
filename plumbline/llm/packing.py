"""Lexical retrieval packing: each window is seeded by a document and filled with its nearest unused neighbours by BM25.

Documents are tokenised once, where they lie. What fills whole windows is cut off there; the remainders, of less than a window each,
are stored with their ids, and the number of remainders that hold each token is counted over the whole corpus: as many figures as
the tokenizer has tokens, whatever the corpus. Each remainder is keyed by the KEYS tokens that a weighted min-hash picks, a token
the likelier the later the tokenizer learnt it (frequent ones come first), and the remainders are range-partitioned and sorted by
these keys, the row last. So remainders that share rare tokens lie side by side whatever the corpus's size, and a crowd of copies is dealt over as
many partitions as it needs.

A partition is read as a stream and cut into shards of about SHARD_BYTES. A shard builds an inverted BM25 index over its remainders,
with the frequencies of the whole corpus. Seeds are taken from the longest down. A seed's rarest terms are looked up, and its unused
neighbours fill the window greedily, best first; the last to be taken is cut where the window ends, and what is left of it stays in
the pool. So all sequences but a shard's last few are full; those are split into powers of two, which need no padding.

Defined cases: a null text is empty, and an empty text is the end token alone; documents of any length are cut, each token lies
in one piece; equal scores are taken in the order of the shard; repeated rows are packed each on its own; a null doc_id stays
null; an empty table gives an empty table. Working columns carry a leading ``_p_``.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

WINDOW, END, SHARD_BYTES = 4096, 2, 8_000_000
#: Tokens of a remainder that say where it is dealt, most telling first.
KEYS = 4
K1, B, QUERY_TERMS, COMMON = 1.2, 0.75, 24, 0.1
TOKENIZER = "word_bpe_49k.json"
_CACHED, _CACHED_CHARS = 900_000, 48
#: Characters that the tokenizer gets at once: it takes some hundred bytes for each.
_LEARNT_CHARS = 50_000
#: Characters of the texts whose chunks are looked up together, and bytes of the texts that are held with their ids.
_AT_ONCE = 2_000_000
#: Signs that are a piece of their own after a word, and share it with no other kind of character.
_SIGNS = "!#$%&*"
#: Between a letter and a full stop or comma, a space changes no token of this tokenizer.
_BREAK = re.compile("[.,](?<=[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff][.,])")
#: Where a full stop or comma follows anything but an ASCII letter or digit, a Latin-1 letter or white space: it may share a token with that.
_JOINED = re.compile("[^0-9a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff \t\n\r\x0b\x0c][.,]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _lowers_by_character(text: str) -> bool:
    """Latin-1 alone: there, lower() changes each character by itself, as the tokenizer does."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Merger:
    """Byte-pair merges of many words at once, by the merges of the tokenizer's own file.

    A word's symbols start as its bytes, the last with the end mark. Each round merges, in every word, the leftmost of its pairs of
    the lowest rank, as the tokenizer does one word at a time. A merge takes one symbol away from each word that goes on, and
    only the pairs beside the new symbol are looked up.
    """

    _NONE = np.int64(1 << 30)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        # Bytes that stand for themselves; the others take the code points from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.first = np.array([vocabulary[letters[b]] for b in range(256)])
        self.last = np.array([vocabulary[letters[b] + end] for b in range(256)])
        self.size = len(vocabulary)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs])
        made = np.array([vocabulary[a + b] for a, b in pairs])
        self.mask = (1 << (2 * len(pairs)).bit_length() + 1) - 1
        self.slots, self.ranks, self.made = np.full(self.mask + 1, -1), np.full(self.mask + 1, self._NONE), made
        todo, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):  # open addressing: of those that want an empty slot, one gets it
            self.probes += 1
            self.slots[at] = np.where(self.slots[at] < 0, keys[todo], self.slots[at])
            got = self.slots[at] == keys[todo]
            self.ranks[at[got]] = todo[got]
            todo, at = todo[~got], (at[~got] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 2654435761) >> 13) & self.mask

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.slots[at] == keys, self.ranks[at], self._NONE)
        open_ = np.nonzero((self.slots[at] != keys) & (self.slots[at] >= 0))[0]
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            found = self.slots[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self._rank(left * np.int64(self.size) + right)

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of one or more bytes, as little-endian unsigned numbers of 32 bits."""
        out: dict[bytes, bytes] = {}
        words = sorted(words, key=len)
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            sizes = np.array([len(w) for w in some])
            width = int(sizes[-1])
            raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in some), np.uint8).reshape(len(some), width)
            columns = np.arange(width)
            ids = np.where(columns < (sizes - 1)[:, None], self.first[raw], np.where(columns == (sizes - 1)[:, None], self.last[raw], -1)).astype(np.int32)
            live, rounds = np.arange(len(some)), 0
            ranks = np.full((len(some), width), self._NONE, np.int32)  # of each symbol with the next; the last column never has a pair
            there = np.nonzero(ids[:, 1:] >= 0)
            ranks[there] = self._rank_of(ids[there], ids[:, 1:][there])
            while len(live):
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(live)), at]
                go = best < self._NONE
                if not go.all():
                    for k, row in zip(live[~go].tolist(), ids[~go].astype("<u4"), strict=True):
                        out[some[k]] = row[: sizes[k] - rounds].tobytes()
                    live, ids, ranks, at, best = live[go], ids[go], ranks[go], at[go], best[go]
                    if not len(live):
                        break
                rounds += 1
                rows, n = np.arange(len(live)), ids.shape[1] - 1
                ids[rows, at] = self.made[best]
                stays = np.ones(ids.shape, bool)
                stays[rows, at + 1] = False
                ids, ranks = ids[stays].reshape(-1, n), ranks[stays].reshape(-1, n)
                left = np.nonzero(at > 0)[0]
                ranks[left, at[left] - 1] = self._rank_of(ids[left, at[left] - 1], ids[left, at[left]])
                ranks[rows, at] = self._NONE
                right = np.nonzero(at + 1 < n)[0]
                right = right[ids[right, at[right] + 1] >= 0]
                ranks[right, at[right]] = self._rank_of(ids[right, at[right]], ids[right, at[right] + 1])
        return out


class Encoder:
    """Token ids of whole texts. Chunks between spaces are encoded once and remembered, as this tokenizer drops white space."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.merger = Merger(path or tokenizer_path())
        self.tokens = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        said = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        start = np.cumsum([0, *(len(c) + 1 for c in chunks)])
        ids = said.ids
        where = np.fromiter(map(itemgetter(0), said.offsets), np.int64, len(ids))
        raw, cut = np.array(ids, "<u4").tobytes(), (4 * np.searchsorted(where, start, "left")).tolist()
        return {c: raw[a:b] for c, a, b in zip(chunks, cut[:-1], cut[1:], strict=True)}

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """The ids of different chunks; what wasn't known is learnt."""
        if len(self.known) > _CACHED:
            self.known.clear()
        known = self.known
        out = list(map(known.get, chunks))  # once for each chunk: lookups in so large a table are what this waits for
        missing = [c for c, ids in zip(chunks, out, strict=True) if ids is None and c]
        learnt = {"": b""}
        # Lower-case Latin-1 words are one piece to the tokenizer, and stay as they are: their merges are done together. So are
        # signs after a word.
        simple, tails, todo = {}, [], []
        for c in missing:
            word = c.rstrip(_SIGNS)
            if word and len(c) <= _CACHED_CHARS and word.isalpha() and word == word.lower() and _lowers_by_character(word):
                simple[word] = word.encode()
                if word != c:
                    tails.append((c, word, c[len(word) :]))
            else:
                todo.append(c)
        todo = sorted({*todo, *{t for _, _, t in tails}.difference(known)})
        learnt.update((w, known[w]) for w in simple.keys() & known.keys())
        words = {w: b for w, b in simple.items() if w not in learnt}
        ids_of = self.merger.encode(list(words.values()))
        learnt.update(zip(words, map(ids_of.__getitem__, words.values()), strict=True))
        at = 0
        while at < len(todo):
            some, size = [], 0
            while at < len(todo) and size < _LEARNT_CHARS:
                some.append(todo[at])
                size += len(todo[at]) + 1
                at += 1
            learnt.update(self._learn(some))
        learnt.update((c, learnt[w] + (known[t] if t in known else learnt[t])) for c, w, t in tails)
        known.update((c, ids) for c, ids in learnt.items() if c and len(c) <= _CACHED_CHARS)
        return [learnt[c] if ids is None else ids for c, ids in zip(chunks, out, strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian and unsigned of 32 bits."""
        out, some, size = [], [], 0
        for t in texts:
            t = t or ""
            t = t.lower() if _lowers_by_character(t) else t
            t = _BREAK.sub(r" \g<0>", t) if _JOINED.search(t) else t.replace(",", " ,").replace(".", " .")
            some.append(t.replace("\n", " "))
            size += len(t)
            if size > _AT_ONCE:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some) if some else out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The different chunks of all texts are looked up once, and their ids put in the places of the chunks."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        ids_of = pa.array(self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        _, ends, raw = ids_of.take(coded.indices).buffers()
        cut = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        raw = memoryview(raw) if raw is not None else b""
        return [bytes(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _idf(df: np.ndarray, pieces: int) -> np.ndarray:
    return np.log1p((pieces - df + 0.5) / (df + 0.5))


def _telling(df: np.ndarray, pieces: int) -> np.ndarray:
    return (df >= 2) & (df <= max(2, COMMON * pieces))


class Index:
    """BM25 over the pieces of a shard; terms in more than COMMON of all pieces, or in one alone, aren't indexed.

    `known` is the number of pieces that hold each token, of how many pieces, and their mean length; by default those of `pieces`.
    """

    def __init__(self, pieces: list[np.ndarray], known: tuple[np.ndarray, int, float] | None = None):
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        tokens = np.concatenate(pieces).astype(np.int64) if n else np.zeros(0, np.int64)
        tokens *= n
        tokens += np.repeat(np.arange(n), sizes)
        key, tf = np.unique(tokens, return_counts=True)
        del tokens
        term, piece = key // max(n, 1), key % max(n, 1)
        self.terms, first, here = np.unique(term, return_index=True, return_counts=True)
        df, of, mean = (known[0][self.terms], known[1], known[2]) if known else (here, n, sizes.mean() if n else 1)
        self.first, self.df = first, here
        self.idf = np.where(_telling(df, of), _idf(df, of), 0)
        self.piece = piece
        per = np.repeat(np.arange(len(self.terms)), here)
        norm = tf + K1 * (1 - B + B * sizes[piece] / max(mean, 1))
        self.weight = (self.idf[per] * tf * (K1 + 1) / norm).astype(np.float32)
        order = np.argsort(piece, kind="stable")  # the terms of each piece
        self.of_piece, self.tf = per[order], tf[order]
        self.bounds = np.searchsorted(piece[order], np.arange(n + 1))
        self.n = n

    def neighbours(self, piece: int) -> np.ndarray:
        """Pieces that share a query term, best first, ties by number."""
        a, b = self.bounds[piece], self.bounds[piece + 1]
        terms = self.of_piece[a:b]
        worth = self.idf[terms] * self.tf[a:b]
        best = np.argsort(-worth, kind="stable")[:QUERY_TERMS]
        best = terms[best[worth[best] > 0]]
        if not len(best):
            return np.zeros(0, np.int64)
        spans = [slice(self.first[t], self.first[t] + self.df[t]) for t in best]
        score = np.bincount(np.concatenate([self.piece[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        found = np.nonzero(score)[0]
        return found[np.argsort(-score[found], kind="stable")]


def fill(sizes: list[int], index: Index, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start in it, length) that use every piece of fewer than `window` tokens up."""
    n = len(sizes)
    at, left = np.zeros(n, np.int64), np.array(sizes, np.int64)
    order = np.argsort(-left, kind="stable")
    done, now, room = [], [], window
    cursor = 0

    def take(i: int) -> None:
        nonlocal room
        k = min(int(left[i]), room)
        now.append((i, int(at[i]), k))
        at[i] += k
        left[i] -= k
        room -= k

    while True:
        while cursor < n and not left[order[cursor]]:
            cursor += 1
        if cursor == n:
            break
        seed = int(order[cursor])
        take(seed)
        if room:
            near = index.neighbours(seed)
            for i in near[left[near] > 0]:
                take(int(i))
                if not room:
                    break
        if not room:
            done.append(now)
            now, room = [], window
        # Else the neighbours are used up: the next seed goes on filling this window.
    if now:  # the last window is split into powers of two
        while now:
            total = sum(k for _, _, k in now)
            want, part = 1 << (total.bit_length() - 1), []
            while want:
                i, a, k = now.pop(0)
                if k > want:
                    now.insert(0, (i, a + want, k - want))
                    k = want
                part.append((i, a, k))
                want -= k
            done.append(part)
    return done


def picks(tokens: int) -> np.ndarray:
    """The place of each token in the order in which a weighted min-hash picks them: by an exponential variable whose rate is the token's id."""
    uniform = (pd.util.hash_array(np.arange(tokens, dtype=np.uint64)) >> np.uint64(11)).astype(float) / 2**53
    place = np.empty(tokens, np.int32)
    place[np.argsort(-np.log(uniform + 2.0**-54) / np.arange(1, tokens + 1), kind="stable")] = np.arange(tokens)
    return place


def keys_of(ids: list[bytes], place: np.ndarray) -> list[np.ndarray]:
    """The KEYS first places among the tokens of each piece, lowest first; len(place) where there are no more."""
    if not ids:
        return [np.zeros(0, np.int32)] * KEYS
    sizes = np.array([len(x) // 4 for x in ids])
    at, out = place[np.frombuffer(b"".join(ids), "<u4")], []
    for _ in range(KEYS):
        out.append(np.minimum.reduceat(at, np.cumsum(sizes) - sizes))
        at = np.where(at == np.repeat(out[-1], sizes), np.int32(len(place)), at)
    return out


_COLUMNS = "doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]
_SHARED: dict[str, Encoder] = {}


_STORED = pa.schema(
    [(n, pa.string() if n == "doc_id" else pa.int64()) for n in _NAMES]
    + [("ids", pa.binary()), ("_p_row", pa.int64()), ("_p_held", pa.list_(pa.int64()))]
    + [(f"_p_key{k}", pa.int32()) for k in range(KEYS)]
)


def _slices(batch: pa.RecordBatch, size: int = _AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Rows in a row with about `size` bytes of text, at least one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "left")) + 1
        yield batch.slice(a, b - a)
        a = min(b, batch.num_rows)


def _give_back() -> None:
    """Free memory goes back to the system, which allocators else keep: a Python worker lives on beside its executor and the other workers."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def _tokeniser(path: str | None, window: int, end: int, with_ids: bool):
    """Whole windows as finished pieces; remainders without a sequence, with their ids; at last, the remainders that hold each token."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _SHARED.setdefault(path or "", None) or Encoder(path)
        _SHARED[path or ""] = encoder
        task, done, last = TaskContext.get().partitionId(), 0, end.to_bytes(4, "little")
        tokens = max(encoder.tokens, end + 1)
        place, held, seen = picks(tokens), np.zeros(tokens, np.int64), np.zeros(tokens, np.int64)
        for k in (k for batch in batches for k in _slices(batch)):
            rows, docs, texts = (k.column(c).to_pylist() for c in ("_p_row", "doc_id", "text"))
            whole, rest = [], []
            for doc, row, raw in zip(docs, rows, encoder.encode_all(texts), strict=True):
                raw += last
                n = len(raw) // 4
                for a in range(0, n - window + 1, window):
                    piece = raw[4 * a : 4 * (a + window)]
                    whole.append((doc, a, window, zlib.crc32(piece), n, 2 * ((task << 32) + done), 0, piece if with_ids else None, row))
                    done += 1
                if n % window:
                    rest.append((doc, n - n % window, n % window, None, n, None, None, raw[4 * (n - n % window) :], row))
            ids = [r[7] for r in rest]
            once = [np.zeros(0, np.int64)]
            for x in ids:  # each token of a remainder once, where it stands last
                t = np.frombuffer(x, "<u4")
                at = np.arange(len(t))
                seen[t] = at
                once.append(t[seen[t] == at])
            held += np.bincount(np.concatenate(once), minlength=tokens)
            columns = list(zip(*whole, *rest, strict=True)) if whole or rest else []
            keys = [[None] * len(whole) + x.tolist() for x in keys_of(ids, place)]
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, [None] * len(columns[0]), *keys], _STORED, strict=True)], schema=_STORED)
            del texts, whole, rest, ids, once, columns, keys
            _give_back()
            yield made
        if held.any():
            yield pa.RecordBatch.from_pylist([{"_p_held": held}], schema=_STORED)

    return tokenise


def _packer(known: tuple[np.ndarray, int, float], window: int, shard_bytes: int, with_ids: bool):
    names = ["doc_id", "start", "doc_tokens", "ids"]
    schema = pa.schema([_STORED.field(n) for n in [*_NAMES, *(["ids"] if with_ids else [])]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0

        def shard(docs: list, starts: list[int], tokens: list[int], ids: list[bytes]) -> pa.RecordBatch:
            nonlocal done
            index, out = Index([np.frombuffer(x, "<u4") for x in ids], known), []
            for parts in fill([len(x) // 4 for x in ids], index, window):
                offset = 0
                for i, a, k in parts:
                    raw = ids[i][4 * a : 4 * (a + k)]
                    out.append((docs[i], starts[i] + a, k, zlib.crc32(raw), tokens[i], 2 * ((task << 32) + done) + 1, offset, *([raw] if with_ids else [])))
                    offset += k
                done += 1
            del index
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            _give_back()
            return made

        held: list[list] = [[], [], [], []]  # of a shard that isn't full: no more than that is taken out of a batch at a time
        size = 0
        for batch in batches:
            ends = size + np.cumsum(pc.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64))
            place = ends // shard_bytes
            cuts = [0, *(np.nonzero(np.diff(place))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if place[a] and held[0]:
                    yield shard(*held)
                    held = [[], [], [], []]
                for column, n in zip(held, names, strict=True):
                    column += batch.column(n).slice(a, b - a).to_pylist()
            size = int(ends[-1]) % shard_bytes if len(ends) else size
        if held[0]:
            yield shard(*held)

    return pack


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end: int = END, tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids (binary)."""
    df = docs.select(F.monotonically_increasing_id().alias("_p_row"), F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = _COLUMNS + ", ids binary, _p_row bigint, _p_held array<bigint>" + "".join(f", _p_key{k} int" for k in range(KEYS))
    stored = materialise(df.mapInArrow(_tokeniser(tokenizer, window, end, with_ids), schema), "tokens")
    rest = stored.filter("sequence_id IS NULL AND _p_held IS NULL")
    pieces, tokens = rest.agg(F.count(F.lit(1)), F.sum("length")).first()
    # As many rows as the tokenizer has tokens.
    counts = stored.filter("_p_held IS NOT NULL").select(F.posexplode("_p_held").alias("token", "n")).groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 1, np.int64)
    held[counts["token"]] = counts["n"]
    order = [*(f"_p_key{k}" for k in range(KEYS)), "_p_row"]
    rest = rest.select("doc_id", "start", "doc_tokens", "ids", *order)
    rest = rest.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "start", "doc_tokens", "ids")
    out = rest.mapInArrow(_packer((held, pieces, (tokens or 0) / max(pieces, 1)), window, shard_bytes, with_ids), _COLUMNS + (", ids binary" if with_ids else ""))
    whole = stored.filter("sequence_id IS NOT NULL").select(*out.columns)
    return whole.unionAll(out).withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
