"""Token ids against the tokenizer itself, on random texts of all of Latin-1, separators next to full stops and commas, and beyond."""

import random

import numpy as np
import pytest

from plumbline.llm import packing

WORDS = ["the", "Casa", "été", "naïve", "x1", "1.5", "it's", "don't.", "ÀÉ", "ß", "µ", "ª", "straße", "a_b", "__", "é", "日本", "İ", "ǅ", "Σας", " ", " ", "﻿", "٣", "𝒳", "\U0001f600"]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder()


@pytest.mark.parametrize("seed", range(6))
def test_ids_are_the_tokenizers(encoder, seed):
    rng, texts = random.Random(seed), []
    for _ in range(4000):
        parts = []
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            parts.append(chr(rng.randrange(256)) if r < 0.35 else rng.choice(".,.,;:!' \n\t") if r < 0.6 else rng.choice("abcXYZ019éÉ") if r < 0.8 else rng.choice(WORDS))
            if rng.random() < 0.2:
                parts.append(rng.choice("\x1c\x1d\x1e\x1f\x85\xa0\x00\x0b\x0c\r"))
        texts.append("".join(parts))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = encoder.encode_all(texts)
    wrong = [t for t, w, g in zip(texts, want, got, strict=True) if b"".join(i.to_bytes(4, "little") for i in w) != g]
    assert not wrong, (len(wrong), wrong[:5])


def test_ids_are_looked_up_once_for_each_different_chunk(encoder):
    """Not for every word: lookups in a table of a million words are what encoding at scale waits for."""

    class Counted(dict):
        lookups = 0

        def __getitem__(self, key):
            self.lookups += 1
            return super().__getitem__(key)

    texts = ["some words, again. " * 3000, None, "", " ", "\n", "other words " * 10, "x" * 200 + " some " + "x" * 200]
    encoder.known = Counted()
    got = encoder.encode_all(texts)
    assert encoder.known.lookups < 50
    for t, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_signs_after_words_are_the_tokenizers(encoder):
    rng = random.Random(9)
    heads = ["the", "été", "straße", "ab", "x1", "don't", "", "日本", "ª", "Ünder", "a" * 60, "zqxj" * 3]
    texts = [" ".join(rng.choice(heads) + "".join(rng.choice("!#$%&*,.'-_") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    got = encoder.encode_all(texts)
    for t, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_each_chunk_is_looked_up_once_and_learnt_in_its_parts(monkeypatch):
    """A chunk that is known costs one lookup; words with signs behind them aren't given to the tokenizer one by one; a merge looks
    up the two pairs beside it, not all of its word."""

    class Counted(dict):
        lookups = 0

        def get(self, *key):
            self.lookups += 1
            return super().get(*key)

        def __contains__(self, key):
            self.lookups += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            self.lookups += 1
            return super().__getitem__(key)

    encoder, rng = packing.Encoder(), random.Random(11)
    words = sorted({"".join(rng.choice("enarstioulché") for _ in range(rng.randint(3, 20))) for _ in range(2000)})
    pairs, given = [], []
    rank, learn = packing.Merger._rank, encoder._learn
    monkeypatch.setattr(packing.Merger, "_rank", lambda self, keys: pairs.append(keys.size) or rank(self, keys))
    encoder._learn = lambda chunks: given.extend(chunks) or learn(chunks)
    first = encoder.encode_all([" ".join(w + "***" for w in words)])
    assert given == ["***"]
    sizes = {w: len(encoder.tokenizer.encode(w, add_special_tokens=False).ids) for w in words}
    assert sum(pairs) <= sum(len(w.encode()) - 1 + 2 * (len(w.encode()) - n) for w, n in sizes.items())
    encoder.known = Counted(encoder.known)
    assert encoder.encode_all([" ".join(w + "***" for w in words)]) == first
    assert encoder.known.lookups <= len(words)
