"""The encoder's lookups: slots that hold several pairs, few places and many, patterns that divide runs of letters."""

from __future__ import annotations

import numpy as np
import public_tokenizers as tokenizers
import pytest
import regex

from pricegrain.llm import bpe


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary.of(tokenizers.path("byte_bpe_50k.tiktoken"))


def test_slots_find_every_pair_and_no_other(vocab):
    keys = np.array(list(vocab.merge_of), dtype=np.int64)
    assert vocab.merged(keys // vocab.n, keys % vocab.n).tolist() == list(vocab.merge_of.values())
    assert vocab.most > 1  # so that slots of several pairs were met
    draw = np.random.default_rng(1).integers(0, vocab.n, (2, 200_000))
    assert vocab.merged(*draw).tolist() == [vocab.merge_of.get(a * vocab.n + b, -1) for a, b in zip(*draw.tolist())]


def test_few_and_many_places_give_the_same_ids(vocab, monkeypatch):
    words = [w.encode() for w in ["aaaaaaa", "aa", "x", " onenaning", "rebleeded", "éééé", "!!!!!!", " Thoueses"]] + [bytes([i % 256, i // 7 % 256, i % 11 + 97]) * (i % 5 + 1) for i in range(3000)]
    usual = [x.tolist() for x in bpe.replay(words, vocab)]
    for few in (0, 1 << 30):
        monkeypatch.setattr(bpe, "_FEW", few)
        assert [x.tolist() for x in bpe.replay(words, vocab)] == usual
    assert all(b"".join(map(vocab.bytes.__getitem__, ids)) == w for ids, w in zip(usual, words))


def test_only_patterns_that_keep_letters_together_are_cut_short(vocab):
    split_case = regex.compile(r" ?\p{Lu}?\p{Ll}+|\p{Lu}+|\s+|.")
    for pattern in (split_case, regex.compile(tokenizers.PATTERN)):
        for chunk in [" fooBar", "HTTPServer", " ", "", "it's", " naïve", "a"]:
            whole = b"".join(x.tobytes() for x in bpe.replay([m.encode() for m in pattern.findall(chunk)], vocab))
            got = list(bpe.encode_chunks([chunk], vocab, pattern))
            assert bpe.decode_ids(got[0], vocab) == chunk.encode() and got[0] == whole
