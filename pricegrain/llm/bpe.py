"""Byte-level BPE (3): the merges are replayed over all distinct words of a slice of the corpus at once, in rank order."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.chunks import ChunkStore, in_batches
from pricegrain.llm.common import id_type

_LOADED: dict = {}
#: Binary logarithm of the slots that pairs of tokens are looked up by; there are some times fewer pairs.
_SLOT_BITS = 21
#: Places up to which the lookups of a merge are cheaper one by one.
_FEW = 24
#: The beginning of a pattern's text by which runs of letters are not divided.
_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+|"


class Vocabulary:
    """Ranks of a .tiktoken file, and for each pair of tokens whose bytes together are a token, that token's rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.n = max(self.ranks.values()) + 1
        self.bytes = [b""] * self.n
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = rank
        self.merge_of = pairs
        # pairs lie in the order of their slots, with one more behind them that no key equals; a slot knows its first pair
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(self._slot(keys), kind="stable")
        self.pairs = np.append(keys[order], -1)
        self.made = np.append(np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))[order], np.int32(-1))
        held = np.bincount(self._slot(keys), minlength=1 << _SLOT_BITS)
        self.first = np.where(held > 0, np.cumsum(held) - held, len(keys)).astype(np.int32)
        self.most = int(held.max(initial=1))  # pairs of the fullest slot

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 where there is none."""
        key = left.astype(np.int64) * self.n + right
        at = self.first[self._slot(key)]
        hit = self.pairs[at] == key
        found = np.where(hit, self.made[at], np.int32(-1))
        for nth in range(1, self.most):  # the few keys whose slot holds other pairs before theirs
            rest = np.flatnonzero(~hit & (self.pairs[at] >= 0)) if nth == 1 else rest[self.pairs[at[rest] + nth - 1] != key[rest]]
            rest = rest[at[rest] + nth < len(self.pairs)]
            if not len(rest):
                break
            same = rest[self.pairs[at[rest] + nth] == key[rest]]
            found[same] = self.made[at[same] + nth]
        return found

    @staticmethod
    def of(path: str) -> Vocabulary:
        if path not in _LOADED:
            _LOADED[path] = Vocabulary(path)
        return _LOADED[path]


def replay(words: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each word. All words lie in one array of tokens, linked to their neighbours. An inverted index holds, for
    each rank, the places whose token and next token merge into it. The lowest rank of the index is taken next; its
    places are merged, and only the pairs around them are looked up and indexed anew.

    A place may be out of date when its turn comes (a neighbour has merged), so each is looked at again. Where places of
    one word overlap ("aa" in "aaa") every second goes first. A pair that forms with a lower rank than the merge that
    made it is taken before any higher one, as when words are encoded one at a time.
    """
    if not words:
        return []
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    total = int(starts[-1])
    token = vocab.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)] if total else np.empty(0, np.int32)
    end = np.zeros(total + 1, dtype=bool)
    end[starts] = True  # a place where no word goes on
    following = np.arange(1, total + 1, dtype=np.int32)  # total: none
    following[end[1:]] = total
    before = np.arange(-1, total - 1, dtype=np.int32)
    before[end[:-1]] = -1
    alive = np.ones(total, dtype=bool)
    due = np.full(total, -1, dtype=np.int32)  # rank of the merge of each place with the next, -1 for none
    index: dict[int, list[np.ndarray]] = {}
    single: dict[int, list[int]] = {}  # places that were indexed one by one
    merge_of = vocab.merge_of.get
    heap: list[int] = []

    def pair_up(places: np.ndarray) -> None:
        """Look up the merges of these places and index them; a place that is met twice is indexed twice."""
        nxt = following[places]
        if len(places) <= _FEW:
            rights = token[np.minimum(nxt, total - 1)].tolist()
            ranks = [merge_of(a * vocab.n + b, -1) if x < total else -1 for a, b, x in zip(token[places].tolist(), rights, nxt.tolist())]
            due[places] = ranks
            for place, rank in zip(places.tolist(), ranks):
                if rank >= 0:
                    if rank in single:
                        single[rank].append(place)
                    else:
                        single[rank] = [place]
                        if rank not in index:
                            heapq.heappush(heap, rank)
            return
        found = vocab.merged(token[places], token[np.minimum(nxt, total - 1)])
        found[nxt == total] = -1
        due[places] = found
        good = np.flatnonzero(found >= 0)
        if not len(good):
            return
        places, found = places[good], found[good]
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        for part, rank in zip(np.split(places, cuts) if len(cuts) else [places], found[np.concatenate([[0], cuts])].tolist(), strict=True):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                if rank not in single:
                    heapq.heappush(heap, rank)

    for at in range(0, total, 1 << 18):
        pair_up(np.arange(at, min(total, at + (1 << 18)), dtype=np.int32))
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank, [])
        if rank in single:
            parts.append(np.array(single.pop(rank), dtype=np.int32))
        places = np.concatenate(parts) if len(parts) > 1 else parts[0]
        places = places[due[places] == rank]
        if not len(places):
            continue
        if len(places) > 1:
            places.sort()  # a copy of its own
            new = places[1:] != places[:-1]
            if not new.all():
                places = places[np.append(True, new)]
        nxt = following[places]
        if len(places) > 1 and (chained := nxt[:-1] == places[1:]).any():
            # runs of overlapping places ("aa" in "aaaa"): the 1st, 3rd, 5th ... of each merge; what is left is looked up below
            run_start = np.concatenate([[0], np.flatnonzero(~chained) + 1])
            nth = np.arange(len(places)) - np.repeat(run_start, np.diff(np.concatenate([run_start, [len(places)]])))
            places, nxt = places[nth % 2 == 0], nxt[nth % 2 == 0]
        after = following[nxt]
        token[places] = rank
        due[nxt] = -1
        alive[nxt] = False
        following[places] = after
        inner = after < total
        before[after[inner]] = places[inner]
        left = before[places]
        pair_up(np.concatenate([places, left[left >= 0]]))
    left_over = np.flatnonzero(alive)
    ids = token[left_over].astype("<u4")
    cuts = np.searchsorted(left_over, starts)
    return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def encode_chunks(chunks: list[str], vocab: Vocabulary, pattern: regex.Pattern) -> Iterator[bytes]:
    """Ids of each chunk: of each match of the pattern, whole if it is a token, else by replaying the merges."""
    # where the pattern begins so, letters of ASCII, after one blank or none, are one match
    whole = pattern.pattern.startswith(_LETTERS)
    matches = [[c.encode()] if whole and c.isascii() and c.removeprefix(" ").isalpha() else [m.encode() for m in pattern.findall(c)] for c in chunks]
    ranks = vocab.ranks
    words = list({m for ms in matches for m in ms if m not in ranks})
    known = {w: ids.tobytes() for w, ids in zip(words, replay(words, vocab), strict=True)}
    for ms in matches:
        yield b"".join([known[m] if m in known else ranks[m].to_bytes(4, "little") for m in ms])


def decode_ids(ids: bytes, vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): the ids of each whole text as little-endian unsigned 32-bit integers; null text gives no ids.

    Special tokens have no meaning in a text. Repeated rows and ids, null ids too, give repeated rows, an empty table none;
    other columns are left out, whatever their names. A word's merges do not depend on other words, so each task replays them
    over the distinct words of its slice of the corpus, some megabytes at a time, and keeps a bounded number of words'
    ids for the next slice: nothing is shuffled or broadcast, and a lost task is simply run again. To replay each distinct
    word of the corpus only once, words would have to be shuffled and their ids joined back to every slice (README).
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, pat = Vocabulary.of(vocabulary), regex.compile(pattern)
        store = ChunkStore(lambda chunks: encode_chunks(chunks, vocab, pat))
        for start, own_ids, texts in text_batches(batches, id_col, text_col):
            yield pd.DataFrame({id_col: own_ids, "ids": store.encode(texts)})

    own, sent, kind = id_type(docs, id_col)
    coded = docs.select(own.alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInPandas(encode, f"`{id_col}` {sent}, ids binary")
    return coded.withColumn(id_col, F.col(id_col).cast(kind))


def text_batches(batches: Iterator[pd.DataFrame], id_col: str, text_col: str, chars: int = 1_500_000):
    """Arrow batches, cut or joined to slices of about so many characters: (number, ids, texts)."""
    n = 0
    for pdf in batches:
        texts, ids = pdf[text_col].tolist(), pdf[id_col]
        for start, own in in_batches(texts, chars):
            yield n, ids.iloc[start : start + len(own)].reset_index(drop=True), own
            n += 1


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) to (id, ids, decoded binary): the bytes that the ids stand for; null ids give no bytes. Rows are decoded one
    by one, repeated ones too; other columns are left out, whatever their names."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = Vocabulary.of(vocabulary)
        for pdf in batches:
            yield pdf.assign(decoded=[decode_ids(x or b"", vocab) for x in pdf["ids"]])

    own, sent, kind = id_type(encoded, id_col)
    found = encoded.select(own.alias(id_col), "ids").mapInPandas(decode, f"`{id_col}` {sent}, ids binary, decoded binary")
    return found.withColumn(id_col, F.col(id_col).cast(kind))
