"""Substring dedup (6): a gear hash of the last bytes says where the passages begin that are looked up; those that stood earlier in one piece are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.llm.chunks import in_batches
from pricegrain.llm.common import discard, fresh, hot_keys, materialize
from pricegrain.llm.rolling import PIECE, numbers, range_hashes

#: What goes stood earlier in pieces of so many words in a row.
MIN_WORDS = 16
#: A cut comes before one white space in 4, and, for texts without, at one character in 4096.
WORD_CUT, PLAIN_CUT = 3, 4095
#: A stretch without white space above so many bytes, or above so many bytes that are not ASCII, is no word but many: one
#: begins at one character in 4, where the gear hash says so, and at one in 4 of these a chunk.
LONG_WORD, LONG_FOREIGN, INNER_WORD, INNER_CUT = 256, 48, 3, 15
_GEAR = numbers(256, 6)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _gear_hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, bytes from the one before it on, gear hashes before each place) of the pieces of a text: of any length,
    it is gone through piece by piece. The gear hash of a place is the sum of the table's entries of the 16 bytes before
    it, each shifted once more the further back it lies, so that it depends on these bytes alone."""
    for piece in range(0, len(data), PIECE):
        a = max(0, piece - 16)  # the bytes before the piece that its cuts depend on
        own = data[a : piece + PIECE]
        h = _GEAR[own]
        for step in (1, 2, 4, 8):
            shifted = np.zeros_like(h)
            shifted[step:] = h[:-step] << np.uint64(step)
            h = h + shifted
        skip = max(piece, 1) - a - 1
        yield max(piece, 1), own[skip:], (h >> np.uint64(4)).astype(np.uint32)[skip:-1]


def cuts(data: np.ndarray) -> np.ndarray:
    """Starts of the chunks and the end, by the gear hash: an insertion moves the cuts next to it and no others."""
    if not len(data):
        return np.zeros(1, dtype=np.int64)
    found = [np.zeros(1, dtype=np.int64)]
    for start, own, last in _gear_hashes(data):
        here = own[1:]
        at = (_SPACES[here] & ~_SPACES[own[:-1]] & ((last >> 8) & WORD_CUT == 0)) | (((last >> 4) & PLAIN_CUT == 0) & ((here & 0xC0) != 0x80))
        found.append(np.flatnonzero(at) + start)
    return np.concatenate([*found, [len(data)]])


def _words_within(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where words begin within long stretches without white space, where chunks do), by the gear hash."""
    none = np.empty(0, np.int64)
    long = end - begin > LONG_WORD
    if np.count_nonzero(data & 0x80) > LONG_FOREIGN:
        before = np.concatenate([[0], np.cumsum(data >> 7, dtype=np.int64)])
        long |= before[end] - before[begin] > LONG_FOREIGN
    if not long.any():
        return none, none
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[begin[long] + 1] += 1
    inside[end[long]] -= 1
    inside = np.cumsum(inside, dtype=np.int8).astype(bool)
    words, chunks = [none], [none]
    for start, own, last in _gear_hashes(data):
        at = inside[start : start + len(last)] & ((own[1:] & 0xC0) != 0x80) & ((last >> 8) & INNER_WORD == 0)
        words.append(np.flatnonzero(at) + start)
        chunks.append(np.flatnonzero(at & ((last >> 8) & INNER_CUT == 0)) + start)
    return np.concatenate(words), np.concatenate(chunks)


def windows(data: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of the passages of min_words words that are looked up, starts of all words, their ends). A passage
    begins with the first whole word of each chunk and, in a chunk longer than itself, at every fourth word; the last one
    holds the text's last words. Words are what white space parts; long stretches without any, as whole texts of some
    scripts are, hold several."""
    word = ~_SPACES[data]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    edges = cuts(data)
    within, chunks = _words_within(data, begin, end)
    if len(within):
        begin, end = np.sort(np.concatenate([begin, within])), np.sort(np.concatenate([end, within]))
        edges = np.union1d(edges, chunks)
    if len(begin) < min_words:
        return np.empty(0, np.int64), begin, end
    first = np.searchsorted(begin, edges)  # of each chunk's words
    long = np.flatnonzero(np.diff(first) > min_words)
    inner = [np.arange(first[i] + 4, first[i + 1], 4) for i in long]
    words = np.unique(np.concatenate([first[:-1], *inner, [len(begin) - min_words]]))
    return words[words + min_words <= len(begin)], begin, end


def runs(text: str, repeated: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(first byte, end, words) of what the repeated passages cover together. White space before a passage goes with it, and
    so does what ends the text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words, begin, end = windows(data, min_words)
    found: list[list[int]] = []
    for w in words[[i for i in sorted(set(repeated)) if i < len(words)]].tolist():
        if found and w <= found[-1][1]:
            found[-1][1] = w + min_words
        else:
            found.append([w, w + min_words])
    return [(int(end[a - 1]) if a else 0, len(data) if b == len(begin) else int(end[b - 1]), b - a) for a, b in found]


def _row_key(text: Column | str) -> Column:
    """32 bits of a text; with the id they tell rows apart that share it."""
    return F.hash(text)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _key, repeated array<int>): the numbers of a row's passages that stand earlier too, in a smaller (id, key) or
    before in it. Rows alike in id and text are one.

    What is shuffled of a passage is its digest of 96 bits, the id, and the key and number in one. Digests above the hot
    share of all rows are settled by a broadcast of their first places, which are summed before the shuffle; at most
    1 / share of them.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, keys, texts = pdf["_id"].to_numpy(), pdf["_key"].to_numpy(dtype=np.int64), pdf["_text"].tolist()
            for start, own in in_batches(texts, 1_000_000):
                parts = [np.frombuffer(t.encode(), dtype=np.uint8) for t in own]
                begins, ends, sizes, offset = [], [], [], 0
                for data in parts:
                    words, begin, end = windows(data, min_words)
                    begins.append(begin[words] + offset)
                    ends.append(end[words + min_words - 1] + offset)
                    sizes.append(len(words))
                    offset += len(data)
                if not sum(sizes):
                    continue
                data, begins, ends = np.concatenate(parts), np.concatenate(begins), np.concatenate(ends)
                numbered = np.concatenate([np.arange(s, dtype=np.int64) for s in sizes])
                rows = slice(start, start + len(own))
                yield pd.DataFrame({
                    "_id": np.repeat(ids[rows], sizes), "place": np.repeat(keys[rows] << 32, sizes) | numbered,
                    "h1": range_hashes(data, begins, ends, 1).view(np.int64),
                    "h2": (range_hashes(data, begins, ends, 2) >> np.uint64(32)).astype(np.uint32).view(np.int32),
                })

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_id IS NOT NULL AND _text <> ''").withColumn("_key", _row_key("_text"))
    rows = materialize(texts.mapInPandas(look_up, f"_id {kind}, place long, h1 long, h2 int"), "windows")
    often = [r[0] for r in hot_keys(rows, "h1").collect()]  # at most 1 / share numbers
    hot = rows.filter(F.col("h1").isin(often) if often else F.lit(False)).groupBy("h1", "h2").agg(F.min(F.struct("_id", "place")).alias("first"))
    met = rows.join(F.broadcast(hot), ["h1", "h2"], "left")
    # rows of hot digests are known by their first places, so they may be spread
    spread = F.when(F.col("first").isNotNull(), F.pmod(F.xxhash64("_id", "place"), F.lit(1024))).otherwise(F.lit(0))
    least = F.first(F.struct("_id", "place")).over(W.partitionBy("h1", "h2", spread).orderBy("_id", "place"))
    again = met.withColumn("first", F.coalesce("first", least)).filter(F.struct("_id", "place") != F.col("first"))
    number, key = F.col("place").bitwiseAND(0xFFFFFFFF).cast("int"), F.shiftright("place", 32).cast("int")
    found = materialize(again.groupBy("_id", key.alias("_key")).agg(F.collect_set(number).alias("repeated")), "repeated")
    discard(rows)
    return found


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with removed_spans (first byte, end, words), n_removed_words and kept_text.

    A text keeps what it says first: passages of min_words words that stand, in one piece, in a smaller id too or earlier
    in the same text are cut out; those that meet are one span. White space between words counts. Passages are looked up
    from the beginnings of chunks, so up to a few words at either end of what is repeated stay. In a stretch without white
    space of more than 256 bytes, or 48 bytes that are not ASCII, a word is some four characters between places that the
    gear hash picks, so texts of scripts without blanks are cut alike (a loop of one character stays one word).

    Null and empty texts stay as they are (kept_text empty), as do rows without id. Rows that share an id but not the text
    are rows of their own, ordered by a hash of the text; rows alike in both are one document and all keep what it keeps:
    no text is lost for its own repetition (exact dedup is for that). An empty table gives no rows. Columns named like the
    new ones are replaced; any other names may occur.
    """
    new = ("removed_spans", "n_removed_words", "kept_text")
    base = docs.select(*[c for c in docs.columns if c not in new])
    own_id, own_key, rep, cut_col = (fresh(c, [*docs.columns, *new]) for c in ("_passage_id", "_passage_key", "_passages", "_passage_cut"))
    found = repeated_windows(docs, id_col, text_col, min_words).toDF(own_id, own_key, rep)
    joined = base.join(found, (base[id_col] == F.col(own_id)) & (_row_key(base[text_col]) == F.col(own_key)), "left").drop(own_id, own_key)

    @F.pandas_udf("removed_spans array<struct<start:long,end:long,words:long>>, kept_text string")
    def cut(texts: pd.Series, repeated: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for t, r in zip(texts, repeated):
            found = [] if t is None or r is None else runs(t, list(r), min_words)
            if found:
                data = t.encode()
                edges = [0, *(x for a, b, _ in found for x in (a, b)), len(data)]
                t = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
            spans.append([{"start": a, "end": b, "words": n} for a, b, n in found])
            kept.append(t if found else None)
        return pd.DataFrame({"removed_spans": spans, "kept_text": kept})

    # one Python worker a task; texts that hold nothing repeated don't go there
    hit = F.col(rep).isNotNull()
    touched = joined.withColumn(cut_col, cut(F.when(hit, F.col(text_col)), F.col(rep))).withColumn("removed_spans", F.when(hit, F.col(f"{cut_col}.removed_spans")))
    return touched.withColumns({
        "n_removed_words": F.aggregate(F.coalesce("removed_spans", F.array().cast("array<struct<start:long,end:long,words:long>>")), F.lit(0).cast("long"), lambda a, s: a + s["words"]),
        "kept_text": F.coalesce(F.col(f"{cut_col}.kept_text"), F.col(text_col), F.lit("")),
    }).drop(rep, cut_col)
