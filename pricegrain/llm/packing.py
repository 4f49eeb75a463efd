"""Best-fit packing (9): Martello-Toth dominance fixes small sets first, best fit places the rest; both work on counts of lengths."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.llm.chunks import ChunkStore
from pricegrain.llm.bpe import text_batches
from pricegrain.llm.common import id_type, materialize

CAPACITY, END_ID = 1024, 2
_LOADED: dict = {}


def _encoder(path: str):
    """(encode chunks, special strings, encode a whole text): the file's merges by tiktoken's core, whose ids are those of
    tokenizers (tests compare them); texts that hold a special token's string go to tokenizers itself."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        one = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        whole = Tokenizer.from_file(path)
        _LOADED[path] = (
            lambda chunks: [np.array(one(c), dtype="<u4").tobytes() for c in chunks],
            special,
            lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(),
        )
    return _LOADED[path]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the ids of each text and end_id, cut where longer than capacity.

    All pieces but the first of a document are full, so a document has as few as it can. Null text is empty: end_id alone.
    """
    own_id, sent, kind = id_type(docs, id_col)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, special, whole = _encoder(vocabulary)
        store, end = ChunkStore(encode), int(end_id).to_bytes(4, "little")
        for _, own, texts in text_batches(batches, id_col, text_col):
            odd = {i for i, t in enumerate(texts) if any(s in t for s in special)}
            found = store.encode([t for i, t in enumerate(texts) if i not in odd])
            usual = iter(found)
            rows = []
            for i, (doc, t) in enumerate(zip(own.tolist(), texts, strict=True)):
                ids = (whole(t) if i in odd else next(usual)) + end
                n = len(ids) // 4
                pieces = -(-n // capacity)
                start = 0
                for p in range(pieces):
                    stop = n - capacity * (pieces - 1 - p)
                    part = ids[4 * start : 4 * stop]
                    rows.append((doc, p, start, stop - start, zlib.crc32(part), *([part] if with_ids else [])))
                    start = stop
            yield pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    texts = docs.select(own_id.alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    pieces = texts.mapInPandas(cut, f"`{id_col}` {sent}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    return pieces.withColumn(id_col, F.col(id_col).cast(kind))


class Plan:
    """Runs: (length, first rank, items, first sequence, offset, items in a sequence). Item t of a run lies in sequence
    first + t // q, at offset + t % q * length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.counts = capacity, {n: c for n, c in counts.items() if c}
        self.taken: dict[int, int] = dict.fromkeys(counts, 0)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.reduced = 0

    def put(self, length: int, items: int, first: int, offset: int, each: int = 1) -> None:
        self.runs.append((length, self.taken[length], items, first, offset, each))
        self.taken[length] += items
        self.counts[length] -= items
        if not self.counts[length]:
            del self.counts[length]

    def fix(self, parts: tuple[int, ...], times: int) -> None:
        """So many sequences, each of these items."""
        offset = 0
        for length in parts:
            self.put(length, times, self.sequences, offset)
            offset += length
        self.sequences += times
        self.reduced += times

    def dominating(self, j: int, sizes: np.ndarray) -> tuple[int, ...] | None:
        """A set holding an item of size j that dominates every feasible set holding it, of at most three items."""
        rest = self.capacity - j
        own = self.counts[j]
        others = sizes if own > 1 else sizes[sizes != j]  # ascending
        fit = others[others <= rest]
        if not len(fit):
            return (j,)
        best = int(fit[-1])
        if best == rest:  # whatever else goes with j fits in the place of one item
            return (j, best)
        have = lambda n: self.counts[n] - (n == j)
        low = [n for n in fit[:3].tolist() for _ in range(min(3, have(n)))][:3]
        if len(low) < 2 or low[0] + low[1] > rest:  # one partner at most
            return (j, best)
        if len(low) == 3 and sum(low) <= rest:
            return None
        # two partners at most: (best, b) must cover every feasible pair
        b = next((n for n in fit[::-1].tolist() if n <= rest - best and have(n) > (n == best)), None)
        if b is None:
            return None
        room = np.searchsorted(fit, rest - fit, side="right") - 1  # the largest partner of each
        partner = np.where(room >= 0, fit[np.maximum(room, 0)], 0)
        x, y = np.maximum(fit, partner), np.minimum(fit, partner)
        return (j, best, b) if bool(np.all((y == 0) | ((x <= best) & (y <= b)) | (x + y <= best))) else None

    def reduce(self) -> None:
        """Martello-Toth: fix dominating sets, largest items first, as long as any is found."""
        found = True
        while found:
            found = False
            for j in sorted(self.counts, reverse=True):
                while j in self.counts:
                    parts = self.dominating(j, np.array(sorted(self.counts), dtype=np.int64))
                    if parts is None:
                        break
                    self.fix(parts, min(self.counts[n] // parts.count(n) for n in set(parts)))
                    found = True

    def best_fit(self) -> None:
        """Best fit decreasing; sequences that are alike are one group, so the work depends on the lengths, not the items."""
        groups: dict[int, list[tuple[int, int]]] = {}  # room left: [(first sequence, sequences)]
        for length in sorted(self.counts, reverse=True):
            while left := self.counts.get(length, 0):
                room = min((r for r in groups if r >= length), default=self.capacity)
                each = min(room // length, left)
                if room in groups:
                    first, n = groups[room].pop()
                    if not groups[room]:
                        del groups[room]
                    use = min(n, left // each)
                    if use < n:
                        groups.setdefault(room, []).append((first + use, n - use))
                else:
                    first, use = self.sequences, left // each
                    self.sequences += use
                self.put(length, use * each, first, self.capacity - room, each)
                if room - each * length:
                    groups.setdefault(room - each * length, []).append((first, use))


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset; a sequence holds at most capacity, gapless from 0.

    The driver sees one count per length, capacity numbers at most, and plans with them. A piece's rank among the pieces
    of its length then tells its place. Ranks are counted in hash buckets first, so that a length which a third of all
    pieces have is not one task's work. keys should be unique; rows alike in keys and length may swap places.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).agg(F.count("*")).collect()}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    spark = pieces.sparkSession
    plan = pack_plan(counts, capacity)
    runs = spark.createDataFrame([(n, a, a + c, s, o, q) for n, a, c, s, o, q in plan.runs], "_n long, _a long, _b long, _s long, _o long, _q long")
    buckets = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    share = placed.groupBy("_bucket", length_col).agg(F.count("*").alias("_c"))
    share = share.select("_bucket", length_col, (F.sum("_c").over(W.partitionBy(length_col).orderBy("_bucket")) - F.col("_c")).alias("_before"))
    ranked = placed.withColumn("_nth", F.row_number().over(W.partitionBy("_bucket", length_col).orderBy(*keys)) - 1)
    ranked = ranked.join(share, ["_bucket", length_col]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    at = (F.col(length_col) == F.col("_n")) & (F.col("_rank") >= F.col("_a")) & (F.col("_rank") < F.col("_b"))
    turn = F.col("_rank") - F.col("_a")
    return ranked.join(F.broadcast(runs), at).select(
        *pieces.columns,
        (F.col("_s") + F.floor(turn / F.col("_q"))).cast("long").alias("sequence_id"),
        (F.col("_o") + turn % F.col("_q") * F.col(length_col)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row per piece. Null text is empty: one piece of end_id alone. Rows that share an id, null
    ones too, each have their pieces. An empty table gives no rows; other columns are left out, whatever their names."""
    pieces = materialize(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return best_fit_pack(pieces, capacity, (id_col, "piece"))
