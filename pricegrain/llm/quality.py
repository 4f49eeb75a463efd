"""Quality classifier (4): a linear-chain conditional random field labels every line; length-weighted marginals make the document's score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.chunks import in_batches
from pricegrain.llm.common import id_type

#: Fitted on at most so many labelled documents, those of the smallest hashed ids, as long as they have at most so many lines
#: together; every line of each is used.
MAX_TRAINING_DOCS, MAX_TRAINING_LINES = 3000, 200_000
#: Share of a document's lines that are expected not to be as it is labelled. This and the neighbours' decay were chosen among
#: 12 pairs by fitting on training rows of crc32 remainder 2 to 4 and comparing on those of remainder 1, not on held-out rows.
NOISE = 0.35
THRESHOLD = 0.3
N_FEATURES = 14
#: A line longer than so many characters has the mean features of its pieces, weighted by their lengths (a bound on memory).
LONG_LINE = 1 << 16
#: Chains of training are cut after so many lines. Texts of more lines than PART are scored in parts that overlap by MARGIN
#: lines, whose own marginals are not used: what lies further off has no weight in the chain.
SEGMENT, PART, MARGIN = 256, 4096, 64


def _piece_features(line: str) -> tuple[float, ...]:
    words = line.split()
    n, nw = len(line), len(words)
    if not nw:
        return (np.log1p(n), 1.0, *[0.0] * (N_FEATURES - 2))
    joined = "".join(words)
    m = len(joined)
    letters = sum(map(str.isalpha, joined))
    marks = m - sum(map(str.isalnum, joined))
    again = sum(a == b for a, b in zip(words, words[1:]))
    odd_end = sum(not w[-1].isalnum() and w[-1] not in ".,;:)\"'" for w in words)
    return (
        np.log1p(n), 0.0, np.log1p(nw), m / nw / 10, len(set(words)) / nw, again / nw, letters / m, marks / m,
        sum(map(str.isupper, joined)) / m, sum(w.isupper() for w in words) / nw, odd_end / nw,
        sum(not any(map(str.isalnum, w)) for w in words) / nw, float(line[-1] in ".!?"), float(sum(map(str.isdigit, joined)) / m),
    )


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of emit [documents, lines, 2] (log potentials): log of the sum over labellings, marginals [d, t, 2], pair marginals summed over t [d, 2, 2]."""
    d, t, _ = emit.shape
    a, b = np.zeros_like(emit), np.zeros_like(emit)
    a[:, 0] = emit[:, 0]
    for i in range(1, t):
        step = np.logaddexp(a[:, i - 1, :1] + trans[0], a[:, i - 1, 1:] + trans[1]) + emit[:, i]
        a[:, i] = np.where(mask[:, i, None], step, a[:, i - 1])
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    pairs = np.zeros((d, 2, 2))
    for i in range(t - 2, -1, -1):
        nxt = emit[:, i + 1] + b[:, i + 1]
        back = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
        b[:, i] = np.where(mask[:, i + 1, None], back, b[:, i + 1])
        joint = np.exp(a[:, i, :, None] + trans + nxt[:, None, :] - z[:, None, None])
        pairs += np.where(mask[:, i + 1, None, None], joint, 0)
    return z, np.exp(np.minimum(a + b - z[:, None, None], 0)), pairs


def line_features(line: str) -> tuple[float, ...]:
    if len(line) <= LONG_LINE:
        return _piece_features(line)
    pieces = [line[a : a + LONG_LINE] for a in range(0, len(line), LONG_LINE)]
    return tuple(np.average([_piece_features(p) for p in pieces], axis=0, weights=[len(p) for p in pieces]))


def _blocks(text: str, size: int = 10_000) -> Iterator[list[str]]:
    """The lines of a text, so many at a time."""
    own, at = [], 0
    while True:
        end = text.find("\n", at)
        own.append(text[at:] if end < 0 else text[at:end])
        if end < 0 or len(own) == size:
            yield own
            own = []
        if end < 0:
            return
        at = end + 1


def document_features(text: str) -> np.ndarray:
    """Features of each line [lines, N_FEATURES]."""
    return np.concatenate([np.array([line_features(x) for x in own], dtype=np.float32) for own in _blocks(text)])


def _bucketed(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chains of about as many lines together: (their numbers, places of their lines in the row of all lines, which are lines)."""
    starts = np.cumsum(sizes) - sizes
    classes = np.ceil(np.log2(sizes)).astype(int)
    for c in np.unique(classes):
        own = np.flatnonzero(classes == c)
        for part in np.array_split(own, max(1, (len(own) << c) // 200_000)):
            step = np.arange(sizes[part].max())
            mask = step < sizes[part][:, None]
            yield part, np.where(mask, starts[part][:, None] + step, starts[part][:, None]), mask


def _emit(logits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.stack([np.zeros(places.shape), logits[places]], axis=2)


@dataclass
class LineCRF:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of label 1 against label 0: [own, line before, line after] features, constant
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """What each line's and its neighbours' features say for label 1; characters of each line, and 1 more."""
        w = self.weights[:-1].reshape(3, N_FEATURES).T
        parts, lengths = [], []
        for own in _blocks(text):
            parts.append(((np.array([line_features(x) for x in own]) - self.mean) / self.scale) @ w)
            lengths.append(np.fromiter((len(x) + 1 for x in own), float, len(own)))
        said = np.concatenate(parts)
        out = said[:, 0] + self.weights[-1]
        out[1:] += said[:-1, 1]
        out[:-1] += said[1:, 2]
        return out, np.concatenate(lengths)

    def line_marginals(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(probability of label 1, weight) of each line of each text."""
        found = [self.logits(t) for t in texts]
        chains, owner = [], []  # (text, first line, end, first of its own, end of its own)
        for i, (own, _) in enumerate(found):
            for a in range(0, len(own), PART) if len(own) > PART else [0]:
                b = min(len(own), a + PART) if len(own) > PART else len(own)
                chains.append(own[max(0, a - MARGIN) : b + MARGIN])
                owner.append((i, a, b, a - max(0, a - MARGIN)))
        out = [(np.empty(len(own)), weight) for own, weight in found]
        flat = np.concatenate(chains)
        for part, places, mask in _bucketed(np.array(list(map(len, chains)))):
            _, marg, _ = forward_backward(_emit(flat, places), mask, self.trans)
            for j, k in enumerate(part):
                i, a, b, lead = owner[k]
                out[i][0][a:b] = marg[j, lead : lead + b - a, 1]
        return out

    def good_share(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the marginals of label 1."""
        out = np.empty(len(texts))
        for start, own in in_batches(texts):
            out[start : start + len(own)] = [(p * w).sum() / w.sum() for p, w in self.line_marginals(own)]
        return out

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        p = np.clip(share, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))

    def score(self, texts: list[str]) -> np.ndarray:
        return self.calibrated(self.good_share(texts)) if texts else np.zeros(0)


def fit_lines(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rounds: int = 5, steps: int = 30, rate: float = 0.12, l2: float = 1e-3, l2_neighbours: float = 0.03) -> LineCRF:
    """Fit on (features, weight) of every line of labelled documents; lines have no labels of their own.

    Expectation maximisation: a document's label is a hint to each of its lines' labels, wrong for a share NOISE of them.
    Each round computes how likely each line and each pair of neighbours is good or bad, given the chain so far and the
    hint, and then fits weights and transitions to that by Adam (maximum conditional likelihood). So junk in a good
    document counts as junk, and transitions between unlike lines are learned. Then the weighted share of good lines is
    mapped to a probability by a logistic curve fitted on the same documents. One label alone, or no document, gives a
    constant score.
    """
    y = np.array(labels, dtype=int)
    if not len(y) or y.min() == y.max():
        return LineCRF(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)), 0.0, 2.0 if not len(y) or y[0] else -2.0)
    sizes = np.array([len(x) for x, _ in documents])
    own = np.concatenate([x for x, _ in documents]).astype(np.float32)
    mean, scale = own.mean(0, dtype=float), own.std(0, dtype=float) + 1e-6
    own = ((own - mean) / scale).astype(np.float32)
    ends = np.cumsum(sizes)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[ends - sizes], after[ends - 1] = 0, 0
    x = np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], axis=1)
    del own, before, after
    of = np.repeat(np.arange(len(sizes)), sizes)
    share = 1.0 / (sizes[of] * len(sizes))  # every document weighs the same
    hint = np.where(y[of] == 1, 1.0, -1.0) * np.log((1 - NOISE) / NOISE)
    cut = np.concatenate([np.append(np.full(n // SEGMENT, SEGMENT), n % SEGMENT) for n in sizes])
    chains = list(_bucketed(cut[cut > 0]))

    def marginals(logits: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good, both = np.empty(len(logits)), np.zeros((2, 2))
        for _, places, mask in chains:
            _, marg, pairs = forward_backward(_emit(logits, places), mask, trans)
            good[places[mask]] = marg[:, :, 1][mask]
            both += (pairs * share[places[:, 0], None, None]).sum(0)
        return good, both

    theta = np.zeros(x.shape[1] + 4)
    decay = np.full(len(theta), l2)
    decay[N_FEATURES : 3 * N_FEATURES] = l2_neighbours  # or a line would be judged by what stands beside it
    for _ in range(rounds):
        wanted, wanted_pairs = marginals(x @ theta[:-4] + hint, theta[-4:].reshape(2, 2))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            good, pairs = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2))
            grad = np.concatenate([(share * (wanted - good)).astype(np.float32) @ x, (wanted_pairs - pairs).ravel()]) - decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = LineCRF(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
    good, _ = marginals(x @ model.weights, model.trans)
    weight = np.concatenate([w for _, w in documents])
    p = np.clip(np.bincount(of, good * weight) / np.bincount(of, weight), 1e-6, 1 - 1e-6)
    logit, slope, shift = np.log(p / (1 - p)), 1.0, 0.0
    for _ in range(400):
        off = y - 1 / (1 + np.exp(-np.clip(slope * logit + shift, -30, 30)))
        slope, shift = max(0.05, slope + 0.1 * ((off * logit).mean() - 1e-3 * slope)), shift + 0.3 * off.mean()
    model.slope, model.shift = float(slope), float(shift)
    return model


def _weights(text: str) -> np.ndarray:
    return np.concatenate([np.fromiter((len(x) + 1 for x in own), float, len(own)) for own in _blocks(text)])


def fit_crf(texts: list[str], labels: list[int]) -> LineCRF:
    return fit_lines([(document_features(t), _weights(t)) for t in texts], labels)


def held_out(id_col: str = "doc_id"):
    """False for a row without id: its label is none that could be learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAINING_DOCS, max_lines: int = MAX_TRAINING_LINES) -> LineCRF:
    """Fit on at most max_docs labelled documents that are not held out, those of the smallest hashed ids, as long as they have
    max_lines lines together. A document that would go beyond, or has more than a tenth of max_lines by itself, is left
    out whole and changes nothing for those after it. Null labels and texts are left out; of
    two labels the smaller counts; rows alike in id and text are one. Features are extracted on the executors, and those
    alone, 56 bytes a line, come to the driver.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("_label")).filter("_label IN (0, 1) AND _id IS NOT NULL")
        .filter(~held_out("_id")).groupBy("_id").agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text IS NOT NULL").join(F.broadcast(chosen), "_id").withColumn("_key", F.xxhash64("_text"))
    n_lines = F.char_length("_text") - F.char_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    places = rows.select("_id", "_key", n_lines.cast("long").alias("_n")).distinct().filter(F.col("_n") <= max_lines // 10)
    # max_docs rows at most, three numbers each
    taken, total = [], 0
    for r in places.orderBy(F.xxhash64("_id"), "_id", "_key").limit(max_docs).collect():
        if total + r["_n"] <= max_lines:
            taken.append((r["_id"], r["_key"]))
            total += r["_n"]
    picked = docs.sparkSession.createDataFrame(taken, rows.select("_id", "_key").schema)
    sample = rows.join(F.broadcast(picked), ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, label, id_, key in zip(pdf["_text"], pdf["_label"], pdf["_id"], pdf["_key"], strict=True):
                yield pd.DataFrame({"_id": [id_], "_key": [key], "_label": [label], "x": [document_features(text).tobytes()], "w": [_weights(text).astype(np.float32).tobytes()]})

    found = sample.select(F.col("_id").cast("string").alias("_id"), "_key", "_label", "_text").mapInPandas(extract, "_id string, _key long, _label int, x binary, w binary").collect()
    found.sort(key=lambda r: (r["_id"], r["_key"]))
    return fit_lines([(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES), np.frombuffer(r["w"], np.float32)) for r in found], [r["_label"] for r in found])


def score_quality(docs: DataFrame, model: LineCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; null text scores as empty text, that is as one empty line. Repeated rows and ids
    give repeated rows, an empty table none; other columns are left out, whatever their names."""
    own, sent, kind = id_type(docs, id_col)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = model.score(pdf[text_col].tolist())
            yield pd.DataFrame({id_col: pdf[id_col], "score": found, "predicted": (found >= THRESHOLD).astype("int32")})

    scored = docs.select(own.alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInPandas(score, f"`{id_col}` {sent}, score double, predicted int")
    return scored.withColumn(id_col, F.col(id_col).cast(kind))


def line_quality(docs: DataFrame, model: LineCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, good, length) of every line of every row: the marginal of label 1, and the line's weight."""
    own, sent, kind = id_type(docs, id_col)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, texts in in_batches(pdf[text_col].tolist()):
                for i, (good, weight) in enumerate(model.line_marginals(texts)):
                    yield pd.DataFrame({id_col: pdf[id_col].iloc[start + i], "line_no": np.arange(len(good), dtype=np.int32), "good": good, "length": weight.astype(np.int64)})

    scored = docs.select(own.alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInPandas(score, f"`{id_col}` {sent}, line_no int, good double, length long")
    return scored.withColumn(id_col, F.col(id_col).cast(kind))
