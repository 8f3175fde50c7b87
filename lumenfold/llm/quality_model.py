"""A quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Tokens are runs of letters, of digits and of other marks. Three views of them give n-grams: the
lower-cased tokens (1 and 2), their shapes (2 and 3; a mark is its own shape), and how far back the
same token stood last, within a few (2). An n-gram's value is its share of the text's tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.arrowtext import ASCII_LOWER, append_columns, combine, flat, mix, steps, word_hashes
from lumenfold.session import ship_package

BUCKETS = 1 << 20
#: The model is fitted on about so many labelled rows, taken by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Rows of a shard, and passes over them.
SHARD_ROWS, EPOCHS = 5_000, 3
#: Follow the regularised leader: learning rate, its smoothing, L1 and L2 strengths.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
SCALE = 24.0
LOOK_BACK = 8
_VIEWS = 5

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True


def ngrams(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of every token (rows; one column a view), and each document's first row."""
    kind = _KIND[body]
    first = np.zeros(len(body), bool)
    first[at[:-1][at[:-1] < len(body)]] = True
    turn = np.ones(len(body), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn |= first
    edges = np.flatnonzero(turn)
    ends = np.append(edges[1:], len(body))
    real = kind[edges] > 0
    starts, ends = edges[real], ends[real]
    begin = np.searchsorted(starts, at)
    n = len(starts)
    if not n:
        return np.zeros((0, _VIEWS), np.int64), begin
    word = word_hashes(body, starts, ends, ASCII_LOWER)
    sort = kind[starts]
    ups = np.concatenate([[0], np.cumsum(_UPPER[body])])
    lows = np.concatenate([[0], np.cumsum(_LOWER[body])])
    up, low = ups[ends] - ups[starts], lows[ends] - lows[starts]
    shape = np.where(low == 0, np.where(up > 1, 4, 3), np.where(up == 0, 1, np.where((up == 1) & _UPPER[body[starts]], 2, 5)))
    shape = np.where(sort == 3, word, np.where(sort == 2, 6, shape).astype(np.uint64))
    place = np.arange(n)
    doc_first = np.repeat(begin[:-1], np.diff(begin))
    back = np.zeros(n, np.uint64)
    for k in range(LOOK_BACK, 0, -1):
        same = np.zeros(n, bool)
        same[k:] = word[k:] == word[:-k]
        back[same & (place - k >= doc_first)] = k

    def before(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[k:] = x[:-k] if k < n else x[:0]
        out[place - k < doc_first] = 0
        return out

    views = [
        combine(np.full(n, 1, np.uint64), word),
        combine(np.full(n, 2, np.uint64), before(word, 1), word),
        combine(np.full(n, 3, np.uint64), before(shape, 1), shape),
        combine(np.full(n, 4, np.uint64), before(shape, 2), before(shape, 1), shape),
        combine(np.full(n, 5, np.uint64), before(back, 1), back),
    ]
    return np.stack([(mix(v) & np.uint64(BUCKETS - 1)).astype(np.int64) for v in views], 1), begin


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the intercept, without L1."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (BETA + np.sqrt(n)) / ALPHA + L2
        l1 = np.where(np.arange(BUCKETS + 1)[at] == BUCKETS, 0.0, L1)
        return -np.sign(z) * np.maximum(0, np.abs(z) - l1) / rate

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
        old = self.n[at]
        sigma = (np.sqrt(old + gradient**2) - np.sqrt(old)) / ALPHA
        self.z[at] += gradient - sigma * w
        self.n[at] = old + gradient**2


def examples_of(texts: pa.Array, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(buckets, values, label) of each text with a token; the last bucket is the intercept's."""
    for i, j, body, at in steps(texts):
        buckets, begin = ngrams(body, at)
        for d in range(i, j):
            own = buckets[begin[d - i] : begin[d - i + 1]]
            if len(own):
                found, n = np.unique(own, return_counts=True)
                yield np.append(found, BUCKETS), np.append(n * (SCALE / len(own)), 1.0), float(labels[d])


def fit(examples: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """The weights of one shard, from its examples in order, ``EPOCHS`` times."""
    model = Ftrl()
    for _ in range(EPOCHS):
        for example in examples:
            model.learn(*example)
    return model.weights()


def train(docs: DataFrame, labels: DataFrame, label_col: str, text_col: str = "text", id_col: str = "doc_id", most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights over the buckets and, last, the intercept; all zero without labelled rows.

    About ``most`` labelled rows are taken by a hash of ``id_col``; of labels that conflict the larger
    counts. A shard has about ``SHARD_ROWS`` of them, and learns in the order of that hash, whatever
    task it is in; the weights are the shards' mean by rows. A shard of one task is bounded by
    ``most`` rows and its texts' length. Null labels, ids and texts teach nothing; texts of rows that
    repeat an id all count.
    """
    ship_package(docs.sparkSession)
    labels = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("__label"))
    order = F.xxhash64(F.lit("quality sample"), F.col("__id"))
    known = labels.count()
    share = most / max(1, known)
    shards = max(1, round(min(most, known) / SHARD_ROWS))
    sample = labels.filter(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < share)
    rows = docs.join(F.broadcast(sample), docs[id_col] == F.col("__id")).filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), "__label", order.alias("__order"), F.pmod(F.xxhash64(F.lit("shard"), F.col("__id")), F.lit(shards)).alias("__shard"))
    dealt = rows.repartition(shards, "__shard").sortWithinPartitions("__shard", "__order", "text")

    def learn(batches):
        shard, examples = None, []
        for batch in batches:
            label, of = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i < j and of[i] != shard:
                    yield from model(shard, examples)
                    shard, examples = of[i], []
                examples.extend(examples_of(batch.column(0).slice(i, j - i), label[i:j]))
        yield from model(shard, examples)

    def model(shard, examples):
        if examples:
            weights = fit(examples).astype(np.float32)
            at = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array([int(shard)], pa.int64()), pa.array([len(examples)], pa.int64()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([weights[at].tobytes()], pa.binary())], names=["shard", "n", "at", "weights"])

    # So many shards as the bound on training rows gives, each with the weights that are not zero.
    parts = sorted(dealt.mapInArrow(learn, "shard long, n long, at binary, weights binary").collect(), key=lambda p: p["shard"])
    total = sum(p["n"] for p in parts)
    out = np.zeros(BUCKETS + 1)
    for p in parts:
        out[np.frombuffer(p["at"], "<i4")] += np.frombuffer(p["weights"], np.float32) * (p["n"] / total)
    return out.astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score double (0 to 1, higher: label 1 likelier) and predicted int.

    A null or empty text has the score of the intercept alone. Repeated rows stay, and columns of
    ``docs`` named like a new one give way.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = sent.value

        def work(texts: pa.Array) -> list:
            out = np.full(len(texts), float(w[BUCKETS]))
            for i, j, body, at in steps(texts, 1 << 20):
                buckets, begin = ngrams(body, at)
                sums = np.concatenate([[0.0], np.cumsum(w[buckets].sum(1, dtype=np.float64))])
                n = np.diff(begin)
                out[i:j] += np.where(n > 0, (sums[begin[1:]] - sums[begin[:-1]]) * SCALE / np.maximum(1, n), 0)
            return [1 / (1 + np.exp(-np.clip(out, -500, 500)))]

        return work

    return append_columns(docs, make, "score double", text_col, keep).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
