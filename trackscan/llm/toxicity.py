"""Toxicity by a factorization machine over hashed terms (operator 6).

Terms are the lower-cased words of a text and their first three to six letters, hashed into buckets. A
text's features are the buckets that it holds, each once. Besides a bias and a weight for each bucket
the machine learns a vector for each, and adds the mean over buckets of the inner products of every pair that
meets, so that two terms can mean more together than alone; the pair sum costs no more than a linear one.

Every bucket that two learned texts hold has a weight and a vector; none is chosen by its own rates. Weights
are learned together by proximal gradient steps, a bucket's penalty being TAU standard errors of its gradient;
then vectors are learned by AdaGrad on what the weights leave open.

Defined results: a null, empty or wordless text has no features and scores by the bias alone; a very long one
is scored whole; with nothing to learn from every text scores 0; a document with several labels counts as
toxic if one of them says so, and of rows that repeat a learned id the least text is learned; null labels or
ids aren't learned from; equal texts score alike, and scores look at the text alone; an empty table gives no
rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.llm import textvec as tv
from trackscan.llm.common import fold, fresh, give_back, share, strings

#: Labelled documents that the machine learns from, about; chosen by a hash of the id, texts whole.
SAMPLE = 12_000
BITS = 20
PREFIXES = (3, 4, 5, 6)
FACTORS = 4
#: How far the classes' shares in the loss keep their rates: 0 not at all, 1 wholly.
EVEN = 0.25
#: Penalty of weights in standard errors, and steps; decay of vectors, rounds, rate and texts of a step.
TAU, STEPS = 2.0, 80
DECAY, ROUNDS, RATE, BATCH = 0.002, 8, 0.05, 256
#: Entries of the sample that are added up at a time; code points whose buckets are found at a time.
PART, SLICE = 1 << 20, 400_000
#: A text's buckets as it is learned from: little-endian unsigned 32-bit numbers, ascending.
PACKED = "<u4"


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, each once, texts ascending."""
    points, bounds = tv.points(texts)
    points = tv.lower_points()[points]
    start, end, row = tv.runs(tv.letters()[points], bounds)
    rolling = tv.Rolling(points)
    found = [rolling.ranges(start, end, 1)]
    rows = [row]
    for n in PREFIXES:
        long = end - start >= n
        found.append(rolling.ranges(start[long], start[long] + n, 2))
        rows.append(row[long])
    pairs = np.concatenate(rows).astype(np.uint64) << np.uint64(BITS) | np.concatenate(found) >> np.uint64(64 - BITS)
    return pairs >> np.uint64(BITS), pairs & np.uint64((1 << BITS) - 1)


def once(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs sorted, each once."""
    pairs = np.unique(row.astype(np.uint64) << np.uint64(BITS) | bucket.astype(np.uint64))
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Machine:
    """bias, buckets (ascending), weights and vectors."""

    def __init__(self, bias: float, buckets: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.buckets, self.weights, self.vectors = bias, buckets, weights, vectors
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bias=self.bias, buckets=self.buckets.astype(PACKED), weights=self.weights.astype(np.float32), vectors=self.vectors.astype(np.float32))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Machine:
        x = np.load(io.BytesIO(data))
        return cls(float(x["bias"]), x["buckets"], x["weights"], x["vectors"])

    def raw(self, n: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Bias, sum of weights and mean of pair products for n texts of (row, index of bucket) pairs."""
        pairs = np.zeros(n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[term, f]
            pairs += np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n)
        return self.bias + np.bincount(row, self.weights[term], n) + 0.5 * pairs / np.maximum(np.bincount(row, minlength=n), 1)

    def score(self, texts: list[str]) -> np.ndarray:
        n = len(texts)
        row, bucket = features(texts)
        known = self.place[bucket] >= 0
        row, bucket = once(row[known], bucket[known])
        return 1 / (1 + np.exp(-np.clip(self.raw(n, row, self.place[bucket]), -30, 30)))


def packed(texts: list[str]) -> list[bytes]:
    """The buckets of each text."""
    out: list[bytes] = []
    for a, b in tv.slices(texts, SLICE):
        row, bucket = once(*features(texts[a:b]))
        cuts = np.searchsorted(row, np.arange(b - a + 1))
        out += [bucket[x:y].astype(PACKED).tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return out


def train(held: list[bytes], toxic: np.ndarray) -> Machine:
    """A machine learned from texts' buckets on the logistic loss, the rarer class weighted up."""
    none = np.zeros(0)
    if not len(held) or not toxic.any() or toxic.all():
        return Machine(-30.0 if not toxic.any() else 30.0, none.astype(np.int64), none, np.zeros((0, FACTORS)))
    n = len(held)
    sizes = [len(x) // 4 for x in held]
    bucket = np.frombuffer(b"".join(held), PACKED)
    held.clear()  # the texts' own buckets are all in one array now
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    several = tally(bucket, 1 << BITS) > 1
    own = several[bucket]
    row, bucket = row[own], bucket[own]
    kept = np.flatnonzero(several)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    term = place[bucket]
    p, q = toxic.mean() ** EVEN, (~toxic).mean() ** EVEN
    share_of = np.where(toxic, p / (p + q) / toxic.sum(), q / (p + q) / (~toxic).sum())
    del bucket, own
    bias, weights = learn_weights(row, term, len(kept), toxic, share_of)
    linear = bias + sum((np.bincount(row[p], weights[term[p]], n) for p in parts(len(row))), np.zeros(n))
    vectors = learn_vectors(row, term, len(kept), toxic, share_of, linear)
    return Machine(bias, kept, weights, vectors)


def parts(n: int) -> list[slice]:
    """n entries, PART at a time: what numpy makes of them is several times as large."""
    return [slice(low, low + PART) for low in range(0, n, PART)]


def tally(numbers: np.ndarray, k: int) -> np.ndarray:
    """How often each number under k is met."""
    return sum((np.bincount(numbers[p], minlength=k) for p in parts(len(numbers))), np.zeros(k, np.int64))


def learn_weights(row: np.ndarray, term: np.ndarray, k: int, toxic: np.ndarray, share_of: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights: accelerated proximal gradient, each bucket's step from its own curvature bound."""
    n = len(toxic)
    cuts = parts(len(row))

    def by_text(values: np.ndarray) -> np.ndarray:
        return sum((np.bincount(row[p], values[term[p]], n) for p in cuts), np.zeros(n))

    def by_bucket(values: np.ndarray) -> np.ndarray:
        return sum((np.bincount(term[p], values[row[p]], k) for p in cuts), np.zeros(k))

    penalty = TAU * np.sqrt(by_bucket((0.5 * share_of) ** 2))
    step = 4 / np.maximum(by_bucket(share_of * tally(row, n)), 1e-12)
    weights = ahead = np.zeros(k)
    bias = bias_ahead = 0.0
    pace = 1.0
    for _ in range(STEPS):
        error = share_of * (1 / (1 + np.exp(-np.clip(bias_ahead + by_text(ahead), -30, 30))) - toxic)
        moved = ahead - step * by_bucket(error)
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        bias_moved = bias_ahead - 4 * error.sum()
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, bias_ahead = moved + (pace - 1) / faster * (moved - weights), bias_moved + (pace - 1) / faster * (bias_moved - bias)
        weights, bias, pace = moved, bias_moved, faster
    return float(bias), weights


def learn_vectors(row: np.ndarray, term: np.ndarray, k: int, toxic: np.ndarray, share_of: np.ndarray, linear: np.ndarray) -> np.ndarray:
    """Vectors of all buckets, for pair products beside `linear`, by AdaGrad over fixed groups of texts."""
    n = len(toxic)
    cuts = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.05, (k, FACTORS)).astype(np.float32)
    slots = np.full((k, FACTORS), 1e-8, np.float32)
    groups = []
    for part in np.array_split(rng.permutation(n), max(1, n // BATCH)):
        size = cuts[part + 1] - cuts[part]
        part, size = part[size > 0], size[size > 0]
        if not len(part):
            continue
        starts = np.cumsum(size) - size
        at = np.repeat(cuts[part] - starts, size) + np.arange(int(size.sum()))
        used, held = np.unique(term[at], return_inverse=True)
        order = np.argsort(held, kind="stable")
        first = np.searchsorted(held[order], np.arange(len(used)))
        text = np.repeat(np.arange(len(part), dtype=np.int32), size)[order]  # of each entry, by bucket
        groups.append((part, size, starts, held.astype(np.int32), text, used, first))
    for _ in range(ROUNDS):
        for i in rng.permutation(len(groups)):
            part, size, starts, held, text, used, first = groups[i]
            own = vectors[used]
            v = own[held]
            total = np.add.reduceat(v, starts)
            raw = linear[part] + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((own * own).sum(axis=1)[held], starts)) / size
            error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - toxic[part]) * share_of[part] * (n / len(part)) / size).astype(np.float32)
            grad = np.add.reduceat((error[:, None] * total)[text], first) - own * np.add.reduceat(error[text], first)[:, None] + DECAY * own
            slots[used] += grad * grad
            vectors[used] -= RATE * grad / np.sqrt(slots[used])
    return vectors


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", learn: Column | None = None, sample: int = SAMPLE) -> bytes:
    """A machine learned in one task from about `sample` labelled documents.

    All tasks turn the chosen texts into buckets, whole; the one task gets 2**BITS of them a text at most.
    """
    own = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    if learn is not None:
        own = own.where(learn)
    n = own.count()
    chosen = own.where(share(F.col("k"), sample / max(n, 1))).groupBy("k").agg(F.max("y").alias("y"))
    # about `sample` keys and labels, whatever the size of the tables: small enough to broadcast
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL").join(F.broadcast(chosen), "k")
    # rows that repeat an id are one, so that the sample is bounded
    rows = rows.groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y")).select("t", "y")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packed(strings(batch.column(0))), pa.binary()), pa.array([y > 0 for y in batch.column(1).to_pylist()])], ["held", "toxic"])
            give_back()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((held, toxic) for batch in batches for held, toxic in zip(*(c.to_pylist() for c in batch.columns)))  # the same machine from any order
        held, toxic = [held for held, _ in rows], np.array([toxic for _, toxic in rows], bool)
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([train(held, toxic).dump()], pa.binary())], ["model"])
        give_back()

    found = rows.mapInArrow(pack, "held binary, toxic boolean").repartition(1).mapInArrow(work, "model binary").collect()
    return bytes(found[0]["model"]) if found else train([], np.zeros(0, bool)).dump()


_loaded: dict[bytes, Machine] = {}


def _machine(data: bytes) -> Machine:
    if data not in _loaded:
        _loaded.clear()
        _loaded[data] = Machine.load(data)
    return _loaded[data]


def score(docs: DataFrame, model: bytes, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the score of each text, 0 to 1; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS buckets

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _machine(shared.value)
        for texts in batches:
            texts = [x if isinstance(x, str) else "" for x in texts]
            yield pd.Series(np.concatenate([np.zeros(0), *(own.score(texts[a:b]) for a, b in tv.slices(texts, SLICE))]))
            give_back()

    return docs.withColumn(column, F.pandas_udf(run, "double")(F.col(text)))


def learnable() -> Column:
    return fold(F.col("k"), 5) != 0


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document, learned from the folds that aren't held out."""
    own = docs.select("doc_id", "text")
    done = score(own, fit(own, labels, learn=learnable()))
    return done.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more."""
    own = fresh(docs, 1)[0]
    done = score(docs, fit(docs, labels, learn=learnable()), column=own)
    return done.where(F.col(own) < 0.5).drop(own)
