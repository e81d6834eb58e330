"""Language identification by word-first backoff (operator 4).

A word that was seen in training adds its log frequency in each language; an unseen word falls back to
its character 5-grams, and if none of them is known to 4-grams, and so on down to single characters.

Defined results: a text that is null, empty or without a letter gets `und` and score 0; with nothing to
learn from every text does; ties go to the language that sorts first; repeated rows score alike;
prediction looks at the text alone.
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

#: Learned documents of each language, about; chosen by a hash of the id, texts taken whole.
SAMPLE = 1500
ORDERS = (5, 4, 3, 2, 1)
#: How much the evidence of a word counts when only n-grams of an order know it.
WEIGHT = {5: 0.8, 4: 0.7, 3: 0.5, 2: 0.3, 1: 0.2}
#: Words whose evidence the score of a text rests on at most: more words add no more certainty.
EVIDENCE = 20.0
#: Added to every count.
SMOOTH = 0.1
UNKNOWN = "und"


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tv.Rolling, np.ndarray]:
    """(start, end, text) of each word, hashes over the padded code points, and has-letter flags.

    The array holds a space before each word and one behind it, so that n-grams see word ends.
    """
    points, bounds = tv.points(texts)
    points = tv.lower_points()[points]
    inside = tv.letters()[points]
    start, end, row = tv.runs(inside, bounds)
    flat = np.where(inside, points, 32).astype(np.uint32)
    padded = np.concatenate([[32], flat, [32]]).astype(np.uint32)
    # words of neighbouring texts may touch: a gap is put between them
    touch = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(flat))]
    if len(touch):
        padded = np.insert(padded, touch + 1, 32)
        shift = np.searchsorted(touch, start, "right")
        start, end = start + shift, end + shift
    return start + 1, end + 1, row, tv.Rolling(padded), padded


def _grams(start: np.ndarray, end: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word) of the n-grams of each word, with the spaces around it if order > 1."""
    low, high = (start - 1, end + 1) if order > 1 else (start, end)
    n = np.maximum(high - low - order + 1, 0)
    word = np.repeat(np.arange(len(n)), n)
    at = low[word] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return at, at + order, word


class Model:
    """Log frequencies per language of hashed words and n-grams, keys sorted."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.languages, self.tables = languages, tables

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages, "U"), **{f"{kind}{order}": x for order, pair in self.tables.items() for kind, x in zip("kv", pair)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        found = np.load(io.BytesIO(data))
        return cls(found["languages"].tolist(), {n: (found[f"k{n}"], found[f"v{n}"]) for n in (0, *ORDERS) if f"k{n}" in found})

    def _find(self, order: int, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash in the table of an order; -1 where it isn't known."""
        keys = self.tables[order][0]
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        if not texts:
            return [], np.zeros(0)
        n, k = len(texts), len(self.languages)
        start, end, row, rolling, _ = _words(texts)
        counts = np.bincount(row, minlength=n)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        total = np.zeros((n, k))
        at = self._find(0, rolling.ranges(start, end))
        known = at >= 0
        values = self.tables[0][1]
        for j in range(k):
            total[:, j] = np.bincount(row[known], values[at[known], j], n)
        left = np.flatnonzero(~known)
        for order in ORDERS:
            if not len(left):
                break
            a, b, word = _grams(start[left], end[left], order)
            at = self._find(order, rolling.ranges(a, b))
            hit = at >= 0
            hits = np.bincount(word[hit], minlength=len(left))
            some = hits > 0
            values = self.tables[order][1]
            scale = np.where(some, WEIGHT[order] / np.maximum(hits, 1), 0)
            for j in range(k):
                mean = np.bincount(word[hit], values[at[hit], j], len(left)) * scale
                total[:, j] += np.bincount(row[left], mean, n)
            left = left[~some]
        total *= np.minimum(1.0, EVIDENCE / np.maximum(counts, 1))[:, None]
        top = total.max(axis=1, keepdims=True)
        chance = np.exp(total - top)
        score = 1 / chance.sum(axis=1)
        best = total.argmax(axis=1)
        return [self.languages[i] if c else UNKNOWN for i, c in zip(best.tolist(), counts.tolist())], np.where(counts > 0, score, 0.0)


def count(rows: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """order (0 for words), key, lang and n: how often each word and n-gram is in the texts of each language."""
    languages = sorted({lang for _, lang in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    texts = [t for t, _ in rows]
    found: list[tuple[int, str, np.ndarray, np.ndarray]] = []
    for a, b in tv.slices(texts):
        own = np.array([number[lang] for _, lang in rows[a:b]])
        start, end, row, rolling, _ = _words(texts[a:b])
        for order in (0, *ORDERS):
            x, y, word = (start, end, np.arange(len(start))) if order == 0 else _grams(start, end, order)
            hashes, lang = rolling.ranges(x, y), own[row[word]]
            for j in np.unique(lang).tolist():
                found.append((order, languages[j], *np.unique(hashes[lang == j], return_counts=True)))
    sizes = [len(keys) for _, _, keys, _ in found]
    return {
        "order": np.repeat(np.array([order for order, *_ in found], np.int32), sizes),
        "key": np.concatenate([np.zeros(0, np.uint64), *(keys for _, _, keys, _ in found)]).view(np.int64),
        "lang": np.repeat(np.array([lang for _, lang, *_ in found], object), sizes),
        "n": np.concatenate([np.zeros(0, np.int64), *(n for *_, n in found)]),
    }


def build(counts: dict[str, np.ndarray]) -> Model:
    """A model of counts, which may hold a key of a language several times."""
    languages = sorted(set(counts["lang"]))
    if not languages:
        return Model([], {n: (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)) for n in (0, *ORDERS)})
    number = np.searchsorted(np.array(languages, object), counts["lang"])
    keys = counts["key"].view(np.uint64)
    tables = {}
    for order in (0, *ORDERS):
        own = counts["order"] == order
        unique, at = np.unique(keys[own], return_inverse=True)
        total = np.zeros((len(unique), len(languages)))
        np.add.at(total, (at, number[own]), counts["n"][own])
        logs = np.log((total + SMOOTH) / (total.sum(axis=0) + SMOOTH * max(1, len(unique))))
        # relative to the mean over languages: only differences between languages matter
        tables[order] = unique, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)
    return Model(languages, tables)


def train(rows: list[tuple[str, str]]) -> Model:
    """A model of (text, language) rows."""
    return build(count(rows))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", learn: Column | None = None, sample: int = SAMPLE) -> bytes:
    """A model learned from about `sample` whole documents of each language; all tasks count, and one gets the counts.

    Rows without a text, language or key are not learned from; of rows that repeat a chosen key the least is.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"), (F.lit(True) if learn is None else learn).alias("w")).where("w AND l IS NOT NULL AND t IS NOT NULL AND k IS NOT NULL").drop("w")
    # one row for each language
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("l") == name) & share(F.col("k"), sample / n))
    picked = rows.where(chosen).groupBy("k").agg(F.min(F.struct("t", "l")).alias("r")).select("r.t", "r.l")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count(list(zip(strings(batch.column(0)), batch.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(found["order"]), pa.array(found["key"]), pa.array(found["lang"], pa.string()), pa.array(found["n"])], ["order", "key", "lang", "n"])
            del found
            give_back()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("order", pa.int32()), ("key", pa.int64()), ("lang", pa.string()), ("n", pa.int64())]))
        made = build({c: table.column(c).to_numpy() for c in table.column_names})
        del table
        yield pa.RecordBatch.from_arrays([pa.array([made.dump()], pa.binary())], ["model"])
        del made
        give_back()

    # what the one task gets is bounded by the words and n-grams of the sample
    every = picked.mapInArrow(counted, "order int, key bigint, lang string, n bigint").groupBy("order", "key", "lang").agg(F.sum("n").alias("n"))
    found = every.repartition(1).mapInArrow(work, "model binary").collect()
    return bytes(found[0]["model"]) if found else train([]).dump()


_loaded: dict[bytes, Model] = {}


def _model(data: bytes) -> Model:
    if data not in _loaded:
        _loaded.clear()
        _loaded[data] = Model.load(data)
    return _loaded[data]


def identify(docs: DataFrame, model: bytes, text: str = "text", lang_column: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """docs with the predicted language and its score; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _model(shared.value)
        for column in batches:
            texts = [x if isinstance(x, str) else "" for x in column]
            langs: list[str] = []
            scores = [np.zeros(0)]
            for a, b in tv.slices(texts):
                found, score = own.score(texts[a:b])
                langs += found
                scores.append(score)
            yield pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": np.concatenate(scores)})
            give_back()

    own = fresh(docs, 1)[0]
    made = docs.withColumn(own, F.pandas_udf(predict, "lang string, score double")(F.col(text)))
    return made.withColumns({lang_column: F.col(own)["lang"], score_column: F.col(own)["score"]}).drop(own)


def learnable(key: str = "doc_id") -> Column:
    return fold(F.col(key), 3) != 1


def query(docs: DataFrame) -> DataFrame:
    """Language and score of every document, learned from the folds that aren't held out."""
    own = docs.select("doc_id", "text", "lang")
    model = fit(own, learn=learnable())
    done = identify(own.select("doc_id", "text"), model)
    return done.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those whose language can't be told: no letter, or a score under `least`."""
    model = fit(docs, learn=learnable())
    lang, score = fresh(docs, 2)
    done = identify(docs, model, lang_column=lang, score_column=score)
    return done.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
