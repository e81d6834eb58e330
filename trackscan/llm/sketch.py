"""Document fingerprints: bottom-k sketches of word shingles (operator 8).

A sketch is the k least distinct 64-bit hashes of a text's five-word shingles, ascending. Sketches of
parts merge into that of the whole; two of them estimate resemblance and containment, and one of them
the number of distinct shingles. Words are runs of anything but white space, in lower case; a text of
fewer words has its whole word sequence as its one shingle, and a text without words an empty sketch.

Defined results: null is empty; two empty sketches are alike with likeness 1, an empty one and another
with 0; very long texts are sketched whole; rows are ordered by id, nulls first, rows that share an id by a hash
of their text, and the next document is the next row in that order, the first after the last, so that of equal
rows all but the last are followed by themselves; a lone row is its own next; ids of any type that sorts keep it;
other columns aren't looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.llm import textvec as tv
from trackscan.llm.common import materialize, share

WORDS, K = 5, 256
#: Ranges of documents per shuffle partition, and most ranges in all: a range streams through its task, whatever its size.
RANGES, MOST_RANGES = 3, 20_000
#: Documents that cuts between ranges are chosen from, for each range; copies of a row that are made at a time.
PICKED, COPIES = 50, 1000
#: Repeated rows (id and hash of the text) that are broadcast at most.
FEW = 100_000


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle, texts ascending."""
    points, bounds = tv.points(texts)
    start, end, row = tv.runs(~tv.spaces()[points], bounds)
    if not len(start):
        return row, np.zeros(0, np.uint64)
    word = tv.Rolling(tv.lower_points()[points]).ranges(start, end)
    count = np.bincount(row, minlength=len(texts))
    first = np.cumsum(count) - count
    last = np.maximum(count - words, 0) + first  # the last shingle's first word
    at = np.arange(len(word))
    heads = at[at <= last[row]]
    left = np.minimum(count[row[heads]], words)
    out = left.astype(np.uint64)
    for i in range(words):
        more = i < left
        out = np.where(more, tv.mix(out * np.uint64(tv.BASE) + word[np.minimum(heads + i, len(word) - 1)]), out)
    return row[heads], out


def sketches(texts: list[str], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    row, hashes = shingles(texts, words)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[fresh], hashes[fresh]
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    return [hashes[a : min(b, a + k)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of either that both hold."""
    union = np.union1d(a, b)[:k]
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of a that b holds."""
    own = distinct(a, k)
    if not own:
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / own)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """key and sketch (little-endian unsigned 64-bit hashes, ascending) of each text."""
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in tv.slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.astype("<u8").tobytes() for s in sketches(texts[a:b], k)], pa.binary())], ["k", "sketch"])

    return source.mapInArrow(work, f"k {kind}, sketch binary").withColumnRenamed("k", key)


def merge_sketches(rows: DataFrame, group: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """group and the merged sketch of its rows; null sketches count as empty.

    Tasks first merge what they hold, so a group of any size sends on one sketch for each task and
    a few more where a task holds very many groups.
    """
    source = rows.select(F.col(group).alias("g"), F.col(sketch).alias("s"))
    schema = f"g {source.schema['g'].dataType.simpleString()}, s binary"

    def combine(most: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(held), batch.column(0).type), pa.array([x.astype("<u8").tobytes() for x in held.values()], pa.binary())], ["g", "s"])

            for batch in batches:
                for g, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if g not in held and len(held) >= most:
                        yield out()
                        held.clear()
                    found = np.frombuffer(part or b"", "<u8")
                    held[g] = merged(held[g], found, k) if g in held else found
            if held:
                yield out()

        return work

    partial = source.mapInArrow(combine(10_000), schema)
    # sorted: the rows of a group follow each other, so one group is held at a time
    done = partial.repartition("g").sortWithinPartitions("g").mapInArrow(combine(1), schema)
    return done.select(F.col("g").alias(group), F.col("s").alias(sketch))


def edited(own: str, after: str) -> str:
    """own with its last floor(n/2) code points replaced by the first as many, or all, of after."""
    half = len(own) // 2
    return own[: len(own) - half] + after[:half]


NEXT = "n_chars bigint, sketch binary, edited string, edited_sketch binary, near_edited double, near_next double"


def _compared(keys: pa.Array, texts: list[str], k: int) -> pa.RecordBatch:
    """Rows that follow each other, compared with the next one each; the last text is only a next one."""
    changed = [edited(x, y) for x, y in zip(texts, texts[1:])]
    mine, new = sketches(texts, k), sketches(changed, k)
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([x.astype("<u8").tobytes() for x in mine[:-1]], pa.binary()),
            pa.array(changed, pa.string()),
            pa.array([x.astype("<u8").tobytes() for x in new], pa.binary()),
            pa.array([resemblance(x, y, k) for x, y in zip(mine, new)], pa.float64()),
            pa.array([resemblance(x, y, k) for x, y in zip(mine, mine[1:])], pa.float64()),
        ],
        ["k", "n_chars", "sketch", "edited", "edited_sketch", "near_edited", "near_next"],
    )


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """key, n_chars, sketch, edited text, its sketch, and likeness to both it and the next document.

    Documents are dealt into ranges of (id, hash of the text) and sorted there; the first one of each range goes
    to the range before it as well, so each text moves once and no task sees more than its range. Rows equal in
    both are one there, and all but one of them, followed by themselves, are made apart in many tasks.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    kind = source.schema["k"].dataType.simpleString()
    # ids and hashes alone: all that ranges and copies are found from
    facts = materialize(source.groupBy("k", "h").agg(F.count("*").alias("n")), "sketch-keys")
    rows = facts.count()
    n = max(1, min(MOST_RANGES, rows, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    place = F.struct(F.col("k").isNotNull().alias("known"), "k", "h")
    # about PICKED keys for each range, so at most a million
    picked = facts.where(share(F.struct("k", "h"), PICKED * n / max(rows, 1))).select(place.alias("p")).collect()
    ordered = sorted(tuple(r["p"]) for r in picked)
    cuts = sorted({ordered[i * len(ordered) // n] for i in range(1, n)}) if ordered else []

    def range_of(k: pd.Series, h: pd.Series) -> list[int]:
        return [bisect.bisect_right(cuts, (x is not None, x, y)) for x, y in zip(_plain(k), h.tolist())]

    ranged = F.pandas_udf(lambda k, h: pd.Series(range_of(k, h), dtype="int32"), "int")
    # one row for each range
    firsts = {r["r"]: tuple(r["p"]) for r in facts.select(ranged("k", "h").alias("r"), place.alias("p")).groupBy("r").agg(F.min("p").alias("p")).collect()}
    used = sorted(firsts)
    before = {firsts[r]: used[i - 1] for i, r in enumerate(used)}  # the first range's first closes the last range

    def places(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([[a, before[v]] if (v := (x is not None, x, y)) in before else [a] for a, x, y in zip(range_of(k, h), _plain(k), h.tolist())])

    several = materialize(facts.where("n > 1").select(F.col("k").alias("k2"), F.col("h").alias("h2"), "n"), "sketch-several")
    repeated = several.count()
    once, copies = source, None
    if repeated:
        # most tables repeat few rows or none: only beyond the checked number do texts move for this
        side = F.broadcast(several) if repeated <= FEW else several
        same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2"))
        copies = source.join(side, same, "left_semi").groupBy("k", "h").agg(F.first("t").alias("t"))
        once = source.join(side, same, "left_anti").unionByName(copies)
    dealt = once.select("k", "t", "h", F.posexplode(F.pandas_udf(places, "array<int>")("k", "h")).alias("extra", "r"))
    ready = dealt.repartition("r").sortWithinPartitions("r", "extra", F.asc_nulls_first("k"), "h").select("r", "extra", "k", "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            low = 0
            for i, (extra, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                # the extra row ends a range
                if texts and (extra or size > tv.BATCH_CHARS):
                    keys.append(batch.column(2).slice(low, i - low))
                    yield _compared(pa.concat_arrays(keys), [*texts, own], k)
                    keys, texts, size, low = [], [], 0, i
                if extra:
                    low = i + 1
                else:
                    texts.append(own)
                    size += len(own)
            keys.append(batch.column(2).slice(low))

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (own, times) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                made = _compared(batch.column(0).slice(i, 1), [own, own], k)
                for low in range(0, times, 16):
                    yield made.take(pa.array([0] * min(16, times - low)))

    made = ready.mapInArrow(work, f"k {kind}, {NEXT}")
    if copies is not None:
        more = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / COPIES))).alias("part")
        times = F.least(F.lit(COPIES).cast("long"), F.col("n") - 1 - F.col("part") * COPIES).cast("int")
        spread = copies.join(side, same).select("k", "h", "t", "n", more).repartition("k", "h", "part").select("k", "t", times.alias("times"))
        made = made.unionByName(spread.mapInArrow(repeats, f"k {kind}, {NEXT}"))
    return made.withColumnRenamed("k", key)


def _plain(values: pd.Series) -> list:
    """Values as Python's own, null as None."""
    return [None if missing else x for x, missing in zip(values.tolist(), values.isna().tolist())]


def _line(sketch: str) -> Column:
    """A sketch as text: base 64 on one line."""
    return F.translate(F.base64(sketch), "\r\n", "")


def query(docs: DataFrame) -> DataFrame:
    done = with_next(docs)
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _line("sketch").alias("fingerprint"), _line("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next")
