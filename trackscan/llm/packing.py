"""Best-fit packing of documents into sequences (operator 5).

Pieces are planned by length, not one by one: a histogram of at most `size` lengths comes to the
driver, whatever the number of documents. From the longest on, a gap is looked up in an index of the sums of
one, two and three lengths under the counts at hand, which may be of the opening length itself; what
finds no exact complement takes the longest piece that still fits, and its new gap is looked up again. The
sequence so found is made as often as the counts allow. Where plain best fit needs fewer sequences its plan is
taken. Each step all but uses up a length, so a plan is bounded by the lengths. Pieces then get a rank
within their length, and rank ranges name sequences.

Defined results: a null or empty text is one piece that holds the end id alone; a very long one is cut into
as many pieces as it needs; rows that repeat an id are separate documents with equal piece numbers; a null id
is kept; extra columns of `assign` are kept, but for sequence_id and offset; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackscan.llm import bpe
from trackscan.llm import textvec as tv
from trackscan.llm.common import fresh, give_back, materialize, strings

SIZE = 2048
END_ID = 0
#: Rows of one length that are ranked together, at least; the square root of their number if more.
RANKED = 1000


@lru_cache(2)
def _encoder(path: str) -> bpe.Added:
    vocab = bpe.vocabulary(path)
    return bpe.Added(bpe.Cached(lambda words: vocab.merge([w.encode() for w in words])), vocab.added)


def pieces(docs: DataFrame, vocab_path: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length and ids (little-endian unsigned 32-bit) of every piece.

    A document is its ids and END_ID. One longer than `size` is cut so that only its first piece may
    be shorter.
    """
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(vocab_path)
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in tv.slices(texts):
                ids, counts = own.encode(texts[a:b])
                ends = np.cumsum(counts)
                whole = np.insert(ids, ends, END_ID).astype("<u4")
                counts = counts + 1
                number = -(-counts // size)
                first = counts - (number - 1) * size
                row = np.repeat(np.arange(len(counts)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                length = np.where(piece == 0, first[row], size)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), bpe._pieces(whole, length)], ["k", "piece", "start", "length", "ids"]
                )
            give_back()

    return source.mapInArrow(work, f"k {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("k", key)


class Sums:
    """The sums of one, two and three lengths at hand, each with the combination that gives it.

    `have` counts the pieces of each length and only falls, so a combination that can't be had any more never
    can again: every sum keeps its place in the list of its combinations, longest first, and moves on from there.
    """

    def __init__(self, have: list[int]):
        self.have = have
        self.below = [x - 1 for x in range(len(have))]  # the next length to look at below one that is used up
        self.pair_at = [s - 1 for s in range(len(have))]
        self.triple_at = [s - 2 for s in range(len(have))]

    def longest(self, most: int) -> int:
        """The longest length at hand up to `most`; 0 if there is none."""
        at, passed = most, []
        while at and not self.have[at]:
            passed.append(at)
            at = self.below[at]
        for x in passed:
            self.below[x] = at
        return at

    def pair(self, total: int) -> tuple[int, ...]:
        """Lengths a >= b with that sum; empty if none are at hand."""
        a = self.pair_at[total]
        while 2 * a >= total > 1 and not (self.have[total - a] and self.have[a] > (2 * a == total)):
            a -= 1
        self.pair_at[total] = a
        return (a, total - a) if 2 * a >= total > 1 else ()

    def triple(self, total: int) -> tuple[int, ...]:
        """Lengths a >= b >= c with that sum; empty if none are at hand."""
        a = self.triple_at[total]
        while 3 * a >= total > 2:
            rest = total - a
            if self.have[a] and self.pair(rest):
                # one a is taken, and the others are no longer than it
                for b in range(min(self.pair_at[rest], a), (rest - 1) // 2, -1):
                    need = (a, b, rest - b)
                    if all(self.have[x] >= need.count(x) for x in need):
                        self.triple_at[total] = a
                        return need
            a -= 1
        self.triple_at[total] = a
        return ()

    def exactly(self, gap: int) -> tuple[int, ...]:
        return (gap,) if self.have[gap] else self.pair(gap) or self.triple(gap)


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences) for counts[length] pieces of each length.

    Of the plan by exact complements and plain best fit from the longest on, the one of fewer sequences.
    """
    have = [int(n) for n in counts]
    return min(complements(have, size), best_fit(have, size), key=lambda found: sum(n for _, n in found))


def complements(counts: list[int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan that fills gaps exactly wherever one, two or three lengths can, and else by the longest that fits."""
    have = list(counts)
    sums = Sums(have)
    out: list[tuple[tuple[int, ...], int]] = []
    while first := sums.longest(size):
        lengths: tuple[int, ...] = ()
        more: tuple[int, ...] = (first,)
        gap = size
        while more:
            for x in more:
                have[x] -= 1
            lengths += more
            gap -= sum(more)
            more = sums.exactly(gap) if gap else ()
            if gap and not more:
                best = sums.longest(gap)
                more = (best,) if best else ()
        uses = {x: lengths.count(x) for x in lengths}
        n = min((have[x] + k) // k for x, k in uses.items())
        for x, k in uses.items():
            have[x] -= k * (n - 1)
        out.append((lengths, n))
    return out


def best_fit(counts: list[int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit from the longest on: each piece goes where it leaves the least room; equal sequences are kept as one."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths: tuple[int, ...], room: int, n: int) -> None:
        if n:
            rooms.setdefault(room, []).append((lengths, n))

    for x in range(size, 0, -1):
        left = counts[x]
        for room in sorted(r for r in rooms if r >= x and rooms[r]) if left else ():
            fit = room // x
            while left and rooms[room]:
                lengths, n = rooms[room].pop()
                whole, some = min(n, left // fit), left % fit if left // fit < n else 0
                put(lengths + (x,) * fit, room - fit * x, whole)
                put(lengths + (x,) * some, room - some * x, int(some > 0))
                put(lengths, room, n - whole - (some > 0))
                left -= whole * fit + some
        fit = size // x
        put((x,) * fit, size - fit * x, left // fit)
        put((x,) * (left % fit), size - left % fit * x, int(left % fit > 0))
    return [x for own in rooms.values() for x in own]


def assign(rows: DataFrame, order: tuple[str, ...], size: int = SIZE) -> DataFrame:
    """rows (a written table with `length`) with sequence_id and offset.

    Ranks within a length are counted in groups by a hash, whose sizes are then summed: a length that
    holds a third of all rows is ranked in many tasks.
    """
    hist = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(size + 1, np.int64)
    for length, n in hist.items():
        counts[length] = n
    found = plan(counts, size)
    salts = np.maximum(1, np.ceil(counts / np.maximum(RANKED, np.sqrt(counts)))).astype(np.int64)
    salt_of = F.array(*(F.lit(int(x)) for x in salts))
    salt, rank, before, n = fresh(rows, 4)
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*order), F.element_at(salt_of, (F.col("length") + 1).cast("int"))))
    sizes = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    running = F.sum(n).over(Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1))
    ahead = sizes.select("length", salt, F.coalesce(running, F.lit(0)).alias(before))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)) - 1)
    placed = ranked.join(ahead, ["length", salt]).withColumn(rank, F.col(rank) + F.col(before))
    return _name(placed, rank, found, size).select(*(c for c in rows.columns if c not in ("sequence_id", "offset")), "sequence_id", "offset")


def _name(placed: DataFrame, rank_column: str, found: list[tuple[tuple[int, ...], int]], size: int) -> DataFrame:
    """sequence_id and offset of each (length, rank) from the ranges of ranks that the plan makes."""
    used = np.zeros(size + 1, np.int64)
    ranges = []
    base = 0
    for lengths, n in found:
        offset = 0
        for x in lengths:
            ranges.append((x, used[x], base, offset))
            used[x] += n
            offset += x
        base += n
    ranges.sort()
    table = np.array(ranges, np.int64).reshape(-1, 4)
    keys = table[:, 0] << 44 | table[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def lookup(length, rank):
        import pandas as pd

        at = np.searchsorted(keys, length.to_numpy() << 44 | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": table[at, 2] + rank.to_numpy() - table[at, 1], "offset": table[at, 3]})

    place = fresh(placed, 1)[0]
    found_at = placed.withColumn(place, lookup(F.col("length"), F.col(rank_column)))
    return found_at.withColumns({name: F.col(place)[name] for name in ("sequence_id", "offset")}).drop(place)


def query(docs: DataFrame, vocab_path: str, size: int = SIZE) -> DataFrame:
    """Every piece with the checksum of its ids, its sequence and its place there."""
    cut = pieces(docs, vocab_path, size).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    rows = materialize(cut, "pieces")
    return assign(rows, ("doc_id", "piece", "start", "ids_crc32"), size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
