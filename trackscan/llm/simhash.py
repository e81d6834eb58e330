"""SimHash near-duplicates by a binary trie self-join (operator 3).

Distinct fingerprints are few next to documents: copies meet in one map-side-combined aggregate. They
are then joined with themselves in tries. A trie that starts at the root would pair most of its upper
nodes, so there are several tries, each with the bits turned so that other blocks of bits lead: of
`blocks` blocks, any two fingerprints within `most` bits agree on blocks - most of them, so some trie
has an error budget of zero on its leading bits and meets the pair below one and the same node. Below
it node pairs are walked together, each step adding a differing bit, and a pair is dropped as soon as
it exceeds the budget. Node pairs whose fingerprints already belong to one component are dropped too,
so a dense family costs no quadratic number of links; what leaves a task is one link per fingerprint.

Defined results: null and empty texts have fingerprint zero and are linked like any other; rows that
share a doc_id are one node, with one component; a null doc_id keeps its fingerprint, takes part in
linking, and gets the smallest doc_id it reaches, null if there is none; very long texts are hashed whole;
`near_duplicates` looks at key and text alone and `keep_one` keeps all other columns, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.llm import textvec as tv
from trackscan.llm.common import give_back, materialize, strings
from trackscan.operators.graph import connected_components

WORDS, SEED, MOST, BITS = 4, 42, 4, 64
#: Node pairs of at most so many fingerprint pairs are compared outright: the leaves of the tries.
LEAF = 64
#: Node pairs walked at a time, and fingerprints gathered before tries are built over them.
WALK, GATHER = 400_000, 150_000
#: Fingerprints below one leading node that one task takes; a node with more is split further.
HOT = 50_000


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key and fp: the 64-bit fingerprint of each text as a signed long."""
    import xxhash

    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in tv.slices(texts):
                hashes: list[int] = []
                counts = np.zeros(b - a, np.int64)
                for i in range(a, b):
                    each = texts[i].encode().lower().split()  # bytes: ASCII case and white space
                    if len(each) > words:
                        found = [digest(b" ".join(each[j : j + words]), SEED) for j in range(len(each) - words + 1)]
                    else:
                        found = [digest(b" ".join(each), SEED)] if each else []
                    counts[i - a] = len(found)
                    hashes += found
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(majority(np.array(hashes, np.uint64), counts).view(np.int64))], ["k", "fp"])
            give_back()

    return source.mapInArrow(work, f"k {kind}, fp bigint").withColumnRenamed("k", key)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes, the bits set in over half of them."""
    full = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint64)
    if len(full):
        heads = (np.cumsum(counts) - counts)[full]
        sums = np.zeros((len(full), BITS), np.int64)
        big = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        step = 1 << 18
        for low in range(0, len(hashes), step):  # so many rows of bits at a time
            bits = np.unpackbits(big[low : low + step], axis=1)
            first = np.searchsorted(heads, low, "right") - 1
            last = np.searchsorted(heads, min(low + step, len(hashes)), "left")
            cuts = np.maximum(heads[first:last] - low, 0)
            sums[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        out[full] = np.packbits(sums * 2 > counts[full, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)
    return out


class Links:
    """Components of array positions under links, kept as the least position of each."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.steps = np.zeros(n + 1, np.int64)
        self._count()

    def _count(self) -> None:
        self.steps[2:] = np.cumsum(self.root[1:] != self.root[:-1])

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = self.root = root[root]
        self._count()

    def joined(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        """Whether both ranges lie in one component."""
        one = (self.steps[ahi] == self.steps[alo + 1]) & (self.steps[bhi] == self.steps[blo + 1])
        return one & (self.root[alo] == self.root[blo])


def walk(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, first_bit: int, most: int = MOST, other: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Component of each position of the sorted array x under links of at most `most` bits.

    Links are sought within each range starts:ends, whose values agree on their first `first_bit`
    bits; with `other`, between each range and the other range of the same index.
    """
    links = Links(len(x))
    blo, bhi = (starts, ends) if other is None else other
    stack = [(first_bit, starts, ends, blo, bhi, np.zeros(len(starts), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        go = ~links.joined(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, err = (v[go] for v in (alo, ahi, blo, bhi, err))
        small = ((ahi - alo) * (bhi - blo) <= LEAF) | (bit >= BITS)
        if small.any():
            _leaves(x, links, *(v[small] for v in (alo, ahi, blo, bhi)), most)
            alo, ahi, blo, bhi, err = (v[~small] for v in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if len(alo) > WALK:  # the nearest pairs first: what they join needs no further walk
            order = np.lexsort((alo != blo, err))
            half = len(order) // 2
            for part in (order[half:], order[:half]):
                stack.append((bit, *(v[part] for v in (alo, ahi, blo, bhi, err))))
            continue
        ones = np.concatenate([[0], np.cumsum((x >> np.uint64(BITS - 1 - bit)) & np.uint64(1))]).astype(np.int64)
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        parts.append(tuple(v[~same] for v in (amid, ahi, blo, bmid, err + 1)))
        joined = [np.concatenate([p[k] for p in parts]) for k in range(5)]
        ok = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= most)
        # a range paired with itself is one that holds two at least
        ok &= (joined[0] != joined[2]) | (joined[1] - joined[0] > 1)
        stack.append((bit + 1, *(v[ok] for v in joined[:4]), joined[4][ok].astype(np.int8)))
    return links.root


def _leaves(x: np.ndarray, links: Links, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, most: int) -> None:
    """Link the near pairs of each leaf pair, whole differences counted."""
    na, nb = ahi - alo, bhi - blo
    size = na * nb
    for low in range(0, len(size), WALK // 8):
        part = slice(low, low + WALK // 8)
        n = size[part]
        pair = np.repeat(np.arange(len(n)), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a = alo[part][pair] + within // nb[part][pair]
        b = blo[part][pair] + within % nb[part][pair]
        near = (a != b) & (np.bitwise_count(x[a] ^ x[b]) <= most)
        links.add(a[near], b[near])


def scheme(count: int, most: int = MOST) -> list[list[tuple[int, int]]]:
    """Leading blocks (first bit, width) of each trie, so that few fingerprints share a lead.

    More fingerprints take more, smaller blocks of which more must agree: every scheme finds all links.
    """
    agree = 1
    while agree < most and count > 64 << math.floor(BITS * agree / (most + agree)):
        agree += 1
    blocks = most + agree
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    return [[(edges[i], edges[i + 1] - edges[i]) for i in chosen] for chosen in combinations(range(blocks), agree)]


def turned(fp: np.ndarray, lead: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with the leading blocks moved to the front, the other bits after them."""
    out = np.zeros_like(fp)
    taken = np.zeros(BITS, bool)
    for at, width in lead:
        taken[at : at + width] = True
    order = [b for at, width in lead for b in range(at, at + width)] + [b for b in range(BITS) if not taken[b]]
    done = 0
    while done < BITS:  # runs of neighbouring bits move together
        run = 1
        while done + run < BITS and order[done + run] == order[done] + run:
            run += 1
        mask = np.uint64((1 << run) - 1)
        out |= ((fp >> np.uint64(BITS - order[done] - run)) & mask) << np.uint64(BITS - done - run)
        done += run
    return out


def star_links(distinct: DataFrame, count: int, most: int = MOST, hot: int = HOT) -> DataFrame:
    """(src, dst): links that connect just the distinct fingerprints `fp` that near pairs connect.

    The lead of a trie with over `hot` fingerprints is split by its next bits into nodes of at most
    that many, and tasks take pairs of such nodes within the budget.
    """
    tries = scheme(count, most)
    widths = [sum(w for _, w in lead) for lead in tries]

    def lead_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, lead in enumerate(tries):
                x, width = turned(fp, lead), np.uint64(widths[t])
                columns = [np.full(len(fp), t, np.int32), (x >> (np.uint64(BITS) - width)).astype(np.int64), x.view(np.int64), (x << width).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["trie", "lead", "x", "rest"])

    rows = distinct.select("fp").mapInArrow(lead_rows, "trie int, lead bigint, x bigint, rest bigint")
    placed = _single(rows)
    if count > hot:
        crowded = materialize(rows.groupBy("trie", "lead").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("trie", "lead"), "simhash-hot")
        if not crowded.isEmpty():
            placed = _single(rows.join(crowded, ["trie", "lead"], "left_anti")).unionByName(_split(rows.join(crowded, ["trie", "lead"]), most, hot))
    grouped = placed.repartition("trie", "lead", "a", "b").sortWithinPartitions("trie", "lead", "a", "b", "side")

    def join_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            part = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            held.append(part)
            size += part.shape[1]
            if size >= GATHER:
                whole = np.concatenate(held, axis=1)
                differ = np.flatnonzero((whole[:4, -1:] != whole[:4]).any(axis=0))
                cut = int(differ[-1]) + 1 if len(differ) else 0
                if cut:
                    yield from _solve(whole[:, :cut], tries, widths, most)
                held, size = [whole[:, cut:]], whole.shape[1] - cut
        if size:
            yield from _solve(np.concatenate(held, axis=1), tries, widths, most)

    return grouped.select("trie", "lead", "a", "b", "side", "x").mapInArrow(join_rows, "src bigint, dst bigint")


def _single(rows: DataFrame) -> DataFrame:
    """Rows whose whole lead is one node, paired with itself."""
    return rows.select("trie", "lead", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("side"), "x")


def _split(dense: DataFrame, most: int, hot: int, step: int = 6) -> DataFrame:
    """Rows of crowded leads in pairs of nodes (a, b) within the budget, side 0 of a and 1 of b.

    Nodes deepen by `step` bits until they hold at most `hot` rows; a node is a one bit and its prefix.
    """
    left = materialize(dense, "simhash-dense")
    done = None
    for depth in range(step, 49, step):
        at = left.withColumn("node", F.expr(f"shiftleft(1L, {depth}) + shiftrightunsigned(rest, {BITS - depth})"))
        many = materialize(at.groupBy("trie", "lead", "node").agg(F.count("*").alias("n")).where(F.col("n") > (hot if depth + step < 49 else math.inf)).select("trie", "lead", "node"), "simhash-nodes")
        part = at.join(many, ["trie", "lead", "node"], "left_anti").select("trie", "lead", "node", "x")
        done = part if done is None else done.unionByName(part)
        if many.isEmpty():
            break
        left = materialize(at.join(many, ["trie", "lead", "node"], "left_semi").drop("node"), "simhash-dense")
    leaves = materialize(done, "simhash-leaves")
    nodes = materialize(leaves.select("trie", "lead", "node").distinct(), "simhash-nodes")
    a, b = (nodes.select("trie", "lead", F.col("node").alias(c)) for c in ("a", "b"))
    differ = F.expr("""bit_count(shiftright(a, length(bin(a)) - least(length(bin(a)), length(bin(b))))
                               ^ shiftright(b, length(bin(b)) - least(length(bin(a)), length(bin(b)))))""")
    pairs = materialize(a.join(b, ["trie", "lead"]).where((F.col("a") <= F.col("b")) & (differ <= most)), "simhash-pairs")
    columns = ["trie", "lead", "a", "b", "side", "x"]
    ends = [(pairs.withColumn("node", F.col("a")), 0), (pairs.where("a <> b").withColumn("node", F.col("b")), 1)]
    first, second = (leaves.join(end, ["trie", "lead", "node"]).withColumn("side", F.lit(side)).select(columns) for end, side in ends)
    return first.unionByName(second)


def _solve(rows: np.ndarray, tries: list, widths: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """One link from each fingerprint to the least of its component, for whole groups of rows."""
    for t in np.unique(rows[0]).tolist():
        own = rows[:, rows[0] == t]
        x = own[5].view(np.uint64)
        order = np.lexsort((x, own[4], own[3], own[2], own[1]))
        x, key = x[order], own[1:5, order]
        change = (key[:, 1:] != key[:, :-1]).any(axis=0)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        ends = np.append(starts[1:], len(x))
        side, a, b = key[3, starts], key[1, starts], key[2, starts]
        root = np.arange(len(x))
        within = (a == b) & (ends - starts > 1)
        if within.any():
            root = walk(x, starts[within], ends[within], widths[t], most)
        left = np.flatnonzero((a != b) & (side == 0))
        left = left[(left + 1 < len(starts))]
        left = left[(side[left + 1] == 1) & (key[:3, starts[left]] == key[:3, starts[left + 1]]).all(axis=0)]
        if len(left):
            # two nodes of one lead: ranges that follow each other, walked as a pair from the lead down
            other = walk(x, starts[left], ends[left], widths[t], most, (starts[left + 1], ends[left + 1]))
            moved = np.flatnonzero(other != np.arange(len(x)))
            yield from _links(x, moved, other[moved], tries[t])
        moved = np.flatnonzero(root != np.arange(len(x)))
        yield from _links(x, moved, root[moved], tries[t])


def _links(x: np.ndarray, a: np.ndarray, b: np.ndarray, lead: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(restored(x[a], lead).view(np.int64)), pa.array(restored(x[b], lead).view(np.int64))], ["src", "dst"])


def restored(x: np.ndarray, lead: list[tuple[int, int]]) -> np.ndarray:
    """The inverse of `turned`."""
    out = np.zeros_like(x)
    taken = np.zeros(BITS, bool)
    for at, width in lead:
        taken[at : at + width] = True
    order = [b for at, width in lead for b in range(at, at + width)] + [b for b in range(BITS) if not taken[b]]
    for place, bit in enumerate(order):
        out |= ((x >> np.uint64(BITS - 1 - place)) & np.uint64(1)) << np.uint64(BITS - 1 - bit)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, hot: int = HOT) -> DataFrame:
    """key, fp and component_id (the smallest key reachable over links, itself included) of each row."""
    own = materialize(fingerprints(docs, key, text), "simhash-own")
    distinct = materialize(own.groupBy("fp").agg(F.min(key).alias("low")), "simhash-distinct")
    repeated = materialize(own.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("fp").alias("dst"), F.max("fp").alias("top")).where("dst <> top").select(key, "dst"), "simhash-repeated")
    same_id = own.join(repeated, key).where("fp <> dst").select(F.col("fp").alias("src"), "dst")
    edges = materialize(star_links(distinct, distinct.count(), most, hot).unionByName(same_id), "simhash-links")
    labels = connected_components(edges)
    linked = materialize(distinct.join(labels.withColumnRenamed("node", "fp"), "fp"), "simhash-linked")
    least = materialize(linked.groupBy("label").agg(F.min("low").alias("component_id")), "simhash-least")
    reached = materialize(linked.join(least, "label").select("fp", "component_id"), "simhash-reached")
    every = materialize(distinct.join(reached, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "simhash-every")
    return own.join(every, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: the one of the smallest key; of rows that share it,
    one. Rows without a key stay."""
    found = materialize(near_duplicates(docs, key, text).where(F.col(key).isNotNull()).groupBy(key).agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), "simhash-found")
    gone = materialize(found.where(F.col(key) != F.col("component_id")).select(key), "simhash-gone")
    twice = materialize(found.where((F.col(key) == F.col("component_id")) & (F.col("n") > 1)).select(key), "simhash-twice")
    kept = docs.join(gone, key, "left_anti").select(docs.columns)
    if twice.isEmpty():
        return kept
    return kept.join(twice, key, "left_anti").select(docs.columns).unionByName(kept.join(twice, key, "left_semi").dropDuplicates([key]).select(docs.columns))


def query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
