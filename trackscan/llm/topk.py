"""Exact top-k inner product search by dual cover trees (operator 10).

Vectors are dealt to blocks around pivots, the upper nodes of a cover tree over all data; a crowded
pivot has several blocks. In each block data and queries are indexed by cover trees, and node pairs are
walked together: a pair is dropped when the best score that its covering radii allow is below the worst
kth score of its queries. Queries first search the block they lie in; the kth score found there decides
which other blocks, by their pivots' radii, they must visit at all. Nothing is approximate: bounds only
drop what can't be among the k best.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id,
take no part; shorter vectors count as zero beyond their end; ties go to the smaller id; rows that share
an id are the query's own and never its candidates, and otherwise count each; a query with fewer than k
candidates gets them all; an empty table gives no rows. Scores that don't fit 64 bits become the nearest
value that does; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackscan.llm.common import materialize, share

K, SCALE = 5, 256
#: Vectors of a block: 8 times the square root of their number, between these; and most pivots.
LEAST_BLOCK, MOST_BLOCK, MOST_PIVOTS = 512, 1 << 16, 4096
#: Points of a tree's leaf, unless they don't separate; queries indexed at a time; products at a time.
LEAF, QUERIES, PRODUCTS = 64, 4096, 1 << 21
#: Each level covers with balls of this share of its radius.
SHRINK = 0.7
#: Low bits of a key, for the tie rule; NONE is below every key.
TIE = 17
NONE = -(1 << 62)


class Tree:
    """A cover tree over the rows of `x`: nodes are ranges of `order`, with centre and covering radius."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, float, list[int]]] = []  # low, high, centre, radius, children
        if len(x):
            self._build()
        self.points = x[self.order]
        centres = np.array([n[2] for n in self.nodes], np.int64)
        self.centres = x[centres] if len(x) else x
        self.norms = np.sqrt((self.centres**2).sum(axis=1)) if len(x) else np.zeros(0)
        self.radii = np.array([n[3] for n in self.nodes])

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.x[rows] - self.x[centre]) ** 2).sum(axis=1))

    def _build(self) -> None:
        todo = [(0, len(self.x), 0, None)]
        while todo:
            low, high, centre, parent = todo.pop()
            rows = self.order[low:high]
            far = self._far(rows, centre)
            radius = float(far.max())
            number = len(self.nodes)
            self.nodes.append((low, high, centre, radius, []))
            if parent is not None:
                self.nodes[parent][4].append(number)
            if high - low <= LEAF or radius == 0:
                continue
            parts, centres = [], []
            near = far <= radius * SHRINK
            left = rows[~near]
            parts.append(rows[near])
            centres.append(centre)
            most = max(8, (high - low) // 16)
            while len(left) and len(parts) <= most:
                c = int(left[0])
                near = self._far(left, c) <= radius * SHRINK
                parts.append(left[near])
                centres.append(c)
                left = left[~near]
            if len(left):
                continue  # balls of this size hardly cover more than their centres: a leaf
            self.order[low:high] = np.concatenate(parts)
            at = low
            for part, c in zip(parts, centres):
                todo.append((at, at + len(part), c, number))
                at += len(part)


def search(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of each query among data of other ids, scores >= least.

    data rows are sorted by id, so that of equal scores the smaller row wins.
    """
    if not len(data) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    big = max(float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) * data.shape[1], 1.0)
    if big >= 2**44:
        return _huge(data, ids, queries, own, k)
    exact = np.float64  # products of this size are exact in doubles
    tree, asks = Tree(data.astype(np.float64)), Tree(queries.astype(np.float64))
    d, q = data[tree.order].astype(exact), queries[asks.order].astype(exact)
    tie = len(data) - 1 - tree.order
    d_ids, q_ids = ids[tree.order], own[asks.order]
    best = np.full((len(q), k), NONE, np.int64)
    floor = np.maximum(least[asks.order], -(1 << 44))  # in scores
    worst = floor.astype(np.float64)
    slack = big * 1e-9 + 1e-6

    def bounds(a: int, which: list[int]) -> np.ndarray:
        inner = tree.centres[which] @ asks.centres[a]
        r, s = tree.radii[which], asks.radii[a]
        return inner + asks.norms[a] * r + tree.norms[which] * s + r * s + slack

    def compare(a: int, b: int) -> None:
        qlo, qhi = asks.nodes[a][:2]
        dlo, dhi, _, radius, _ = tree.nodes[b]
        rows = np.arange(dlo, dhi)
        if radius == 0 and len(rows) > k + 1:
            # equal vectors: only the smallest ids can be among the best, one of them maybe the query's
            by_id = rows[np.argsort(-tie[rows])]
            firsts = by_id[np.unique(d_ids[by_id], return_index=True)[1]][: k + 1] if len(np.unique(d_ids[by_id])) == len(by_id) else by_id
            rows = firsts
        for low in range(0, len(rows), 4096):
            some = rows[low : low + 4096]
            step = max(1, PRODUCTS // len(some))
            for start in range(qlo, qhi, step):
                stop = min(start + step, qhi)
                scores = (q[start:stop] @ d[some].T).astype(np.int64)
                keys = (scores << TIE) + tie[some]
                keys[q_ids[start:stop, None] == d_ids[some]] = NONE
                keys[scores < floor[start:stop, None]] = NONE
                both = np.concatenate([best[start:stop], keys], axis=1)
                best[start:stop] = -np.sort(np.partition(-both, k - 1, axis=1)[:, :k], axis=1)
                kth = best[start:stop, k - 1]
                worst[start:stop] = np.maximum(worst[start:stop], np.where(kth > NONE, kth >> TIE, worst[start:stop]))

    if len(q) and len(d):
        stack = [(0, 0, float(bounds(0, [0])[0]))]
        while stack:
            a, b, bound = stack.pop()
            qlo, qhi, _, qr, qc = asks.nodes[a]
            if bound < worst[qlo:qhi].min():
                continue
            children = tree.nodes[b][4]
            if qc and (not children or qr >= tree.radii[b]):
                stack += [(c, b, float(bounds(c, [b])[0])) for c in qc]
            elif children:
                found = bounds(a, children)
                stack += [(a, children[i], float(found[i])) for i in np.argsort(found)]  # the best last, so it is next
            else:
                compare(a, b)
    row, at = np.nonzero(best > NONE)
    keys = best[row, at]
    return asks.order[row], ids[len(data) - 1 - (keys & ((1 << TIE) - 1))], keys >> TIE


def _huge(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by Python's integers, for components too large for the bounds and keys above."""
    found = []
    rows = data.astype(object)
    for i, q in enumerate(queries.astype(object)):
        scores = rows @ q
        others = [j for j in range(len(rows)) if ids[j] != own[i]]
        found += [(i, int(ids[j]), max(-(1 << 63), min((1 << 63) - 1, int(scores[j])))) for j in sorted(others, key=lambda j: (-scores[j], ids[j]))[:k]]
    return tuple(np.array([x[c] for x in found], np.int64) for c in range(3))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, zeros beyond the end of shorter ones."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if (sizes == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _solve(rows: DataFrame, width: int, k: int) -> DataFrame:
    """query_id, vec_id, score for rows (block, kind 0 data or 1 query, id, v, least)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: list[tuple[np.ndarray, np.ndarray]] = []
        asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        block = None
        ready: tuple[np.ndarray, np.ndarray] | None = None

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal ready
            if asked and data:
                if ready is None:
                    ids = np.concatenate([x for x, _ in data])
                    order = np.argsort(ids, kind="stable")
                    ready = ids[order], np.concatenate([x for _, x in data])[order]
                own, q, least = (np.concatenate([x[i] for x in asked]) for i in range(3))
                # the keys of `search` have room for so many rows; the k best of each part hold the k best of all
                for low in range(0, len(ready[0]), 1 << TIE):
                    row, ids, scores = search(ready[1][low : low + (1 << TIE)], ready[0][low : low + (1 << TIE)], q, own, least, k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])
            asked.clear()

        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if blocks[low] != block:
                    yield from out()
                    data.clear()
                    block, ready = blocks[low], None
                part = batch.slice(low, high - low)
                ids, v = part.column(2).to_numpy(zero_copy_only=False), _matrix(part.column(3), width)
                if kinds[low] == 0:
                    data.append((ids, v))
                else:
                    for i in range(0, len(ids), QUERIES):
                        asked.append((ids[i : i + QUERIES], v[i : i + QUERIES], part.column(4).to_numpy(zero_copy_only=False)[i : i + QUERIES]))
                        if sum(len(x[0]) for x in asked) >= QUERIES:
                            yield from out()
        yield from out()

    dealt = rows.select("block", "kind", "id", "v", "least").repartition("block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(work, "query_id bigint, vec_id bigint, score bigint")


def integers(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id and v: floor(scale * x) of every component, of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("e")).where("id IS NOT NULL AND e IS NOT NULL")
    fine = F.forall("e", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return rows.where(fine).select("id", F.transform("e", lambda x: F.floor(x.cast("double") * float(scale))).alias("v"))


def pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows spread over the sample: each the farthest from those before it."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def top_k(vectors: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every row where `asks` (over column id)."""
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    spark = vectors.sparkSession
    own = materialize(integers(vectors, key, vector, scale), "topk-vectors")
    facts = own.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).collect()[0]
    n, width = facts["n"], facts["width"]
    if not n or not width:
        return spark.createDataFrame([], schema)
    size = int(min(MOST_BLOCK, max(LEAST_BLOCK, 8 * math.sqrt(n))))
    count = min(MOST_PIVOTS, math.ceil(n / size))
    # at most some ten rows for each pivot, so at most 40,000 of them
    picked = own.where(share(F.col("id"), 8 * count / n)).select("v").limit(10 * count).toArrow() if n > 8 * count else own.select("v").limit(10 * count).toArrow()
    column = picked.column(0).combine_chunks()
    sample = _matrix(column if isinstance(column, pa.Array) else column.chunk(0), width).astype(np.float64) if picked.num_rows else np.zeros((1, width))
    centres = pivots(sample[np.lexsort(sample.T)], count)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres**2).sum(axis=1) / 2
        rng = np.random.default_rng()
        for batch in batches:
            x = _matrix(batch.column(1), width).astype(np.float64)
            pivot = (x @ centres.T - half).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - centres[pivot]) ** 2).sum(axis=1))
            salt = rng.integers(0, 1 << 30, len(x)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pivot.astype(np.int32)), pa.array(far), pa.array(salt)], ["id", "v", "pivot", "far", "salt"])

    # the salt deals rows of one id to different blocks; once written it stays
    near = materialize(own.mapInArrow(nearest, "id bigint, v array<bigint>, pivot int, far double, salt int"), "topk-near")
    # one row for each pivot, MOST_PIVOTS at most
    held = {r["pivot"]: (r["n"], r["far"]) for r in near.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    splits = np.ones(len(centres), np.int64)
    radius = np.full(len(centres), -np.inf)
    for p, (m, r) in held.items():
        splits[p], radius[p] = max(1, round(m / size)), r
    first = np.cumsum(splits) - splits
    of = F.create_map(*[F.lit(int(x)) for p in held for x in (p, first[p])])
    by = F.create_map(*[F.lit(int(x)) for p in held for x in (p, splits[p])])
    block = (F.element_at(of, F.col("pivot")) + F.pmod(F.col("salt"), F.element_at(by, F.col("pivot")))).cast("long")
    none = F.lit(NONE).cast("long")
    dealt = near.withColumn("block", block)
    data = dealt.select("block", F.lit(0).alias("kind"), "id", "v", none.alias("least"))
    asked = dealt.where(asks).select("block", F.lit(1).alias("kind"), "id", "v", none.alias("least"))
    home = materialize(_solve(data.unionByName(asked), width, k), "topk-home")
    kth = home.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("low")).distinct()
    pending = asked.drop("least", "kind").join(kth.groupBy("id").agg(F.min("low").alias("low")), "id", "left").select("block", "id", "v", F.coalesce("low", none).alias("least"))
    pivot_of = np.repeat(np.arange(len(centres)), splits)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                x = _matrix(part.column(2), width).astype(np.float64)
                best = x @ centres.T + np.sqrt((x**2).sum(axis=1))[:, None] * radius
                go = best * (1 + 1e-9) + 1e-6 >= part.column(3).to_numpy(zero_copy_only=False)[:, None]
                row, at = np.nonzero(go[:, pivot_of] & (np.arange(len(pivot_of)) != part.column(0).to_numpy(zero_copy_only=False)[:, None]))
                for i in range(0, len(row), 8192):
                    some = pa.array(row[i : i + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 8192]), part.column(1).take(some), part.column(2).take(some), part.column(3).take(some)], ["block", "id", "v", "least"])

    sent = pending.mapInArrow(visits, "block bigint, id bigint, v array<bigint>, least bigint").select("block", F.lit(1).alias("kind"), "id", "v", "least")
    every = home.unionByName(_solve(data.unionByName(sent), width, k))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.pmod(F.col("id"), F.lit(50)) == 0)
