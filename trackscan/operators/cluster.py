"""Connected components of points (C1) and of voxels.

`components` works frame by frame in one task each: a frame is bounded by its sensor. `components_native`
gives the same answer by joins alone, for groups that one task shouldn't hold.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.config import FRAME
from trackscan.operators.graph import connected_components
from trackscan.session import materialize

RADIUS = 0.25
#: Half of the 26 neighbours of a cell: the others are met from their own side.
HALF = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
#: Candidate pairs compared at a time.
PAIRS = 2_000_000


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least position of each component after linking a with b."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _cells(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of points by cell, cell keys ascending, first and last position of each cell)."""
    low = cells.min(axis=0) - 1
    span = cells.max(axis=0) - low + 2
    key = ((cells[:, 0] - low[0]) * span[1] + (cells[:, 1] - low[1])) * span[2] + (cells[:, 2] - low[2])
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    steps = [int((o[0] * span[1] + o[1]) * span[2] + o[2]) for o in HALF]
    return order, keys, np.append(first, len(key)), np.array(steps)


def point_components(xyz: np.ndarray, radius: float) -> np.ndarray:
    """For each point the least position of those reachable over gaps of at most the radius."""
    if not len(xyz):
        return np.zeros(0, np.int64)
    order, keys, first, steps = _cells(np.floor(xyz / radius).astype(np.int64))
    p = xyz[order]
    root = np.arange(len(p))
    lefts, rights = [np.arange(len(keys))], [np.arange(len(keys))]
    for step in steps:
        at = np.searchsorted(keys, keys + step)
        hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == keys + step))
        lefts.append(hit)
        rights.append(at[hit])
    a, b = np.concatenate(lefts), np.concatenate(rights)
    n, m = (first[1:] - first[:-1])[a], (first[1:] - first[:-1])[b]
    size = n * m
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + PAIRS, PAIRS))
    for low, high in zip(cuts, [*cuts[1:], len(size)]):
        part = slice(low, max(high, low))
        s = size[part]
        if not len(s):
            continue
        pair = np.repeat(np.arange(len(s)), s)
        k = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        x, y = first[a[part]][pair] + k // m[part][pair], first[b[part]][pair] + k % m[part][pair]
        near = ((p[x] - p[y]) ** 2).sum(axis=1) <= radius * radius
        root = _join(root, x[near], y[near])
    least = np.full(len(p), len(p))
    np.minimum.at(least, root, order)
    out = np.empty(len(p), np.int64)
    out[order] = least[root]
    return out


def voxel_components(xyz: np.ndarray, voxel: float) -> tuple[np.ndarray, int]:
    """(least position of each point's group of voxels that touch, number of voxels)."""
    if not len(xyz):
        return np.zeros(0, np.int64), 0
    order, keys, first, steps = _cells(np.floor(xyz / voxel).astype(np.int64))
    root = np.arange(len(keys))
    for step in steps:
        at = np.searchsorted(keys, keys + step)
        hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == keys + step))
        root = _join(root, hit, at[hit])
    cell = np.repeat(np.arange(len(keys)), np.diff(first))
    least = np.full(len(keys), len(xyz))
    np.minimum.at(least, root[cell], order)
    out = np.empty(len(xyz), np.int64)
    out[order] = least[root[cell]]
    return out, len(keys)


def _by_group(points: DataFrame, keys: list[str], work, places: bool = False) -> DataFrame:
    """FRAME, keys, source_index, component (the least source_index) and voxels of finite points, and their places."""
    same = [*keys, *("xyz" if places else "")]
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in same)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source_index", kind="stable")
        own, voxels = work(pdf[["x", "y", "z"]].to_numpy(np.float64))
        index = pdf["source_index"].to_numpy()
        return pd.DataFrame({**{c: pdf[c] for c in same}, "source_index": index, "component": index[own] if len(own) else index, "voxels": voxels})

    return points.select(*keys, "source_index", "x", "y", "z").groupBy(*keys).applyInPandas(run, f"{kinds}, source_index bigint, component bigint, voxels bigint")


def components(points: DataFrame, radius: float = RADIUS) -> DataFrame:
    """FRAME, source_index, component: groups linked by gaps of at most the radius, named by their least index."""
    return _by_group(points, FRAME, lambda xyz: (point_components(xyz, radius), 0)).drop("voxels")


def voxel_groups(points: DataFrame, voxel: float, zone: str | None = None, places: bool = False) -> DataFrame:
    """FRAME (and zone), source_index, component, voxels: groups of voxels that touch, never across zones.

    With places x, y and z are kept, so that what is asked of the groups needs no join with the points.
    """
    return _by_group(points, [*FRAME, *([zone] if zone else [])], lambda xyz: voxel_components(xyz, voxel), places)


def neighbours(points: DataFrame, radius: float) -> DataFrame:
    """FRAME, a, b (a < b): pairs within the radius by a hash join of grid cells.

    Each point goes to its own cell and to half of the neighbours, so each pair meets once.
    """
    cell = [F.floor(F.col(c).cast("double") / radius).alias(f"c{c}") for c in "xyz"]
    own = points.select(*FRAME, F.col("source_index").alias("b"), *(F.col(c).cast("double").alias(f"{c}b") for c in "xyz"), *cell)
    shifts = F.array(*(F.struct(*(F.lit(v).alias(f"d{c}") for c, v in zip("xyz", o))) for o in [(0, 0, 0), *HALF]))
    sent = points.select(*FRAME, F.col("source_index").alias("a"), *(F.col(c).cast("double").alias(f"{c}a") for c in "xyz"), *cell, F.explode(shifts).alias("o"))
    sent = sent.select(*FRAME, "a", "xa", "ya", "za", "o", *((F.col(f"c{c}") + F.col(f"o.d{c}")).alias(f"c{c}") for c in "xyz"))
    met = sent.join(own, [*FRAME, "cx", "cy", "cz"])
    apart = F.expr("(xa-xb)*(xa-xb) + (ya-yb)*(ya-yb) + (za-zb)*(za-zb)")
    once = (F.col("o") != F.struct(*(F.lit(0).alias(f"d{c}") for c in "xyz"))) | (F.col("a") < F.col("b"))
    return met.where(once & (apart <= radius * radius) & (F.col("a") != F.col("b"))).select(*FRAME, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _cell_pairs(cells: DataFrame) -> DataFrame:
    """Structs `a` and `b` of each two cells of a frame that are at most two cells apart on every axis, b behind a.

    A cell is sent to the six or so blocks of 4 x 4 x 4 cells that its reach meets, not to all 62 cells.
    """
    reach = {"x": (0, 2), "y": (-2, 2), "z": (-2, 2)}
    own = cells.select(*FRAME, *(F.shiftright(f"c{c}", 2).alias(f"k{c}") for c in "xyz"), F.struct(*cells.columns).alias("b"))
    sent = cells.select(*FRAME, F.struct(*cells.columns).alias("a"))
    for c, (low, high) in reach.items():
        sent = sent.withColumn(f"k{c}", F.explode(F.sequence(F.shiftright(F.col(f"a.c{c}") + low, 2), F.shiftright(F.col(f"a.c{c}") + high, 2))))
    near = " AND ".join(f"b.c{c} - a.c{c} BETWEEN {low} AND {high}" for c, (low, high) in reach.items())
    behind = "(b.cx > a.cx OR (b.cx = a.cx AND (b.cy > a.cy OR (b.cy = a.cy AND b.cz > a.cz))))"
    return sent.join(own, [*FRAME, "kx", "ky", "kz"]).where(f"{near} AND {behind}").select(*FRAME, "a", "b")


def components_native(points: DataFrame, radius: float = RADIUS) -> DataFrame:
    """`components` by joins: points of one small cell are one node, cells are linked by their near pairs.

    A cell of side radius / sqrt(3) holds only points within the radius of each other. Cells are linked first
    where their least points are near; points meet only of cells that this leaves in different groups and whose
    boxes are near enough, so that a dense frame isn't sent from every cell to all its neighbours.
    """
    side, most = radius / math.sqrt(3) * (1 - 1e-9), radius * radius
    cell = [*FRAME, "cx", "cy", "cz"]
    own = points.select(*FRAME, "source_index", *(F.col(c).cast("double").alias(c) for c in "xyz")).select("*", *(F.floor(F.col(c) / side).alias(f"c{c}") for c in "xyz"))
    boxes = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    cells = materialize(own.groupBy(*cell).agg(F.min(F.struct("source_index", "x", "y", "z")).alias("head"), *boxes), "cc-cells")

    def node(index: str) -> Column:
        return F.struct(*FRAME, F.col(index).alias("i"))

    def apart(a: str, b: str) -> Column:
        return F.expr(" + ".join(f"({a}{c}-{b}{c})*({a}{c}-{b}{c})" for c in "xyz"))

    linked = _cell_pairs(cells.select(*cell, "head")).where(apart("a.head.", "b.head.") <= most).select(node("a.head.source_index").alias("src"), node("b.head.source_index").alias("dst"))
    every = cells.select(node("head.source_index").alias("src"), node("head.source_index").alias("dst"))
    found = connected_components(materialize(linked.unionByName(every), "cc-links"))
    named = found.select(*(F.col(f"node.{c}").alias(c) for c in FRAME), F.col("node.i").alias("first"), F.col("label.i").alias("label"))
    grouped = materialize(cells.withColumn("first", F.col("head.source_index")).join(named, [*FRAME, "first"]).drop("first", "head"), "cc-cells")

    # no two points of boxes are nearer than the boxes, in floating point too: differences, squares and sums round in order
    gaps = [F.greatest(F.lit(0.0), F.col(f"a.min_{c}") - F.col(f"b.max_{c}"), F.col(f"b.min_{c}") - F.col(f"a.max_{c}")) for c in "xyz"]
    unsure = (F.col("a.label") != F.col("b.label")) & (gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2] <= most)
    still = materialize(_cell_pairs(grouped).where(unsure).select(*(F.col(f"a.{c}").alias(c) for c in cell), F.struct(*(f"b.{c}" for c in cell[len(FRAME) :])).alias("to"), F.col("a.label").alias("la"), F.col("b.label").alias("lb")), "cc-unsure")
    label = F.col("label")
    if not still.isEmpty():
        left = still.join(own, cell).select(*FRAME, *(F.col(f"to.{c}").alias(c) for c in cell[len(FRAME) :]), "la", "lb", *(F.col(c).alias(f"{c}a") for c in "xyz"))
        near = left.join(own, cell).where(F.expr("(xa-x)*(xa-x) + (ya-y)*(ya-y) + (za-z)*(za-z)") <= most)
        joined = connected_components(materialize(near.select(node("la").alias("src"), node("lb").alias("dst")).distinct(), "cc-links"))
        again = joined.select(*(F.col(f"node.{c}").alias(c) for c in FRAME), F.col("node.i").alias("label"), F.col("label.i").alias("joined"))
        grouped, label = grouped.join(again, [*FRAME, "label"], "left"), F.coalesce("joined", "label")
    return own.select(*cell, "source_index").join(grouped.select(*cell, label.alias("component")), cell).select(*FRAME, "source_index", "component")
