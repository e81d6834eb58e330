"""The clearance envelope: zone of every point, counts, nearest points, cropping.

The theta join of points and segments is an equi-join on the frame with the geometry as its condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackscan.config import CORE, EXPANDED, FRAME, TOLERANCE, Bounds
from trackscan.functions.exprs import distance, in_bounds

FIELDS = ("seg_index", "ax", "ay", "az", "tx", "ty", "nx", "ny", "dz", "length", "s0", "s1")


def with_segments(points: DataFrame, segs: DataFrame) -> DataFrame:
    """points with `segs`, the frame's segments in order; null where it has none."""
    packed = segs.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("segs"))
    return points.join(packed, FRAME, "left")


def _local(seg: Column) -> tuple[Column, Column, Column]:
    """(station, lateral, height) of a row's point at a segment."""
    dx, dy = F.col("x").cast("double") - seg["ax"], F.col("y").cast("double") - seg["ay"]
    station = dx * seg["tx"] + dy * seg["ty"]
    return station, dx * seg["nx"] + dy * seg["ny"], F.col("z").cast("double") - seg["az"] - seg["dz"] * station / seg["length"]


def _covers(seg: Column) -> Column:
    station = _local(seg)[0]
    return (station >= -TOLERANCE) & (station <= seg["length"] + TOLERANCE)


def label(points: DataFrame, segs: DataFrame, core: Bounds = CORE, expanded: Bounds = EXPANDED, priority: str = "first") -> DataFrame:
    """FRAME, source_index, x, y, z and `zone`: 0 unknown, 1 core, 2 margin, 3 outside.

    Core wins wherever it is met; otherwise the first covering segment decides, or with
    priority="best" the nearest zone over all of them (E3, T1). A join on the frame compares a point
    with its frame's few segments inside generated code, and an aggregate below the frame, which needs
    no further shuffle, keeps the first of those that cover it.
    """
    own = points.select(*FRAME, "source_index", "x", "y", "z").alias("p")
    seg = segs.alias("g")
    here = {c: F.col(f"g.{c}") for c in FIELDS}
    dx, dy = F.col("p.x").cast("double") - here["ax"], F.col("p.y").cast("double") - here["ay"]
    station = dx * here["tx"] + dy * here["ty"]
    same = (F.col("p.source_id") == F.col("g.source_id")) & (F.col("p.frame_index") == F.col("g.frame_index"))
    met = own.join(seg, same & (station >= -TOLERANCE) & (station <= here["length"] + TOLERANCE), "left")
    lateral = dx * here["nx"] + dy * here["ny"]
    height = F.col("p.z").cast("double") - here["az"] - here["dz"] * station / here["length"]
    zone = F.when(here["seg_index"].isNull(), 0).when(in_bounds(core, lateral, height), 1).when(in_bounds(expanded, lateral, height), 2).otherwise(3)
    keys = [F.col(f"p.{c}").alias(c) for c in (*FRAME, "source_index", "x", "y", "z")]
    flat = met.select(*keys, F.coalesce(here["seg_index"], F.lit(0)).alias("seg"), zone.alias("zone"))
    best = flat.groupBy(*FRAME, "source_index", "x", "y", "z").agg(F.min(F.col("seg") * 4 + F.col("zone")).alias("first"), F.min("zone").alias("least"))
    decided = F.col("least") if priority == "best" else F.when(F.col("least") == 1, 1).otherwise(F.col("first") % 4)
    return best.select(*FRAME, "source_index", "x", "y", "z", decided.cast("tinyint").alias("zone"))


def narrow(labels: DataFrame) -> DataFrame:
    """labels as they are worth writing: the distance of core and margin points, and the place of core points alone."""
    near = F.col("zone").isin(1, 2)
    return labels.select(*FRAME, "source_index", "zone", F.when(near, distance()).alias("distance"), *(F.when(F.col("zone") == 1, F.col(c)).alias(c) for c in "xyz"))


def narrow_stats(labels: DataFrame) -> DataFrame:
    """zone_stats of narrow labels."""
    return zone_stats(labels, F.col("distance"))


def zone_stats(labels: DataFrame, far: Column | None = None) -> DataFrame:
    """Counts by zone and the nearest core and margin points, ties to the lower index (A1, A2)."""

    def nearest(zone: int) -> Column:
        return F.min(F.when(F.col("zone") == zone, F.struct((distance() if far is None else far).alias("distance"), F.col("source_index").alias("source_index"))))

    done = labels.groupBy(*FRAME).agg(
        F.count("*").alias("points"),
        *(F.count_if(F.col("zone") == z).alias(n) for z, n in ((1, "core"), (2, "margin"), (3, "outside"), (0, "unknown"))),
        nearest(1).alias("c"),
        nearest(2).alias("m"),
    )
    flat = [F.col(f"{k}.{f}").alias(f"{n}_{f}") for k, n in (("c", "nearest_core"), ("m", "nearest_margin")) for f in ("source_index", "distance")]
    return done.select(*FRAME, "points", "core", "margin", "outside", "unknown", *flat)


def crop(points: DataFrame, segs: DataFrame, bounds: Bounds = EXPANDED) -> DataFrame:
    """Points inside the bounds, and those beside the supported range, which stay unknown."""
    own = with_segments(points, segs)
    covered = F.filter("segs", _covers)

    def inside(seg: Column) -> Column:
        _, lateral, height = _local(seg)
        return in_bounds(bounds, lateral, height)

    return own.where(F.col("segs").isNull() | (F.size(covered) == 0) | F.exists(covered, inside)).drop("segs")


def project(points: DataFrame, segs: DataFrame) -> DataFrame:
    """points with axis_s and axis_distance of the nearest place of the axis (J19); null without an axis."""

    def near(seg: Column) -> Column:
        dx, dy = F.col("x").cast("double") - seg["ax"], F.col("y").cast("double") - seg["ay"]
        station = F.greatest(F.lit(0.0), F.least(dx * seg["tx"] + dy * seg["ty"], seg["length"]))
        t = station / seg["length"]
        px = F.col("x").cast("double") - (seg["ax"] + seg["tx"] * station).cast("float")
        py = F.col("y").cast("double") - (seg["ay"] + seg["ty"] * station).cast("float")
        pz = F.col("z").cast("double") - (seg["az"] + seg["dz"] * t).cast("float")
        return F.struct(F.sqrt(px * px + py * py + pz * pz).alias("distance"), seg["seg_index"].alias("seg_index"), (seg["s0"] + t * (seg["s1"] - seg["s0"])).alias("s"))

    best = F.array_min(F.transform("segs", near))
    return with_segments(points, segs).withColumn("_near", best).withColumns({"axis_s": F.col("_near.s"), "axis_distance": F.col("_near.distance")}).drop("_near", "segs")


def live_clusters(labels: DataFrame | None, clusters: DataFrame, min_points: int = 5, max_voxels: int | None = 50_000) -> DataFrame:
    """Clusters of core and margin returns with their boxes and nearest points, the nearest first.

    Frames over the voxel budget have none; with None there is no budget. Columns: FRAME, cluster_id, zone, component, n, box, nearest_index, nearest.
    labels give the places of points; None if the clusters have them, which then are dealt out as boxes alone.
    """
    own = clusters if max_voxels is None else clusters.where(F.col("voxels") <= max_voxels)
    if labels is not None:
        own = own.select(*FRAME, "zone", "component", "source_index").join(labels.where("zone IN (1, 2)").select(*FRAME, "source_index", "x", "y", "z"), [*FRAME, "source_index"])
    boxes = own.groupBy(*FRAME, "zone", "component").agg(
        F.count("*").alias("n"), *(f(F.col(a).cast("double")).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))), F.min(F.struct(distance().alias("distance"), "source_index")).alias("near")
    )
    rank = F.row_number().over(Window.partitionBy(*FRAME).orderBy("near.distance", "zone", "component")) - 1
    kept = boxes.where(F.col("n") >= min_points).withColumn("cluster_id", rank.cast("long"))
    return kept.select(*FRAME, "cluster_id", F.when(F.col("zone") == 1, "CORE").otherwise("MARGIN").alias("zone"), "component", "n", *(f"{m}_{a}" for a in "xyz" for m in ("min", "max")), F.col("near.source_index").alias("nearest_index"), F.col("near.distance").alias("nearest"))


def live_envelope(labels: DataFrame, clusters: DataFrame, min_points: int = 5, max_voxels: int = 50_000) -> DataFrame:
    """Status, counts and grouping of evaluated frames.

    labels: zones of every point; clusters: FRAME, zone, component, source_index of voxel groups of
    the core and margin returns, and `voxels` per frame.
    """
    stats = zone_stats(labels)
    sizes = clusters.groupBy(*FRAME, "zone", "component").agg(F.count("*").alias("n"), F.max("voxels").alias("voxels"))
    groups = sizes.groupBy(*FRAME).agg(F.count_if(F.col("n") >= min_points).alias("clusters"), F.coalesce(F.sum(F.when(F.col("n") < min_points, F.col("n"))), F.lit(0)).alias("ungrouped"), F.max("voxels").alias("voxels"))
    own = stats.join(groups, FRAME, "left").fillna(0, ["clusters", "ungrouped", "voxels"])
    over = F.col("voxels") > max_voxels
    status = F.when(F.col("core") > 0, "OBSERVED_CORE_INTRUSION_CANDIDATE").when(F.col("margin") > 0, "OBSERVED_MARGIN_RETURN").otherwise("UNKNOWN")
    reason = (
        F.when(F.col("core") > 0, "ANY_OBSERVED_RETURN_INSIDE_SUPPORTED_CORE_IS_INTRUSION_CANDIDATE").when(F.col("margin") > 0, "OBSERVED_RETURN_IN_CLEARANCE_MARGIN")
        .otherwise("NO_RETURNS_INTERSECT_REFERENCE_NOT_CLEAR")
    )
    return own.select(
        *FRAME, status.alias("status"), F.lit("UNKNOWN").alias("system_status"), reason.alias("reason"), (F.col("core") > 0).alias("intrusion_candidate_present"), (F.col("margin") > 0).alias("margin_return_present"),
        "core", "margin", "outside", "unknown", F.when(over, 0).otherwise(F.col("clusters")).cast("long").alias("clusters"), F.when(over, F.col("core") + F.col("margin")).otherwise(F.col("ungrouped")).cast("long").alias("ungrouped"),
        F.when(over, "LIMIT_EXCEEDED_POINTS_RETAINED").otherwise("COMPLETE").alias("grouping_status"),
    )
