"""Above-floor objects without an axis, and components against an envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackscan.config import FRAME, Objects
from trackscan.functions.exprs import distance
from trackscan.operators.cluster import voxel_groups


def floor_fit(points: DataFrame, cfg: Objects = Objects()) -> DataFrame:
    """FRAME, samples, grade, intercept, residual, reason of the line through the floor quantiles of bins (C11).

    The exact interpolated quantile of a bin is an aggregate that spills, so bins of any size work.
    """
    s = -F.col("y").cast("double")
    inside = points.withColumn("s", s).where((F.col("s") >= 0) & (F.col("s") < cfg.floor_forward_max) & (F.abs(F.col("x").cast("double")) <= cfg.floor_half_width))
    bins = inside.groupBy(*FRAME, F.floor(F.col("s") / cfg.floor_bin).alias("bin")).agg(F.count("*").alias("n"), F.percentile(F.col("z").cast("double"), F.lit(cfg.floor_quantile)).alias("q"))
    at = (F.col("bin") * cfg.floor_bin + F.least((F.col("bin") + 1) * cfg.floor_bin, F.lit(cfg.floor_forward_max))) / 2
    samples = bins.where(F.col("n") >= cfg.floor_min_points).withColumn("at", at)
    by = Window.partitionBy(*FRAME)
    centred = samples.withColumns({"ms": F.avg("at").over(by), "mq": F.avg("q").over(by)})
    fit = centred.groupBy(*FRAME).agg(
        F.count("*").alias("samples"), F.first("ms").alias("ms"), F.first("mq").alias("mq"), (F.sum(F.expr("(at - ms) * (q - mq)")) / F.sum(F.expr("(at - ms) * (at - ms)"))).alias("grade"), F.collect_list(F.struct("at", "q")).alias("list")
    )
    fit = fit.withColumn("intercept", F.expr("mq - grade * ms"))
    fit = fit.withColumn("residual", F.array_max(F.transform("list", lambda p: F.abs(p["q"] - F.col("intercept") - F.col("grade") * p["at"]))))
    every = points.select(*FRAME).distinct().join(fit, FRAME, "left")
    reason = (
        F.when(F.coalesce("samples", F.lit(0)) < cfg.floor_min_bins, "INSUFFICIENT_FLOOR_SUPPORT")
        .when((F.abs("grade") > cfg.max_grade) | (F.col("residual") > cfg.max_residual), "FLOOR_FIT_REJECTED")
    )
    return every.select(*FRAME, F.coalesce("samples", F.lit(0)).alias("samples"), "grade", "intercept", "residual", reason.alias("reason"))


def above_floor(points: DataFrame, floors: DataFrame, cfg: Objects = Objects()) -> DataFrame:
    """Points of the search space at object height above a fitted floor."""
    own = points.join(floors.where("reason IS NULL").select(*FRAME, "grade", "intercept"), FRAME)
    s, x = -F.col("y").cast("double"), F.col("x").cast("double")
    own = own.withColumns({"s": s, "h": F.col("z").cast("double") - F.col("intercept") - F.col("grade") * s})
    return own.where(F.col("s").between(cfg.forward_min, cfg.forward_max) & (F.abs(x) <= cfg.search_half_width) & F.col("h").between(cfg.min_height, cfg.max_height))


def object_candidates(points: DataFrame, cfg: Objects = Objects()) -> tuple[DataFrame, DataFrame]:
    """(objects, one status row per frame) of voxel groups above the floor."""
    floors = floor_fit(points, cfg)
    chosen = above_floor(points, floors, cfg)
    groups = voxel_groups(chosen, cfg.voxel)
    # frames over the budget have a status and no objects
    own = groups.where(F.col("voxels") <= cfg.max_voxels).join(chosen.select(*FRAME, "source_index", "x", "y", "z"), [*FRAME, "source_index"])
    d = {a: F.col(a).cast("double") for a in "xyz"}
    boxes = own.groupBy(*FRAME, "component").agg(
        F.count("*").alias("n"), *(f(d[a]).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))), F.min(F.struct(distance().alias("distance"), "source_index")).alias("near")
    )
    small = F.col("n") < cfg.min_points
    large = ~small & (F.greatest(F.expr("max_x - min_x"), F.expr("max_y - min_y")) > cfg.max_horizontal_extent)
    kept = boxes.where(~small & ~large)
    rank = F.row_number().over(Window.partitionBy(*FRAME).orderBy("near.distance", "component")) - 1
    edge = (
        (F.col("min_x") <= -cfg.search_half_width + cfg.voxel) | (F.col("max_x") >= cfg.search_half_width - cfg.voxel) | (-F.col("max_y") <= cfg.forward_min + cfg.voxel) | (-F.col("min_y") >= cfg.forward_max - cfg.voxel)
    )
    objects = kept.select(*FRAME, rank.cast("long").alias("object_id"), "component", "n", *(f"{m}_{a}" for a in "xyz" for m in ("min", "max")), F.col("near.source_index").alias("nearest_index"), F.col("near.distance").alias("nearest"), edge.alias("possibly_roi_clipped"))
    counts = boxes.groupBy(*FRAME).agg(
        F.sum("n").alias("selected"), F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("small"), F.coalesce(F.sum(F.when(large, F.col("n"))), F.lit(0)).alias("oversized"), F.count_if(~small & ~large).alias("objects")
    )
    voxels = groups.groupBy(*FRAME).agg(F.max("voxels").alias("voxels"))
    status = floors.join(counts, FRAME, "left").join(voxels, FRAME, "left").fillna(0, ["selected", "small", "oversized", "objects", "voxels"])
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("voxels") > cfg.max_voxels, "VOXEL_BUDGET_EXCEEDED").when(F.col("objects") > 0, "SUPPLEMENTAL_PROPOSALS_NOT_PERSON_CLASSIFICATION")
        .otherwise("NO_PROPOSALS_NOT_CLEAR")
    )
    done = status.withColumn("reason", reason)
    return objects, done.select(*FRAME, F.when(F.col("reason").startswith("SUPPLEMENTAL"), "OBJECT_CANDIDATES").otherwise("UNKNOWN").alias("status"), "reason", "selected", "small", "oversized", "objects")


def assess(members: DataFrame, labels: DataFrame, clipped: DataFrame | None = None) -> DataFrame:
    """Components against the envelope: counts by zone, status, nearest hits (C13, A24), and the share inside."""
    own = members.select(*FRAME, "component", "source_index").join(labels.select(*FRAME, "source_index", "zone", distance().alias("distance")), [*FRAME, "source_index"])

    def near(zone: int) -> F.Column:
        return F.min(F.when(F.col("zone") == zone, F.struct("distance", "source_index")))

    done = own.groupBy(*FRAME, "component").agg(*(F.count_if(F.col("zone") == z).alias(n) for z, n in ((0, "unknown"), (1, "core"), (2, "margin"), (3, "outside"))), near(1)["source_index"].alias("nearest_core"), near(2)["source_index"].alias("nearest_margin"))
    done = done.join(clipped, [*FRAME, "component"], "left") if clipped is not None else done.withColumn("possibly_roi_clipped", F.lit(False))
    cut = F.coalesce("possibly_roi_clipped", F.lit(False))
    status = F.when(F.col("core") > 0, "CORE_INTERSECTION").when(F.col("margin") > 0, "MARGIN_INTERSECTION").when((F.col("unknown") > 0) | cut, "UNKNOWN").otherwise("OBSERVED_RETURNS_OUTSIDE")
    ratio = F.col("core") / (F.col("core") + F.col("margin") + F.col("outside") + F.col("unknown"))
    return done.withColumns({"status": status, "complete": (F.col("unknown") == 0) & ~cut, "inside_ratio": ratio}).drop("possibly_roi_clipped")


def anchor_membership(anchors: DataFrame, labels: DataFrame, slack: float = 1e-6) -> DataFrame:
    """anchors (FRAME, event_id, ax, ay, az) with the first point there and its zone.

    Both sides meet on rounded coordinates, each anchor sent to the cells its slack reaches.
    """
    grid = 1e-3
    cell = [F.floor(F.col(c).cast("double") / grid).alias(f"c{c}") for c in "xyz"]
    own = labels.select(*FRAME, "source_index", "zone", "x", "y", "z", *cell)
    sides = [F.array_distinct(F.array(*(F.floor((F.col(f"a{c}") + e) / grid) for e in (-slack, slack)))) for c in "xyz"]
    sent = anchors
    for c, s in zip("xyz", sides):
        sent = sent.withColumn(f"c{c}", F.explode(s))
    near = sent.join(own, [*FRAME, "cx", "cy", "cz"]).where(" AND ".join(f"abs(cast({c} AS double) - a{c}) <= {slack}" for c in "xyz"))
    first = near.groupBy(*FRAME, "event_id").agg(F.min(F.struct("source_index", "zone")).alias("hit"))
    done = anchors.join(first, [*FRAME, "event_id"], "left")
    zone = F.col("hit.zone")
    status = F.when(F.col("hit").isNull(), "SOURCE_POINT_NOT_FOUND").when(zone == 1, "CORE").when(zone == 2, "MARGIN").when(zone == 3, "OBSERVED_OUTSIDE_GABARIT").otherwise("UNKNOWN")
    return done.select(*FRAME, "event_id", F.col("hit.source_index").alias("source_index"), status.alias("membership"))
