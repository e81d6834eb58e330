"""Component shapes, features and decisions (A4, A5, C3-C10), and frame flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.config import FRAME
from trackscan.functions.exprs import THRESHOLD, distance, forest_score

COMPONENT = [*FRAME, "component"]
FEATURES = ("f0", "f1", "f2", "f3", "f4", "f5", "f6", "f7")
#: Points from which a component counts without the forest, and from which it may be a boundary.
STRONG, BOUNDARY = 1000, 250
# Rules over the shape columns, in SQL that both dialects read.
BOUNDARY_RULE = f"n >= {BOUNDARY} AND ((cx < -1.30e0 AND ex < 0.25e0 AND ez > 1.50e0) OR (cz > 1.00e0 AND ex > 1.00e0 AND ey > 1.00e0 AND ez > 0.30e0))"
EARLY_RULE = """n >= 80 AND nearest > 7e0 AND nearest <= 80e0 AND ey <= 0.8e0 AND abs((min_x + max_x) * 0.5e0) <= 1.4e0
 AND ((ex BETWEEN 1.1e0 AND 2.6e0 AND ez BETWEEN 1.1e0 AND 2.6e0) OR (ex BETWEEN 0.2e0 AND 0.65e0 AND ez BETWEEN 0.2e0 AND 0.65e0))"""


def members(points: DataFrame, components: DataFrame) -> DataFrame:
    """Component members with their coordinates."""
    return components.join(points.select(*FRAME, "source_index", "x", "y", "z"), [*FRAME, "source_index"])


def shapes(own: DataFrame) -> DataFrame:
    """n, box, extents, centroid and nearest distance of each component (A4)."""
    d = {a: F.col(a).cast("double") for a in "xyz"}
    done = own.groupBy(*COMPONENT).agg(
        F.count("*").alias("n"),
        *(f(d[a]).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))),
        *(F.avg(d[a]).alias(f"c{a}") for a in "xyz"),
        F.min(distance()).alias("nearest"),
    )
    return done.withColumns({f"e{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"})


def features(shape: DataFrame) -> DataFrame:
    """shape with the eight features of the forest."""
    volume = F.greatest(F.expr("ex * ey * ez"), F.lit(1e-6))
    columns = [F.col("n").cast("double"), F.col("ex"), F.col("ey"), F.col("ez"), volume, F.col("n") / volume, F.expr("sqrt(cx*cx + cy*cy + cz*cz)"), F.col("nearest")]
    return shape.withColumns(dict(zip(FEATURES, columns)))


def decide(shape: DataFrame) -> DataFrame:
    """shape with boundary, early, score (null unless asked for) and decision."""
    own = features(shape).withColumns({"boundary": F.expr(BOUNDARY_RULE), "early": F.expr(f"NOT ({BOUNDARY_RULE}) AND {EARLY_RULE}")})
    own = own.withColumn("score", F.when(~F.col("boundary") & (F.col("n") < STRONG), forest_score(*FEATURES)))
    decision = F.when(F.col("boundary"), "boundary_warning").when(F.col("n") >= STRONG, "geometry_obstacle").when(F.col("score") >= THRESHOLD, "model_assist").otherwise("noise")
    return own.withColumn("decision", decision).withColumn("reportable", F.col("decision").isin("geometry_obstacle", "model_assist")).drop(*FEATURES)


def assist_only(shape: DataFrame) -> DataFrame:
    """The alternative filter by the forest alone."""
    own = features(shape).withColumn("score", forest_score(*FEATURES))
    return own.withColumn("reportable", F.col("score") >= THRESHOLD).drop(*FEATURES)


def axis_stats(projected: DataFrame) -> DataFrame:
    """Span along the axis and mean distance from it of each component (A5); null without an axis."""
    return projected.groupBy(*COMPONENT).agg(F.count("*").alias("n"), (F.max("axis_s") - F.min("axis_s")).alias("span"), F.avg("axis_distance").alias("mean_distance"), F.min("axis_s").alias("near_s"))


def legacy_filter(stats: DataFrame, min_points: int = 22, max_span: float = 1.0, max_distance: float = 1.2) -> DataFrame:
    """The alternative filter by size, span and distance."""
    keep = (F.col("n") >= min_points) & (F.col("span") <= max_span) & (F.col("mean_distance") <= max_distance)
    return stats.withColumn("reportable", F.coalesce(keep, F.lit(False)))


def frame_flags(frames: DataFrame, stats: DataFrame, decided: DataFrame, mode: str = "baseline_v3") -> DataFrame:
    """Per frame: zone counts and the points of each kind of component; null flags where nothing was evaluated.

    frames: FRAME and `evaluated`, whether the frame has an axis; a frame without one stays unknown. Under the
    alternative filters any reportable point makes a frame a candidate, which is its `model` flag; the other
    flags are those of the cascade alone.
    """
    n = F.col("n")
    sums = decided.groupBy(*FRAME).agg(
        F.count("*").alias("components"),
        *(F.coalesce(F.sum(F.when(F.col("decision") == d, n)), F.lit(0)).alias(d) for d in ("geometry_obstacle", "model_assist", "boundary_warning")),
        F.coalesce(F.sum(F.when(F.col("early"), n)), F.lit(0)).alias("early_points"),
        F.coalesce(F.sum(F.when(F.col("reportable"), n)), F.lit(0)).alias("reportable_points"),
        F.min(F.when(F.col("reportable"), F.col("nearest"))).alias("nearest_reportable"),
        F.min(F.when(F.col("early"), F.col("nearest"))).alias("nearest_early"),
    )
    own = frames.join(stats.select(*FRAME, "core", "margin", "outside", "unknown"), FRAME, "left").join(sums, FRAME, "left")
    counts = ("core", "margin", "outside", "unknown", "components", "geometry_obstacle", "model_assist", "boundary_warning", "early_points", "reportable_points")
    own = own.fillna(0, list(counts))
    flags = {"geometry": "geometry_obstacle", "model": "model_assist" if mode == "baseline_v3" else "reportable_points", "early": "early_points", "boundary": "boundary_warning"}
    return own.withColumns({k: F.when(F.col("evaluated"), F.col(v) > 0) for k, v in flags.items()})
