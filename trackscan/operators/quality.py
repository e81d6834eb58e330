"""Frame quality: counts, usable points, ranges, closest return, frame records (survey F1-F15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackscan.config import FRAME, Rails
from trackscan.functions.exprs import distance, finite

ZERO = "x = 0 AND y = 0 AND z = 0"


def usable(points: DataFrame) -> DataFrame:
    """Finite points that aren't the zero return (F2)."""
    return points.where(finite("x", "y", "z")).where(f"NOT ({ZERO})")


def frame_quality(points: DataFrame) -> DataFrame:
    """Counts per frame; a zero return is finite, too (F1)."""
    ok, zero = finite("x", "y", "z"), F.expr(ZERO)
    return points.groupBy(*FRAME).agg(
        F.count("*").alias("points"),
        F.count_if(ok).alias("finite"),
        F.count_if(ok & zero).alias("zero"),
        F.count_if(~ok).alias("nonfinite"),
        F.count_if(ok & ~zero).alias("nonzero_finite"),
    )


def extents(points: DataFrame) -> DataFrame:
    """Least and greatest x, y, z of the usable points; null in a frame without any."""
    ok = finite("x", "y", "z") & ~F.expr(ZERO)
    return points.groupBy(*FRAME).agg(*(f(F.when(ok, F.col(c))).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def closest_return(points: DataFrame) -> DataFrame:
    """Distance of the closest usable point."""
    ok = finite("x", "y", "z") & ~F.expr(ZERO)
    return points.groupBy(*FRAME).agg(F.min(F.when(ok, distance())).alias("closest_return_distance_m"))


def time_range(points: DataFrame, time: str = "timestamp") -> DataFrame:
    """Least and greatest finite per-point time."""
    ok = finite(time)
    return points.groupBy(*FRAME).agg(F.min(F.when(ok, F.col(time))).alias("first_time"), F.max(F.when(ok, F.col(time))).alias("last_time"))


def veto(points: DataFrame) -> DataFrame:
    """Frames with the reason NONFINITE_XYZ if any coordinate isn't finite."""
    bad = F.coalesce(F.bool_or(~finite("x", "y", "z")), F.lit(False))
    return points.groupBy(*FRAME).agg(bad.alias("vetoed")).withColumn("reason", F.when(F.col("vetoed"), "NONFINITE_XYZ"))


def keep_sound(points: DataFrame) -> DataFrame:
    """Points of frames without a veto."""
    return points.join(veto(points).where("NOT vetoed").select(*FRAME), FRAME, "left_semi")


def frame_records(frames: DataFrame, bag_ns: str = "bag_ns") -> DataFrame:
    """frames with bag_offset_seconds from the source's first time (F9); going back in time is an error."""
    first = F.first(bag_ns).over(Window.partitionBy("source_id").orderBy("frame_index"))
    delta = F.col(bag_ns) - first
    return frames.withColumn("bag_offset_seconds", F.when(delta < 0, F.raise_error(F.lit("bag time precedes the first frame")).cast("double")).otherwise(delta / F.lit(1e9)))


def search_window(points: DataFrame, cfg: Rails = Rails()) -> DataFrame:
    """Points of the rail search window, half open (F7), with station and lateral cell."""
    s, x = -F.col("y").cast("double"), F.col("x").cast("double")
    inside = points.withColumns({"s": s, "station": F.floor((s - cfg.forward_min) / cfg.station_length), "cell": F.floor((x - cfg.lateral_min) / cfg.cell_width)})
    return inside.where((F.col("s") >= cfg.forward_min) & (F.col("s") < cfg.forward_max) & (x >= cfg.lateral_min) & (x < cfg.lateral_max))


def select_zone(labels: DataFrame, zone: int) -> DataFrame:
    """Points of one zone."""
    return labels.where(F.col("zone") == zone)


def reasoned(frame: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """frame with the reason of the first check that fails; null if all hold."""
    reason = F.lit(None).cast("string")
    for ok, name in reversed(checks):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    return frame.withColumn("reason", reason)
