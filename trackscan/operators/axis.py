"""The track axis: validated pairs, segments, forward extensions, wireframes and rings.

Rail pairs are long rows: FRAME, s, left, right (structs of float x, y, z), observed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from trackscan.config import FRAME, TOLERANCE, Bounds

POINT = "struct<x:float,y:float,z:float>"


def order() -> WindowSpec:
    """Pairs of a frame by station."""
    return Window.partitionBy(*FRAME).orderBy("s")


def pair_rows(detected: DataFrame) -> DataFrame:
    """Long rows of the pairs of detected frames."""
    return detected.select(*FRAME, F.explode("rail_pairs").alias("p")).select(*FRAME, "p.*", F.lit(True).alias("observed"))


def manual_axis(clicks: DataFrame) -> DataFrame:
    """Pairs of two clicked stations, four points a frame (X7): FRAME, left_a, right_a, left_b, right_b."""
    rows = F.array(*(F.struct((-(F.col(f"left_{e}.y").cast("double") + F.col(f"right_{e}.y")) * 0.5).alias("s"), F.col(f"left_{e}").cast(POINT).alias("left"), F.col(f"right_{e}").cast(POINT).alias("right")) for e in "ab"))
    return clicks.select(*FRAME, F.explode(rows).alias("p")).select(*FRAME, "p.*", F.lit(True).alias("observed"))


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """The first reason why a frame's pairs make no axis; null if they do."""

    def fine(c: Column) -> Column:
        return F.coalesce(F.abs(c) < float("inf"), F.lit(False))

    ends = fine(F.col("s")) & fine(F.col("left.x")) & fine(F.col("left.y")) & fine(F.col("left.z")) & fine(F.col("right.x")) & fine(F.col("right.y")) & fine(F.col("right.z"))
    side = F.hypot(F.col("left.x").cast("double") - F.col("right.x"), F.col("left.y").cast("double") - F.col("right.y"))
    moved = F.hypot(*(F.col(c).cast("double") - F.lag(c).over(order()) for c in ("cx", "cy")))
    own = with_centre(pairs).withColumns({"_fine": ends, "_step": F.col("s") - F.lag("s").over(order()), "_side": side, "_moved": moved})
    facts = own.groupBy(*FRAME).agg(F.count("*").alias("n"), F.bool_and("_fine").alias("fine"), F.min("_step").alias("step"), F.min("_side").alias("side"), F.min("_moved").alias("moved"))
    reason = (
        F.when(F.col("n") < 2, "TOO_FEW_PAIRS").when(~F.col("fine"), "NONFINITE_PAIRS").when(F.col("step") <= 0, "UNORDERED_PAIRS").when(F.col("side") < TOLERANCE, "EQUAL_SIDES")
        .when(F.col("moved") < TOLERANCE, "EQUAL_SECTIONS")
    )
    return facts.select(*FRAME, "n", reason.alias("reason"))


def with_centre(pairs: DataFrame) -> DataFrame:
    """pairs with cx, cy, cz: the midpoint, added in float and halved in double as the sensor's own code does."""
    return pairs.withColumns({f"c{a}": ((F.col(f"left.{a}") + F.col(f"right.{a}")).cast("double") * 0.5).cast("float") for a in "xyz"})


def segments(pairs: DataFrame) -> DataFrame:
    """FRAME, seg_index, origin, unit tangent and normal, dz, length, s0, s1 of neighbouring pairs.

    The normal points to the left rail. Neighbours with one centre make no segment; validate_pairs names their frames.
    """
    nxt = {f"n{c}": F.lead(c).over(order()) for c in ("cx", "cy", "cz", "s")}
    own = with_centre(pairs).withColumns({**nxt, "seg_index": (F.row_number().over(order()) - 1).cast("long")}).where("ns IS NOT NULL")
    own = own.withColumns({f"d{a}": F.col(f"nc{a}").cast("double") - F.col(f"c{a}") for a in "xyz"})
    own = own.withColumn("length", F.expr("sqrt(dx*dx + dy*dy)")).where(F.col("length") >= TOLERANCE).withColumns({"tx": F.expr("dx/length"), "ty": F.expr("dy/length")})
    side = F.expr("ty * (cast(left.x AS double) - right.x) - tx * (cast(left.y AS double) - right.y)")
    flip = F.when(side < 0, -1.0).otherwise(1.0)
    own = own.withColumns({"nx": F.col("ty") * flip, "ny": -F.col("tx") * flip})
    return own.select(*FRAME, "seg_index", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("cz").alias("az"), "tx", "ty", "nx", "ny", "dz", "length", F.col("s").alias("s0"), F.col("ns").alias("s1"))


def path_lengths(segs: DataFrame) -> DataFrame:
    """segs with the running length in the plane and in space."""
    run = Window.partitionBy(*FRAME).orderBy("seg_index").rowsBetween(Window.unboundedPreceding, 0)
    return segs.withColumns({"path_2d": F.sum("length").over(run), "path_3d": F.sum(F.hypot("length", "dz")).over(run)})


def _tail(pairs: DataFrame, n: int) -> DataFrame:
    """One row per frame: its number of pairs and the last n with centres, the last first."""
    own = with_centre(pairs).withColumn("back", F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("s"))))
    item = F.struct("back", "s", "left", "right", "cx", "cy", "cz")
    return own.groupBy(*FRAME).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("back") <= n, item))).alias("tail"))


def extend_tangent(pairs: DataFrame, target_s: float = 80.0) -> DataFrame:
    """pairs and, where the last one lies before target_s, one more there, moved rigidly along the last step."""
    tail = _tail(pairs, 2).where((F.col("n") >= 2) & (F.col("tail")[0]["s"] + TOLERANCE < target_s))
    last, before = F.col("tail")[0], F.col("tail")[1]
    scale = (F.lit(target_s) - last["s"]) / (last["s"] - before["s"])

    def moved(side: str) -> Column:
        return F.struct(*((last[side][a] + (last[f"c{a}"].cast("double") - before[f"c{a}"]) * scale).cast("float").alias(a) for a in "xyz")).cast(POINT)

    more = tail.select(*FRAME, F.lit(target_s).alias("s"), moved("left").alias("left"), moved("right").alias("right"), F.lit(False).alias("observed"))
    return pairs.select(*FRAME, "s", "left", "right", "observed").unionByName(more)


def tangent_status(pairs: DataFrame, target_s: float = 80.0) -> DataFrame:
    ends = pairs.groupBy(*FRAME).agg(F.max("s").alias("end_s"))
    return ends.select(*FRAME, F.when(F.col("end_s") + TOLERANCE >= target_s, "AT_FORWARD_LIMIT").otherwise("TANGENT_APPLIED").alias("status"))


def _circle_of_three(own: DataFrame) -> DataFrame:
    """Centre of the circle through the last three centres; null if they are in line."""
    p = {n: F.col("tail")[i] for n, i in (("c", 0), ("b", 1), ("a", 2))}
    x, y = ({n: v[f"c{axis}"].cast("double") for n, v in p.items()} for axis in "xy")
    det = 2.0 * (x["a"] * (y["b"] - y["c"]) + x["b"] * (y["c"] - y["a"]) + x["c"] * (y["a"] - y["b"]))
    sq = {n: x[n] * x[n] + y[n] * y[n] for n in p}
    own = own.withColumn("det", F.when(F.col("n") >= 3, det))
    fit = F.abs("det") > TOLERANCE
    ox = (sq["a"] * (y["b"] - y["c"]) + sq["b"] * (y["c"] - y["a"]) + sq["c"] * (y["a"] - y["b"])) / F.col("det")
    oy = (sq["a"] * (x["c"] - x["b"]) + sq["b"] * (x["a"] - x["c"]) + sq["c"] * (x["b"] - x["a"])) / F.col("det")
    own = own.withColumns({"ox": F.when(fit, ox), "oy": F.when(fit, oy)})
    return own.withColumn("radius", F.hypot(x["c"] - F.col("ox"), y["c"] - F.col("oy"))).drop("det")


def _circle_of_window(own: DataFrame, window: int) -> DataFrame:
    """Centre and radius of the least-squares circle of the last pairs' centres.

    x^2 + y^2 + d x + e y + f = 0 by the normal equations, solved by determinants on centred sums.
    """
    t = F.slice("tail", 1, window)
    n = F.size(t).cast("double")

    def total(f) -> Column:
        return F.aggregate(t, F.lit(0.0), lambda acc, p: acc + f(p["cx"].cast("double"), p["cy"].cast("double")))

    own = own.withColumns({"mx": total(lambda x, y: x) / n, "my": total(lambda x, y: y) / n})
    u, v = (lambda x: x - F.col("mx")), (lambda y: y - F.col("my"))
    own = own.withColumns(
        {
            "suu": total(lambda x, y: u(x) * u(x)), "suv": total(lambda x, y: u(x) * v(y)), "svv": total(lambda x, y: v(y) * v(y)),
            "suq": total(lambda x, y: u(x) * (u(x) * u(x) + v(y) * v(y))), "svq": total(lambda x, y: v(y) * (u(x) * u(x) + v(y) * v(y))),
        }
    )
    own = own.withColumn("det", F.expr("suu*svv - suv*suv"))
    fit = (F.col("n") >= 3) & (F.col("det") > TOLERANCE)
    own = own.withColumns({"ou": F.when(fit, F.expr("(suq*svv - svq*suv) / (2*det)")), "ov": F.when(fit, F.expr("(svq*suu - suq*suv) / (2*det)"))})
    return own.withColumns({"ox": F.expr("mx + ou"), "oy": F.expr("my + ov"), "radius": F.sqrt(F.expr("ou*ou + ov*ov") + F.expr("suu + svv") / n)}).drop("mx", "my", "suu", "suv", "svv", "suq", "svq", "det", "ou", "ov")


def _arc(pairs: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with samples along the arc, one status row per frame) for rows with horizon, ox, oy, radius, status."""
    last, before = F.col("tail")[0], F.col("tail")[1]
    rx, ry = last["cx"].cast("double") - F.col("ox"), last["cy"].cast("double") - F.col("oy")
    mx, my = last["cx"].cast("double") - before["cx"], last["cy"].cast("double") - before["cy"]
    own = own.withColumns({"turn": F.when(-ry * mx + rx * my >= 0, 1.0).otherwise(-1.0), "step": last["s"] - before["s"]})
    go = own.where("horizon IS NOT NULL").withColumn("sample", F.least("step", "horizon"))
    each = go.withColumn("i", F.explode(F.sequence(F.lit(1), F.ceil(F.col("horizon") / F.col("sample")).cast("int"))))
    each = each.withColumn("far", F.least("horizon", F.col("i") * F.col("sample"))).withColumn("angle", F.expr("turn * far / radius"))

    def turned(side: str) -> Column:
        dx, dy = last[side]["x"].cast("double") - F.col("ox"), last[side]["y"].cast("double") - F.col("oy")
        z = last[side]["z"].cast("double") + (last[side]["z"] - before[side]["z"]).cast("double") * (F.col("far") / F.col("step"))
        x = F.col("ox") + F.cos("angle") * dx - F.sin("angle") * dy
        y = F.col("oy") + F.sin("angle") * dx + F.cos("angle") * dy
        return F.struct(x.cast("float").alias("x"), y.cast("float").alias("y"), z.cast("float").alias("z")).cast(POINT)

    more = each.select(*FRAME, (last["s"] + F.col("far")).alias("s"), turned("left").alias("left"), turned("right").alias("right"), F.lit(False).alias("observed"))
    status = own.select(*FRAME, "status", "radius", F.coalesce("horizon", F.lit(0.0)).alias("horizon"), F.least("step", "horizon").alias("sample_step"), F.degrees(F.col("horizon") / F.col("radius")).alias("turn_deg"))
    return pairs.select(*FRAME, "s", "left", "right", "observed").unionByName(more), status


def extend_arc_limited(pairs: DataFrame, horizon: float, max_s: float = 80.0) -> tuple[DataFrame, DataFrame]:
    """Samples along the circle through the last three centres (X4), and a status per frame."""
    own = _circle_of_three(_tail(pairs, 3))
    room = F.lit(max_s) - F.col("tail")[0]["s"]
    # Statuses, in their order
    status = (
        F.when(F.lit(horizon) <= TOLERANCE, "ARC_HORIZON_DISABLED").when(room <= TOLERANCE, "AT_FORWARD_LIMIT").when(F.col("n") < 3, "INSUFFICIENT_ARC_SUPPORT")
        .when(F.col("ox").isNull() | (F.col("radius") <= TOLERANCE), "COLLINEAR_ARC_SUPPORT").otherwise("ARC_LIMITED_APPLIED")
    )
    own = own.withColumn("status", status)
    return _arc(pairs, own.withColumn("horizon", F.when(F.col("status") == "ARC_LIMITED_APPLIED", F.least(F.lit(horizon), room))))


def extend_arc_clamped(pairs: DataFrame, horizon: float, max_s: float = 80.0, min_radius: float = 60.0, max_turn_deg: float = 8.0, window: int = 5) -> tuple[DataFrame, DataFrame]:
    """Samples along the circle fitted to the last pairs, no tighter and no farther round than allowed."""
    own = _circle_of_window(_tail(pairs, max(window, 3)), window)
    room = F.lit(max_s) - F.col("tail")[0]["s"]
    wanted = F.least(F.lit(horizon), room)
    clamped = F.least(wanted, F.col("radius") * math.radians(max_turn_deg))
    # Statuses, in their order
    status = (
        F.when(F.lit(horizon) <= TOLERANCE, "ARC_HORIZON_DISABLED").when(room <= TOLERANCE, "AT_FORWARD_LIMIT")
        .when(F.col("ox").isNull() | (F.col("radius") < min_radius) | (clamped <= TOLERANCE), "ARC_CLAMPED_REJECTED")
        .when(clamped + TOLERANCE < wanted, "ARC_CLAMPED_TO_MAX_TURN").otherwise("ARC_CLAMPED_APPLIED")
    )
    own = own.withColumn("status", status)
    return _arc(pairs, own.withColumn("horizon", F.when(F.col("status").isin("ARC_CLAMPED_APPLIED", "ARC_CLAMPED_TO_MAX_TURN"), clamped)))


def extend(pairs: DataFrame, method: str, horizon: float = 0.0, min_radius: float = 60.0, max_turn_deg: float = 8.0, window: int = 5, max_s: float = 80.0) -> DataFrame:
    """pairs extended by one of the methods; `observed` leaves them alone."""
    if method == "tangent":
        return extend_tangent(pairs, max_s)
    if method == "arc_limited":
        return extend_arc_limited(pairs, horizon, max_s)[0]
    if method == "arc_clamped":
        return extend_arc_clamped(pairs, horizon, max_s, min_radius, max_turn_deg, window)[0]
    return pairs.select(*FRAME, "s", "left", "right", "observed")


def world(station: Column, lateral: Column, height: Column) -> Column:
    """Source coordinates of a place on a segment row."""
    x = F.col("ax") + F.col("tx") * station + F.col("nx") * lateral
    y = F.col("ay") + F.col("ty") * station + F.col("ny") * lateral
    z = F.col("az") + F.col("dz") * station / F.col("length") + height
    return F.struct(x.cast("float").alias("x"), y.cast("float").alias("y"), z.cast("float").alias("z"))


def local(point: Column) -> tuple[Column, Column, Column]:
    """(station, lateral, height) of a point on a segment row, the inverse of `world`."""
    dx, dy = point["x"].cast("double") - F.col("ax"), point["y"].cast("double") - F.col("ay")
    station = dx * F.col("tx") + dy * F.col("ty")
    return station, dx * F.col("nx") + dy * F.col("ny"), point["z"].cast("double") - F.col("az") - F.col("dz") * station / F.col("length")


def wireframe(segs: DataFrame, bounds: Bounds) -> DataFrame:
    """Twelve edges of each segment's box: FRAME, seg_index, edge, start, finish."""
    corners = [(bounds.left, bounds.bottom), (bounds.right, bounds.bottom), (bounds.right, bounds.top), (bounds.left, bounds.top)]

    def at(end: int, corner: int) -> Column:
        return world(F.lit(0.0) if end == 0 else F.col("length"), F.lit(corners[corner][0]), F.lit(corners[corner][1]))

    edges = [((e, i), (e, (i + 1) % 4)) for e in (0, 1) for i in range(4)] + [((0, i), (1, i)) for i in range(4)]
    rows = F.array(*(F.struct(F.lit(n).cast("long").alias("edge"), at(*a).alias("start"), at(*b).alias("finish")) for n, (a, b) in enumerate(edges)))
    return segs.select(*FRAME, "seg_index", F.explode(rows).alias("e")).select(*FRAME, "seg_index", "e.*")


def rings(segs: DataFrame, bounds: Bounds, sections: int = 20) -> DataFrame:
    """Cross-sections at equal steps of each segment: FRAME, seg_index, section, corner, point (E5)."""
    corners = [(bounds.left, bounds.bottom), (bounds.right, bounds.bottom), (bounds.right, bounds.top), (bounds.left, bounds.top)]
    each = segs.withColumn("section", F.explode(F.sequence(F.lit(0), F.lit(sections))))
    at = F.col("length") * F.col("section") / F.lit(sections)
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("corner"), world(at, F.lit(a), F.lit(h)).alias("point")) for i, (a, h) in enumerate(corners)))
    return each.select(*FRAME, "seg_index", F.col("section").cast("long").alias("section"), F.explode(rows).alias("c")).select(*FRAME, "seg_index", "section", "c.*")
