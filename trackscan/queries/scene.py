"""Queries over the derived scene: rails, axis, zones, components, decisions, objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.config import CORE, EXPANDED, FRAME, Config, Objects, Rails
from trackscan.fixtures import dealt_scene as scene
from trackscan.fixtures import table
from trackscan.operators import axis, cluster, decide, envelope, objects, quality, rails, temporal, viewer
from trackscan.plans import pipeline
from trackscan.queries import twins as t
from trackscan.queries.registry import query
from trackscan.session import materialize

FK = t.FK


def r6(*columns: str) -> list[Column]:
    return [(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in columns]


def s6(*columns: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0e0 AS {c}" for c in columns)


def _detected(spark, sf_dir, cfg: Rails = Rails()) -> DataFrame:
    return materialize(rails.detect(scene(spark, sf_dir), cfg=cfg), "detected")


def _segments(spark, sf_dir, cfg: Rails = Rails()) -> DataFrame:
    """Axis rows are few; written once, they serve each of the later joins."""
    return materialize(pipeline.Pipeline(Config(rails=cfg)).segments(_detected(spark, sf_dir, cfg)), "segments")


def _labels(spark, sf_dir, cfg: Rails = Rails()) -> DataFrame:
    return envelope.label(scene(spark, sf_dir), _segments(spark, sf_dir, cfg))


def _core(spark, sf_dir) -> DataFrame:
    return materialize(quality.select_zone(_labels(spark, sf_dir), 1), "core")


def _members(spark, sf_dir) -> DataFrame:
    core = _core(spark, sf_dir)
    return decide.members(core, cluster.components(core))


@query(t.select(t.BIN, f"SELECT {FK}, count(*) AS points, CAST(sum(station) AS BIGINT) AS stations FROM bin GROUP BY ALL"))
def search_window_filter(spark, sf_dir):
    return quality.search_window(scene(spark, sf_dir)).groupBy(*FRAME).agg(F.count("*").alias("points"), F.sum("station").alias("stations"))


@query(t.select(t.BIN, f"SELECT {FK}, station, cell, count(*) AS points FROM bin GROUP BY ALL"))
def station_cell_binning(spark, sf_dir):
    return rails.station_cells(scene(spark, sf_dir)).select(*FRAME, "station", "cell", F.size("zs").cast("long").alias("points"))


@query(t.select(t.FLOORS, f"SELECT {FK}, station, {s6('floor')} FROM floors"))
def station_floor(spark, sf_dir):
    return rails.station_floors(scene(spark, sf_dir)).select(*FRAME, "station", *r6("floor"))


@query(t.select(t.HEADS, f"SELECT {FK}, station, cell, {s6('height')} FROM heads"))
def ridge_heights(spark, sf_dir):
    return rails.ridge_heights(scene(spark, sf_dir)).select(*FRAME, "station", "cell", *r6("height"))


@query(t.select(t.PROM, f"SELECT {FK}, station, cell, {s6('prominence')} FROM prom"))
def ridge_prominence(spark, sf_dir):
    return rails.ridge_prominence(scene(spark, sf_dir)).select(*FRAME, "station", "cell", *r6("prominence"))


@query(t.select(t.PEAKS, f"SELECT {FK}, station, cell, source_index, {s6('x', 'z')} FROM peaks"))
def ridge_representative(spark, sf_dir):
    return rails.ridge_peaks(scene(spark, sf_dir)).select(*FRAME, "station", "cell", "source_index", *r6("x", "z"))


@query(t.select(t.SEPARATE, f"SELECT {FK}, station, p.cell AS cell, round(p.x, 6) AS x FROM sep"))
def peak_nms(spark, sf_dir):
    return rails.separate_peaks(rails.ridge_peaks(scene(spark, sf_dir))).select(*FRAME, "station", F.explode("peaks").alias("p")).select(*FRAME, "station", "p.cell", F.round("p.x", 6).alias("x"))


@query(t.select(t.PAIRS, f"SELECT {FK}, station, {s6('s', 'l', 'r', 'lz', 'rz')} FROM pairs"))
def rail_pair_candidates(spark, sf_dir):
    own = rails.rail_pairs(scene(spark, sf_dir)).select(*FRAME, "station", F.explode("pairs").alias("p")).select(*FRAME, "station", "p.*")
    return own.select(*FRAME, "station", *r6("s", "l", "r", "lz", "rz"))


RAIL_FIELDS = f"SELECT {FK}, reason, CAST(pair_stations AS BIGINT) AS pair_stations, CAST(supported AS BIGINT) AS supported_stations, CAST(best.score AS BIGINT) AS best_score, round(-best.gain, 6) + 0e0 AS best_cost, {s6('span', 'coverage')}, round(displacement, 6) AS rival_displacement FROM rails"


def _rail_fields(found: DataFrame) -> DataFrame:
    return found.select(*FRAME, "reason", "pair_stations", "supported_stations", "best_score", (F.round("best_cost", 6) + 0.0).alias("best_cost"), *r6("span", "coverage", "rival_displacement"))


@query(t.select(t.RAILS, RAIL_FIELDS))
def rail_chain_dp(spark, sf_dir):
    return _rail_fields(_detected(spark, sf_dir))


# Two parallel chains a few decimetres apart, with gaps, by nation; the last one has too many pairs.
LADDER = """SELECT CAST(n_nationkey AS BIGINT) AS source_id, CAST(0 AS BIGINT) AS frame_index, CAST(station AS BIGINT) AS station, c, 2e0 + (station + 5e-1)*2e0 AS s,
  c*(3e-1*(n_nationkey % 5)) + 1e-2*(station % 3) - 8e-1 AS l, c*(3e-1*(n_nationkey % 5)) + 1e-2*(station % 3) + 8e-1 AS r, 1e-3*station AS lz, 1e-3*station + 1e-2*c AS rz"""
LADDER_KEEP = "(station*7 + n_nationkey*3 + c) % (5 + n_nationkey % 7) <> 0 AND (c = 0 OR n_nationkey % 5 > 0) AND (c < 2 OR n_nationkey = 24) AND station < 8 + n_nationkey"
_POINTS = ", ".join(f"CAST(0 AS FLOAT) AS {c}" for c in ("lx", "ly", "lzz", "rx", "ry", "rzz"))
LADDER_SQL = f"""pairs AS (SELECT *, {_POINTS} FROM ({LADDER} FROM nation, (SELECT unnest(range(0, 39)) AS station), (SELECT unnest(range(0, 10)) AS c) WHERE {LADDER_KEEP})), fks AS (SELECT CAST(n_nationkey AS BIGINT) AS source_id, CAST(0 AS BIGINT) AS frame_index FROM nation)"""


def _ladder(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation")
    own = nation.selectExpr("n_nationkey", "explode(sequence(0, 38)) AS station").selectExpr("*", "explode(sequence(0, 9)) AS c").where(LADDER_KEEP)
    rows = spark.sql(f"{LADDER} FROM {{own}}", own=own)
    none = F.lit(None).cast(axis.POINT)
    packed = rows.groupBy(*FRAME, "station").agg(F.sort_array(F.collect_list(F.struct("l", "r", "s", "lz", "rz"))).alias("p"))
    pairs = packed.select(*FRAME, "station", F.transform("p", lambda p: F.struct(p["s"].alias("s"), p["l"].alias("l"), p["r"].alias("r"), p["lz"].alias("lz"), p["rz"].alias("rz"), none.alias("left"), none.alias("right"))).alias("pairs"))
    return pairs, nation.selectExpr("CAST(n_nationkey AS BIGINT) AS source_id", "CAST(0 AS BIGINT) AS frame_index")


@query(t.select(f"{LADDER_SQL}, {t.CHAIN}", RAIL_FIELDS))
def rail_ambiguity(spark, sf_dir):
    pairs, frames = _ladder(spark, sf_dir)
    return _rail_fields(rails.judge(rails.chain_nodes(pairs, frames)))


@query(t.select(LADDER_SQL, f"SELECT {FK}, CAST(coalesce(max(n), 0) AS BIGINT) AS most_pairs, coalesce(max(n), 0) > 8 AS exceeded FROM fks LEFT JOIN (SELECT {FK}, station, count(*) AS n FROM pairs GROUP BY ALL) USING ({FK}) GROUP BY ALL"))
def pair_budget_guard(spark, sf_dir):
    pairs, frames = _ladder(spark, sf_dir)
    nodes = rails.chain_nodes(pairs, frames)
    return nodes.select(*FRAME, F.col("most_pairs").cast("long").alias("most_pairs"), (F.col("most_pairs") > 8).alias("exceeded"))


@query(t.select(t.STRAIGHT, f"SELECT {FK}, CASE WHEN reason = 'PAIRED_RAISED_LINEAR_RIDGES' THEN 'AUTO_HYPOTHESIS' ELSE 'UNKNOWN' END AS status, reason, {', '.join(f"CASE WHEN reason = 'PAIRED_RAISED_LINEAR_RIDGES' THEN {v} END AS {n}" for n, v in (('supported_stations', 'held'), ('rms', 'round(rms, 6) + 0e0'), ('start_s', 'round(first_s, 6) + 0e0'), ('end_s', 'round(last_s, 6) + 0e0')))} FROM rails"))
def rail_baseline_lines(spark, sf_dir):
    return rails.detect_straight(scene(spark, sf_dir)).select(*FRAME, "status", "reason", "supported_stations", *r6("rms", "start_s", "end_s"))


@query(t.select(t.STRAIGHT, f"SELECT {FK}, {s6('s', 'lx', 'ly', 'rx', 'rz')} FROM observed"))
def rail_baseline_pairs(spark, sf_dir):
    own = axis.pair_rows(rails.detect_straight(scene(spark, sf_dir)))
    return own.select(*FRAME, "s", F.col("left.x").alias("lx"), F.col("left.y").alias("ly"), F.col("right.x").alias("rx"), F.col("right.z").alias("rz")).select(*FRAME, *r6("s", "lx", "ly", "rx", "rz"))


@query(t.select(t.AXIS, f"SELECT {FK}, seg_index, {s6('ax', 'ay', 'az', 'tx', 'ty', 'nx', 'ny', 'dz', 'length', 's0', 's1')} FROM segs"))
def axis_segments(spark, sf_dir):
    return _segments(spark, sf_dir).select(*FRAME, "seg_index", *r6("ax", "ay", "az", "tx", "ty", "nx", "ny", "dz", "length", "s0", "s1"))


@query(t.select(t.AXIS, f"SELECT {FK}, count(*) AS segments, round(sum(length), 5) AS length_2d, round(sum(sqrt(length*length + dz*dz)), 5) AS length_3d FROM segs GROUP BY ALL"))
def axis_length(spark, sf_dir):
    own = axis.path_lengths(_segments(spark, sf_dir))
    return own.groupBy(*FRAME).agg(F.count("*").alias("segments"), F.round(F.max("path_2d"), 5).alias("length_2d"), F.round(F.max("path_3d"), 5).alias("length_3d"))


@query(t.select(f"{t.OBSERVED}, {t.tangent('observed')}", f"SELECT {FK}, count(*) AS pairs, round(max(s), 6) AS end_s, round(arg_max(CAST(lx AS DOUBLE), s), 4) AS lx, round(arg_max(CAST(ry AS DOUBLE), s), 4) AS ry FROM axis_pairs GROUP BY ALL"))
def tangent_extension(spark, sf_dir):
    own = axis.extend_tangent(axis.pair_rows(_detected(spark, sf_dir)))
    return own.groupBy(*FRAME).agg(F.count("*").alias("pairs"), F.round(F.max("s"), 6).alias("end_s"), F.round(F.max_by(F.col("left.x").cast("double"), "s"), 4).alias("lx"), F.round(F.max_by(F.col("right.y").cast("double"), "s"), 4).alias("ry"))


# Pairs on circles of a radius by nation, every fifth on a line.
ARC_N = "6 + n_nationkey % 4"
ARC = {
    "radius": "4e1 + 1e1*(n_nationkey % 9)",
    "cx": "CASE WHEN n_nationkey % 5 = 0 THEN 0e0 ELSE (4e1 + 1e1*(n_nationkey % 9)) * (1e0 - cos((2e0*i) / (4e1 + 1e1*(n_nationkey % 9)))) END",
    "cy": "CASE WHEN n_nationkey % 5 = 0 THEN -2e0*i ELSE -(4e1 + 1e1*(n_nationkey % 9)) * sin((2e0*i) / (4e1 + 1e1*(n_nationkey % 9))) END",
}
ARC_ROWS = f"""SELECT CAST(n_nationkey AS BIGINT) AS source_id, CAST(0 AS BIGINT) AS frame_index, 4e0 + 2e0*i AS s, {ARC['cx']} AS cx, {ARC['cy']} AS cy, 1e-2*i AS cz"""


def _arc_pairs(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"explode(sequence(0, {ARC_N} - 1)) AS i")
    rows = spark.sql(f"{ARC_ROWS} FROM {{own}}", own=own)
    side = lambda off: F.struct((F.col("cx") + off).cast("float").alias("x"), F.col("cy").cast("float").alias("y"), F.col("cz").cast("float").alias("z"))
    return rows.select(*FRAME, "s", side(-0.8).alias("left"), side(0.8).alias("right"), F.lit(True).alias("observed"))


ARC_SQL = f"""arc AS (SELECT {FK}, s, CAST(cx - 8e-1 AS FLOAT) AS lx, CAST(cy AS FLOAT) AS ly, CAST(cz AS FLOAT) AS lz, CAST(cx + 8e-1 AS FLOAT) AS rx, CAST(cy AS FLOAT) AS ry, CAST(cz AS FLOAT) AS rz
  FROM ({ARC_ROWS} FROM nation, (SELECT unnest(range(0, 9)) AS i) WHERE i < {ARC_N})), mids AS ({t.centred('arc')})"""
ARC_THREE = f"""{ARC_SQL}, lasts AS (SELECT *, lag(cx) OVER w AS x2, lag(cy) OVER w AS y2, lag(cx, 2) OVER w AS x1, lag(cy, 2) OVER w AS y1, lag(s) OVER w AS bs, lag(lz) OVER w AS blz, lag(rz) OVER w AS brz, row_number() OVER (PARTITION BY {FK} ORDER BY s DESC) AS back FROM mids WINDOW w AS (PARTITION BY {FK} ORDER BY s)),
dets AS (SELECT *, 2e0*(CAST(x1 AS DOUBLE)*(CAST(y2 AS DOUBLE)-cy) + CAST(x2 AS DOUBLE)*(CAST(cy AS DOUBLE)-y1) + CAST(cx AS DOUBLE)*(CAST(y1 AS DOUBLE)-y2)) AS det,
  CAST(x1 AS DOUBLE)*x1 + CAST(y1 AS DOUBLE)*y1 AS a2, CAST(x2 AS DOUBLE)*x2 + CAST(y2 AS DOUBLE)*y2 AS b2, CAST(cx AS DOUBLE)*cx + CAST(cy AS DOUBLE)*cy AS c2 FROM lasts WHERE back = 1),
circ AS (SELECT *, CASE WHEN abs(det) > 1e-6 THEN (a2*(CAST(y2 AS DOUBLE)-cy) + b2*(CAST(cy AS DOUBLE)-y1) + c2*(CAST(y1 AS DOUBLE)-y2)) / det END AS ox, CASE WHEN abs(det) > 1e-6 THEN (a2*(CAST(cx AS DOUBLE)-x2) + b2*(CAST(x1 AS DOUBLE)-cx) + c2*(CAST(x2 AS DOUBLE)-x1)) / det END AS oy FROM dets),
rad AS (SELECT *, sqrt((cx-ox)*(cx-ox) + (cy-oy)*(cy-oy)) AS radius, 80e0 - s AS room FROM circ)"""


@query(t.select(ARC_THREE, f"SELECT {FK}, CASE WHEN ox IS NULL THEN 'COLLINEAR_ARC_SUPPORT' ELSE 'ARC_LIMITED_APPLIED' END AS status, round(radius, 3) AS radius, CASE WHEN ox IS NULL THEN 0e0 ELSE least(9e0, room) END AS horizon, CASE WHEN ox IS NULL THEN 0 ELSE CAST(ceil(least(9e0, room) / 2e0) AS BIGINT) END AS samples FROM rad"))
def arc_limited(spark, sf_dir):
    pairs, status = axis.extend_arc_limited(_arc_pairs(spark, sf_dir), 9.0)
    added = pairs.groupBy(*FRAME).agg(F.count_if(~F.col("observed")).alias("samples"))
    return status.join(added, FRAME).select(*FRAME, "status", F.round("radius", 3).alias("radius"), "horizon", "samples")


ARC_SAMPLES = f"""{ARC_THREE}, bent AS (SELECT *, CASE WHEN -(cy - oy) * (CAST(cx AS DOUBLE) - x2) + (cx - ox) * (CAST(cy AS DOUBLE) - y2) >= 0 THEN 1e0 ELSE -1e0 END AS turn, s - bs AS step, least(9e0, room) AS reach FROM rad WHERE ox IS NOT NULL),
spots AS (SELECT *, least(reach, i * least(step, reach)) AS far FROM (SELECT *, unnest(range(1, CAST(ceil(reach / least(step, reach)) AS BIGINT) + 1)) AS i FROM bent)), turned AS (SELECT *, turn * far / radius AS angle FROM spots)"""
_TURNED = ", ".join(
    f"round(CAST(CAST(ox + cos(angle) * ({a}x - ox) - sin(angle) * ({a}y - oy) AS FLOAT) AS DOUBLE), 4) + 0e0 AS {a}x, round(CAST(CAST(oy + sin(angle) * ({a}x - ox) + cos(angle) * ({a}y - oy) AS FLOAT) AS DOUBLE), 4) + 0e0 AS {a}y, round(CAST(CAST({a}z + CAST({a}z - b{a}z AS DOUBLE) * (far / step) AS FLOAT) AS DOUBLE), 4) + 0e0 AS {a}z"
    for a in "lr"
)


@query(t.select(ARC_SAMPLES, f"SELECT {FK}, round(s + far, 6) AS s, {_TURNED} FROM turned"))
def arc_samples(spark, sf_dir):
    added = axis.extend_arc_limited(_arc_pairs(spark, sf_dir), 9.0)[0].where("NOT observed")
    return added.select(*FRAME, F.round("s", 6).alias("s"), *((F.round(F.col(f"{side}.{a}").cast("double"), 4) + 0.0).alias(f"{side[0]}{a}") for side in ("left", "right") for a in "xyz"))


ARC_FIT = f"""{ARC_SQL}, wins AS (SELECT *, CAST(cx AS DOUBLE) AS x, CAST(cy AS DOUBLE) AS y FROM (SELECT *, row_number() OVER (PARTITION BY {FK} ORDER BY s DESC) AS back FROM mids) WHERE back <= 5),
mean AS (SELECT {FK}, avg(x) AS mx, avg(y) AS my, count(*) AS k, max(s) AS s FROM wins GROUP BY ALL),
sums AS (SELECT {FK}, any_value(k) AS k, any_value(m.s) AS s, sum((x-mx)*(x-mx)) AS suu, sum((x-mx)*(y-my)) AS suv, sum((y-my)*(y-my)) AS svv, sum((x-mx)*((x-mx)*(x-mx)+(y-my)*(y-my))) AS suq, sum((y-my)*((x-mx)*(x-mx)+(y-my)*(y-my))) AS svq FROM wins JOIN mean m USING ({FK}) GROUP BY ALL),
solved AS (SELECT *, suu*svv - suv*suv AS det FROM sums), cen AS (SELECT *, CASE WHEN det > 1e-6 THEN (suq*svv - svq*suv)/(2*det) END AS ou, CASE WHEN det > 1e-6 THEN (svq*suu - suq*suv)/(2*det) END AS ov FROM solved),
fitted AS (SELECT *, sqrt(ou*ou + ov*ov + (suu + svv)/k) AS radius, least(1e1, 80e0 - s) AS wanted FROM cen), clamp AS (SELECT *, least(wanted, radius * (8e0 * pi() / 180e0)) AS clamped FROM fitted),
named AS (SELECT *, CASE WHEN ou IS NULL OR radius < 6e1 OR clamped <= 1e-6 THEN 'ARC_CLAMPED_REJECTED' WHEN clamped + 1e-6 < wanted THEN 'ARC_CLAMPED_TO_MAX_TURN' ELSE 'ARC_CLAMPED_APPLIED' END AS status FROM clamp)"""


@query(t.select(ARC_FIT, f"SELECT {FK}, status, round(radius, 1) AS radius, CASE WHEN status = 'ARC_CLAMPED_REJECTED' THEN 0e0 ELSE round(clamped, 2) END AS horizon FROM named"))
def arc_clamped(spark, sf_dir):
    _, status = axis.extend_arc_clamped(_arc_pairs(spark, sf_dir), 10.0)
    return status.select(*FRAME, "status", F.round("radius", 1).alias("radius"), F.round("horizon", 2).alias("horizon"))


# Pairs with a fault by nation: one alone, a coordinate that isn't a number, equal stations, equal sides, equal centres.
FAULTY = """SELECT CAST(n_nationkey AS BIGINT) AS source_id, CAST(0 AS BIGINT) AS frame_index, CASE WHEN n_nationkey % 7 = 2 AND i = 3 THEN 8e0 ELSE 4e0 + 2e0*i END AS s, CAST(-8e-1 AS FLOAT) AS lx,
  CAST(CASE WHEN n_nationkey % 7 = 1 AND i = 2 THEN CAST('NaN' AS DOUBLE) WHEN n_nationkey % 7 = 4 AND i = 3 THEN -4e0 ELSE -2e0*i END AS FLOAT) AS ly, CAST(1e-2*i AS FLOAT) AS lz,
  CAST(CASE WHEN n_nationkey % 7 = 3 AND i = 1 THEN -8e-1 ELSE 8e-1 END AS FLOAT) AS rx, CAST(CASE WHEN n_nationkey % 7 = 4 AND i = 3 THEN -4e0 ELSE -2e0*i END AS FLOAT) AS ry, CAST(1e-2*i AS FLOAT) AS rz, i"""
FAULTY_KEEP = "i < CASE WHEN n_nationkey % 7 = 5 THEN 1 ELSE 5 END"


@query(t.select(f"bad AS ({FAULTY} FROM nation, (SELECT unnest(range(0, 5)) AS i) WHERE {FAULTY_KEEP}), mid AS ({t.centred('bad')}), steps AS (SELECT *, s - lag(s) OVER w AS step, sqrt(pow(CAST(cx AS DOUBLE) - lag(cx) OVER w, 2) + pow(CAST(cy AS DOUBLE) - lag(cy) OVER w, 2)) AS moved FROM mid WINDOW w AS (PARTITION BY {FK} ORDER BY s, i))",
                f"SELECT {FK}, count(*) AS n, CASE WHEN count(*) < 2 THEN 'TOO_FEW_PAIRS' WHEN bool_or(isnan(ly)) THEN 'NONFINITE_PAIRS' WHEN min(step) <= 0 THEN 'UNORDERED_PAIRS' WHEN min(abs(CAST(lx AS DOUBLE) - rx)) < 1e-6 THEN 'EQUAL_SIDES' WHEN min(moved) < 1e-6 THEN 'EQUAL_SECTIONS' END AS reason FROM steps GROUP BY ALL"))
def axis_validation(spark, sf_dir):
    own = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "explode(sequence(0, 4)) AS i").where(FAULTY_KEEP)
    rows = spark.sql(f"{FAULTY} FROM {{own}}", own=own)
    side = lambda a: F.struct(*(F.col(f"{a}{c}").alias(c) for c in "xyz"))
    return axis.validate_pairs(rows.select(*FRAME, "s", side("l").alias("left"), side("r").alias("right"), F.lit(True).alias("observed")))


@query(t.select(t.LABELS, f"SELECT {FK}, zone, count(*) AS points, CAST(sum(source_index) AS BIGINT) AS indices FROM (SELECT {FK}, source_index, CAST(zone AS INTEGER) AS zone FROM labels) GROUP BY ALL"))
def point_zone_labels(spark, sf_dir):
    return _labels(spark, sf_dir).groupBy(*FRAME, F.col("zone").cast("int").alias("zone")).agg(F.count("*").alias("points"), F.sum("source_index").alias("indices"))


@query(t.select(f"{t.LABELS}, {t.STATS}", f"SELECT {FK}, points, core, margin, outside, unknown FROM stats"))
def zone_counts(spark, sf_dir):
    return envelope.zone_stats(_labels(spark, sf_dir)).select(*FRAME, "points", "core", "margin", "outside", "unknown")


@query(t.select(f"{t.LABELS}, {t.STATS}", f"SELECT {FK}, core_i AS core_index, round(core_d, 6) AS core_distance, margin_i AS margin_index, round(margin_d, 6) AS margin_distance FROM stats"))
def nearest_points(spark, sf_dir):
    own = envelope.zone_stats(_labels(spark, sf_dir))
    return own.select(*FRAME, F.col("nearest_core_source_index").alias("core_index"), F.round("nearest_core_distance", 6).alias("core_distance"), F.col("nearest_margin_source_index").alias("margin_index"), F.round("nearest_margin_distance", 6).alias("margin_distance"))


@query(t.select(f"{t.AXIS}, {t.PLACES}, best AS (SELECT {FK}, source_index, min(z) AS zone FROM zoned GROUP BY ALL)", f"SELECT {FK}, CAST(coalesce(zone, 0) AS INTEGER) AS zone, count(*) AS points FROM t LEFT JOIN best USING ({FK}, source_index) GROUP BY ALL"))
def zone_priority_best(spark, sf_dir):
    own = envelope.label(scene(spark, sf_dir), _segments(spark, sf_dir), priority="best")
    return own.groupBy(*FRAME, F.col("zone").cast("int").alias("zone")).agg(F.count("*").alias("points"))


@query(t.select(f"{t.AXIS}, {t.PLACES}, best AS (SELECT {FK}, source_index, min(z) AS zone FROM zoned GROUP BY ALL)", f"SELECT {FK}, count(*) AS points FROM t LEFT JOIN best USING ({FK}, source_index) WHERE zone IS NULL OR zone < 3 GROUP BY ALL"))
def crop_envelope(spark, sf_dir):
    return envelope.crop(scene(spark, sf_dir), _segments(spark, sf_dir), EXPANDED).groupBy(*FRAME).agg(F.count("*").alias("points"))


@query(t.select(t.LABELS, f"SELECT {FK}, source_index FROM labels WHERE zone = 1"))
def select_zone_points(spark, sf_dir):
    return quality.select_zone(_labels(spark, sf_dir), 1).select(*FRAME, "source_index")


def _place(station: str, lateral: str, height: str, name: str) -> str:
    """SQL of the three coordinates of a place on a segment."""
    made = (f"ax + tx * {station} + nx * {lateral}", f"ay + ty * {station} + ny * {lateral}", f"az + dz * {station} / length + {height}")
    return ", ".join(f"round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 4) + 0e0 AS {name}{a}" for a, v in zip("xyz", made))


def _spot(column: str, name: str) -> list[Column]:
    return [(F.round(F.col(f"{column}.{a}").cast("double"), 4) + 0.0).alias(f"{name}{a}") for a in "xyz"]


_EDGES = [(e, i, e, (i + 1) % 4) for e in (0, 1) for i in range(4)] + [(0, i, 1, i) for i in range(4)]
_CORNERS = "[-14e-1, 14e-1, 14e-1, -14e-1]", "[0e0, 0e0, 37e-1, 37e-1]"
WIRES = f"{t.AXIS}, edge_ends(edge, e1, c1, e2, c2) AS (VALUES {', '.join(str((n, a, i + 1, b, j + 1)) for n, (a, i, b, j) in enumerate(_EDGES))})"


@query(t.select(WIRES, f"SELECT {FK}, seg_index, CAST(edge AS BIGINT) AS edge, {_place('(e1 * length)', f'({_CORNERS[0]})[c1]', f'({_CORNERS[1]})[c1]', 'start_')}, {_place('(e2 * length)', f'({_CORNERS[0]})[c2]', f'({_CORNERS[1]})[c2]', 'end_')} FROM segs, edge_ends"))
def envelope_wireframe(spark, sf_dir):
    return axis.wireframe(_segments(spark, sf_dir), CORE).select(*FRAME, "seg_index", "edge", *_spot("start", "start_"), *_spot("finish", "end_"))


RINGS = f"{t.AXIS}, sections AS (SELECT unnest(range(0, 21)) AS section), corners(corner, side_m, up) AS (VALUES (0, -19e-1, -5e-1), (1, 19e-1, -5e-1), (2, 19e-1, 42e-1), (3, -19e-1, 42e-1))"


@query(t.select(RINGS, f"SELECT {FK}, seg_index, CAST(section AS BIGINT) AS section, CAST(corner AS BIGINT) AS corner, {_place('(length * section / 2e1)', 'side_m', 'up', '')} FROM segs, sections, corners"))
def envelope_rings(spark, sf_dir):
    return axis.rings(_segments(spark, sf_dir), EXPANDED).select(*FRAME, "seg_index", "section", "corner", *_spot("point", ""))


@query(t.select(f"{t.AXIS}, {t.PLACES}", f"SELECT {FK}, seg_index, count(*) AS points, round(sum(side_m), 3) + 0e0 AS lateral, round(sum(height), 3) + 0e0 AS height FROM places GROUP BY ALL"))
def segment_local(spark, sf_dir):
    points = scene(spark, sf_dir).withColumn("at", F.struct("x", "y", "z")).select(*FRAME, "at")
    segs = _segments(spark, sf_dir).withColumnsRenamed({"source_id": "sid", "frame_index": "fid"})
    met = points.join(segs, (F.col("source_id") == F.col("sid")) & (F.col("frame_index") == F.col("fid")))
    station, lateral, height = axis.local(F.col("at"))
    inside = met.where((station >= -1e-6) & (station <= F.col("length") + 1e-6))
    return inside.groupBy(*FRAME, "seg_index").agg(F.count("*").alias("points"), (F.round(F.sum(lateral), 3) + 0.0).alias("lateral"), (F.round(F.sum(height), 3) + 0.0).alias("height"))


@query(t.select(t.COMPONENTS, f"SELECT {FK}, source_index, component FROM members", True))
def connected_components(spark, sf_dir):
    return cluster.components(_core(spark, sf_dir))


@query(t.select(t.COMPONENTS, f"SELECT {FK}, source_index, component FROM members", True))
def connected_components_native(spark, sf_dir):
    return cluster.components_native(_core(spark, sf_dir))


SHAPE = ("ex", "ey", "ez", "cx", "cy", "cz", "nearest")


@query(t.select(t.SHAPES, f"SELECT {FK}, component, n, {s6(*SHAPE)} FROM shapes", True))
def component_shape(spark, sf_dir):
    return decide.shapes(_members(spark, sf_dir)).select(*decide.COMPONENT, "n", *r6(*SHAPE))


@query(t.select(t.FEATURES, f"SELECT {FK}, component, {', '.join(f'round(f{i}, 4) AS f{i}' for i in range(8))} FROM features", True))
def component_features(spark, sf_dir):
    return decide.features(decide.shapes(_members(spark, sf_dir))).select(*decide.COMPONENT, *(F.round(f, 4).alias(f) for f in decide.FEATURES))


@query(t.select(t.DECIDED, f"SELECT {FK}, component, n, boundary, early, round(score, 6) AS score, decision FROM decided", True))
def decision_cascade(spark, sf_dir):
    return decide.decide(decide.shapes(_members(spark, sf_dir))).select(*decide.COMPONENT, "n", "boundary", "early", F.round("score", 6).alias("score"), "decision")


@query(t.select(t.FEATURES, f"SELECT {FK}, component, round({t.FOREST}, 6) AS score, {t.FOREST} >= {t.number(t.THRESHOLD)} AS reportable FROM features", True))
def assist_filter(spark, sf_dir):
    return decide.assist_only(decide.shapes(_members(spark, sf_dir))).select(*decide.COMPONENT, F.round("score", 6).alias("score"), "reportable")


AXIS_STATS = f"""{t.COMPONENTS}, spots AS (SELECT m.*, g.seg_index, s0, s1, length, greatest(0e0, least((x - ax)*tx + (y - ay)*ty, length)) AS st, ax, ay, az, tx, ty, dz FROM members m JOIN segs g USING ({FK})),
far AS (SELECT {FK}, source_index, component, seg_index, s0 + st/length*(s1 - s0) AS s, sqrt((x - CAST(ax + tx*st AS FLOAT))*(x - CAST(ax + tx*st AS FLOAT)) + (y - CAST(ay + ty*st AS FLOAT))*(y - CAST(ay + ty*st AS FLOAT)) + (z - CAST(az + dz*(st/length) AS FLOAT))*(z - CAST(az + dz*(st/length) AS FLOAT))) AS dist FROM spots),
closest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {FK}, source_index ORDER BY dist, seg_index) AS rn FROM far) WHERE rn = 1),
astats AS (SELECT {FK}, component, count(*) AS n, max(s) - min(s) AS span, avg(dist) AS mean_distance, min(s) AS near_s FROM closest GROUP BY ALL)"""


@query(t.select(AXIS_STATS, f"SELECT {FK}, component, n, {s6('span', 'mean_distance', 'near_s')}, n >= 22 AND span <= 1e0 AND mean_distance <= 12e-1 AS reportable FROM astats", True))
def legacy_noise_filter(spark, sf_dir):
    segs = _segments(spark, sf_dir)
    own = envelope.project(_members(spark, sf_dir), segs)
    return decide.legacy_filter(decide.axis_stats(own)).select(*decide.COMPONENT, "n", *r6("span", "mean_distance", "near_s"), "reportable")


def _result(spark, sf_dir) -> DataFrame:
    return pipeline.Pipeline(Config()).run(scene(spark, sf_dir))


@query(t.select(t.FLAGS, f"SELECT {FK}, evaluated, core, margin, outside, unknown, components, geometry_obstacle, model_assist, boundary_warning, early_points, geometry, model, early, boundary FROM tri", True))
def frame_flags(spark, sf_dir):
    return _result(spark, sf_dir).select(*FRAME, "evaluated", "core", "margin", "outside", "unknown", "components", "geometry_obstacle", "model_assist", "boundary_warning", "early_points", "geometry", "model", "early", "boundary")


@query(t.select(t.PUBLIC, f"SELECT {FK}, core, margin, outside, unknown, model_streak, early_streak, intrusion, public_points, noise_points, round(public_nearest, 6) AS public_nearest, status, reason, 'UNKNOWN' AS system_status FROM public", True))
def public_decision_status(spark, sf_dir):
    return _result(spark, sf_dir).select(*FRAME, "core", "margin", "outside", "unknown", "model_streak", "early_streak", "intrusion", "public_points", "noise_points", *r6("public_nearest"), "status", "reason", "system_status")


JSON_FIELDS = {"status": "string", "reason": "string", "core": "bigint", "margin": "bigint", "intrusion": "boolean", "model_streak": "bigint", "public_points": "bigint", "noise_points": "bigint"}


@query(t.select(t.PUBLIC, f"SELECT {FK}, {', '.join(JSON_FIELDS)} FROM public", True))
def json_result_roundtrip(spark, sf_dir):
    documents = pipeline.to_json(_result(spark, sf_dir))
    return documents.select(*FRAME, *(F.get_json_object("json", f"$.{n}").cast(kind).alias(n) for n, kind in JSON_FIELDS.items()))


MODE_FIELDS = ("core", "margin", "model_streak", "intrusion", "public_points", "noise_points", "public_nearest", "status", "reason")


def _mode(spark, sf_dir, **options) -> DataFrame:
    result = pipeline.Pipeline(Config(**options)).run(scene(spark, sf_dir))
    return result.select(*FRAME, *(r6(c)[0] if c == "public_nearest" else F.col(c) for c in MODE_FIELDS))


_MODE_SQL = f"SELECT {FK}, {', '.join(s6(c) if c == 'public_nearest' else c for c in MODE_FIELDS)} FROM public"


@query(t.select(f"{AXIS_STATS}, {t.STATS}, {t.SHAPES[len(t.COMPONENTS) + 2:]}, {t.alternative(f'SELECT {FK}, component, a.n, nearest, a.n >= 22 AND span <= 1e0 AND mean_distance <= 12e-1 AS reportable FROM astats a JOIN shapes USING ({FK}, component)', 1)}", _MODE_SQL, True))
def public_legacy_status(spark, sf_dir):
    return _mode(spark, sf_dir, noise_filter="legacy")


@query(t.select(f"{t.FEATURES}, {t.STATS}, {t.alternative(f'SELECT {FK}, component, n, nearest, {t.FOREST} >= {t.number(t.THRESHOLD)} AS reportable FROM features', 2)}", _MODE_SQL, True))
def public_assist_status(spark, sf_dir):
    return _mode(spark, sf_dir, noise_filter="baseline_v3_assist_score")


@query(t.select(f"{t.LABELS.replace(t.OBSERVED, t.STRAIGHT, 1)}, {t.STATS}", f"SELECT {FK}, reason = 'PAIRED_RAISED_LINEAR_RIDGES' AS evaluated, core, margin, outside, unknown FROM rails JOIN stats USING ({FK})"))
def baseline_method_zones(spark, sf_dir):
    return pipeline.Pipeline(Config(rail_method="baseline")).run(scene(spark, sf_dir)).select(*FRAME, "evaluated", "core", "margin", "outside", "unknown")


STAMPED = f"""{t.FLAGS}, stamped AS (SELECT *, CAST(floor(frame_index * 2 / 3e0) AS BIGINT) AS header_ns FROM tri), seen AS (SELECT *, coalesce(lag(header_ns) OVER (PARTITION BY source_id ORDER BY frame_index) = header_ns, FALSE) AS again FROM stamped),
fresh AS (SELECT * FROM seen WHERE NOT again), {t.confirmed('fresh', 'firsts')}, carried AS (SELECT s.*, f.model_streak, f.early_streak, f.model_confirmed, f.early_confirmed FROM seen s ASOF JOIN firsts f ON s.source_id = f.source_id AND s.frame_index >= f.frame_index)"""


@query(t.select(STAMPED, f"SELECT {FK}, header_ns, model_streak, early_streak, CASE WHEN evaluated THEN geometry OR model_confirmed OR early_confirmed END AS intrusion FROM carried", True))
def repeated_stamps_run(spark, sf_dir):
    points = scene(spark, sf_dir)
    stamps = points.select(*FRAME).distinct().withColumn("header_ns", F.floor(F.col("frame_index") * 2 / F.lit(3.0)))
    return pipeline.Pipeline().run(points, stamps).select(*FRAME, "header_ns", "model_streak", "early_streak", "intrusion")


_REPORT = "decision IN ('geometry_obstacle', 'model_assist')"
INDICES = f"""{t.PUBLIC}, marks AS (SELECT {FK}, source_index, {_REPORT} AS rep, early AS fore, ep FROM members JOIN decided d USING ({FK}, component) JOIN (SELECT {FK}, ep FROM sure) USING ({FK})),
lists AS (SELECT {FK}, string_agg(source_index, ',' ORDER BY source_index) FILTER (rep) AS reportable, string_agg(source_index, ',' ORDER BY source_index) FILTER (fore) AS early, string_agg(source_index, ',' ORDER BY source_index) FILTER (NOT rep AND NOT (ep AND fore)) AS noise,
  string_agg(source_index, ',' ORDER BY source_index) FILTER (CASE WHEN ep THEN fore ELSE rep END) AS public FROM marks GROUP BY ALL)"""


@query(t.select(INDICES, f"SELECT {FK}, {', '.join(f'coalesce({c}, {chr(39) * 2}) AS {c}' for c in ('reportable', 'early', 'noise', 'public'))} FROM fks LEFT JOIN lists USING ({FK})", True))
def public_index_sets(spark, sf_dir):
    result = pipeline.Pipeline(Config(detail="full")).run(scene(spark, sf_dir))
    return result.select(*FRAME, *(F.array_join(name, ",").alias(flag) for name, flag in temporal.INDEX_SETS.items()))


NEIGHBOURS = f"""{AXIS_STATS}, {t.SHAPES[len(t.COMPONENTS) + 2:]}, whole AS MATERIALIZED (SELECT s.*, near_s, mean_distance FROM shapes s JOIN astats USING ({FK}, component)),
matched AS (SELECT a.source_id, a.frame_index, a.component, count(DISTINCT b.frame_index) AS seen FROM whole a JOIN whole b ON a.source_id = b.source_id AND abs(a.frame_index - b.frame_index) = 1
  WHERE (abs(a.near_s - b.near_s) <= 2e0 AND abs(a.mean_distance - b.mean_distance) <= 75e-2) OR (a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz) <= 1e0 GROUP BY ALL),
certain AS (SELECT w.*, CAST(1 + coalesce(seen, 0) AS BIGINT) AS confirmations FROM whole w LEFT JOIN matched USING ({FK}, component))"""


def _confirmations(spark, sf_dir) -> DataFrame:
    own = materialize(_members(spark, sf_dir), "members")
    stats = decide.axis_stats(envelope.project(own, _segments(spark, sf_dir))).drop("n")
    return viewer.neighbour_confirmations(decide.shapes(own).join(stats, decide.COMPONENT))


@query(t.select(NEIGHBOURS, f"SELECT {FK}, component, confirmations FROM certain", True))
def neighbor_frame_confirmation(spark, sf_dir):
    return _confirmations(spark, sf_dir).select(*decide.COMPONENT, F.col("confirmations").cast("long").alias("confirmations"))


@query(t.select(NEIGHBOURS, f"SELECT {FK}, component, near_s <= 2e1 AS near, CASE WHEN near_s <= 2e1 THEN FALSE ELSE confirmations >= 2 END AS shown FROM certain", True))
def near_zone_rule(spark, sf_dir):
    shown = viewer.near_zone(_confirmations(spark, sf_dir), moving=True, required=2, near_m=20.0)
    return shown.select(*decide.COMPONENT, (F.col("near_s") <= 20.0).alias("near"), "shown")


FLOOR = f"""{t.T}, fbin AS (SELECT {FK}, CAST(floor(-CAST(y AS DOUBLE) / 1e1) AS BIGINT) AS bin, CAST(z AS DOUBLE) AS z FROM t WHERE -CAST(y AS DOUBLE) >= 0 AND -CAST(y AS DOUBLE) < 6e1 AND abs(CAST(x AS DOUBLE)) <= 18e-1),
fq AS (SELECT {FK}, bin, quantile_cont(z, 0.1) AS q, (bin*1e1 + least((bin+1)*1e1, 6e1)) / 2e0 AS pos FROM fbin GROUP BY ALL HAVING count(*) >= 200),
fm AS (SELECT *, avg(pos) OVER w AS ms, avg(q) OVER w AS mq FROM fq WINDOW w AS (PARTITION BY {FK})),
ff AS (SELECT {FK}, count(*) AS samples, sum((pos-ms)*(q-mq)) / sum((pos-ms)*(pos-ms)) AS grade, any_value(mq) AS mq, any_value(ms) AS ms FROM fm GROUP BY ALL),
fi AS (SELECT *, mq - grade*ms AS intercept FROM ff), fr2 AS (SELECT {FK}, max(abs(q - intercept - grade*pos)) AS residual FROM fq JOIN fi USING ({FK}) GROUP BY ALL),
ground AS (SELECT DISTINCT t.source_id, t.frame_index, coalesce(samples, 0) AS samples, grade, intercept, residual, CASE WHEN coalesce(samples, 0) < 4 THEN 'INSUFFICIENT_FLOOR_SUPPORT' WHEN abs(grade) > 1e-1 OR residual > 4e-1 THEN 'FLOOR_FIT_REJECTED' END AS reason FROM t LEFT JOIN fi USING ({FK}) LEFT JOIN fr2 USING ({FK}))"""


@query(t.select(FLOOR, f"SELECT {FK}, samples, {s6('grade', 'intercept', 'residual')}, reason FROM ground"))
def floor_fit(spark, sf_dir):
    return objects.floor_fit(scene(spark, sf_dir)).select(*FRAME, "samples", *r6("grade", "intercept", "residual"), "reason")


OBJECTS = f"""{FLOOR}, above AS (SELECT {FK}, source_index, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, -CAST(y AS DOUBLE) AS s, CAST(z AS DOUBLE) - intercept - grade*(-CAST(y AS DOUBLE)) AS h FROM t JOIN ground USING ({FK}) WHERE reason IS NULL),
chosen AS MATERIALIZED (SELECT *, CAST(floor(x/2e-1) AS BIGINT) AS vx, CAST(floor(y/2e-1) AS BIGINT) AS vy, CAST(floor(z/2e-1) AS BIGINT) AS vz FROM above WHERE s BETWEEN 0e0 AND 2e2 AND abs(x) <= 19e-1 AND h BETWEEN 35e-2 AND 28e-1),
vox AS MATERIALIZED (SELECT {FK}, vx, vy, vz, min(source_index) AS node FROM chosen GROUP BY ALL),
vedges AS MATERIALIZED (SELECT a.source_id, a.frame_index, a.node AS a, b.node AS b FROM vox a JOIN vox b USING ({FK}) WHERE a.node <> b.node AND abs(a.vx-b.vx) <= 1 AND abs(a.vy-b.vy) <= 1 AND abs(a.vz-b.vz) <= 1),
{t.reach('vox', 'vedges')}, grouped AS (SELECT c.*, label AS component FROM chosen c JOIN vox USING ({FK}, vx, vy, vz) JOIN cc USING ({FK}, node)),
obox AS (SELECT {FK}, component, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, min(sqrt(x*x+y*y+z*z)) AS nearest FROM grouped GROUP BY ALL)"""


@query(t.select(OBJECTS, f"SELECT {FK}, source_index, component FROM grouped", True))
def voxel_components(spark, sf_dir):
    points = scene(spark, sf_dir)
    chosen = objects.above_floor(points, objects.floor_fit(points))
    return cluster.voxel_groups(chosen, Objects().voxel).select(*FRAME, "source_index", "component")


@query(t.select(OBJECTS, f"SELECT {FK}, CAST(row_number() OVER (PARTITION BY {FK} ORDER BY nearest, component) - 1 AS BIGINT) AS object_id, n, {s6('min_x', 'max_x', 'min_z', 'nearest')}, min_x <= -19e-1 + 2e-1 OR max_x >= 19e-1 - 2e-1 OR -max_y <= 2e-1 OR -min_y >= 2e2 - 2e-1 AS possibly_roi_clipped FROM obox WHERE n >= 5 AND greatest(max_x - min_x, max_y - min_y) <= 3e0", True))
def object_candidates(spark, sf_dir):
    found, _ = objects.object_candidates(scene(spark, sf_dir))
    return found.select(*FRAME, "object_id", "n", *r6("min_x", "max_x", "min_z", "nearest"), "possibly_roi_clipped")


@query(t.select(OBJECTS, f"""SELECT {FK}, CASE WHEN coalesce(objects, 0) > 0 AND reason IS NULL THEN 'OBJECT_CANDIDATES' ELSE 'UNKNOWN' END AS status, coalesce(reason, CASE WHEN coalesce(objects, 0) > 0 THEN 'SUPPLEMENTAL_PROPOSALS_NOT_PERSON_CLASSIFICATION' ELSE 'NO_PROPOSALS_NOT_CLEAR' END) AS reason, CAST(coalesce(selected, 0) AS BIGINT) AS selected, CAST(coalesce(objects, 0) AS BIGINT) AS objects
  FROM ground LEFT JOIN (SELECT {FK}, sum(n) AS selected, count(*) FILTER (n >= 5 AND greatest(max_x - min_x, max_y - min_y) <= 3e0) AS objects FROM obox GROUP BY ALL) USING ({FK})""", True))  # fmt: skip
def object_status(spark, sf_dir):
    _, status = objects.object_candidates(scene(spark, sf_dir))
    return status.select(*FRAME, "status", "reason", "selected", "objects")


@query(t.select(f"{t.AXIS}, {t.PLACES}, {t.FIRST}, {OBJECTS[len(t.T) + 2:]}", f"""SELECT {FK}, g.component, CASE WHEN count(*) FILTER (zone = 1) > 0 THEN 'CORE_INTERSECTION' WHEN count(*) FILTER (zone = 2) > 0 THEN 'MARGIN_INTERSECTION' WHEN count(*) FILTER (zone = 0) > 0 THEN 'UNKNOWN' ELSE 'OBSERVED_RETURNS_OUTSIDE' END AS status,
  count(*) FILTER (zone = 1) AS core, count(*) FILTER (zone = 0) AS unknown, round(count(*) FILTER (zone = 1) / CAST(count(*) AS DOUBLE), 6) AS inside_ratio FROM grouped g JOIN labels USING ({FK}, source_index) GROUP BY ALL""", True))  # fmt: skip
def component_assessment(spark, sf_dir):
    points = scene(spark, sf_dir)
    chosen = objects.above_floor(points, objects.floor_fit(points))
    groups = cluster.voxel_groups(chosen, Objects().voxel)
    return objects.assess(groups, _labels(spark, sf_dir)).select(*FRAME, "component", "status", "core", "unknown", *r6("inside_ratio"))


@query(t.select(OBJECTS, f"""SELECT {FK}, CASE WHEN reason IS NOT NULL THEN reason WHEN coalesce(voxels, 0) > 60 THEN 'VOXEL_BUDGET_EXCEEDED' WHEN coalesce(objects, 0) > 0 THEN 'SUPPLEMENTAL_PROPOSALS_NOT_PERSON_CLASSIFICATION' ELSE 'NO_PROPOSALS_NOT_CLEAR' END AS reason, CASE WHEN coalesce(voxels, 0) > 60 THEN 0 ELSE CAST(coalesce(objects, 0) AS BIGINT) END AS objects
  FROM ground LEFT JOIN (SELECT {FK}, count(*) AS voxels FROM vox GROUP BY ALL) USING ({FK}) LEFT JOIN (SELECT {FK}, count(*) FILTER (n >= 5 AND greatest(max_x - min_x, max_y - min_y) <= 3e0) AS objects FROM obox GROUP BY ALL) USING ({FK})""", True))  # fmt: skip
def object_budget(spark, sf_dir):
    found, status = objects.object_candidates(scene(spark, sf_dir), Objects(max_voxels=60))
    held = found.groupBy(*FRAME).agg(F.count("*").alias("objects"))
    return status.drop("objects").join(held, FRAME, "left").select(*FRAME, "reason", F.coalesce("objects", F.lit(0)).cast("long").alias("objects"))


#: Labels written once: the plan is poor where they are worked out again below the recursion.
LABELS_ONCE = t.LABELS.replace("labels AS (", "labels AS MATERIALIZED (")
ANCHORS = f"""SELECT source_id, frame_index, 'a' AS event_id, CAST(x AS DOUBLE) + 5e-7 AS ax, CAST(y AS DOUBLE) AS ay, CAST(z AS DOUBLE) AS az FROM {{0}} WHERE source_index = 7000 + frame_index
UNION ALL SELECT source_id, frame_index, 'b' AS event_id, CAST(x AS DOUBLE) + 5e-3 AS ax, CAST(y AS DOUBLE) AS ay, CAST(z AS DOUBLE) AS az FROM {{0}} WHERE source_index = 40"""


@query(t.select(f"{LABELS_ONCE}, anchors AS ({ANCHORS.format('t')}), hits AS (SELECT {FK}, event_id, arg_min(zone, source_index) AS zone, min(source_index) AS source_index FROM anchors JOIN labels USING ({FK}) WHERE abs(CAST(x AS DOUBLE) - ax) <= 1e-6 AND abs(CAST(y AS DOUBLE) - ay) <= 1e-6 AND abs(CAST(z AS DOUBLE) - az) <= 1e-6 GROUP BY ALL)",
                f"SELECT {FK}, event_id, h.source_index, CASE WHEN h.source_index IS NULL THEN 'SOURCE_POINT_NOT_FOUND' WHEN zone = 1 THEN 'CORE' WHEN zone = 2 THEN 'MARGIN' WHEN zone = 3 THEN 'OBSERVED_OUTSIDE_GABARIT' ELSE 'UNKNOWN' END AS membership FROM anchors LEFT JOIN hits h USING ({FK}, event_id)"))
def anchor_membership(spark, sf_dir):
    anchors = spark.sql(ANCHORS.format("{points}"), points=scene(spark, sf_dir))
    return objects.anchor_membership(anchors, _labels(spark, sf_dir))


LIVE = f"""{LABELS_ONCE}, {t.STATS}, cand AS (SELECT {FK}, source_index, zone, d, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(floor(CAST(x AS DOUBLE)/25e-2) AS BIGINT) AS vx, CAST(floor(CAST(y AS DOUBLE)/25e-2) AS BIGINT) AS vy, CAST(floor(CAST(z AS DOUBLE)/25e-2) AS BIGINT) AS vz FROM labels WHERE zone IN (1, 2)),
vox AS MATERIALIZED (SELECT {FK}, zone, vx, vy, vz, min(source_index) AS node, count(*) AS n, min({{'d': d, 'i': source_index}}) AS near, min(x) AS min_x, max(y) AS max_y, max(z) AS max_z FROM cand GROUP BY ALL),
placed AS (SELECT *, vx - row_number() OVER (PARTITION BY {FK}, zone, vy, vz ORDER BY vx) AS g FROM vox),
rods AS MATERIALIZED (SELECT {FK}, zone, vy, vz, g, min(vx) AS low, max(vx) AS high, min(node) AS node, sum(n) AS n, min(near) AS near, min(min_x) AS min_x, max(max_y) AS max_y, max(max_z) AS max_z FROM placed GROUP BY ALL),
vedges AS MATERIALIZED (SELECT a.source_id, a.frame_index, a.node AS a, b.node AS b FROM rods a JOIN rods b USING ({FK}, zone) WHERE a.node <> b.node AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1 AND a.low <= b.high + 1 AND b.low <= a.high + 1),
{t.reach('rods', 'vedges')}, groups AS (SELECT {FK}, zone, label, CAST(sum(n) AS BIGINT) AS n, min(near) AS near, min(min_x) AS min_x, max(max_y) AS max_y, max(max_z) AS max_z FROM rods JOIN cc USING ({FK}, node) GROUP BY ALL)"""


@query(t.select(LIVE, f"""SELECT {FK}, CASE WHEN core > 0 THEN 'OBSERVED_CORE_INTRUSION_CANDIDATE' WHEN margin > 0 THEN 'OBSERVED_MARGIN_RETURN' ELSE 'UNKNOWN' END AS status, core > 0 AS intrusion_candidate_present, core, margin, clusters, ungrouped
  FROM (SELECT {FK}, CAST(sum(core) AS BIGINT) AS core, CAST(sum(margin) AS BIGINT) AS margin, CAST(sum(clusters) AS BIGINT) AS clusters, CAST(sum(ungrouped) AS BIGINT) AS ungrouped FROM (SELECT {FK}, core, margin, 0 AS clusters, 0 AS ungrouped FROM stats
    UNION ALL SELECT {FK}, 0, 0, CASE WHEN n >= 5 THEN 1 ELSE 0 END, CASE WHEN n < 5 THEN n ELSE 0 END FROM groups) GROUP BY ALL)""", True))  # fmt: skip
def live_envelope(spark, sf_dir):
    labels = materialize(_labels(spark, sf_dir), "labels")
    groups = cluster.voxel_groups(labels.where("zone IN (1, 2)"), 0.25, "zone")
    return envelope.live_envelope(labels, groups).select(*FRAME, "status", "intrusion_candidate_present", "core", "margin", "clusters", "ungrouped")


#: LIVE with the chains of every frame: stations of any number of pairs are searched.
LIVE_WHOLE = LIVE.replace(" AND most_pairs <= 8", "").replace(" WHEN most_pairs > 8 THEN 'SEARCH_BUDGET_EXCEEDED'", "")


@query(t.select(LIVE_WHOLE, f"SELECT {FK}, CAST(row_number() OVER (PARTITION BY {FK} ORDER BY near, zone, label) - 1 AS BIGINT) AS cluster_id, CASE WHEN zone = 1 THEN 'CORE' ELSE 'MARGIN' END AS zone, n, near.i AS nearest_index, round(near.d, 6) + 0e0 AS nearest, {s6('min_x', 'max_y', 'max_z')} FROM groups WHERE n >= 5", True))
def live_clusters(spark, sf_dir):
    # labels stay dealt by frame as the scene is, so that their groups are found where they are
    near = _labels(spark, sf_dir, Rails(max_pairs_per_station=None)).where("zone IN (1, 2)")
    groups = cluster.voxel_groups(near, 0.25, "zone", places=True)
    return envelope.live_clusters(None, groups, max_voxels=None).select(*FRAME, "cluster_id", "zone", "n", "nearest_index", *r6("nearest", "min_x", "max_y", "max_z"))


@query(t.select(t.OBSERVED, f"SELECT {FK}, CAST(i AS BIGINT) AS pair_index, s FROM (SELECT *, row_number() OVER (PARTITION BY {FK} ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY {FK}) AS n FROM observed) WHERE i % CAST(ceil(n / 8e0) AS BIGINT) = 0 OR i = n - 1"))
def axis_label_stride(spark, sf_dir):
    return viewer.label_stride(axis.pair_rows(_detected(spark, sf_dir)))


@query(t.select(f"{t.OBSERVED}, {t.AXIS[len(t.OBSERVED) + 2:]}, {t.PLACES}, {t.FIRST}, {t.STATS}", f"SELECT {FK}, round(core_d, 6) AS distance_m, s FROM (SELECT {FK}, core_d, s, row_number() OVER (PARTITION BY {FK} ORDER BY abs(o.s - core_d), o.s) AS rn FROM observed o JOIN stats USING ({FK}) WHERE core_d IS NOT NULL) WHERE rn = 1"))
def nearest_pair_label(spark, sf_dir):
    detected = materialize(_detected(spark, sf_dir), "detected")
    segs = pipeline.Pipeline().segments(detected)
    far = envelope.zone_stats(envelope.label(scene(spark, sf_dir), segs)).where("nearest_core_distance IS NOT NULL").select(*FRAME, F.col("nearest_core_distance").alias("distance_m"))
    return viewer.nearest_pair(axis.pair_rows(detected), far).select(*FRAME, *r6("distance_m"), "s")


@query(t.select(t.PUBLIC, "SELECT source_id, count(*) AS frames, CAST(min(frame_index) AS BIGINT) AS first_frame, CAST(max(frame_index) AS BIGINT) AS last_frame FROM fks GROUP BY ALL", True))
def source_manifest(spark, sf_dir):
    return pipeline.manifest(scene(spark, sf_dir).select(*FRAME).distinct())


@query(t.select(t.PUBLIC, f"SELECT {FK}, CASE WHEN source_id % 2 = 0 AND coalesce(intrusion, FALSE) THEN 'FALSE_ALARM' ELSE status END AS status FROM public", True))
def relabel_known_empty(spark, sf_dir):
    result = _result(spark, sf_dir)
    return viewer.relabel_empty(result, result.where("source_id % 2 = 0")).select(*FRAME, "status")


@query(t.select(t.PUBLIC, f"SELECT {FK}, CASE WHEN model IS NULL THEN 'RESET_UNKNOWN' WHEN model_streak >= 2 THEN 'APPLIED_CONFIRMED' WHEN model THEN 'APPLIED_WAITING_FOR_CONSECUTIVE_FRAME' ELSE 'APPLIED_NO_CURRENT_MODEL_ALARM' END AS model_status FROM public", True))
def temporal_status_names(spark, sf_dir):
    return _result(spark, sf_dir).select(*FRAME, temporal.status_of_streak("model", 2).alias("model_status"))
