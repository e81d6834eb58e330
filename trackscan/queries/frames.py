"""Queries over point buffers of the embeddings table: codecs, quality, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackscan.config import FRAME
from trackscan.fixtures import table, vector_points, vector_points_sql
from trackscan.functions.exprs import distance, header_ns
from trackscan.operators import cluster, quality
from trackscan.queries import twins as t
from trackscan.queries.registry import query
from trackscan.queries.scene import r6
from trackscan.sources import codecs

FK = t.FK
M = vector_points_sql()
OK = "isfinite(x) AND isfinite(y) AND isfinite(z)"
ZERO = "x = 0 AND y = 0 AND z = 0"
D = "sqrt(x*x + y*y + z*z)"


def _buffers(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS source_id", "CAST(0 AS BIGINT) AS frame_index", "embedding")


@query("SELECT vec_id AS source_id, CAST(0 AS BIGINT) AS frame_index, CAST(i AS BIGINT) AS source_index, round(CAST(embedding[3*i+1] AS DOUBLE), 6) AS x, round(CAST(embedding[3*i+2] AS DOUBLE), 6) AS y, round(CAST(embedding[3*i+3] AS DOUBLE), 6) AS z FROM (SELECT *, unnest(range(0, CAST(len(embedding) // 3 AS BIGINT))) AS i FROM embeddings)")
def decode_packed_xyz(spark, sf_dir):
    return codecs.decode_packed(_buffers(spark, sf_dir), "embedding").select(*FRAME, "source_index", *r6("x", "y", "z"))


@query("SELECT vec_id AS source_id, CAST(0 AS BIGINT) AS frame_index, CAST(len(embedding) % 3 AS BIGINT) AS left_over, CASE WHEN len(embedding) % 3 <> 0 THEN 'INVALID_LENGTH' END AS reason FROM embeddings")
def xyzf_invalid_length(spark, sf_dir):
    return codecs.packed_remainder(_buffers(spark, sf_dir), "embedding")


@query(f"WITH {M} SELECT {FK}, count(*) AS points, round(sum(CAST(CAST(x AS FLOAT) AS DOUBLE)), 3) + 0e0 AS sum_x FROM m WHERE {OK} AND NOT ({ZERO}) GROUP BY ALL")
def pointcloud2_round_trip(spark, sf_dir):
    sound = quality.usable(vector_points(spark, sf_dir))
    again = codecs.decode_pointcloud2(codecs.encode_pointcloud2(sound))
    return again.groupBy(*FRAME).agg(F.count("source_index").alias("points"), (F.round(F.sum("x"), 3) + 0.0).alias("sum_x"))


@query(f"WITH {M} SELECT {FK}, count(*) AS points, round(sum(CAST(CAST(z AS FLOAT) AS DOUBLE)), 3) + 0e0 AS sum_z FROM m WHERE {OK} GROUP BY ALL")
def xyzf_round_trip(spark, sf_dir):
    from trackscan.functions.exprs import finite

    sound = vector_points(spark, sf_dir).where(finite("x", "y", "z"))
    again = codecs.decode_xyzf(codecs.encode_xyzf(sound))
    return again.groupBy(*FRAME).agg(F.count("source_index").alias("points"), (F.round(F.sum(F.col("z").cast("double")), 3) + 0.0).alias("sum_z"))


@query(f"WITH {M} SELECT {FK}, count(*) AS points, count(*) FILTER ({OK}) AS finite, count(*) FILTER ({OK} AND {ZERO}) AS zero, count(*) FILTER (NOT ({OK})) AS nonfinite, count(*) FILTER ({OK} AND NOT ({ZERO})) AS nonzero_finite FROM m GROUP BY ALL")
def frame_quality_counts(spark, sf_dir):
    return quality.frame_quality(vector_points(spark, sf_dir))


_MM = ", ".join(f"round({f}({c}) FILTER ({OK} AND NOT ({ZERO})), 6) AS {f}_{c}" for c in "xyz" for f in ("min", "max"))


@query(f"WITH {M} SELECT {FK}, {_MM} FROM m GROUP BY ALL")
def usable_minmax(spark, sf_dir):
    return quality.extents(vector_points(spark, sf_dir)).select(*FRAME, *r6(*(f"{f}_{c}" for c in "xyz" for f in ("min", "max"))))


@query(f"WITH {M} SELECT {FK}, round(min({D}) FILTER ({OK} AND NOT ({ZERO})), 6) AS closest_return_distance_m FROM m GROUP BY ALL")
def closest_return(spark, sf_dir):
    return quality.closest_return(vector_points(spark, sf_dir)).select(*FRAME, *r6("closest_return_distance_m"))


@query(f"WITH {M} SELECT {FK}, round(min(x) FILTER (isfinite(x)), 6) AS first_time, round(max(x) FILTER (isfinite(x)), 6) AS last_time FROM m GROUP BY ALL")
def point_time_range(spark, sf_dir):
    return quality.time_range(vector_points(spark, sf_dir), "x").select(*FRAME, *r6("first_time", "last_time"))


@query(f"WITH {M} SELECT {FK}, bool_or(NOT ({OK})) AS vetoed, CASE WHEN bool_or(NOT ({OK})) THEN 'NONFINITE_XYZ' END AS reason FROM m GROUP BY ALL")
def nonfinite_frame_veto(spark, sf_dir):
    return quality.veto(vector_points(spark, sf_dir))


@query(f"WITH {M}, bad AS (SELECT {FK} FROM m WHERE NOT ({OK})) SELECT count(*) AS points, CAST(sum(source_index) AS BIGINT) AS indices FROM m WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.source_id = m.source_id AND b.frame_index = m.frame_index)")
def sound_frames(spark, sf_dir):
    return quality.keep_sound(vector_points(spark, sf_dir)).agg(F.count("*").alias("points"), F.sum("source_index").alias("indices"))


GOOD = f"good AS (SELECT * FROM m WHERE {OK})"
NEAR = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 15e-1*15e-1"


def _good(spark, sf_dir):
    from trackscan.functions.exprs import finite

    return vector_points(spark, sf_dir).where(finite("x", "y", "z"))


@query(f"WITH {M}, {GOOD} SELECT {FK}, a.source_index AS a, b.source_index AS b FROM good a JOIN good b USING ({FK}) WHERE a.source_index < b.source_index AND {NEAR}")
def radius_neighbors_grid(spark, sf_dir):
    return cluster.neighbours(_good(spark, sf_dir), 1.5)


@query(f"WITH RECURSIVE {M}, {GOOD}, pts AS (SELECT *, source_index AS node FROM good), edges AS (SELECT a.source_id, a.frame_index, a.node AS a, b.node AS b FROM pts a JOIN pts b USING ({FK}) WHERE a.node <> b.node AND {NEAR}), {t.reach('pts', 'edges')} SELECT {FK}, node AS source_index, label AS component FROM cc")
def buffer_components(spark, sf_dir):
    return cluster.components(_good(spark, sf_dir), 1.5)


@query(f"WITH {M}, {GOOD} SELECT {FK}, round({t.lq('list(x)', '5e-1')}, 6) AS median_low, round({t.lq('list(x)', '9e-1')}, 6) AS q90_low, round(quantile_cont(x, 0.9), 6) AS q90 FROM good GROUP BY ALL")
def lower_quantile(spark, sf_dir):
    from trackscan.functions.exprs import lower_quantile as lq

    own = _good(spark, sf_dir).groupBy(*FRAME).agg(F.collect_list("x").alias("v"), F.percentile("x", F.lit(0.9)).alias("q90"))
    return own.select(*FRAME, F.round(lq(F.col("v"), 0.5), 6).alias("median_low"), F.round(lq(F.col("v"), 0.9), 6).alias("q90_low"), F.round("q90", 6).alias("q90"))


@query(f"WITH {M}, {GOOD} SELECT {FK}, round(avg({D}), 6) AS mean_distance, CAST(CAST(any_value(source_id) AS BIGINT) * 1000000000 + 7 AS VARCHAR) AS header_ns FROM good GROUP BY ALL")
def header_stamps(spark, sf_dir):
    own = _good(spark, sf_dir).groupBy(*FRAME).agg(F.round(F.avg(distance()), 6).alias("mean_distance"))
    return own.withColumn("header_ns", header_ns(F.col("source_id"), F.lit(7)))

