"""Queries over frame streams derived from events, and over rows of the other tables: confirmation, evaluation, measurements."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackscan.config import FRAME
from trackscan.fixtures import EVENT_FRAMES, event_frames, table
from trackscan.functions.exprs import THRESHOLD, forest_score, forest_sql, mebibytes, number, percent
from trackscan.operators import evaluate, perf, temporal
from trackscan.queries import twins as t
from trackscan.queries.registry import query
from trackscan.queries.scene import r6
from trackscan.session import materialize, shared_root
from trackscan.streaming import confirm

FK = t.FK
#: Flags of event frames: unknown frames have null flags.
TRI = f"ev AS ({EVENT_FRAMES}), tri AS (SELECT source_id, frame_index, ts, value, CASE WHEN NOT unknown THEN model END AS model, CASE WHEN NOT unknown THEN early END AS early FROM ev)"


def micros(column: str) -> Column:
    """Microseconds of a time without zone since 1970, whatever zone the session is in."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def _tri(spark, sf_dir):
    own = event_frames(spark, sf_dir)
    return own.select(*FRAME, "ts", "value", *(F.when(~F.col("unknown"), F.col(c)).alias(c) for c in ("model", "early")))


@query(f"WITH {TRI}, {t.streak('tri', 'model', 'streak', 'k')} SELECT {FK}, streak, streak >= 2 AS confirmed FROM k")
def temporal_streak_model(spark, sf_dir):
    own = temporal.streaks(_tri(spark, sf_dir), "model", "streak")
    return own.select(*FRAME, "streak", (F.col("streak") >= 2).alias("confirmed"))


@query(f"WITH {TRI}, {t.streak('tri', 'early', 'streak', 'k')} SELECT {FK}, streak, streak >= 3 AS confirmed FROM k")
def temporal_streak_early(spark, sf_dir):
    own = temporal.streaks(_tri(spark, sf_dir), "early", "streak")
    return own.select(*FRAME, "streak", (F.col("streak") >= 3).alias("confirmed"))


@query(f"WITH {TRI}, {t.confirmed('tri')} SELECT {FK}, model_streak, early_streak, model_confirmed, early_confirmed FROM confirmed")
def temporal_reset_unknown(spark, sf_dir):
    return temporal.confirm(_tri(spark, sf_dir)).select(*FRAME, "model_streak", "early_streak", "model_confirmed", "early_confirmed")


# Stamps of whole quarter days: many neighbouring frames share one.
STAMP = "CAST(floor(epoch(ts) / 21600e0) AS BIGINT) * 21600000000000"


def _stamped(spark, sf_dir):
    return _tri(spark, sf_dir).withColumn("header_ns", F.floor(micros("ts") / F.lit(21600e6)) * 21600000000000)


@query(f"""WITH {TRI}, st AS (SELECT *, {STAMP} AS header_ns FROM tri), rp AS (SELECT *, coalesce(lag(header_ns) OVER (PARTITION BY source_id ORDER BY frame_index) = header_ns, FALSE) AS again FROM st),
once AS (SELECT * FROM rp WHERE NOT again), {t.confirmed('once')}, alone AS (SELECT *, frame_index AS since FROM confirmed)
SELECT r.source_id, r.frame_index, r.again AS repeated, c.model_streak, c.early_streak, c.model_confirmed, c.early_confirmed FROM rp r ASOF JOIN alone c ON r.source_id = c.source_id AND r.frame_index >= c.since""")
def temporal_dedupe_ns(spark, sf_dir):
    own = temporal.confirm(_stamped(spark, sf_dir), stamp="header_ns")
    return own.select(*FRAME, F.col("repeat").alias("repeated"), "model_streak", "early_streak", "model_confirmed", "early_confirmed")


@query(f"WITH {TRI}, {t.confirmed('tri')} SELECT {FK}, model_streak, early_streak, model_confirmed, early_confirmed FROM confirmed")
def streaming_equals_batch(spark, sf_dir):
    """The stateful stream over everything there is, started from a written table of frames."""
    rows = materialize(_tri(spark, sf_dir).select(*FRAME, micros("ts").alias("header_ns"), "model", "early"), "stream-in")
    place = rows.inputFiles()[0].rsplit("/", 1)[0]
    path = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(rows.schema).parquet(place)
    confirm.run_available(confirm.confirm_stream(stream), path)
    return spark.read.parquet(f"{path}/table").select(*FRAME, "model_streak", "early_streak", "model_confirmed", "early_confirmed")


@query(f"WITH {TRI} SELECT {FK}, CAST(held AS BIGINT) AS held, held >= 2 AS confirmed FROM (SELECT {FK}, sum(CASE WHEN coalesce(model, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS held FROM tri)")
def k_of_last_frames(spark, sf_dir):
    return temporal.k_of_last(_tri(spark, sf_dir), "model", 2, 4).select(*FRAME, "held", "confirmed")


@query(f"""WITH {TRI}, named AS (SELECT *, CASE WHEN floor(frame_index / 11e0) % 2 = 0 THEN 'lidar' ELSE 'lidar_raw' END AS source_frame FROM tri)
SELECT {FK}, coalesce(early, FALSE) AND coalesce(lag(early) OVER w, FALSE) AND coalesce(lag(early, 2) OVER w, FALSE) AND coalesce(lag(source_frame) OVER w = source_frame, FALSE) AND coalesce(lag(source_frame, 2) OVER w = source_frame, FALSE) AS warned FROM named WINDOW w AS (PARTITION BY source_id ORDER BY frame_index)""")
def early_run_lag(spark, sf_dir):
    own = _tri(spark, sf_dir).withColumn("source_frame", F.when(F.floor(F.col("frame_index") / 11) % 2 == 0, "lidar").otherwise("lidar_raw"))
    return temporal.three_early(own, "early", "source_frame").select(*FRAME, "warned")


@query(f"""WITH {TRI}, aged AS (SELECT {FK}, epoch_us(ts) * 1000 - last_value(CASE WHEN model THEN epoch_us(ts) * 1000 END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame_index) AS age FROM tri)
SELECT {FK}, CASE WHEN age / 1e9 <= 432e3 THEN round(age / 1e9, 3) END AS age_s FROM aged""")
def alarm_age(spark, sf_dir):
    own = _tri(spark, sf_dir).withColumn("header_ns", micros("ts") * 1000)
    return temporal.alarm_age(own, "model", longest_s=432e3).select(*FRAME, F.round("age_s", 3).alias("age_s"))


@query(f"WITH {TRI} SELECT {FK}, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY source_id)) / 1e6, 3) AS bag_offset_seconds FROM tri")
def frame_records_offsets(spark, sf_dir):
    from trackscan.operators.quality import frame_records

    own = _tri(spark, sf_dir).withColumn("bag_ns", micros("ts") * 1000)
    return frame_records(own).select(*FRAME, F.round("bag_offset_seconds", 3).alias("bag_offset_seconds"))


@query(f"WITH {TRI} SELECT source_id, min(frame_index) FILTER (model) AS frame, round(arg_min(value, frame_index) FILTER (model), 6) AS measure FROM tri GROUP BY ALL")
def first_detection(spark, sf_dir):
    return evaluate.first_match(_tri(spark, sf_dir), "model", ["source_id"], "value").select("source_id", "frame", *r6("measure"))


FIRST_RUN = f"""{TRI}, run_r AS (SELECT *, sum(CASE WHEN coalesce(early, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY frame_index) AS run FROM tri),
held AS (SELECT *, row_number() OVER w AS place, first_value(frame_index) OVER w AS run_start, first_value(value) OVER w AS sv FROM run_r WHERE early WINDOW w AS (PARTITION BY source_id, run ORDER BY frame_index)),
hit AS (SELECT source_id, frame_index AS frame, run_start, value, sv FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame_index) AS rn FROM held WHERE place >= 3) WHERE rn = 1)"""


@query(f"WITH {FIRST_RUN} SELECT s.source_id, frame, run_start, round(value, 6) AS measure, round(sv, 6) AS run_start_measure FROM (SELECT DISTINCT source_id FROM tri) s LEFT JOIN hit USING (source_id)")
def first_run_of_n(spark, sf_dir):
    return evaluate.first_run(_tri(spark, sf_dir), "early", ["source_id"], "value", 3).select("source_id", "frame", "run_start", *r6("measure", "run_start_measure"))


# Positive intervals and event windows of each source, by rule.
SOURCES = "SELECT DISTINCT user_id AS source_id FROM events"
INTERVALS = "SELECT source_id, 5 + source_id % 7 AS start, 20 + source_id % 11 AS \"end\" FROM {0} UNION ALL SELECT source_id, 18 + source_id % 5 AS start, 30 AS \"end\" FROM {0} WHERE source_id % 3 = 0"
EVENTS = "SELECT source_id, 'obj' || lpad(CAST(n AS VARCHAR(20)), 2, '0') || '_x' AS event_id, CASE WHEN n % 3 = 2 THEN 'negative' ELSE 'positive' END AS polarity, 4*n + source_id % 4 AS start, 4*n + source_id % 4 + 2 + n % 3 AS \"end\" FROM {0}"
REVIEW = "SELECT source_id, 'obj' || lpad(CAST(n AS VARCHAR(20)), 2, '0') AS object_id, 'object ' || CAST(n AS VARCHAR(20)) AS description, CASE WHEN n % 4 = 3 THEN 'excluded' ELSE 'positive' END AS working_role, CASE WHEN n % 2 = 0 THEN 'user_visible' ELSE 'hidden' END AS review_status, CASE WHEN n % 5 <> 4 THEN 4*n END AS start, CASE WHEN n % 5 <> 4 THEN 4*n + 3 END AS \"end\" FROM {0}"
LABELS = f"srcs AS ({SOURCES}), ns AS (SELECT source_id, unnest(range(0, 8)) AS n FROM srcs), intervals AS ({INTERVALS.format('srcs')}), wins AS ({EVENTS.format('ns')}), review AS ({REVIEW.format('ns')})"


def _labels(spark, sf_dir):
    """(intervals, events, review) as small tables by rule."""
    sources = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id")).distinct()
    numbered = sources.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7))))
    quoted = lambda sql: sql.replace('"end"', "`end`")
    intervals = spark.sql(quoted(INTERVALS).format("{a}"), a=sources)
    return intervals, spark.sql(quoted(EVENTS).format("{a}"), a=numbered), spark.sql(quoted(REVIEW).format("{a}"), a=numbered)


@query(f"""WITH {TRI}, {LABELS}, lab AS (SELECT t.*, coalesce(model, FALSE) AS alarm, EXISTS (SELECT 1 FROM intervals i WHERE i.source_id = t.source_id AND t.frame_index BETWEEN i.start AND i."end") AS positive FROM tri t)
SELECT source_id, count(*) AS frames, count(*) FILTER (positive AND alarm) AS tp, count(*) FILTER (NOT positive AND NOT alarm) AS tn, count(*) FILTER (NOT positive AND alarm) AS fp, count(*) FILTER (positive AND NOT alarm) AS fn FROM lab GROUP BY ROLLUP (source_id)""")
def frame_confusion(spark, sf_dir):
    return evaluate.frame_confusion(_tri(spark, sf_dir), _labels(spark, sf_dir)[0], "model")


HITS = f"""{TRI}, {LABELS}, hits AS (SELECT w.*, EXISTS (SELECT 1 FROM tri t WHERE t.source_id = w.source_id AND t.frame_index BETWEEN w.start AND w."end" AND t.model) AS hit FROM wins w)"""


@query(f"WITH {HITS} SELECT source_id, event_id, hit FROM hits")
def event_hits(spark, sf_dir):
    return evaluate.event_hits(_tri(spark, sf_dir), _labels(spark, sf_dir)[1], "model").select("source_id", "event_id", "hit")


@query(f"""WITH {HITS}, c AS (SELECT source_id, count(*) AS events, count(*) FILTER (polarity = 'positive' AND hit) AS tp, count(*) FILTER (polarity <> 'positive' AND NOT hit) AS tn, count(*) FILTER (polarity <> 'positive' AND hit) AS fp, count(*) FILTER (polarity = 'positive' AND NOT hit) AS fn FROM hits GROUP BY ALL)
SELECT *, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS "precision", round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS recall, round(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 6) AS f_score FROM c""")
def event_confusion(spark, sf_dir):
    own = evaluate.scores(evaluate.event_confusion(_tri(spark, sf_dir), _labels(spark, sf_dir)[1], "model"))
    defined = F.coalesce("f_score", F.when(F.col("fp") + F.col("fn") > 0, 0.0))
    return own.withColumn("f_score", defined).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f_score")})


@query(f"""WITH {LABELS}, seen AS (SELECT * FROM review WHERE working_role = 'positive' AND review_status = 'user_visible' AND start IS NOT NULL)
SELECT source_id, 'positive_' || lpad(CAST(row_number() OVER (PARTITION BY source_id ORDER BY start) AS VARCHAR), 2, '0') AS event_id, 'development interval' AS description, CAST(start AS BIGINT) AS first, 'positive_frames' AS kind FROM intervals
UNION ALL SELECT source_id, object_id, description, start, 'user_visible' FROM seen
UNION ALL SELECT w.source_id, w.event_id, coalesce(r.description, w.event_id), w.start, 'scoring_only' FROM wins w LEFT JOIN review r ON r.source_id = w.source_id AND r.object_id = split_part(w.event_id, '_', 1)
  WHERE polarity = 'positive' AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.source_id = w.source_id AND s.object_id = split_part(w.event_id, '_', 1))""")
def distance_window_catalog(spark, sf_dir):
    intervals, events, review = _labels(spark, sf_dir)
    own = evaluate.window_catalog(intervals, review, events)
    return own.select("source_id", "event_id", "description", F.col("start").cast("long").alias("first"), "kind")


@query(f"""WITH {HITS}, inside AS (SELECT w.source_id, w.event_id, t.frame_index, value, early, model FROM wins w JOIN tri t ON t.source_id = w.source_id AND t.frame_index BETWEEN w.start AND w."end"),
runs AS (SELECT *, sum(CASE WHEN coalesce(early, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, event_id ORDER BY frame_index) AS run FROM inside),
warned AS (SELECT source_id, event_id, min(frame_index) AS warning_frame, arg_min(value, frame_index) AS wm FROM (SELECT *, row_number() OVER (PARTITION BY source_id, event_id, run ORDER BY frame_index) AS place FROM runs WHERE early) WHERE place >= 3 GROUP BY ALL),
sure AS (SELECT *, sum(CASE WHEN coalesce(model, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, event_id ORDER BY frame_index) AS srun FROM inside),
steady AS (SELECT source_id, event_id, min(frame_index) AS stable_frame, arg_min(value, frame_index) AS sm FROM (SELECT *, row_number() OVER (PARTITION BY source_id, event_id, srun ORDER BY frame_index) AS place FROM sure WHERE model) WHERE place >= 2 GROUP BY ALL),
firsts AS (SELECT source_id, event_id, min(frame_index) FILTER (early) AS early_frame, arg_min(value, frame_index) FILTER (early) AS em, min(frame_index) FILTER (model) AS public_frame, arg_min(value, frame_index) FILTER (model) AS m FROM inside GROUP BY ALL)
SELECT w.source_id, w.event_id, early_frame, round(em, 3) AS early_m, warning_frame, round(wm, 3) AS warning_m, public_frame AS reportable_frame, public_frame, stable_frame, round(sm, 3) AS stable_m, CASE WHEN public_frame IS NULL THEN 'missed' ELSE 'f' || public_frame || ' / ' || printf('%.3f m', m) END AS metric
FROM wins w LEFT JOIN firsts USING (source_id, event_id) LEFT JOIN warned USING (source_id, event_id) LEFT JOIN steady USING (source_id, event_id)""")
def window_detections(spark, sf_dir):
    own = _tri(spark, sf_dir).withColumns({"intrusion": F.col("model"), "nearest_early": F.col("value"), "nearest_reportable": F.col("value")})
    done = evaluate.detections(own, _labels(spark, sf_dir)[1])
    metres = [F.round(c, 3).alias(c) for c in ("early_m", "warning_m", "stable_m")]
    return done.select("source_id", "event_id", "early_frame", "warning_frame", "reportable_frame", "public_frame", "stable_frame", *metres, evaluate.metric_text(F.col("public_frame"), F.col("public_m")).alias("metric"))


@query(f"WITH {TRI} SELECT {FK}, CASE WHEN frame_index % 10 = 0 THEN 'left_only' WHEN frame_index % 7 = 0 THEN 'differs' END AS side, CASE WHEN frame_index % 10 <> 0 AND frame_index % 7 = 0 THEN 'value' END AS fields FROM tri WHERE frame_index % 10 = 0 OR frame_index % 7 = 0")
def parity_diff(spark, sf_dir):
    own = _tri(spark, sf_dir).select(*FRAME, "value", "model", "early")
    other = own.where("frame_index % 10 <> 0").withColumn("value", F.when(F.col("frame_index") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return evaluate.parity(own, other, FRAME)


@query(f"WITH {TRI} SELECT {FK} FROM tri WHERE frame_index % 13 = 0")
def identity_mismatches(spark, sf_dir):
    frames = _tri(spark, sf_dir).select(*FRAME, micros("ts").alias("header_ns"), F.lit("lidar").alias("source_frame"))
    results = frames.withColumn("header_ns", F.when(F.col("frame_index") % 13 == 0, F.col("header_ns") + 1).otherwise(F.col("header_ns")))
    return evaluate.identity_mismatches(results, frames).select(*FRAME)


@query(f"WITH {TRI}, {LABELS}, notes AS (SELECT source_id, start AS frame_index, list_sort(list(event_id)) AS events FROM wins GROUP BY ALL) SELECT {FK}, array_to_string(events, ',') AS events FROM tri LEFT JOIN notes USING ({FK})")
def annotated_frames(spark, sf_dir):
    notes = _labels(spark, sf_dir)[1].select("source_id", F.col("start").alias("frame_index"), "event_id")
    return evaluate.annotated(_tri(spark, sf_dir), notes).select(*FRAME, F.array_join("events", ",").alias("events"))


@query("SELECT DISTINCT n_nationkey AS source_id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def unknown_sources(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source_id"))
    return evaluate.unknown_sources(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id")), known)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def status_histogram(spark, sf_dir):
    own = perf.histogram(table(spark, sf_dir, "events"), "event_type")
    return own.select(F.explode("counts").alias("event_type", "n"))


@query('SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS "max", round(avg(value), 4) AS mean FROM events GROUP BY ALL')
def latency_percentiles(spark, sf_dir):
    own = perf.latency(table(spark, sf_dir, "events"), "value", ["event_type"])
    return own.select("event_type", "n", *r6("p50", "p95", "p99", "max"), F.round("mean", 4).alias("mean"))


USAGE = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) || CASE CAST(l_linenumber AS BIGINT) % 4 WHEN 0 THEN 'MiB' WHEN 1 THEN 'GiB' WHEN 2 THEN 'KiB' ELSE 'B' END || ' / 64GiB'"


@query("""SELECT l_returnflag, round(max(l_quantity), 4) AS cpu_max, round(avg(l_quantity), 4) AS cpu_mean, round(max(m), 4) AS mib_max, round(avg(m), 4) AS mib_mean FROM (SELECT l_returnflag, l_quantity,
  CAST(l_quantity AS BIGINT) * CASE CAST(l_linenumber AS BIGINT) % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 1024e0 WHEN 2 THEN 1 / 1024e0 ELSE 1 / 1048576e0 END AS m FROM lineitem) GROUP BY ALL""")
def resource_units(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_returnflag", F.concat(F.col("l_quantity").cast("string"), F.lit("%")).alias("cpu"), F.expr(USAGE).alias("memory"))
    done = perf.resources(own, by=["l_returnflag"])
    return done.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("cpu_max", "cpu_mean", "mib_max", "mib_mean")))


@query("SELECT 'events' AS origin, count(*) AS rows_read, count(*) FILTER (NOT json_valid(props)) AS bad FROM events UNION ALL SELECT 'documents', count(*), count(*) FROM documents")
def json_parse_errors(spark, sf_dir):
    events, documents = table(spark, sf_dir, "events").select(F.lit("events").alias("origin"), F.col("props").alias("text")), table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text")
    own = perf.parse_messages(events.unionByName(documents), "text", "k BIGINT")
    return own.groupBy("origin").agg(F.count("*").alias("rows_read"), F.count("parse_error").alias("bad"))


@query("SELECT bool_or(regexp_matches(url, 'page=[0-9]+')) AS paged, bool_or(regexp_matches(url, 'dropped [0-9]+ frames')) AS dropped FROM pages")
def log_flags(spark, sf_dir):
    return perf.log_flags(table(spark, sf_dir, "pages"), "url", {"paged": "page=[0-9]+", "dropped": "dropped [0-9]+ frames"})


FORBIDDEN = r"/de/[0-9]+\.html$"


@query(f"SELECT url AS path, 'forbidden' AS finding FROM pages WHERE regexp_matches(url, '{FORBIDDEN}') UNION ALL SELECT url, 'too_large' FROM pages WHERE length(html) > 4000 UNION ALL SELECT 'README.md', 'missing'")
def package_gate_regex(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.length("html").alias("bytes"))
    return evaluate.package_gate(files, FORBIDDEN, 4000, ["README.md"])


# Feature rows spread over the forest's splits.
FEATURE_SQL = {
    "f0": "60e0 + 7e0*(l_orderkey % 19)", "f1": "6e-1 + 1e-2*(l_partkey % 11)", "f2": "2e-1 + 1e-1*(l_suppkey % 9)", "f3": "4e-1 + 1e-1*(l_orderkey % 17)",
    "f4": "1e-1 + 1e-1*(l_partkey % 11)", "f5": "1e2*(1 + l_linenumber)", "f6": "52e0 + 1e0*(l_suppkey % 10)", "f7": "55e0 + 1e0*(l_orderkey % 13)",
}
FEATURES = ", ".join(f"{c} AS {n}" for n, c in FEATURE_SQL.items())


@query(f"SELECT round(score, 6) AS score, score >= {number(THRESHOLD)} AS assist, count(*) AS n FROM (SELECT {forest_sql(list(FEATURE_SQL))} AS score FROM (SELECT {FEATURES} FROM lineitem)) GROUP BY ALL")
def forest_scores(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").selectExpr(*(f"{c} AS {n}" for n, c in FEATURE_SQL.items())).withColumn("s", forest_score(*FEATURE_SQL))
    return own.groupBy(F.round("s", 6).alias("score"), (F.col("s") >= THRESHOLD).alias("assist")).agg(F.count("*").alias("n"))


@query(r"SELECT l_linenumber, round(max(CAST(regexp_replace(CAST(l_discount AS VARCHAR) || '%', '%', '') AS DOUBLE)), 6) AS percent, round(max(l_quantity) / 1024e0, 6) AS mib FROM lineitem GROUP BY ALL")
def unit_parsing(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_linenumber", percent(F.concat(F.col("l_discount").cast("string"), F.lit("%"))).alias("p"), mebibytes(F.concat(F.col("l_quantity").cast("string"), F.lit("KiB / 1GiB"))).alias("m"))
    return own.groupBy("l_linenumber").agg(F.round(F.max("p"), 6).alias("percent"), F.round(F.max("m"), 6).alias("mib"))


@query("SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS BIGINT)) AS quantity, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY ALL")
def line_fit_totals(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return own.agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("*").alias("n"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))
