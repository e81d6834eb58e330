"""Evaluation: confusion counts, events, first detections, window catalogues, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackscan.config import FRAME


def in_intervals(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """frames with `positive`: some interval (source_id, start, end) of the source holds the frame.

    Intervals are spread to their frames, so that the range join is an equi-join.
    """
    spread = intervals.select("source_id", F.explode(F.sequence("start", "end")).alias("frame_index")).distinct().withColumn("positive", F.lit(True))
    return frames.join(spread, FRAME, "left").withColumn("positive", F.coalesce("positive", F.lit(False)))


def _counts(truth: Column, alarm: Column) -> list[Column]:
    return [F.count_if(truth & alarm).alias("tp"), F.count_if(~truth & ~alarm).alias("tn"), F.count_if(~truth & alarm).alias("fp"), F.count_if(truth & ~alarm).alias("fn")]


def frame_confusion(frames: DataFrame, intervals: DataFrame, alarm: str = "alarm") -> DataFrame:
    """tp, tn, fp, fn per source, and over all in a row of a null source (V1, A14); an unknown frame raised no alarm."""
    own = in_intervals(frames, intervals)
    return own.rollup("source_id").agg(F.count("*").alias("frames"), *_counts(F.col("positive"), F.coalesce(F.col(alarm), F.lit(False))))


def event_hits(frames: DataFrame, events: DataFrame, alarm: str = "alarm") -> DataFrame:
    """events (source_id, event_id, polarity, start, end) with `hit`: an alarm within."""
    spread = events.select("source_id", "event_id", F.explode(F.sequence("start", "end")).alias("frame_index"))
    met = spread.join(frames.select(*FRAME, alarm), FRAME)
    hits = met.groupBy("source_id", "event_id").agg(F.bool_or(F.coalesce(F.col(alarm), F.lit(False))).alias("hit"))
    return events.join(hits, ["source_id", "event_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def event_confusion(frames: DataFrame, events: DataFrame, alarm: str = "alarm") -> DataFrame:
    """Confusion over events per source (V2)."""
    return event_hits(frames, events, alarm).groupBy("source_id").agg(F.count("*").alias("events"), *_counts(F.col("polarity") == "positive", F.col("hit")))


def scores(confusion: DataFrame, beta: float = 1.0) -> DataFrame:
    """confusion with precision, recall and F-beta; null where undefined."""
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    own = confusion.withColumns({"precision": p, "recall": r})
    b = beta * beta
    return own.withColumn("f_score", (1 + b) * F.col("precision") * F.col("recall") / F.nullif(b * F.col("precision") + F.col("recall"), F.lit(0.0)))


def with_warm_up(frames: DataFrame, first: int, last: int, decide) -> DataFrame:
    """Decisions of a frame range, streaks counted over the whole source before the range is cut (V3)."""
    return decide(frames).where(F.col("frame_index").between(first, last))


def window_catalog(intervals: DataFrame, review: DataFrame, events: DataFrame) -> DataFrame:
    """Windows to measure: positive intervals, visible reviewed objects, and events of objects not among these.

    intervals: source_id, start, end; review: source_id, object_id, description, working_role,
    review_status, start, end (null if never visible); events: source_id, event_id, polarity, start, end.
    """
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("start"))
    positive = intervals.select("source_id", F.format_string("positive_%02d", number).alias("event_id"), F.lit("development interval").alias("description"), "start", "end", F.lit("positive_frames").alias("kind"))
    seen = review.where("working_role = 'positive' AND review_status = 'user_visible' AND start IS NOT NULL")
    visible = seen.select("source_id", F.col("object_id").alias("event_id"), "description", "start", "end", F.lit("user_visible").alias("kind"))
    own = events.where("polarity = 'positive'").withColumn("object_id", F.element_at(F.split("event_id", "_"), 1))
    rest = own.join(seen.select("source_id", "object_id"), ["source_id", "object_id"], "left_anti").join(review.select("source_id", "object_id", "description"), ["source_id", "object_id"], "left")
    scoring = rest.select("source_id", "event_id", F.coalesce("description", "event_id").alias("description"), "start", "end", F.lit("scoring_only").alias("kind"))
    return positive.unionByName(visible).unionByName(scoring)


def first_match(frames: DataFrame, flag: str, by: list[str], measure: str) -> DataFrame:
    """Per group the first frame where the flag holds, and its measure."""
    hit = F.min(F.when(F.col(flag), F.struct("frame_index", F.col(measure).alias("measure"))))
    return frames.groupBy(*by).agg(hit.alias("h")).select(*by, F.col("h.frame_index").alias("frame"), F.col("h.measure").alias("measure"))


def first_run(frames: DataFrame, flag: str, by: list[str], measure: str, n: int) -> DataFrame:
    """Per group the first frame that ends n consecutive rows where the flag holds, and the run's start."""
    order = Window.partitionBy(*by).orderBy("frame_index")
    held = F.coalesce(F.col(flag), F.lit(False))
    own = frames.withColumn("_run", F.sum((~held).cast("int")).over(order)).where(held)
    run = Window.partitionBy(*by, "_run").orderBy("frame_index")
    own = own.withColumns({"_at": F.row_number().over(run), "_start": F.first("frame_index").over(run), "_start_measure": F.first(measure).over(run)})
    end = F.min(F.when(F.col("_at") >= n, F.struct("frame_index", "_start", F.col(measure).alias("m"), F.col("_start_measure").alias("sm"))))
    found = own.groupBy(*by).agg(end.alias("h")).where("h IS NOT NULL")
    every = frames.select(*by).distinct().join(found, by, "left")
    return every.select(*by, F.col("h.frame_index").alias("frame"), F.col("h._start").alias("run_start"), F.col("h.m").alias("measure"), F.col("h.sm").alias("run_start_measure"))


def metric_text(frame: Column, measure: Column) -> Column:
    """'f14 / 55.580 m', or 'missed'."""
    return F.when(frame.isNull(), "missed").otherwise(F.concat(F.lit("f"), frame.cast("string"), F.lit(" / "), F.coalesce(F.format_string("%.3f m", measure), F.lit("unknown"))))


def detections(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """The five first detections of each window (V5): frames hold early, model, intrusion and both distances."""
    spread = windows.select("source_id", "event_id", F.explode(F.sequence("start", "end")).alias("frame_index"))
    own = spread.join(frames, FRAME)
    by = ["source_id", "event_id"]
    parts = [
        ("early", first_match(own, "early", by, "nearest_early")), ("warning", first_run(own, "early", by, "nearest_early", 3)), ("reportable", first_match(own, "model", by, "nearest_reportable")),
        ("public", first_match(own, "intrusion", by, "nearest_reportable")), ("stable", first_run(own, "intrusion", by, "nearest_reportable", 2)),
    ]
    done = windows
    for name, part in parts:
        done = done.join(part.select(*by, F.col("frame").alias(f"{name}_frame"), F.col("measure").alias(f"{name}_m")), by, "left")
    return done


def parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and fields in which two results differ, nulls compared as values."""
    fields = [c for c in left.columns if c not in keys]
    a, b = left.select(*keys, F.struct(*fields).alias("l")), right.select(*keys, F.struct(*fields).alias("r"))
    met = a.join(b, keys, "full")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in fields)))
    side = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").when(F.size(differ) > 0, "differs")
    return met.select(*keys, side.alias("side"), F.when(side == "differs", F.array_join(differ, ",")).alias("fields")).where("side IS NOT NULL")


def identity_mismatches(results: DataFrame, frames: DataFrame) -> DataFrame:
    """Results whose stamp or frame name isn't the record's."""
    met = results.join(frames.select(*FRAME, F.col("header_ns").alias("_ns"), F.col("source_frame").alias("_name")), FRAME, "left")
    return met.where(~(F.col("header_ns").eqNullSafe(F.col("_ns")) & F.col("source_frame").eqNullSafe(F.col("_name")))).drop("_ns", "_name")


def annotated(frames: DataFrame, annotations: DataFrame) -> DataFrame:
    """frames with the sorted events annotated there."""
    packed = annotations.groupBy(*FRAME).agg(F.sort_array(F.collect_list("event_id")).alias("events"))
    return frames.join(packed, FRAME, "left")


def unknown_sources(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Wanted sources that aren't known."""
    return wanted.select("source_id").distinct().join(known, "source_id", "left_anti")


def package_gate(files: DataFrame, forbidden: str, most_bytes: int, required: list[str]) -> DataFrame:
    """Findings over (path, bytes): forbidden names, files too large, required paths missing (V9)."""
    bad = files.where(F.col("path").rlike(forbidden)).select("path", F.lit("forbidden").alias("finding"))
    large = files.where(F.col("bytes") > most_bytes).select("path", F.lit("too_large").alias("finding"))
    needed = files.sparkSession.createDataFrame([(p,) for p in required], "path string")
    missing = needed.join(files.select("path"), "path", "left_anti").select("path", F.lit("missing").alias("finding"))
    return bad.unionByName(large).unionByName(missing)
