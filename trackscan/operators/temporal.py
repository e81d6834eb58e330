"""Confirmation over consecutive frames of a source, and the public decision (W1-W4, C16, C17, T-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from trackscan.config import FRAME


def order() -> WindowSpec:
    """Frames of a source in their order."""
    return Window.partitionBy("source_id").orderBy("frame_index")


def streaks(frames: DataFrame, flag: str, out: str) -> DataFrame:
    """frames with the number of consecutive frames, this one last, where the flag holds.

    A frame whose flag is false or null ends a run: an unevaluated frame resets it (W1-W3).
    """
    broken = F.sum((~F.coalesce(F.col(flag), F.lit(False))).cast("int")).over(order())
    own = frames.withColumn("_run", broken)
    held = F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("long")).over(Window.partitionBy("source_id", "_run").orderBy("frame_index"))
    return own.withColumn(out, F.when(F.coalesce(F.col(flag), F.lit(False)), held).otherwise(0)).drop("_run")


def first_of_stamp(frames: DataFrame, stamp: str = "header_ns") -> DataFrame:
    """frames with `repeat`: whether the frame before it has the same stamp, so that it is decided as that one."""
    return frames.withColumn("repeat", F.coalesce(F.lag(stamp).over(order()) == F.col(stamp), F.lit(False)))


def confirm(frames: DataFrame, model_frames: int = 2, early_frames: int = 3, stamp: str | None = None) -> DataFrame:
    """frames with streaks and confirmations of the model and early flags.

    With `stamp` a frame of the stamp before it repeats that decision and counts for nothing.
    """
    own = frames if stamp is None else first_of_stamp(frames, stamp)
    once = own if stamp is None else own.where("NOT repeat")
    done = streaks(streaks(once, "model", "model_streak"), "early", "early_streak")
    for kind, n in (("model", model_frames), ("early", early_frames)):
        done = done.withColumn(f"{kind}_confirmed", F.when(F.col(kind).isNotNull(), F.col(kind) & (F.col(f"{kind}_streak") >= n)))
    if stamp is None:
        return done
    # a repeat takes the last decision before it; the rest of its row is its own
    results = ["model_streak", "early_streak", "model_confirmed", "early_confirmed"]
    packed = done.select(*FRAME, F.struct(*results).alias("_d"))
    joined = own.join(packed, FRAME, "left")
    last = F.last("_d", ignorenulls=True).over(order())
    return joined.withColumn("_d", last).select(*(c for c in own.columns), *(F.col(f"_d.{c}").alias(c) for c in results))


def status_of_streak(kind: str, needed: int) -> F.Column:
    """The temporal status of a frame of the model or early branch."""
    return (
        F.when(F.col(kind).isNull(), "RESET_UNKNOWN").when(F.col(f"{kind}_streak") >= needed, "APPLIED_CONFIRMED").when(F.col(kind), "APPLIED_WAITING_FOR_CONSECUTIVE_FRAME")
        .otherwise(f"APPLIED_NO_CURRENT_{kind.upper()}_ALARM")
    )


# Statuses and reasons of the public result, in their order of precedence.
def _status(cascade: bool) -> Column:
    if cascade:
        return (
            F.when(F.col("intrusion"), "OBSERVED_CORE_INTRUSION_CANDIDATE").when(F.col("boundary"), "OBSERVED_BOUNDARY_WARNING").when(F.col("core") > 0, "UNKNOWN")
            .when(F.col("margin") > 0, "OBSERVED_MARGIN_RETURN").otherwise("UNKNOWN")
        )
    return (
        F.when(F.col("intrusion"), "OBSERVED_CORE_INTRUSION_CANDIDATE").when(F.col("model"), "UNCONFIRMED_CORE_INTRUSION_CANDIDATE").when(F.col("core") > 0, "NO_REPORTABLE_INTRUSION_NOISE_IGNORED")
        .when(F.col("margin") > 0, "OBSERVED_MARGIN_RETURN").otherwise("UNKNOWN")
    )


def _reason(cascade: bool) -> Column:
    own = F.when(~F.col("evaluated"), F.col("axis_reason"))
    if cascade:
        own = (
            own.when(F.col("intrusion"), "BASELINE_V3_CONFIRMED_INTRUSION_CANDIDATE")
            .when(F.col("boundary"), "BASELINE_V3_BOUNDARY_WARNING_NOT_OBSTACLE")
            .when(F.col("early"), "BASELINE_V3_EARLY_CANDIDATE_WAITING_FOR_TEMPORAL_CONFIRMATION")
            .when(F.col("model"), "BASELINE_V3_MODEL_ASSIST_WAITING_FOR_TEMPORAL_CONFIRMATION")
            .when(F.col("core") > 0, "BASELINE_V3_WEAK_OR_UNCONFIRMED_CORE_UNKNOWN_NOT_CLEAR")
        )
    else:
        own = (
            own.when(F.col("intrusion"), "ANY_REPORTABLE_CORE_COMPONENT_IS_INTRUSION_CANDIDATE")
            .when(F.col("model"), "MODEL_CANDIDATE_WAITING_FOR_TEMPORAL_CONFIRMATION")
            .when(F.col("core") > 0, "ONLY_SPARSE_CORE_GROUPS")
        )
    return own.when(F.col("margin") > 0, "OBSERVED_RETURN_IN_CLEARANCE_MARGIN").otherwise("NO_RETURNS_INTERSECT_REFERENCE_NOT_CLEAR")


def publish(confirmed: DataFrame, mode: str = "baseline_v3") -> DataFrame:
    """The public decision, status and reason of frames with flags and confirmations.

    Under the cascade geometry alarms at once, model and early candidates once confirmed; under the
    alternative filters a confirmed candidate does.
    """
    cascade = mode == "baseline_v3"
    sure = F.col("geometry") | F.col("model_confirmed") | F.col("early_confirmed") if cascade else F.col("model_confirmed")
    own = confirmed.withColumn("intrusion", F.when(F.col("evaluated"), sure))
    early_public = F.coalesce(F.col("early_confirmed") & (F.col("reportable_points") == 0), F.lit(False)) if cascade else F.lit(False)
    own = own.withColumn("early_public", early_public)
    early_public = F.col("early_public")
    own = own.withColumns(
        {
            "public_points": F.when(early_public, F.col("early_points")).otherwise(F.col("reportable_points")),
            "public_nearest": F.when(early_public, F.col("nearest_early")).otherwise(F.col("nearest_reportable")),
            "noise_points": F.col("core") - F.when(early_public, F.col("early_points")).otherwise(F.col("reportable_points")),
        }
    )
    return own.withColumns({"status": _status(cascade), "reason": _reason(cascade), "system_status": F.lit("UNKNOWN"), "safety_decision_permitted": F.lit(False)})


def public_points(result: DataFrame, members: DataFrame, decided: DataFrame) -> DataFrame:
    """FRAME, source_index and whether each core point is reportable, early, noise and public.

    members: core points with their component; what isn't reportable is noise, and early points that become
    public stop being noise. Points meet their component's decision, then their frame's.
    """
    flags = decided.select(*FRAME, "component", "reportable", "early")
    own = members.select(*FRAME, "component", "source_index").join(flags, [*FRAME, "component"]).join(result.select(*FRAME, "early_public"), FRAME)
    public = F.when(F.col("early_public"), F.col("early")).otherwise(F.col("reportable"))
    return own.select(*FRAME, "source_index", "reportable", "early", (~F.col("reportable") & ~(F.col("early_public") & F.col("early"))).alias("noise"), public.alias("public"))


#: Index lists of the result and the flag of `public_points` that each collects.
INDEX_SETS = {"reportable_core_source_indices": "reportable", "baseline_v3_early_candidate_source_indices": "early", "ignored_noise_source_indices": "noise", "public_reportable_core_source_indices": "public"}


def index_sets(points: DataFrame) -> DataFrame:
    """FRAME and the sorted indices of each kind of point, each once (A13). A sensor bounds a frame's points."""
    return points.groupBy(*FRAME).agg(*(F.array_sort(F.collect_set(F.when(F.col(flag), F.col("source_index")))).alias(name) for name, flag in INDEX_SETS.items()))


def k_of_last(frames: DataFrame, flag: str, k: int, last: int) -> DataFrame:
    """frames with `confirmed`: the flag holds in at least k of the last frames (T-8, an extension)."""
    held = F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(order().rowsBetween(1 - last, 0))
    return frames.withColumns({"held": held.cast("long"), "confirmed": held >= k})


def alarm_age(frames: DataFrame, flag: str, ns: str = "header_ns", longest_s: float = 2.0) -> DataFrame:
    """frames with the seconds since the last frame where the flag held, null beyond the longest."""
    last = F.last(F.when(F.col(flag), F.col(ns)), ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0))
    age = (F.col(ns) - last) / F.lit(1e9)
    return frames.withColumn("age_s", F.when(age <= longest_s, age))


def three_early(frames: DataFrame, flag: str, same: str) -> DataFrame:
    """frames with `warned`: the flag holds here and in the two frames before, all with the same `same`."""
    held = F.coalesce(F.col(flag), F.lit(False))
    warned = held
    for back in (1, 2):
        warned = warned & F.coalesce(F.lag(flag, back).over(order()), F.lit(False)) & F.coalesce(F.lag(same, back).over(order()) == F.col(same), F.lit(False))
    return frames.withColumn("warned", warned)
