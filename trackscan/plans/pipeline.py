"""The whole run: points of frames in, one result row per frame out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.config import FRAME, Config
from trackscan.operators import axis, cluster, decide, envelope, quality, rails, temporal
from trackscan.session import materialize


class Pipeline:
    """The operators in their order under one configuration.

    Points are dealt by frame once. Axis rows and component rows are few beside points and are
    written to the shared folder where several later steps read them.
    """

    def __init__(self, cfg: Config = Config()):
        if cfg.reason():
            raise ValueError(cfg.reason())
        self.cfg = cfg

    def detect(self, points: DataFrame) -> DataFrame:
        """Rails of every frame by the chosen method; frames with a non-finite point are vetoed."""
        facts = materialize(quality.veto(points), "frames")
        sound = quality.usable(points.join(facts.where("NOT vetoed").select(*FRAME), FRAME, "left_semi"))
        method = rails.detect_straight if self.cfg.rail_method == "baseline" else rails.detect
        found = method(sound, facts, self.cfg.rails)
        bad = facts.where("vetoed").select(*FRAME, F.col("reason").alias("_veto"))
        return found.join(bad, FRAME, "left").withColumn("reason", F.coalesce("_veto", "reason")).drop("_veto")

    def axis(self, detected: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(detected, segments); a frame whose extended pairs make no axis is unknown with the reason why."""
        c = self.cfg
        pairs = axis.extend(axis.pair_rows(detected), c.extension, c.arc_horizon, c.arc_min_radius, c.arc_max_turn_deg, c.arc_window, c.rails.forward_max)
        bad = materialize(axis.validate_pairs(pairs).where("reason IS NOT NULL").select(*FRAME, F.col("reason").alias("_bad")), "bad-axes")
        unknown = F.col("_bad").isNotNull()
        sound = detected.join(bad, FRAME, "left").withColumns({"status": F.when(unknown, "UNKNOWN").otherwise(F.col("status")), "reason": F.coalesce("_bad", "reason")}).drop("_bad")
        return sound, axis.segments(pairs.join(bad, FRAME, "left_anti"))

    def segments(self, detected: DataFrame) -> DataFrame:
        return self.axis(detected)[1]

    def members(self, labels: DataFrame) -> DataFrame:
        """The core points with their components."""
        core = quality.select_zone(labels, 1)
        return decide.members(core, cluster.components(core, self.cfg.radius))

    def decided(self, own: DataFrame, segs: DataFrame) -> DataFrame:
        """Components of the core points, each with its decision by the chosen filter."""
        shape = decide.shapes(own)
        if self.cfg.noise_filter == "baseline_v3":
            return decide.decide(shape)
        if self.cfg.noise_filter == "legacy":
            kept = decide.legacy_filter(decide.axis_stats(envelope.project(own, segs))).select(*decide.COMPONENT, "reportable")
        else:
            kept = decide.assist_only(shape).select(*decide.COMPONENT, "reportable")
        none = {"boundary": F.lit(False), "early": F.lit(False), "score": F.lit(None).cast("double")}
        return shape.join(kept, decide.COMPONENT).withColumns({**none, "decision": F.when(F.col("reportable"), "reported").otherwise("noise")})

    def run(self, points: DataFrame, stamps: DataFrame | None = None) -> DataFrame:
        """One row per frame: counts, flags, confirmations, public decision, status and reason.

        stamps: FRAME and header_ns; with them and `dedupe` a frame that repeats the stamp before it takes that
        decision (W4). With detail="full" the result has the index lists of its points as well (A13).
        """
        c = self.cfg
        detected, segs = self.axis(materialize(self.detect(points), "detected"))
        detected, segs = materialize(detected, "axes"), materialize(segs, "segments")
        # read by the counts and by the components; only core points keep their place
        labels = materialize(envelope.narrow(envelope.label(quality.usable(points), segs, c.core, c.expanded)), "labels")
        own = materialize(self.members(labels), "members")
        comps = materialize(self.decided(own, segs), "components")
        frames = detected.select(*FRAME, (F.col("status") == "AUTO_HYPOTHESIS").alias("evaluated"), F.col("reason").alias("axis_reason"))
        flags = decide.frame_flags(frames, envelope.narrow_stats(labels), comps, c.noise_filter)
        stamp = "header_ns" if stamps is not None and c.dedupe else None
        if stamp:
            flags = flags.join(stamps.select(*FRAME, stamp), FRAME, "left")
        needed = 1 if c.noise_filter == "legacy" else c.model_frames
        result = temporal.publish(temporal.confirm(materialize(flags, "flags"), needed, c.early_frames, stamp), c.noise_filter)
        if c.detail == "full":
            sets = temporal.index_sets(temporal.public_points(result, own, comps))
            result = result.join(sets, FRAME, "left").withColumns({n: F.coalesce(n, F.array().cast("array<bigint>")) for n in temporal.INDEX_SETS})
        return result


#: Fixed value: the format that readers of the document expect.
FORMAT = "lidar-curve-envelope-v1"


def to_json(result: DataFrame, detail: str = "summary") -> DataFrame:
    """FRAME and the result document as JSON (S10); summary leaves arrays out."""
    heavy = [f.name for f in result.schema.fields if f.dataType.typeName() in ("array", "map")]
    kept = result.drop(*heavy) if detail == "summary" else result
    return kept.select(*FRAME, F.to_json(F.struct(F.lit(FORMAT).alias("format"), *kept.columns), {"ignoreNullFields": "false"}).alias("json"))


def manifest(frames: DataFrame) -> DataFrame:
    """Per source its number of frames and their first and last."""
    return frames.groupBy("source_id").agg(F.count("*").alias("frames"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))


def frame(points: DataFrame, source_id, frame_index: int) -> DataFrame:
    """The points of one frame, in order."""
    return points.where((F.col("source_id") == source_id) & (F.col("frame_index") == frame_index)).orderBy("source_index")
