"""Rail detection: ridges by station, pairs, the longest locally continuous chain, straight lines.

Give points dealt by frame (repartition(*FRAME), as Pipeline does): every step groups or windows below the
frame, so that one shuffle serves all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackscan.config import FRAME, Rails
from trackscan.functions.exprs import lower_quantile
from trackscan.operators.quality import search_window
from trackscan.session import materialize

NODE = "struct<idx:int,s:double,l:double,r:double,lz:double,rz:double,left:struct<x:float,y:float,z:float>,right:struct<x:float,y:float,z:float>,score:int,cost:double,prev:int>"


#: More than the lateral cells of a station, so that station * CELLS + cell names a cell of a frame.
CELLS = 1 << 20


def station_cells(points: DataFrame, cfg: Rails = Rails()) -> DataFrame:
    """FRAME, station, cell and zs: the heights of the window's points of each lateral cell."""
    return search_window(points, cfg).groupBy(*FRAME, "station", "cell").agg(F.collect_list("z").alias("zs"))


def _stations(points: DataFrame, cfg: Rails) -> DataFrame:
    """FRAME, station, floor (the low quantile of the cells' low quantiles), and cells with the heights in them."""
    low = F.when(F.size("zs") >= cfg.min_cell_points, lower_quantile(F.col("zs"), cfg.cell_floor_quantile).cast("double"))
    each = station_cells(points, cfg).withColumn("low", low)
    return each.groupBy(*FRAME, "station").agg(F.collect_list("low").alias("lows"), F.collect_list(F.struct("cell", "zs")).alias("cells")).withColumn("floor", lower_quantile(F.col("lows"), cfg.floor_quantile)).drop("lows")


def station_floors(points: DataFrame, cfg: Rails = Rails()) -> DataFrame:
    """FRAME, station, floor."""
    return _stations(points, cfg).select(*FRAME, "station", "floor")


def ridge_heights(points: DataFrame, cfg: Rails = Rails()) -> DataFrame:
    """FRAME, station, cell, floor and height of cells with enough points in the floor band.

    The cells of a station are worked on as one array: a filter on rows would have the floor worked out anew for
    every point.
    """
    bands = F.transform("cells", lambda c: F.struct(c["cell"].alias("cell"), F.filter(c["zs"], lambda z: (z.cast("double") >= F.col("floor") - cfg.floor_band_below) & (z.cast("double") <= F.col("floor") + cfg.floor_band_above)).alias("zs")))
    heights = F.transform(bands, lambda b: F.struct(b["cell"].alias("cell"), F.when(F.size(b["zs"]) >= cfg.min_cell_points, lower_quantile(b["zs"], cfg.head_quantile).cast("double")).alias("height")))
    kept = F.filter(heights, lambda h: h["height"].isNotNull())
    return _stations(points, cfg).where("floor IS NOT NULL").select(*FRAME, "station", "floor", F.explode(kept).alias("h")).select(*FRAME, "station", "h.cell", "floor", "h.height")


def ridge_prominence(points: DataFrame, cfg: Rails = Rails()) -> DataFrame:
    """ridge_heights with prominence over the medians of both flanks, where it is in range."""
    near, far = math.ceil(cfg.flank_min / cfg.cell_width), math.floor(cfg.flank_max / cfg.cell_width)
    by = Window.partitionBy(*FRAME, "station").orderBy("cell")
    sides = {"left_heights": by.rangeBetween(-far, -near), "right_heights": by.rangeBetween(near, far)}
    flanked = ridge_heights(points, cfg).withColumns({n: F.collect_list("height").over(w) for n, w in sides.items()})
    full = flanked.where((F.size("left_heights") >= cfg.min_flank_cells) & (F.size("right_heights") >= cfg.min_flank_cells))
    over = [F.col("height") - lower_quantile(F.col(n), 0.5) for n in sides]
    return full.withColumn("prominence", F.least(*over)).where(F.col("prominence").between(cfg.min_prominence, cfg.max_prominence)).drop(*sides)


def ridge_peaks(points: DataFrame, cfg: Rails = Rails()) -> DataFrame:
    """FRAME, station, cell, s, x, z, prominence and the observed point that stands for each ridge.

    Ridges are few: they are written, packed by frame, and met by the frame's points, so that the places of all
    other points are never carried along.
    """
    name = F.col("station") * CELLS + F.col("cell")
    ridges = materialize(ridge_prominence(points, cfg), "ridges")
    packed = ridges.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct(name.alias("name"), "floor", "height", "prominence"))).alias("r"))
    packed = packed.select(*FRAME, F.transform("r", lambda r: r["name"]).alias("names"), "r")
    met = search_window(points, cfg).join(packed, FRAME).withColumn("at", F.array_position("names", name)).where("at > 0")
    own = met.select(*FRAME, "station", "cell", F.col("z").cast("double").alias("z"), F.col("x").cast("double").alias("x"), "s", "source_index", F.element_at("r", F.col("at").cast("int")).alias("r"))
    z, floor = F.col("z"), F.col("r.floor")
    head = own.where((z >= floor - cfg.floor_band_below) & (z <= floor + cfg.floor_band_above) & (z >= F.col("r.height") - cfg.head_band))
    kept = head.groupBy(*FRAME, "station", "cell").agg(F.first("r.height").alias("height"), F.first("r.prominence").alias("prominence"), F.collect_list(F.struct("x", "s", "source_index", "z")).alias("head"))
    kept = kept.withColumns({"s": cfg.forward_min + (F.col("station") + 0.5) * cfg.station_length, "x": lower_quantile(F.transform("head", lambda p: p["x"]), 0.5)})
    cost = F.transform("head", lambda p: F.struct((F.abs(p["x"] - F.col("x")) + F.abs(p["s"] - F.col("s")) * 0.01).alias("cost"), p["source_index"].alias("source_index"), p["x"].alias("px"), p["s"].alias("ps"), p["z"].alias("pz")))
    best = kept.withColumn("best", F.array_min(cost))
    point = F.struct(F.col("best.px").cast("float").alias("x"), (-F.col("best.ps")).cast("float").alias("y"), F.col("best.pz").cast("float").alias("z"))
    return best.select(*FRAME, "station", "cell", "s", "x", F.col("height").alias("z"), "prominence", F.col("best.source_index").alias("source_index"), point.alias("point"))


def separate_peaks(peaks: DataFrame, cfg: Rails = Rails()) -> DataFrame:
    """FRAME, station and peaks: by falling prominence, those apart from all taken before (W7, O1); ties to the lower cell."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("prominence")).alias("order"), "cell", "x", "z", "s", "point")))
    taken = peaks.groupBy(*FRAME, "station").agg(ordered.alias("p"))
    kind = taken.schema["p"].dataType.simpleString()
    chosen = F.aggregate("p", F.array().cast(kind), lambda acc, p: F.when(F.exists(acc, lambda a: F.abs(a["x"] - p["x"]) <= cfg.peak_separation), acc).otherwise(F.array_append(acc, p)))
    return taken.select(*FRAME, "station", F.sort_array(F.transform(chosen, lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z"), p["s"].alias("s"), p["cell"].alias("cell"), p["point"].alias("point")))).alias("peaks"))


def rail_pairs(points: DataFrame, cfg: Rails = Rails()) -> DataFrame:
    """FRAME, station and pairs of ridges a gauge apart, the left one first."""
    return pair_peaks(separate_peaks(ridge_peaks(points, cfg), cfg), cfg)


def pair_peaks(separate: DataFrame, cfg: Rails = Rails()) -> DataFrame:
    def mates(a: Column) -> Column:
        fit = F.filter("peaks", lambda b: (b["x"] > a["x"]) & (b["x"] - a["x"]).between(cfg.pair_min, cfg.pair_max) & (F.abs(b["z"] - a["z"]) <= cfg.max_cross_height))
        return F.transform(fit, lambda b: F.struct(a["s"].alias("s"), a["x"].alias("l"), b["x"].alias("r"), a["z"].alias("lz"), b["z"].alias("rz"), a["point"].alias("left"), b["point"].alias("right")))

    return separate.select(*FRAME, "station", F.flatten(F.transform("peaks", mates)).alias("pairs"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: an expression that a lambda names twice is worked out twice."""
    return F.transform(F.array(value), use)[0]


def over_budget(cfg: Rails) -> Column:
    """Whether a frame has a station of more pairs than are searched; without a limit none has."""
    return F.lit(False) if cfg.max_pairs_per_station is None else F.col("most_pairs") > cfg.max_pairs_per_station


def chain_nodes(pairs: DataFrame, frames: DataFrame, cfg: Rails = Rails()) -> DataFrame:
    """frames with pair_stations, most_pairs and nodes: all pairs by station, each with the best chain that ends there.

    The chain is a dynamic programme over stations x pairs nodes, folded in one expression (R9, J6, O3). Peaks that
    are apart bound the pairs of a station (some 60 with the default window), so it can do without a limit on them.
    """
    each = pairs.groupBy(*FRAME).agg(
        F.count_if(F.size("pairs") > 0).alias("pair_stations"),
        F.max(F.size("pairs")).alias("most_pairs"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("station", "pairs"))), lambda b: b["pairs"])).alias("rows"),
    )
    every = frames.select(*FRAME).distinct().join(each, FRAME, "left")
    every = every.withColumns({"pair_stations": F.coalesce("pair_stations", F.lit(0)).cast("long"), "most_pairs": F.coalesce("most_pairs", F.lit(0))})
    # over a limit that is set nothing is searched, as nothing would be reported either
    rows = F.when((F.col("pair_stations") >= cfg.min_stations) & ~over_budget(cfg), F.col("rows"))

    def step(acc: Column, row: Column) -> Column:
        def slope(p: Column) -> Column:
            gap = row["s"] - p["s"]
            return F.greatest(*(F.abs(row[c] - p[c]) / gap for c in ("l", "r", "lz", "rz")))

        def joins(p: Column) -> Column:
            gap = row["s"] - p["s"]
            return F.when((gap > 0) & (gap <= cfg.max_gap), slope(p) <= cfg.max_slope).otherwise(F.lit(False))

        def offer(p: Column) -> Column:
            gap = row["s"] - p["s"]
            edge = slope(p) / cfg.max_slope + (gap - cfg.station_length) / cfg.station_length
            return F.struct((p["score"] + 1).alias("score"), (-(p["cost"] + edge)).alias("gain"), (-p["idx"]).alias("back"))

        def node(best: Column) -> Column:
            return F.struct(
                F.size(acc["nodes"]).alias("idx"), *(row[c].alias(c) for c in ("s", "l", "r", "lz", "rz", "left", "right")),
                F.coalesce(best["score"], F.lit(1)).alias("score"), F.coalesce(-best["gain"], F.lit(0.0)).alias("cost"), F.coalesce(-best["back"], F.lit(-1)).alias("prev"),
            ).cast(NODE)

        def add(near: Column) -> Column:
            best = F.array_max(F.transform(F.filter(near, joins), offer))
            return _once(_once(best, node), lambda n: F.struct(F.array_append(acc["nodes"], n).alias("nodes"), F.array_append(near, n).alias("near")))

        # rows come by station: what is too far behind this row is so behind all later ones
        return _once(F.filter(acc["near"], lambda p: row["s"] - p["s"] <= cfg.max_gap), add)

    none = F.array().cast(f"array<{NODE}>")
    nodes = F.aggregate(F.coalesce(rows, F.array().cast(every.schema["rows"].dataType)), F.struct(none.alias("nodes"), none.alias("near")), step, lambda acc: acc["nodes"])
    return every.withColumn("nodes", nodes).drop("rows")


def _chain(nodes: Column, end: Column) -> Column:
    """Nodes of the chain that ends at index `end`, in order."""
    start = F.struct(end.cast("int").alias("want"), F.array().cast(f"array<{NODE}>").alias("chain"))

    def back(acc: Column, _: Column) -> Column:
        return _once(nodes[acc["want"]], lambda n: F.struct(n["prev"].alias("want"), F.array_prepend(acc["chain"], n).alias("chain")))

    # a node's score is the length of its chain, its idx its place
    return F.aggregate(F.sequence(F.lit(1), nodes[end.cast("int")]["score"]), start, back, lambda acc: acc["chain"])


def detect(points: DataFrame, frames: DataFrame | None = None, cfg: Rails = Rails()) -> DataFrame:
    """One row per frame: status, reason, diagnostics and rail pairs of the longest continuous chain."""
    every = (frames if frames is not None else points).select(*FRAME).distinct()
    if cfg.reason():
        return every.withColumns({"status": F.lit("UNKNOWN"), "reason": F.lit(cfg.reason())})
    return judge(chain_nodes(rail_pairs(points, cfg), every, cfg), cfg)


def judge(nodes: DataFrame, cfg: Rails = Rails()) -> DataFrame:
    """Status, reason and the chosen chain of frames with nodes."""
    ends = F.array_max(F.transform(F.filter("nodes", lambda n: n["score"] >= cfg.min_stations), lambda n: F.struct(n["score"].alias("score"), (-n["cost"]).alias("gain"), (-n["idx"]).alias("back"))))
    own = nodes.withColumn("best", ends).withColumn("chain", F.when(F.col("best").isNotNull(), _chain(F.col("nodes"), -F.col("best.back"))))
    first, last = F.col("chain")[0], F.element_at("chain", -1)
    own = own.withColumns({"span": last["s"] - first["s"], "supported_stations": F.when(F.col("best").isNotNull(), F.size("chain"))})
    own = own.withColumn("coverage", F.col("supported_stations") / (F.col("span") / cfg.station_length + 1.0))

    def centre(n: Column) -> Column:
        return (n["l"] + n["r"]) * 0.5

    def moved(n: Column) -> Column:
        def apart(other: Column) -> Column:
            shared = F.flatten(F.transform("chain", lambda a: F.transform(F.filter(other, lambda b: F.abs(a["s"] - b["s"]) <= 1e-6), lambda b: F.abs(centre(b) - centre(a)))))
            return F.coalesce(F.array_max(shared), F.abs(centre(n) - centre(F.element_at("chain", -1))))

        return _once(_chain(F.col("nodes"), n["idx"]), apart)

    def first_apart(found: Column, n: Column) -> Column:
        return F.coalesce(found, _once(moved(n), lambda d: F.when(d > cfg.pair_min * 0.5, d)))

    rivals = F.filter("nodes", lambda n: (n["idx"] != -F.col("best.back")) & (n["score"] >= F.col("best.score") * cfg.ambiguity_ratio))
    enough = (F.col("span") >= cfg.min_span) & (F.col("coverage") >= cfg.min_coverage)
    own = own.withColumn("rival_displacement", F.when(enough, F.aggregate(rivals, F.lit(None).cast("double"), first_apart)))
    # Reasons, in their order
    reason = (
        F.when(F.col("pair_stations") < cfg.min_stations, "INSUFFICIENT_PAIRED_RAIL_SUPPORT")
        .when(over_budget(cfg), "SEARCH_BUDGET_EXCEEDED")
        .when(F.col("best").isNull(), "INSUFFICIENT_LOCALLY_CONTINUOUS_PAIR_SUPPORT")
        .when(~enough, "INSUFFICIENT_CONTIGUOUS_COVERAGE")
        .when(F.col("rival_displacement").isNotNull(), "AMBIGUOUS_LOCAL_CONTINUITY_PATH")
        .otherwise("PAIRED_RAISED_LOCAL_CONTINUITY_PATH")
    )
    own = own.withColumn("reason", reason)
    good = F.col("reason") == "PAIRED_RAISED_LOCAL_CONTINUITY_PATH"
    pairs = F.when(good, F.transform("chain", lambda n: F.struct(n["s"].alias("s"), n["left"].alias("left"), n["right"].alias("right"))))
    return own.select(
        *FRAME, F.when(good, "AUTO_HYPOTHESIS").otherwise("UNKNOWN").alias("status"), "reason", "pair_stations", F.col("supported_stations").cast("long").alias("supported_stations"),
        F.col("best.score").cast("long").alias("best_score"), (-F.col("best.gain")).alias("best_cost"), "span", "coverage", first["s"].alias("start_s"), last["s"].alias("end_s"),
        "rival_displacement", pairs.alias("rail_pairs"),
    )


def detect_straight(points: DataFrame, frames: DataFrame | None = None, cfg: Rails = Rails()) -> DataFrame:
    """The alternative method: lines through two pairs, refitted on the pairs near them.

    Seeds are joined by frame only, at most max_seed_pairs of them; each step is an aggregate or join
    on (frame, seed).
    """
    every = (frames if frames is not None else points).select(*FRAME).distinct()
    binned = materialize(rail_pairs(points, cfg), "pairs")  # few beside the points, and read by each step
    each = binned.select(*FRAME, "station", F.posexplode("pairs").alias("n", "p")).select(*FRAME, "station", "n", "p.*")
    facts = binned.groupBy(*FRAME).agg(F.count_if(F.size("pairs") > 0).alias("pair_stations"), F.max(F.size("pairs")).alias("most_pairs"))
    a, b = (each.select(*FRAME, *(F.col(c).alias(f"{c}_{t}") for c in ("station", "n", "s", "l", "r", "lz", "rz"))) for t in "ab")
    seeds = a.join(b, FRAME).where((F.col("station_b") - F.col("station_a")) * cfg.station_length >= cfg.min_span)
    counted = facts.join(seeds.groupBy(*FRAME).agg(F.count("*").alias("seeds")), FRAME, "left")
    within = counted.where((F.col("pair_stations") >= cfg.min_stations) & ~over_budget(cfg) & (F.coalesce("seeds", F.lit(0)) <= cfg.max_seed_pairs)).select(*FRAME)
    seeded = seeds.join(within, FRAME, "left_semi")
    fields = ("l", "r", "lz", "rz")
    key = [*FRAME, "seed"]
    seeded = seeded.withColumn("seed", F.struct("station_a", "n_a", "station_b", "n_b"))
    # the fit of two rows is the line through them
    model = seeded.withColumns({f"{f}_slope": (F.col(f"{f}_b") - F.col(f"{f}_a")) / (F.col("s_b") - F.col("s_a")) for f in fields})
    model = model.withColumns({f"{f}_at": F.col(f"{f}_a") - F.col(f"{f}_slope") * F.col("s_a") for f in fields})
    model = model.where(F.greatest(*(F.abs(f"{f}_slope") for f in fields)) <= cfg.max_slope).select(*key, *(f"{f}_{p}" for f in fields for p in ("slope", "at")))

    def error() -> Column:
        off = {f: F.abs(F.col(f) - (F.col(f"{f}_at") + F.col(f"{f}_slope") * F.col("s"))) for f in fields}
        return F.greatest(off["l"] / cfg.lateral_tolerance, off["r"] / cfg.lateral_tolerance, off["lz"] / cfg.height_tolerance, off["rz"] / cfg.height_tolerance)

    def gather(m: DataFrame) -> DataFrame:
        near = m.join(each, FRAME).withColumn("error", error()).where("error <= 1")
        best = near.groupBy(*key, "station").agg(F.min(F.struct("error", "n", "s", *fields, "left", "right")).alias("row"))
        return best.select(*key, "station", "row.*")

    def fit(rows: DataFrame, by: list[str], keep: tuple[Column, ...] = ()) -> DataFrame:
        # regressions are plain aggregates, combined before the shuffle; rows of one station have slope zero
        slopes = [F.coalesce(F.regr_slope(f, "s"), F.lit(0.0)).alias(f"{f}_slope") for f in fields]
        sums = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.avg("s").alias("ms"), *(F.avg(f).alias(f"m_{f}") for f in fields), *slopes, *keep)
        return sums.withColumns({f"{f}_at": F.col(f"m_{f}") - F.col(f"{f}_slope") * F.col("ms") for f in fields})

    lines = [f"{f}_{p}" for f in fields for p in ("slope", "at")]
    second = gather(fit(gather(model), key).where(F.col("rows") >= cfg.min_stations).select(*key, *lines))
    order = Window.partitionBy(*key).orderBy("s")
    apart = second.withColumn("gap", F.col("s") - F.lag("s").over(order)).withColumn("run", F.sum((F.coalesce("gap", F.lit(0.0)) > cfg.max_gap).cast("int")).over(order))
    size = F.count("*").over(Window.partitionBy(*key))
    runs = fit(apart.withColumn("total", size).where(F.col("total") >= cfg.min_stations), [*key, "run"], (F.sort_array(F.collect_list(F.struct("s", *fields, "left", "right"))).alias("list"), F.min("s").alias("s0"), F.max("s").alias("s1")))
    span = F.col("s1") - F.col("s0")
    fine = runs.where((F.col("rows") >= cfg.min_stations) & (span >= cfg.min_span) & (F.col("rows") / (span / cfg.station_length + 1.0) >= cfg.min_coverage))
    fine = fine.where((F.abs(F.col("l_slope") - F.col("r_slope")) * span <= cfg.lateral_tolerance) & (F.greatest(*(F.abs(f"{f}_slope") for f in fields)) <= cfg.max_slope))

    def off(r: Column, f: str) -> Column:
        return r[f] - (F.col(f"{f}_at") + F.col(f"{f}_slope") * r["s"])

    tolerance = {"l": cfg.lateral_tolerance, "r": cfg.lateral_tolerance, "lz": cfg.height_tolerance, "rz": cfg.height_tolerance}
    close = ~F.exists("list", lambda r: F.greatest(*(F.abs(off(r, f)) / tolerance[f] for f in fields)) > 1)
    squares = F.aggregate("list", F.lit(0.0), lambda t, r: t + sum((off(r, f) * off(r, f) for f in fields), F.lit(0.0)))
    fine = fine.where(close).withColumn("rms", F.sqrt(squares / (F.col("rows") * 4))).where(F.col("rms") <= cfg.max_rms)

    def value(f: str, at: str) -> Column:
        return F.col(f"{f}_at") + F.col(f"{f}_slope") * F.col(at)

    tilt = F.hypot(F.lit(1.0), (F.col("l_slope") + F.col("r_slope")) * 0.5)
    for at in ("s0", "s1"):
        fine = fine.where(((value("r", at) - value("l", at)) / tilt).between(cfg.pair_min, cfg.pair_max) & (F.abs(value("rz", at) - value("lz", at)) <= cfg.max_cross_height))
    fine = materialize(fine, "lines")
    ranked = fine.withColumn("place", F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("rows"), "rms", "seed", "run")))
    best = ranked.where("place = 1").select(*FRAME, F.col("rows").alias("best_rows"), F.col("rms").alias("best_rms"), F.col("s0").alias("start"), F.col("s1").alias("end"), F.col("list").alias("best_list"), *(F.col(c).alias(f"best_{c}") for c in lines))

    def gone(f: str, at: str) -> Column:
        return F.abs((F.col(f"{f}_at") + F.col(f"{f}_slope") * F.col(at)) - (F.col(f"best_{f}_at") + F.col(f"best_{f}_slope") * F.col(at)))

    rivals = fine.join(best.drop("best_list"), FRAME).where(F.col("rows") >= F.col("best_rows") * cfg.ambiguity_ratio)
    unclear = rivals.groupBy(*FRAME).agg(F.max(F.greatest(*(gone(f, at) for f in ("l", "r") for at in ("start", "end")))).alias("displacement"))
    done = every.join(counted, FRAME, "left").join(best.drop(*(f"best_{c}" for c in lines)), FRAME, "left").join(unclear, FRAME, "left")
    # Reasons, in their order
    reason = (
        F.when(F.coalesce("pair_stations", F.lit(0)) < cfg.min_stations, "INSUFFICIENT_PAIRED_RAIL_SUPPORT")
        .when(over_budget(cfg) | (F.coalesce("seeds", F.lit(0)) > cfg.max_seed_pairs), "SEARCH_BUDGET_EXCEEDED")
        .when(F.col("best_rows").isNull(), "NO_STRAIGHT_CONSISTENT_PAIR")
        .when(F.col("displacement") > cfg.pair_min / 2, "AMBIGUOUS_RAIL_PAIRS")
        .otherwise("PAIRED_RAISED_LINEAR_RIDGES")
    )
    done = done.withColumn("reason", reason)
    good = F.col("reason") == "PAIRED_RAISED_LINEAR_RIDGES"
    pairs = F.when(good, F.transform("best_list", lambda n: F.struct(n["s"].alias("s"), n["left"].alias("left"), n["right"].alias("right")))).alias("rail_pairs")
    return done.select(*FRAME, F.when(good, "AUTO_HYPOTHESIS").otherwise("UNKNOWN").alias("status"), "reason", pairs, F.when(good, F.col("best_rows")).alias("supported_stations"), F.when(good, F.col("best_rms")).alias("rms"), F.when(good, F.col("start")).alias("start_s"), F.when(good, F.col("end")).alias("end_s"))
