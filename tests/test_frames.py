import io
import json
import sqlite3
import struct
import tarfile

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from trackscan import fixtures
from trackscan.config import CORE, EXPANDED, Config, Rails, with_margins
from trackscan.functions.exprs import register
from trackscan.operators import axis, cluster, decide, envelope, evaluate, perf, quality, rails, temporal, viewer
from trackscan.plans.pipeline import Pipeline
from trackscan.queries import scene
from trackscan.session import discard, materialize
from trackscan.sources import bags, codecs, sinks
from trackscan.streaming.confirm import run_available

POINTS = "source_id long, frame_index long, source_index long, x float, y float, z float"


def points(spark, xyz, frame=0):
    return spark.createDataFrame([(0, frame, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(xyz)], POINTS)


@pytest.fixture(scope="module")
def bent(spark):
    rows = [(4.0, -1.0, 1.0, -4.0), (6.0, -1.1, 0.9, -6.0), (8.0, -1.5, 0.5, -8.0)]
    point = "struct<x:float,y:float,z:float>"
    return spark.createDataFrame([(0, 0, s, (a, y, 0.0), (b, y, 0.0), True) for s, a, b, y in rows], f"source_id long, frame_index long, s double, left {point}, right {point}, observed boolean")


XYZ = [(0.0, -4.5, 0.005), (1.7, -5.0, 1.0), (3.0, -5.0, 1.0), (0.0, -3.0, 1.0), (-1.0, -9.0, 1.0)]


def zones(labels):
    return {r["source_index"]: r["zone"] for r in labels.collect()}


def test_zones_and_tangent(spark, bent):
    own = points(spark, XYZ)
    assert zones(envelope.label(own, axis.segments(bent))) == {0: 1, 1: 2, 2: 3, 3: 0, 4: 0}
    longer = axis.extend_tangent(bent, 10.0)
    assert longer.count() == 4 and zones(envelope.label(own, axis.segments(longer)))[4] == 1
    last = longer.where("s = 10").first()
    assert abs((last["right"]["x"] - last["left"]["x"]) - 2.0) < 1e-5  # a rigid gauge


def test_no_axis_leaves_all_unknown(spark, bent):
    own = points(spark, XYZ)
    assert set(zones(envelope.label(own, axis.segments(bent.limit(0)))).values()) == {0}
    stats = envelope.zone_stats(envelope.label(own, axis.segments(bent))).first()
    assert stats["core"] + stats["margin"] + stats["outside"] + stats["unknown"] == stats["points"] == 5
    assert stats["nearest_core_source_index"] == 0


def test_wireframe_and_validation(spark, bent):
    assert axis.wireframe(axis.segments(bent), CORE).count() == 24
    assert axis.validate_pairs(bent).first()["reason"] is None
    assert axis.validate_pairs(bent.limit(1)).first()["reason"] == "TOO_FEW_PAIRS"


def test_equal_centres_are_no_division_by_zero(spark, bent):
    twice = bent.limit(1).unionByName(bent.limit(1).withColumn("s", F.col("s") + 1.0))
    assert axis.segments(twice).count() == 0 and axis.validate_pairs(twice).first()["reason"] == "EQUAL_SECTIONS"
    detected = spark.createDataFrame([(0, 0, "AUTO_HYPOTHESIS", "fine")], "source_id long, frame_index long, status string, reason string")
    packed = twice.groupBy("source_id", "frame_index").agg(F.collect_list(F.struct("s", "left", "right")).alias("rail_pairs"))
    found, segs = Pipeline(Config(extension="observed")).axis(detected.join(packed, ["source_id", "frame_index"]))
    assert (found.first()["status"], found.first()["reason"]) == ("UNKNOWN", "EQUAL_SECTIONS") and segs.count() == 0


def test_arcs(spark):
    rows = [(s, float(60 * (1 - np.cos(s / 60))), float(-60 * np.sin(s / 60))) for s in (2.0, 4.0, 6.0, 8.0, 10.0)]
    point = "struct<x:float,y:float,z:float>"
    pairs = spark.createDataFrame([(0, 0, s, (x - 0.8, y, 0.0), (x + 0.8, y, 0.0), True) for s, x, y in rows], f"source_id long, frame_index long, s double, left {point}, right {point}, observed boolean")
    longer, status = axis.extend_arc_limited(pairs, 4.0)
    assert status.first()["status"] == "ARC_LIMITED_APPLIED" and longer.count() == 7 and abs(status.first()["radius"] - 60) < 0.5
    assert axis.extend_arc_limited(pairs, 0.0)[1].first()["status"] == "ARC_HORIZON_DISABLED"
    assert axis.extend_arc_clamped(pairs, 40.0, min_radius=50.0)[1].first()["status"] == "ARC_CLAMPED_TO_MAX_TURN"
    assert axis.extend_arc_clamped(pairs, 40.0, min_radius=100.0)[1].first()["status"] == "ARC_CLAMPED_REJECTED"


def brute(xyz, radius):
    label = list(range(len(xyz)))
    changed = True
    while changed:
        changed = False
        for i in range(len(xyz)):
            for j in range(len(xyz)):
                if label[j] < label[i] and ((xyz[i] - xyz[j]) ** 2).sum() <= radius * radius:
                    label[i], changed = label[j], True
    return label


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-6, 6)] * 3), min_size=0, max_size=25))
def test_components_match_brute_force(rows):
    xyz = np.array(rows, float).reshape(-1, 3) * 0.125
    assert cluster.point_components(xyz, 0.25).tolist() == brute(xyz, 0.25)


def test_native_components_agree(spark):
    rng = np.random.default_rng(1)
    own = points(spark, rng.normal(size=(120, 3)) * 0.5)
    a = {(r["source_index"], r["component"]) for r in cluster.components(own).collect()}
    assert a == {(r["source_index"], r["component"]) for r in cluster.components_native(own).collect()}


def test_native_components_agree_where_only_outer_points_of_cells_are_near(spark):
    rng = np.random.default_rng(3)
    clouds = [rng.uniform(-1, 1, (400, 3)) * size for size in (0.2, 0.8, 1.4, 3.0)]
    # two dense sheets a little less, and a little more, than the radius apart, and pairs of points on the limit
    sheet = np.array([(0.03 * i, 0.03 * j, 0.0) for i in range(15) for j in range(15)])
    clouds += [np.concatenate([sheet, sheet + [0, 0, gap]]) for gap in (0.2499, 0.25, 0.2501)]
    clouds.append(np.concatenate([sheet * 0.4 - [0.5, 0, 0], [[0.0, 0, 0], [0.25, 0, 0], [0.375, 0, 0]], sheet * 0.4 + [0.6, 0, 0]]))
    rows = [(0, f, len(xyz) - i, *map(float, p)) for f, xyz in enumerate(clouds) for i, p in enumerate(xyz)]
    own = spark.createDataFrame(rows, "source_id long, frame_index long, source_index long, x double, y double, z double")
    found = {(r["frame_index"], r["source_index"], r["component"]) for r in cluster.components_native(own).collect()}
    assert len(found) == len(rows)
    assert found == {(r["frame_index"], r["source_index"], r["component"]) for r in cluster.components(own).collect()}


def shuffled(spark):
    """Bytes that this application has written for shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_native_components_send_few_rows_of_a_dense_frame(spark):
    k = np.arange(20)
    own = points(spark, (np.stack(np.meshgrid(k, k, k), -1).reshape(-1, 3) * 0.05).tolist())
    before = shuffled(spark)
    assert cluster.components_native(own).where("component = 0").count() == 8000
    assert shuffled(spark) - before < 300 * 8000


def test_live_clusters_send_boxes_not_points(spark):
    before = shuffled(spark)
    assert __spark_entry__.queries()["live_clusters"](spark, "/root/testdata/sf0.001").count() > 0
    assert shuffled(spark) - before < 500_000


def test_live_clusters_with_and_without_places(spark):
    rng = np.random.default_rng(2)
    place = rng.uniform(-2, 2, (3000, 3)).astype("float32")
    rows = [(0, i % 3, i, *map(float, p), i % 4) for i, p in enumerate(place)]
    labels = spark.createDataFrame(rows, POINTS + ", zone int")
    near = labels.where("zone IN (1, 2)")
    joined = envelope.live_clusters(labels, cluster.voxel_groups(near, 0.25, "zone"))
    carried = envelope.live_clusters(None, cluster.voxel_groups(near, 0.25, "zone", places=True))
    assert joined.columns == carried.columns
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, carried.collect())) != []


SF = "/root/testdata/sf0.001"
#: The scene with a station where every sixth floor column is a ridge: more than eight pairs, of which one goes on.
CROWD = "CAST(CAST({z} AS DOUBLE) + CASE WHEN source_index < 7777 AND {s} >= 30e0 AND {s} < 32e0 AND source_index % 101 % 6 = 1 THEN 17e-2 ELSE 0e0 END AS FLOAT)"


def test_live_clusters_search_crowded_stations(spark, monkeypatch):
    crowded = materialize(fixtures.scene(spark, SF).withColumn("z", F.expr(CROWD.format(z="z", s="-y"))), "crowded")
    assert {r["reason"] for r in rails.detect(crowded).collect()} == {"SEARCH_BUDGET_EXCEEDED"}
    monkeypatch.setattr(scene, "scene", lambda *_: crowded)
    own = __spark_entry__.queries()["live_clusters"](spark, SF)
    z = "CAST(z + grade*s AS FLOAT)"
    sql = __spark_entry__.oracle_sql()["live_clusters"]
    assert sql.count(f"{z} AS z FROM raw_t)") == 1
    found = duckdb.sql(sql.replace(f"{z} AS z FROM raw_t)", f"{CROWD.format(z=z, s='s')} AS z FROM raw_t)").replace("FROM supplier", f"FROM '{SF}/supplier.parquet'"))
    rows = sorted(map(tuple, own.collect()))
    assert rows == sorted(found.select(*own.columns).fetchall())
    assert {r[:2] for r in rows} == {tuple(r) for r in crowded.select("source_id", "frame_index").distinct().collect()}


def test_live_clusters_group_any_number_of_voxels(spark, monkeypatch):
    groups = cluster.voxel_groups
    monkeypatch.setattr(cluster, "voxel_groups", lambda *a, **k: groups(*a, **k).withColumn("voxels", F.lit(50_001).cast("long")))
    assert __spark_entry__.queries()["live_clusters"](spark, SF).count() > 0


@pytest.mark.parametrize("step", [0.24, 0.5])
def test_crowded_chains_equal_a_plain_search(spark, step):
    cfg, rng = Rails(max_pairs_per_station=None), np.random.default_rng(3)
    rows = []
    for station in range(12):
        s = 2 + (station + 0.5) * 2
        xs = [-3 + step * i + float(rng.uniform(-0.009, 0.009)) for i in range(int(6 / step) + 1)]
        rows.append((0, 0, station, [(x, float(rng.uniform(-0.1, 0.1)), s, i, (x, -s, 0.0)) for i, x in enumerate(xs)]))
    kind = "array<struct<x:double,z:double,s:double,cell:long,point:struct<x:float,y:float,z:float>>>"
    pairs = rails.pair_peaks(spark.createDataFrame(rows, f"source_id long, frame_index long, station long, peaks {kind}"), cfg)
    found = rails.chain_nodes(pairs, pairs, cfg).first()
    assert found["most_pairs"] > 8
    nodes = []
    for r in pairs.orderBy("station").collect():
        for p in r["pairs"]:
            best = (1, 0.0, -1)
            for i, (q, score, cost, _) in enumerate(nodes):
                gap = p["s"] - q["s"]
                slope = max(abs(p[c] - q[c]) for c in ("l", "r", "lz", "rz")) / gap if gap > 0 else 1.0
                if slope <= cfg.max_slope and gap <= cfg.max_gap:
                    total = cost + (slope / cfg.max_slope + (gap - cfg.station_length) / cfg.station_length)
                    if score + 1 > best[0] or (score + 1 == best[0] and total < best[1]):
                        best = (score + 1, total, i)
            nodes.append((p, *best))
    assert [(n["s"], n["l"], n["r"], n["score"], n["prev"]) for n in found["nodes"]] == [(p["s"], p["l"], p["r"], score, prev) for p, score, _, prev in nodes]
    assert np.allclose([n["cost"] for n in found["nodes"]], [cost for _, _, cost, _ in nodes])


def test_cascade(spark):
    cube = [(0.05 * i, -20 - 0.05 * j, 0.05 * k) for i in range(10) for j in range(10) for k in range(10)]
    pillar = [(-1.38 + 0.04 * i, -25 - 0.02 * j, 0.016 * k) for i in range(2) for j in range(5) for k in range(100)]
    own = points(spark, cube + pillar)
    done = {r["decision"]: r["n"] for r in decide.decide(decide.shapes(decide.members(own, cluster.components(own)))).collect()}
    assert done == {"geometry_obstacle": 1000, "boundary_warning": 1000}


FRAMES = "source_id long, frame_index long, model boolean, early boolean, header_ns long"


def test_streaks_reset_and_repeat(spark):
    rows = [(0, 0, True, True, 1), (0, 1, True, True, 2), (0, 2, None, None, 3), (0, 3, True, True, 4), (0, 4, True, True, 4), (0, 5, True, True, 5)]
    frames = spark.createDataFrame(rows, FRAMES)
    plain = [(r["model_streak"], r["model_confirmed"]) for r in temporal.confirm(frames).orderBy("frame_index").collect()]
    assert plain == [(1, False), (2, True), (0, None), (1, False), (2, True), (3, True)]
    once = [r["model_streak"] for r in temporal.confirm(frames, stamp="header_ns").orderBy("frame_index").collect()]
    assert once == [1, 2, 0, 1, 1, 2]


def test_quality_and_veto(spark):
    own = points(spark, [(0, 0, 0), (1, 2, 2), (float("nan"), 0, 0)])
    r = quality.frame_quality(own).first()
    assert (r["points"], r["finite"], r["zero"], r["nonfinite"], r["nonzero_finite"]) == (3, 2, 1, 1, 1)
    assert quality.veto(own).first()["reason"] == "NONFINITE_XYZ" and quality.closest_return(own).first()[2] == 3.0
    assert quality.keep_sound(own).count() == 0


def message(big=False, data=None, step=24):
    order = ">" if big else "<"
    kind = np.dtype({"names": ["x", "y", "z", "ring", "timestamp", "extra"], "formats": [f"{order}f4"] * 3 + [f"{order}u2", f"{order}f8", ("u1", (2,))], "offsets": [0, 4, 8, 12, 14, 22], "itemsize": 24})
    rows = b"".join(np.array([(*p, 7, 1.5, (1, 2))], kind).tobytes() + b"\0" * 4 for p in ((1, 2, 3), (4, 5, 6)))
    fields = [("x", 0, 7, 1), ("y", 4, 7, 1), ("z", 8, 7, 1), ("ring", 12, 4, 1), ("timestamp", 14, 8, 1), ("extra", 22, 2, 2)]
    return (0, 0, 2, 1, step, 28, big, fields, bytearray(rows if data is None else data))


CLOUD = "source_id long, frame_index long, height int, width int, point_step int, row_step int, is_bigendian boolean, fields array<struct<name:string,offset:int,datatype:int,count:int>>, data binary"


def test_pointcloud_decode(spark):
    for big in (False, True):
        rows = codecs.decode_pointcloud2(spark.createDataFrame([message(big)], CLOUD)).collect()
        assert [(r["x"], r["y"], r["z"], r["timestamp"], r["reason"]) for r in rows] == [(1, 2, 3, 1.5, None), (4, 5, 6, 1.5, None)]
    bad = codecs.decode_pointcloud2(spark.createDataFrame([message(data=b"short"), message(step=20)], CLOUD)).collect()
    assert {r["reason"] for r in bad} == {"INVALID_LAYOUT", "INVALID_FIELDS"}


def test_framed_stream():
    body = np.arange(6, dtype="<f4").tobytes()
    assert [f.tolist() for f in codecs.read_framed(io.BytesIO(struct.pack("<Q", 2) + body))] == [[[0, 1, 2], [3, 4, 5]]]
    for bad in (struct.pack("<Q", 0), struct.pack("<Q", 3) + body, b"123"):
        with pytest.raises(ValueError):
            list(codecs.read_framed(io.BytesIO(bad)))


def test_bag_source(spark, tmp_path):
    archive = tmp_path / "bag.tar"
    files = []
    with tarfile.open(archive, "w") as tar:
        for n, stamps in enumerate(((30, 10), (40,))):
            place = tmp_path / f"p{n}.db3"
            with sqlite3.connect(place) as db:
                db.execute("CREATE TABLE topics (id, name, type, serialization_format)")
                db.execute("CREATE TABLE messages (id, topic_id, timestamp, data)")
                db.execute("INSERT INTO topics VALUES (1, '/cloud', 't', 'cdr'), (2, '/other', 't', 'cdr')")
                db.executemany("INSERT INTO messages VALUES (?, 1, ?, ?)", [(i, s, b"d%d" % s) for i, s in enumerate(stamps)])
            tar.add(place, f"run/p{n}.db3")
            files.append({"path": f"p{n}.db3", "messages": len(stamps)})
        meta = json.dumps({"bag": {"messages": 3, "files": files, "topics": [{"name": "/cloud", "type": bags.CLOUD, "format": "cdr"}]}}).encode()
        info = tarfile.TarInfo("run/metadata.yaml")
        info.size = len(meta)
        tar.addfile(info, io.BytesIO(meta))
    spark.dataSource.register(bags.BagSource)
    rows = spark.read.format("bagframes").option("archive", str(archive)).option("prefix", "run").load().orderBy("frame_index").collect()
    assert [(r["frame_index"], r["bag_ns"], bytes(r["data"])) for r in rows] == [(0, 10, b"d10"), (1, 30, b"d30"), (2, 40, b"d40")]
    assert bags.prepare_archive(str(archive), str(tmp_path / "copy.tar"), ["run/metadata.yaml"])
    with pytest.raises(ValueError):
        bags.prepare_archive(str(archive), str(tmp_path / "other.tar"), ["run/none"])


def test_config_reasons():
    assert Config().reason() is None and Rails(station_length=0).reason() == "INVALID_SEARCH_PARAMETERS"
    assert Config(core=EXPANDED, expanded=CORE).reason() == "INVALID_ENVELOPE" and Config(extension="x").reason() == "INVALID_FORWARD_EXTENSION_METHOD"
    assert with_margins(CORE).left == -1.9
    with pytest.raises(ValueError):
        Pipeline(Config(arc_window=2))


def test_parity_and_parse(spark):
    a = spark.createDataFrame([(1, 2, None), (2, 3, 4)], "k long, a long, b long")
    b = spark.createDataFrame([(1, 2, None), (2, 3, 5), (3, 0, 0)], "k long, a long, b long")
    assert {(r["k"], r["side"], r["fields"]) for r in evaluate.parity(a, b, ["k"]).collect()} == {(2, "differs", "b"), (3, "right_only", None)}
    rows = spark.createDataFrame([('{"k": 1}',), ("nope",), (None,)], "t string")
    assert perf.parse_messages(rows, "t", "k BIGINT").where("parse_error IS NULL").count() == 1


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT zone_of(0D, 1D) AS a, zone_of(1.5D, 1D) AS b, zone_of(3D, 1D) AS c, lower_quantile(array(5D, 1D, 2D, 3D, 4D), 0.9D) AS q").first()
    assert tuple(r) == (1, 2, 3, 4.0)


def test_framed_files_batch_and_stream(spark, tmp_path):
    frame = lambda xyz: struct.pack("<Q", len(xyz)) + np.array(xyz, "<f4").tobytes()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(frame([(1, 2, 3), (4, 5, 6)]) + frame([(7, 8, 9)]))
    (tmp_path / "in/b.bin").write_bytes(frame([(1, 1, 1)]) + b"\x05\x00")
    (tmp_path / "in/c.bin").write_bytes(b"")
    expected = {("a", 0, 0, 1.0, None), ("a", 0, 1, 4.0, None), ("a", 1, 0, 7.0, None), ("b", 0, 0, 1.0, None), ("b", 1, None, None, "TRUNCATED_FRAME")}
    rows = lambda df: {(r["path"][-5], r["frame_index"], r["source_index"], r["x"], r["reason"]) for r in df.collect()}
    assert rows(codecs.framed_points(spark.read.format("binaryFile").load(str(tmp_path / "in")))) == expected
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = codecs.framed_points(spark.readStream.schema(schema).format("binaryFile").load(str(tmp_path / "in")))
    run_available(stream, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out/table"))) == expected


def test_results_stream_to_json_lines(spark, tmp_path):
    result = spark.createDataFrame([(0, 0, "UNKNOWN", [1]), (0, 1, "OBSERVED_MARGIN_RETURN", [])], "source_id long, frame_index long, status string, indices array<long>")
    result.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second call finds nothing new
        sinks.stream_json_lines(spark.readStream.schema(result.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/lines")).collect()]
    assert sorted(x["status"] for x in lines) == ["OBSERVED_MARGIN_RETURN", "UNKNOWN"] and all("indices" not in x for x in lines)


def test_viewer_points_and_reviews(spark):
    own = points(spark, [(i, 0, 0) for i in range(4)])
    public = spark.createDataFrame([(0, 0, 1, True), (0, 0, 2, False)], "source_id long, frame_index long, source_index long, noise boolean")
    shown = lambda **k: {r["source_index"] for r in viewer.point_set(own, public, **k).collect()}
    assert shown() == {0, 1, 2, 3} and shown(show_noise=False) == {0, 2, 3} and shown(core_only=True) == {1, 2} and shown(show_noise=False, core_only=True) == {2}
    key = "source_id long, frame_index long, header_ns string, source_frame string"
    frames = spark.createDataFrame([(0, i, str(i), "lidar") for i in range(3)], key)
    records = spark.createDataFrame([(0, 0, "0", "lidar", [1.0]), (0, 1, "1", "lidar", [2.0]), (0, 1, "1", "lidar", [3.0]), (0, 2, "9", "lidar", [4.0])], f"{key}, pairs array<double>")
    got = {r["frame_index"]: (r["pairs"], r["reason"]) for r in viewer.review_pairs(frames, records).collect()}
    assert got == {0: ([1.0], None), 1: (None, "NO_SINGLE_REVIEW_RECORD"), 2: (None, "NO_SINGLE_REVIEW_RECORD")}


@pytest.mark.parametrize("option", ["noise_filter", "rail_method", "extension", "detail"])
def test_unknown_options_are_refused(option):
    with pytest.raises(ValueError):
        Pipeline(Config(**{option: "other"}))


def test_written_tables_can_be_discarded(spark):
    written = materialize(spark.range(5), "gone")
    assert written.count() == 5 and discard(spark) >= 1 and discard(spark) == 0
    with pytest.raises(Exception, match="gone"):
        spark.read.parquet(written.inputFiles()[0])
