"""Scenes derived from the supplied tables in closed form, for queries, tests and the benchmark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackscan.session import shared_root

#: Boxes of the scene by kind: points along x, s and z; x, s and z as SQL of i, j, m; x from the axis or not.
BOXES = {
    1: (5, 5, 5, "-1.4e-1 + 7e-2*i", "15e0 + 7e-2*j", "7e-2*m", True),
    2: (10, 1, 10, "-9e-1 + 2e-1*i", "60e0 + 1e-1*j", "2e-1*m", True),
    3: (10, 10, 10, "-2e-1 + 5e-2*i", "20e0 + 5e-2*j", "5e-2*m", True),
    4: (6, 5, 5, "1.6e-1*i", "55e0 + 1e-1*j", "2e-1*m", True),
    5: (2, 5, 100, "-1.38e0 + 4e-2*i", "25e0 + 2e-2*j", "1.6e-2*m", False),
}
FLOOR = (77, 101)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _layers() -> list[tuple[str, str, str, str, str]]:
    """(condition, number of points, x, s, z before grade) of each part, in SQL of `k`, valid in both dialects."""
    rows, columns = FLOOR
    i, j = f"CAST(floor(k / {columns}e0) AS BIGINT)", f"(k % {columns})"
    x0 = f"(-2e0 + 2e-2 + 4e-2*{j})"
    floor = f"(-2e0 + CASE WHEN kind <> 6 AND abs(abs({x0}) - 8e-1) < 5e-2 THEN 1.7e-1 ELSE 0e0 END + 4e-4*(({i}*7 + {j}*13) % 5))"
    out = [("TRUE", str(rows * columns), f"(cx + {x0})", f"(2.25e0 + 5e-1*{i})", floor)]
    for kind, (_, ny, nz, x, s, z, moved) in BOXES.items():
        n = BOXES[kind][0] * ny * nz
        names = {"i": f"CAST(floor(k / {ny * nz}e0) AS BIGINT)", "j": f"(CAST(floor(k / {nz}e0) AS BIGINT) % {ny})", "m": f"(k % {nz})"}

        def put(text: str, names: dict[str, str] = names) -> str:
            return "".join(names.get(c, c) for c in text)

        out.append((f"kind = {kind}", str(n), f"({'cx + ' if moved else ''}({put(x)}))", f"({put(s)})", f"(-1.83e0 + 5e-1 + {put(z)})"))
    return out


def _frames_sql(source: str) -> str:
    return f"""SELECT CAST(floor(s_suppkey / 24e0) AS BIGINT) AS source_id, CAST(s_suppkey % 24 AS BIGINT) AS frame_index,
  CAST(floor((s_suppkey % 24) / 3e0) AS BIGINT) AS kind, -8e-2*(s_nationkey % 3) AS cx, -5e-3*(s_nationkey % 3) AS grade FROM {source}"""


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, frame_index, source_index and x, y, z (float) of one frame for each supplier.

    Frames are dealt out before their points are made, so that all of a frame is made, and stays, in
    one partition and operators that group by frame need no further shuffle. The number of partitions
    is given, as the few rows of frames would else be gathered into one.
    """
    suppliers = table(spark, sf_dir, "supplier")
    frames = spark.sql(_frames_sql("{suppliers}"), suppliers=suppliers).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_id", "frame_index")
    layers = _layers()
    parts = F.array(*(F.expr(f"named_struct('part', {p}, 'n', CASE WHEN {c} THEN {n} ELSE 0 END)") for p, (c, n, *_) in enumerate(layers)))
    dealt = frames.withColumn("p", F.explode(F.filter(parts, lambda p: p["n"] > 0))).selectExpr("*", "p.part AS part", "explode(sequence(0, p.n - 1)) AS k")

    def pick(column: int) -> str:
        return "CASE part " + " ".join(f"WHEN {p} THEN {layer[column]}" for p, layer in enumerate(layers)) + " END"

    first = layers[0][1]
    made = dealt.selectExpr("source_id", "frame_index", "grade", f"CAST(CASE WHEN part = 0 THEN k ELSE {first} + k END AS BIGINT) AS source_index", f"{pick(2)} AS x", f"{pick(3)} AS s", f"{pick(4)} AS z")
    return made.selectExpr("source_id", "frame_index", "source_index", "CAST(x AS FLOAT) AS x", "CAST(-s AS FLOAT) AS y", "CAST(z + grade*s AS FLOAT) AS z")


_written: dict[tuple[str, str, int], str] = {}


def dealt_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene as points arrive in practice: a table in buckets by frame, written once a session.

    Reading it cuts the closed form off, and operators that group or join by frame find it dealt already.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = (spark.sparkContext.applicationId, sf_dir, n)
    if key not in _written:
        name = f"scene_{uuid.uuid4().hex}"
        made = scene(spark, sf_dir)  # dealt as the buckets are, so each is one file
        made.write.bucketBy(n, "source_id", "frame_index").format("parquet").option("path", f"{shared_root(spark)}/{name}").saveAsTable(name)
        _written[key] = name
    return spark.table(_written[key])


def scene_sql() -> str:
    """CTEs `fr` and `t`: the same scene for the SQL twins."""
    layers = _layers()
    first = layers[0][1]
    parts = "\nUNION ALL ".join(
        f"SELECT source_id, frame_index, grade, CAST({0 if p == 0 else first} + k AS BIGINT) AS source_index, {x} AS x, {s} AS s, {z} AS z FROM fr, (SELECT unnest(range(0, {n})) AS k) WHERE {c}"
        for p, (c, n, x, s, z) in enumerate(layers)
    )
    return f"""fr AS ({_frames_sql('supplier')}), raw_t AS ({parts}),
t AS (SELECT source_id, frame_index, source_index, CAST(x AS FLOAT) AS x, CAST(-s AS FLOAT) AS y, CAST(z + grade*s AS FLOAT) AS z FROM raw_t)"""


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packed buffer of each embedding as 21 points, with some zero and some non-finite returns."""
    own = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS source_id", "CAST(0 AS BIGINT) AS frame_index", "embedding", "explode(sequence(0, 20)) AS i")
    return own.selectExpr("source_id", "frame_index", "CAST(i AS BIGINT) AS source_index", *(f"{c} AS {n}" for n, c in _vector_xyz("embedding[3*i]", "embedding[3*i+1]", "embedding[3*i+2]", "source_id").items()))


def _vector_xyz(a: str, b: str, c: str, key: str) -> dict[str, str]:
    zero, bad = f"({key}*21 + i) % 89 = 0", f"({key}*21 + i) % 97 = 0"
    return {
        "x": f"CASE WHEN {zero} THEN 0e0 ELSE CAST({a} AS DOUBLE)*4e0 END",
        "y": f"CASE WHEN {zero} THEN 0e0 ELSE CAST({b} AS DOUBLE)*40e0 - 20e0 END",
        "z": f"CASE WHEN {zero} THEN 0e0 WHEN {bad} THEN CAST('NaN' AS DOUBLE) ELSE CAST({c} AS DOUBLE)*4e0 END",
    }


def vector_points_sql() -> str:
    xyz = ", ".join(f"{c} AS {n}" for n, c in _vector_xyz("embedding[3*i+1]", "embedding[3*i+2]", "embedding[3*i+3]", "vec_id").items())
    return f"m AS (SELECT vec_id AS source_id, CAST(0 AS BIGINT) AS frame_index, CAST(i AS BIGINT) AS source_index, {xyz} FROM (SELECT *, unnest(range(0, 21)) AS i FROM embeddings))"


#: Frames of an event stream: SQL that both dialects read, over `events`.
EVENT_FRAMES = """SELECT user_id AS source_id, event_id, ts, value,
  event_type IN ('error', 'purchase') AS model, event_type IN ('error', 'click') AS early, event_type = 'signup' AS unknown,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_index FROM events"""


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENT_FRAMES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
