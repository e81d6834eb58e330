"""Codecs of point buffers: PointCloud2 messages, raw float triples, packed arrays."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.config import FRAME

#: Numpy kinds of the message's field types 1 to 8.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
MOST_POINTS = 10_000_000


def view(message: dict) -> np.ndarray:
    """A strided record view of a message's points; ValueError with a reason where it makes none."""
    width, height, step, row = (int(message[k]) for k in ("width", "height", "point_step", "row_step"))
    data, names = message["data"] or b"", [f["name"] for f in message["fields"]]
    if step <= 0 or row < width * step or len(data) != height * row:
        raise ValueError("INVALID_LAYOUT")
    if len(set(names)) != len(names) or not {"x", "y", "z"} <= set(names):
        raise ValueError("INVALID_FIELDS")
    formats = []
    for f in message["fields"]:
        kind, count = KINDS.get(f["datatype"]), int(f["count"])
        if kind is None or count < 1 or f["offset"] + int(kind[1]) * count > step:
            raise ValueError("INVALID_FIELDS")
        if f["name"] in "xyz" and (kind[0] != "f" or count != 1):
            raise ValueError("UNSUPPORTED_POINTCLOUD_XYZ_SCHEMA")
        formats.append(((">" if message["is_bigendian"] else "<") + kind, (count,)) if count > 1 else (">" if message["is_bigendian"] else "<") + kind)
    kind = np.dtype({"names": names, "formats": formats, "offsets": [f["offset"] for f in message["fields"]], "itemsize": step})
    return np.ndarray((height, width), kind, data, strides=(row, step)).reshape(-1)


def decode_pointcloud2(messages: DataFrame, chunk: int = 200_000) -> DataFrame:
    """FRAME, source_index, x, y, z, timestamp and reason.

    Zero returns go, and the others keep their place in the message. A message that can't be decoded
    gives one row with a reason and no point. Columns: FRAME, height, width, point_step, row_step,
    is_bigendian, fields (array of name, offset, datatype, count) and data.
    """
    names = ["height", "width", "point_step", "row_step", "is_bigendian", "fields", "data"]
    kinds = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in FRAME)
    columns = [*FRAME, "source_index", "x", "y", "z", "timestamp", "reason"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key = [row[c] for c in FRAME]
                try:
                    points = view(row)
                    reason = None
                except (ValueError, TypeError) as error:
                    points, reason = np.zeros(0, [("x", "f4"), ("y", "f4"), ("z", "f4")]), str(error)
                xyz = np.stack([points[c].astype(np.float64) for c in "xyz"])
                index = np.flatnonzero((xyz != 0).any(axis=0))
                if reason:
                    yield pa.RecordBatch.from_arrays([*(pa.array([k], t.type) for k, t in zip(key, batch.columns)), pa.array([None], pa.int64()), *(pa.array([None], pa.float64()) for _ in range(4)), pa.array([reason])], columns)
                for low in range(0, len(index), chunk):
                    at = index[low : low + chunk]
                    time = pa.array(points["timestamp"][at].astype(np.float64)) if "timestamp" in (points.dtype.names or ()) else pa.nulls(len(at), pa.float64())
                    yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(at), t.type) for k, t in zip(key, batch.columns)), pa.array(at), *(pa.array(xyz[i][at]) for i in range(3)), time, pa.nulls(len(at), pa.string())], columns)

    return messages.select(*FRAME, *names).mapInArrow(work, f"{kinds}, source_index bigint, x double, y double, z double, timestamp double, reason string")


def encode_pointcloud2(points: DataFrame) -> DataFrame:
    """FRAME and one little-endian float message per frame, points in order."""
    fields = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(4 * i).alias("offset"), F.lit(7).alias("datatype"), F.lit(1).alias("count")) for i, c in enumerate("xyz")))
    packed = encode_xyzf(points)
    return packed.select(
        *FRAME, F.lit(1).alias("height"), (F.length("data") / 12).cast("int").alias("width"), F.lit(12).alias("point_step"), F.length("data").cast("int").alias("row_step"), F.lit(False).alias("is_bigendian"), fields.alias("fields"), "data"
    )


def encode_xyzf(points: DataFrame) -> DataFrame:
    """FRAME and data: little-endian float triples of each frame, by source_index (S3)."""

    def pack(pdf):
        own = pdf.sort_values("source_index", kind="stable")
        return pdf.iloc[:1][FRAME].assign(data=own[["x", "y", "z"]].to_numpy("<f4").tobytes())

    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in FRAME)
    return points.select(*FRAME, "source_index", "x", "y", "z").groupBy(*FRAME).applyInPandas(pack, f"{kinds}, data binary")


def decode_xyzf(buffers: DataFrame, data: str = "data") -> DataFrame:
    """FRAME, source_index, x, y, z and reason of raw float triples (S3); a buffer that holds none gives a reason."""
    kinds = ", ".join(f"{c} {buffers.schema[c].dataType.simpleString()}" for c in FRAME)
    columns = [*FRAME, "source_index", "x", "y", "z", "reason"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = row[data] or b""
                xyz = np.frombuffer(own, "<f4").reshape(-1, 3) if len(own) % 12 == 0 else np.zeros((0, 3), "<f4")
                reason = "INVALID_LENGTH" if len(own) % 12 else "NONFINITE_XYZ" if not np.isfinite(xyz).all() else None
                n = 1 if reason else len(xyz)
                keys = [pa.array([row[c]] * n, t.type) for c, t in zip(FRAME, batch.columns)]
                body = [pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.float32()) for _ in range(3))] if reason else [pa.array(np.arange(n)), *(pa.array(np.ascontiguousarray(xyz[:, i])) for i in range(3))]
                yield pa.RecordBatch.from_arrays([*keys, *body, pa.array([reason] * n, pa.string())], columns)

    return buffers.select(*FRAME, data).mapInArrow(work, f"{kinds}, source_index bigint, x float, y float, z float, reason string")


def decode_packed(buffers: DataFrame, values: str) -> DataFrame:
    """FRAME, source_index, x, y, z of an array of floats in triples; what is left over is dropped (S3)."""
    own = buffers.select(*FRAME, F.col(values).alias("v")).withColumn("n", F.floor(F.size("v") / 3).cast("int")).where("n > 0")
    each = own.select(*FRAME, "v", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.select(*FRAME, F.col("i").cast("long").alias("source_index"), *(F.col("v")[F.col("i") * 3 + k].alias(c) for k, c in enumerate("xyz")))


def packed_remainder(buffers: DataFrame, values: str) -> DataFrame:
    """FRAME, floats left over and the reason INVALID_LENGTH where some are."""
    left = F.size(values) % 3
    return buffers.select(*FRAME, left.cast("long").alias("left_over"), F.when(left != 0, "INVALID_LENGTH").alias("reason"))


def read_framed(stream) -> Iterator[np.ndarray]:
    """Frames of a binary stream: a 64-bit count, then that many float triples.

    An empty, oversized, cut-off or non-finite frame is an error, as nothing after it can be trusted.
    """
    while head := stream.read(8):
        if len(head) < 8:
            raise ValueError("TRUNCATED_FRAME")
        (count,) = struct.unpack("<Q", head)
        if not 0 < count <= MOST_POINTS:
            raise ValueError("INVALID_POINT_COUNT")
        body = stream.read(12 * count)
        if len(body) < 12 * count:
            raise ValueError("TRUNCATED_FRAME")
        xyz = np.frombuffer(body, "<f4").reshape(-1, 3)
        if not np.isfinite(xyz).all():
            raise ValueError("NONFINITE_XYZ")
        yield xyz


def framed_points(files: DataFrame) -> DataFrame:
    """path, frame_index, source_index, x, y, z and reason of framed binary files, batch or stream.

    files: `path` and `content`, as the binaryFile source reads them, also from readStream. What follows a
    frame that can't be read is not trusted: it gives one row with the reason.
    """
    columns = ["path", "frame_index", "source_index", "x", "y", "z", "reason"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                frame, reason = 0, None
                frames = read_framed(io.BytesIO(content or b""))
                while reason is None:
                    try:
                        xyz = next(frames)
                    except StopIteration:
                        break
                    except ValueError as e:
                        xyz, reason = None, str(e)
                    n = 1 if xyz is None else len(xyz)
                    body = [pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.float32()) for _ in "xyz")] if xyz is None else [pa.array(np.arange(n)), *(pa.array(np.ascontiguousarray(xyz[:, i])) for i in range(3))]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([frame] * n, pa.int64()), *body, pa.array([reason] * n, pa.string())], columns)
                    frame += 1

    return files.select("path", "content").mapInArrow(work, "path string, frame_index bigint, source_index bigint, x float, y float, z float, reason string")
