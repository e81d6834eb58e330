"""Recordings in tar archives of SQLite parts as a Spark data source, and archive preparation."""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import tarfile
import tempfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: messages of a part in their order.
MESSAGES = "SELECT m.id, t.name, m.timestamp, m.data FROM messages m JOIN topics t ON t.id = m.topic_id ORDER BY m.timestamp, m.id"
CLOUD = "sensor_msgs/msg/PointCloud2"


def read_metadata(archive: str, prefix: str) -> dict:
    """The recording's metadata (JSON is read as the YAML it also is); ValueError where it contradicts itself."""
    with tarfile.open(archive) as tar:
        member = tar.extractfile(f"{prefix}/metadata.yaml")
        if member is None:
            raise ValueError("MISSING_METADATA")
        text = member.read().decode()
    try:
        info = json.loads(text)["bag"]
    except ValueError:
        import yaml

        info = yaml.safe_load(text)["bag"]
    clouds = [t for t in info["topics"] if t["type"] == CLOUD and t["format"] == "cdr"]
    if len(clouds) != 1:
        raise ValueError("NOT_ONE_POINT_CLOUD_TOPIC")
    if len(info["files"]) > 1 and sum(f["messages"] for f in info["files"]) != info["messages"]:
        raise ValueError("MESSAGE_COUNTS_DISAGREE")
    return info | {"topic": clouds[0]["name"]}


def offsets(files: list[dict]) -> list[tuple[str, int]]:
    """(part, number of messages in the parts before it)."""
    out, before = [], 0
    for f in files:
        out.append((f["path"], before))
        before += f["messages"]
    return out


class BagSource(DataSource):
    """spark.read.format("bagframes").option("archive", ...).option("prefix", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "bagframes"

    def schema(self) -> str:
        return "source_id string, frame_index bigint, part string, topic string, bag_ns bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Part(InputPartition):
    def __init__(self, path: str, before: int):
        self.path, self.before = path, before


class _Reader(DataSourceReader):
    """One partition for each part of the recording."""

    def __init__(self, options: dict):
        self.archive, self.prefix = options["archive"], options["prefix"]
        self.source = options.get("source_id", os.path.basename(self.archive))
        self.info = read_metadata(self.archive, self.prefix)

    def partitions(self) -> list[_Part]:
        return [_Part(path, before) for path, before in offsets(self.info["files"])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        declared = next(f["messages"] for f in self.info["files"] if f["path"] == partition.path)
        with tempfile.TemporaryDirectory() as folder:  # SQLite reads files; it goes with the task
            place = os.path.join(folder, "part.db3")
            with tarfile.open(self.archive) as tar, open(place, "wb") as out:
                shutil.copyfileobj(tar.extractfile(f"{self.prefix}/{partition.path}"), out)
            with sqlite3.connect(f"file:{place}?mode=ro", uri=True) as db:
                count = 0
                for _, topic, stamp, data in db.execute(MESSAGES):
                    if topic != self.info["topic"]:
                        continue
                    yield self.source, partition.before + count, partition.path, topic, stamp, data
                    count += 1
            if count != declared:
                raise ValueError(f"{partition.path}: {count} messages, {declared} declared")


def prepare_archive(source: str, target: str, required: list[str]) -> str:
    """A plain tar at target from a plain or zstd-compressed one, its members checked."""
    with open(source, "rb") as f:
        packed = f.read(4) == b"\x28\xb5\x2f\xfd"
    if packed:
        import zstandard

        with open(source, "rb") as f, open(target, "wb") as out:
            zstandard.ZstdDecompressor().copy_stream(f, out)
    else:
        try:
            os.link(source, target)
        except OSError:
            shutil.copyfile(source, target)
    with tarfile.open(target) as tar:
        names = tar.getnames()
    if any(n.startswith("/") or ".." in n.split("/") for n in names):
        raise ValueError("UNSAFE_MEMBER")
    missing = [n for n in required if n not in names]
    if missing:
        raise ValueError(f"MISSING_MEMBERS {missing}")
    return target
