"""Session helpers: a local builder, worker imports, and tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "trackscan") -> SparkSession:
    """A local session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Rows in a batch for Python workers: texts are long, and workers hold a batch in several forms.
ARROW_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this repository wherever the driver was started, in small batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder for cut lineage: spark.checkpoint.dir, or a temporary one on a local master.

    A cluster without spark.checkpoint.dir is an error: executors could not see a local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="trackscan-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders written by `materialize`, by application.
_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage is cut there.

    Unlike a checkpoint the plan below runs once, columns are pruned on reading, and the table
    outlives any executor. `discard` removes what was written.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Remove all folders that `materialize` wrote in this application; results over them must be saved before."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in map(hadoop, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
