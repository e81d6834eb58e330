"""What the operators share: reading tables, bounded samples by hash, and Arrow batches."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackscan.session import materialize, prepare, shared_root  # noqa: F401

#: Steps of the hash that samples are cut by.
GRAIN = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null where doc_id is."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def share(key: Column, part: float) -> Column:
    """True for about `part` of the keys, always the same ones."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(GRAIN)) < int(min(1.0, part) * GRAIN)


def fresh(df: DataFrame, n: int) -> list[str]:
    """n column names that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"_own{i}" for i in range(n + len(taken))) if c not in taken][:n]


def give_back() -> None:
    """Return this worker's freed memory to the system.

    Workers are used again by later stages, and would else keep what the largest batch of each took.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def strings(column: pa.Array) -> list[str]:
    """Texts of a column; null is empty."""
    return [x or "" for x in column.to_pylist()]
