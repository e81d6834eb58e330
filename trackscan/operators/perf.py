"""Run measurements: histograms, latency percentiles, resources, log flags (A16-A18, V6, T-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.functions.exprs import mebibytes, percent


def parse_messages(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """rows with the parsed message `m`, or the reason `parse_error` where it isn't one; no row is lost."""
    parsed = F.from_json(F.col(text), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    own = rows.withColumn("m", parsed)
    bad = F.col(text).isNull() | F.col("m").isNull() | F.col("m._bad").isNotNull()
    return own.withColumn("parse_error", F.when(bad, "INVALID_JSON")).withColumn("m", F.when(~bad, F.col("m").dropFields("_bad")))


def histogram(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """A map of value -> count per group."""
    by = by or []
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(column), F.lit("null")), "n")))).alias("counts"))


def latency(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, exact interpolated p50, p95, p99, max and mean."""
    qs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return rows.groupBy(*(by or [])).agg(F.count(column).alias("n"), *(F.percentile(column, F.lit(q)).alias(name) for name, q in qs.items()), F.max(column).alias("max"), F.avg(column).alias("mean"))


def resources(stats: DataFrame, cpu: str = "cpu", memory: str = "memory", by: list[str] | None = None) -> DataFrame:
    """Greatest and mean processor share and MiB of texts such as '136.5%' and '883MiB / 4GiB' (A18)."""
    own = stats.withColumns({"_cpu": percent(F.col(cpu)), "_mib": mebibytes(F.col(memory))})
    return own.groupBy(*(by or [])).agg(F.max("_cpu").alias("cpu_max"), F.avg("_cpu").alias("cpu_mean"), F.max("_mib").alias("mib_max"), F.avg("_mib").alias("mib_mean"))


def log_flags(lines: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Whether any line matches each pattern (T-7)."""
    return lines.agg(*(F.coalesce(F.bool_or(F.col(text).rlike(p)), F.lit(False)).alias(name) for name, p in patterns.items()))


def summary(messages: DataFrame) -> DataFrame:
    """Latency, status and reason maps of collected messages in one row (V6)."""
    done = latency(messages, "processing_ms").withColumn("_one", F.lit(1))
    for column in ("status", "reason"):
        done = done.join(histogram(messages, column).select(F.lit(1).alias("_one"), F.col("counts").alias(f"{column}_counts")), "_one")
    return done.drop("_one")
