"""Sinks: result documents as JSON lines, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.plans.pipeline import to_json


def write_json_lines(result: DataFrame, path: str, detail: str = "summary") -> None:
    to_json(result, detail).select("json").write.text(path)


def stream_json_lines(result: DataFrame, path: str, detail: str = "summary") -> None:
    """What a stream of results holds, as JSON lines; a later call goes on from its checkpoint."""
    lines = to_json(result, detail).select(F.col("json").alias("value"))
    lines.writeStream.format("text").option("path", f"{path}/lines").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small report table; `most` bounds what comes to the driver, and exceeding it is an error."""
    found = rows.take(most + 1)
    if len(found) > most:
        raise ValueError(f"a report holds {most} rows at most")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found])
