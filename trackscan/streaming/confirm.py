"""Streaming confirmation: the state of each source survives between micro-batches (T-1 to T-3).

Frames of a source are decided by rising stamp within a batch. A frame of the stamp decided last
repeats that decision, an unknown frame resets the streaks, and a frame older than the last stamp is
dropped: the batch operators know no late frames, so this rule is an extension.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "source_id {0}, frame_index bigint, header_ns bigint, model_streak bigint, early_streak bigint, model_confirmed boolean, early_confirmed boolean"
STATE = "last_ns bigint, model_streak bigint, early_streak bigint, model_confirmed boolean, early_confirmed boolean"


def confirm_stream(frames: DataFrame, model_frames: int = 2, early_frames: int = 3) -> DataFrame:
    """Decisions of streamed frames (source_id, frame_index, header_ns, model, early); null flags are unknown."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ms, es, mc, ec = state.get if state.exists else (None, 0, 0, None, None)
        rows = pd.concat(list(batches)).sort_values(["header_ns", "frame_index"], kind="stable")
        out = []
        for r in rows.itertuples():
            if last is not None and r.header_ns < last:
                continue
            if last is None or r.header_ns > last:
                last = r.header_ns
                unknown = pd.isna(r.model) or pd.isna(r.early)
                ms = 0 if unknown or not r.model else ms + 1
                es = 0 if unknown or not r.early else es + 1
                mc = None if unknown else ms >= model_frames
                ec = None if unknown else es >= early_frames
            out.append((key[0], r.frame_index, r.header_ns, ms, es, mc, ec))
        state.update((last, ms, es, mc, ec))
        yield pd.DataFrame(out, columns=["source_id", "frame_index", "header_ns", "model_streak", "early_streak", "model_confirmed", "early_confirmed"])

    kind = frames.schema["source_id"].dataType.simpleString()
    return frames.groupBy("source_id").applyInPandasWithState(run, OUT.format(kind), STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str) -> None:
    """Write what is there to a Parquet table, and stop; a later call goes on from its checkpoint."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
