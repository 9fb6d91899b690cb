"""H8, E2 on a stream: sources and tracks that fall silent, told without a new event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TOLD = "id string, status string, since timestamp"
_TOLD = "id string, status string, since_us long"


def freshness_changes(stream: DataFrame, id: Column, at: Column, fresh: Column, seconds: float) -> DataFrame:
    """Rows (id, status, since) of a stream: ``stale`` once nothing fresh has come for ``seconds`` by the clock, ``live`` when it does again.

    ``fresh`` says which rows renew: an answer that nothing changed is a contact and does not. ``since`` is the time of
    the last fresh row, null if there was none. Late rows never set it back. A source has one state row and a timer that
    fires without input; states are kept over restarts and do not expire. Rows of a batch are combined by source in the
    tasks that read them, so a source that sends very much comes to its state as a few rows.
    """

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.table(batch.columns, names=batch.schema.names).group_by("id").aggregate([("fresh_us", "max")]).rename_columns(["id", "fresh_us"]).to_batches()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (-1, "")
        if not state.hasTimedOut:
            for frame in frames:
                got = frame["fresh_us"].max()
                last = last if pd.isna(got) else max(last, int(got))
        left = last // 1000 + seconds * 1000 - state.getCurrentProcessingTimeMs()
        status = "live" if last >= 0 and left >= 0 else "stale"
        state.update((last, status))
        if status == "live":
            state.setTimeoutDuration(int(left) + 1)
        if status != told and not (status == "live" and told == ""):  # a first sign of life is no change
            yield pd.DataFrame({"id": [key[0]], "status": [status], "since_us": pd.array([last if last >= 0 else None], "Int64")})

    rows = stream.select(id.cast("string").alias("id"), F.when(fresh, F.unix_micros(at)).alias("fresh_us"))
    once = rows.mapInArrow(combined, "id string, fresh_us long")
    told = once.groupBy("id").applyInPandasWithState(step, _TOLD, "last long, told string", "update", GroupStateTimeout.ProcessingTimeTimeout)
    return told.select("id", "status", F.timestamp_micros("since_us").alias("since"))
