"""Streaming forms of the missing-product state and of change detection (an extension)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.operators.merge import compare, merge_snapshot
from tallyforge.operators.quality import CONFIRMED_MISSING

STATE = "misses long"
OUTPUT = "key string, seq long, evidence string, misses long, state string"


def _state_of(misses: int, warning_at: int, candidate_at: int) -> str:
    return "MISSING_CANDIDATE" if misses >= candidate_at else "WARNING" if misses >= warning_at else "WATCH" if misses else "ACTIVE"


def stream_missing_states(observations: DataFrame, warning_at: int = 2, candidate_at: int = 3) -> DataFrame:
    """Per observation (key, seq, evidence, guarded) the confirmed misses so far and the state.

    The count per key is kept in the state store; rows of a micro-batch are taken in order of seq, so
    the result is that of operators.quality.missing_states if batches arrive in that order.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        misses = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq")
        counts = []
        for evidence, guarded in zip(rows["evidence"], rows["guarded"], strict=True):
            misses = 0 if evidence == "SEEN" else misses + int(evidence in CONFIRMED_MISSING and not guarded)
            counts.append(misses)
        state.update((misses,))
        yield pd.DataFrame({
            "key": rows["key"].to_numpy(), "seq": rows["seq"].to_numpy(), "evidence": rows["evidence"].to_numpy(), "misses": counts,
            "state": [_state_of(n, warning_at, candidate_at) for n in counts],
        })

    return observations.groupBy("key").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and key, with a watermark for late rows."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def versioned_merge(read: Callable[[int], DataFrame | None], write: Callable[[DataFrame, int, str], Any], keys: list[str], values: list[str], observed_at) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: merge each micro-batch into the next table version and append its changes.

    read(batch) gives the version before a batch (None at first), write(df, batch, table) stores
    "current" or "changes"; writing is by batch number, so a repeated batch overwrites itself.
    """

    def merge(batch: DataFrame, number: int) -> None:
        before = read(number)
        if before is None:
            write(batch.select(*keys, *values, observed_at.alias("last_changed_at")), number, "current")
            return
        current = before.select(*keys, *values)
        changes = compare(current, batch.select(*keys, *values), keys, {"all": values}).filter("status in ('NEW', 'CHANGED')")
        write(changes.select(*keys, "status"), number, "changes")
        write(merge_snapshot(before, batch.select(*keys, *values), keys, values, observed_at), number, "current")

    return merge
