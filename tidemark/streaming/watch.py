"""The debounced change stream: windows of processing time that open with their first event.

A window opens at the first change that no window covers, lasts a fixed time from it, and
later changes neither extend nor align it. At its end the distinct tracked paths come
out, sorted; a window without tracked paths gives nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scalars import UNTRACKED, excluded

WINDOW_MS = 250
OUTPUT = "root string, opened long, paths array<string>"
STATE = "opened long, paths array<string>"


def tracked(changes: DataFrame) -> DataFrame:
    """Changes outside the store and version control; other ignore rules don't apply to watching."""
    return changes.where(~excluded(F.col("path"), UNTRACKED))


def debounced(changes: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """(root, opened, paths) for a stream of (root, path); state is one window for each watched root."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            opened, paths = state.get
            state.remove()
            yield pd.DataFrame({"root": [key[0]], "opened": [opened], "paths": [sorted(set(paths))]})
            return
        now = state.getCurrentProcessingTimeMs()
        opened, paths = state.get if state.exists else (now, [])
        new = {p for b in batches for p in b["path"]}
        if state.exists and now >= opened + window_ms:  # the window's end passed before its timer fired
            yield pd.DataFrame({"root": [key[0]], "opened": [opened], "paths": [sorted(set(paths))]})
            opened, paths = now, []
        state.update((opened, sorted({*paths, *new})))
        state.setTimeoutDuration(max(1, opened + window_ms - now))

    return tracked(changes).groupBy("root").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(changes: DataFrame, on_paths: Callable[[str, list[str]], None], checkpoint: str | None = None, window_ms: int = WINDOW_MS) -> StreamingQuery:
    """Call on_paths(root, paths) for each window until the query is stopped."""

    def sink(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("opened").toLocalIterator():
            on_paths(row["root"], row["paths"])

    writer = debounced(changes, window_ms).writeStream.foreachBatch(sink).trigger(processingTime=f"{window_ms} milliseconds")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def distinct_peers(beacons: DataFrame) -> DataFrame:
    """A bounded stream of beacons with one row for each address, the first to arrive."""
    return beacons.dropDuplicates(["addr"])
