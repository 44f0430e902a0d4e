"""Progress as streams: throttling and parallel merges with state by operation; batch twins for tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

INTERVAL_MS = 100  # the interval between reports
THROTTLED = "operation long, seq long, ms long, bytes long"
MERGED = "operation long, bytes long, workers long, file string"


def _kept(rows: pd.DataFrame, last: int | None, interval: int) -> tuple[list[int], int | None]:
    """Row numbers that are reported: the first, forced ones, and those an interval or more after the last reported."""
    out = []
    for i, (ms, force) in enumerate(zip(rows["ms"], rows["force"], strict=True)):
        if force or last is None or ms - last >= interval:
            out.append(i)
            last = int(ms)
    return out, last


def throttled_stream(events: DataFrame, interval: int = INTERVAL_MS) -> DataFrame:
    """events: operation, seq, ms, bytes, force. State: when each operation last reported."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ms", "seq"])
        last = state.get[0] if state.exists else None
        keep, last = _kept(rows, last, interval)
        state.update((last,))
        yield rows.iloc[keep][["operation", "seq", "ms", "bytes"]]

    return events.groupBy("operation").applyInPandasWithState(step, THROTTLED, "last_ms long", "append", "NoTimeout")


def throttled(events: DataFrame, interval: int = INTERVAL_MS) -> DataFrame:
    """The same over a table. An operation's rows stream through one task in order; only the last time is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple = (None, None)
        for rows in batches:
            for operation, own in rows.groupby("operation", sort=False):
                keep, last = _kept(own, held[1] if held[0] == operation else None, interval)
                held = (operation, last)
                yield own.iloc[keep][["operation", "seq", "ms", "bytes"]]

    dealt = events.select("operation", "seq", "ms", "bytes", "force").repartition("operation").sortWithinPartitions("operation", "ms", "seq")
    return dealt.mapInPandas(run, THROTTLED)


def merged_stream(events: DataFrame) -> DataFrame:
    """events: operation, worker, seq, bytes, file. After each batch, the sum of every worker's largest counter, and the latest file."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        workers, counters, seq, file = state.get if state.exists else ([], [], -1, "")
        held = dict(zip(workers, counters, strict=True))
        for rows in batches:
            for worker, most in rows.groupby("worker")["bytes"].max().items():
                held[worker] = max(held.get(worker, 0), int(most))
            newest = rows.loc[rows["seq"].idxmax()]
            if newest["seq"] > seq:
                seq, file = int(newest["seq"]), newest["file"]
        state.update((list(held), list(held.values()), seq, file))
        yield pd.DataFrame({"operation": [key[0]], "bytes": [sum(held.values())], "workers": [len(held)], "file": [file]})

    return events.groupBy("operation").applyInPandasWithState(step, MERGED, "workers array<string>, counters array<long>, seq long, file string", "update", "NoTimeout")
