"""What Python workers hold: bounded Arrow batches, few Python objects at once, memory given back after a task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to a Python worker at most, but for one long row.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bounds this session's Arrow batches by bytes, as whole batches of long texts would fill workers and executors; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > size or int(now) <= 0:
        spark.conf.set(key, size)


def values(column: pa.Array, at_once: int = 256) -> Iterator:
    """A column's values; only so many are Python objects at once, as a batch of long texts would fill a worker's memory."""
    for i in range(0, len(column), at_once):
        yield from column.slice(i, at_once).to_pylist()


def give_back() -> None:
    """Returns what a task has freed to the system; workers live on for later stages, and would hold it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)
