"""Memory of Python workers, which Spark keeps for the tasks of later stages.

A worker holds memos (hashes of words, ids of chunks, automata) only for the kind of task that it runs: a
task of another kind clears them first. What a task freed goes back to the system at its end, and Arrow
batches are bounded by bytes, so that long texts come in small batches.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch on its way to Python (one row at least).
BATCH_BYTES = 4 << 20

#: How to empty the memos of each kind of task.
_CLEAR: dict[str, Callable[[], None]] = {}


def memo(kind: str, clear: Callable[[], None]) -> None:
    """Name a memo of this worker and the way to empty it."""
    _CLEAR[kind] = clear


#: Kinds of the task before this one.
_LAST: list[tuple[str, ...]] = [()]


def claim(*kinds: str) -> None:
    """Empty all memos but those of these kinds; where the kind of task changes, their memory goes back at once."""
    for k, clear in _CLEAR.items():
        if k not in kinds:
            clear()
    if _LAST[0] != kinds:
        _LAST[0] = kinds
        trim()


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own ways


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *kinds: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that keeps only the memos of these kinds and trims at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(*kinds)
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; their session sends batches of at most BATCH_BYTES to Python from now on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
