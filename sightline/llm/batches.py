"""What Python workers hold: small batches, and nothing once a partition is done."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

from sightline.llm.tokens import word_ids

#: Bytes of a batch that goes to a worker (Spark's own default is eight times as much), unless the session says otherwise.
BATCH_BYTES = "8m"
_KEY, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20

Batches = Iterator[pa.RecordBatch]


#: Pages of 4 KB that a worker may keep between partitions; more are given back.
_KEPT_PAGES = 30_000


def _release() -> None:
    """Gives freed memory back to the system; a worker lives on and serves other stages."""
    try:
        pages = int(Path("/proc/self/statm").read_text().split()[1])
    except (OSError, IndexError, ValueError):
        pages = _KEPT_PAGES + 1
    if pages <= _KEPT_PAGES:
        return
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def lean(function: Callable[[Batches], Batches], *, words: bool = False) -> Callable[[Batches], Batches]:
    """``function`` for ``mapInArrow``, in small batches; ``words``: it uses the table of words' ids, which others drop."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get(_KEY, str(_DEFAULT)).lower() in (str(_DEFAULT), f"{_DEFAULT}b", "64m", "64mb"):
        session.conf.set(_KEY, BATCH_BYTES)

    def run(batches: Batches) -> Batches:
        if not words:
            word_ids.cache_clear()
        try:
            yield from function(batches)
        finally:
            _release()

    return run
