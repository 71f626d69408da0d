"""Memory of Python workers: bounds on what they get at once, and what they give back."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of one Arrow batch of whole texts or of packed blocks.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's default bound on the bytes of an Arrow batch, as whole texts are several times larger in Python; a bound that the caller has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "-1", str((1 << 63) - 1)):
        spark.conf.set(name, BATCH_BYTES)


def release() -> None:
    """Give free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def releasing(batches):
    """A worker's iterator function that gives free memory back at the end of its task, as an idle worker stays for a minute."""

    @functools.wraps(batches)
    def run(rows):
        yield from batches(rows)
        release()

    return run
