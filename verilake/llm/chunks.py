"""Substring dedup by content-defined chunking with a gear rolling hash.

A byte is a boundary where the gear hash of the 32 bytes up to it has MASK bits of zeros at
the top, so boundaries follow the content and an insertion moves only the chunks around
it. Chunks are deduplicated by a 128-bit digest, counted before the shuffle; runs of
chunks that occur elsewhere are reported, however short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilake.llm.common import bounded_batches, cut, releasing, table

#: Bytes of the smallest and the largest chunk, and the zero bits of a boundary.
SMALLEST, LARGEST, ZEROS = 32, 512, 5
#: One 32-bit value for each byte, from a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 0) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear values of the 32 bytes up to it, the k-th last shifted by k."""
    state = GEAR[data]
    for reach in (1, 2, 4, 8, 16):
        longer = state.copy()
        longer[reach:] += state[:-reach] << np.uint32(reach)
        state = longer
    return state


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; the last chunk may be shorter than SMALLEST."""
    n = len(data)
    if not n:
        return []
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - ZEROS) == 0) + 1
    ends, start = [], 0
    for mark in marks.tolist():
        while mark - start > LARGEST:
            start += LARGEST
            ends.append(start)
        if mark - start >= SMALLEST:
            ends.append(mark)
            start = mark
    while n - start > LARGEST:
        start += LARGEST
        ends.append(start)
    if n > start:
        ends.append(n)
    return ends


@releasing
def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_128_intdigest
    for batch in batches:
        counts, nths, starts, sizes, digests = [], [], [], [], []
        for text in batch["text"]:
            raw = text.encode("utf-8", "replace") if text else b""
            ends = chunk_ends(np.frombuffer(raw, np.uint8))
            begins = [0, *ends[:-1]] if ends else []
            counts.append(len(ends))
            nths += range(len(ends))
            starts += begins
            sizes += [e - s for s, e in zip(begins, ends)]
            digests += [digest(raw[s:e]) for s, e in zip(begins, ends)]
        high = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
        low = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64).view(np.int64)
        own = {c: np.repeat(batch[c].to_numpy(np.int64), counts) for c in ("_id", "_hash", "_row")}
        yield pd.DataFrame(own | {"_nth": np.array(nths, np.int32), "_start": np.array(starts, np.int64), "_size": np.array(sizes, np.int32), "_high": high, "_low": low})


def chunks(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """_id, _hash (of the text), _row, _nth, _start, _size and the digest of every chunk; empty and null texts have none.

    _row tells rows of one id apart; it holds only within one run, so write the result
    before reading it twice. Rows with a null id are left out, as runs are named by it.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("text"))
    return own.filter("_id IS NOT NULL").mapInPandas(_chunks, "_id long, _hash long, _row long, _nth int, _start long, _size int, _high long, _low long")


def repeated_runs(docs: DataFrame, id_col="doc_id", text_col="text", run=1) -> DataFrame:
    """id, start_byte, n_bytes, n_chunks, first_doc_id and kept of every run of repeated chunks; of run bytes or more, if that is given.

    A chunk is repeated if its digest occurs at least twice. Of its occurrences the one of
    the smallest id, and in it the first, is kept. Runs break where kept changes, so a run
    with kept false can be cut out whole. Rows of one id are documents of their own, in
    order of a hash of their texts; of rows equal in both, one is kept.
    """
    found = cut(chunks(docs, id_col, text_col))
    key, place = ["_high", "_low"], ["_id", "_hash", "_row", "_nth"]
    # Written before the join, so that both sides are dealt anew and AQE can split a chunk that a third of the documents share.
    first = cut(found.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct(*place)).alias("_first")).filter("_n > 1").drop("_n"))
    repeated = found.join(first, key).select(*place, "_start", "_size", F.col("_first._id").alias("_from"), (F.struct(*place) == F.col("_first")).alias("kept"))
    order = Window.partitionBy("_id", "_row").orderBy("_nth")
    broken = (F.col("_nth") - F.lag("_nth", 1, -9).over(order) > 1) | (F.col("kept") != F.lag("kept").over(order))
    runs = repeated.withColumn("_run", F.sum(F.coalesce(broken, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    summed = runs.groupBy("_id", "_row", "_run").agg(F.min("_start").alias("start_byte"), F.sum("_size").alias("n_bytes"), F.count("*").alias("n_chunks"), F.min("_from").alias("first_doc_id"), F.first("kept").alias("kept"))
    return summed.filter(F.col("n_bytes") >= run).select(F.col("_id").alias(id_col), "start_byte", "n_bytes", "n_chunks", "first_doc_id", "kept")


def op7_chunks(spark, sf_dir):
    """Runs of repeated chunks of all documents."""
    return repeated_runs(table(spark, sf_dir, "documents"))
