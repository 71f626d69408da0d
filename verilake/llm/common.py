"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.functions.memory import BATCH_BYTES, bounded_batches, release, releasing  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def rows_at_once(spark: SparkSession, n: int):
    """At most n rows in an Arrow batch of what is run inside; for rows of several MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir or the context.

    Where none is set, local mode, as in tests, gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="verilake-"))
            held = context._jsc.sc().getCheckpointDir()
        base = held.get()
    return base


#: Row groups of tables whose rows have several MB. Parquet looks at the size of a group after 100 rows first, and reads a group's binary column at once.
BIG_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1}


def cut(df: DataFrame, big_rows: bool = False) -> DataFrame:
    """df as a table written to the shared folder, which cuts its lineage. Parquet is several times smaller than a checkpoint of rows."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/verilake-{uuid.uuid4().hex}"
    df.write.options(**(BIG_ROWS if big_rows else {})).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._verilake_path = path
    return written


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut has written, once what was made of them is written itself."""
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._verilake_path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Bits of the filter that may_be_in sends along: at most 1024 bitmaps of 4 KB, whatever the number of keys.
FILTER_BITS = 1 << 25


def may_be_in(df: DataFrame, column: str, keys: DataFrame, flag: str) -> DataFrame:
    """df with a boolean flag: false only where the hash in column isn't among the long hashes of keys (one column).

    The bitmaps have a fixed size, so they can be broadcast. With very many keys most
    bits are set and the flag tells little; it spares work, and a join must follow.
    """
    place = lambda c: F.pmod(F.col(c), F.lit(FILTER_BITS))
    (name,) = keys.columns
    bits = keys.select(place(name).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_bits"))
    joined = df.join(F.broadcast(bits), F.bitmap_bucket_number(place(column)) == F.col("_bucket"), "left")
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(flag, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0 (null ids: 0 as well)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))
