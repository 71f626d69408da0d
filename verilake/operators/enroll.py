"""Enrolment, hashes and encryption of reference vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilake.operators.prefix import dense_index

IV, TAG = 12, 16


def enroll_users(existing: DataFrame, external_ids: DataFrame) -> DataFrame:
    """existing (id, external_id) with a new id for each external id that is not there yet, in order of the external id."""
    fresh = external_ids.select("external_id").dropna().distinct().join(existing, "external_id", "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = dense_index(fresh, ["external_id"], "n").crossJoin(F.broadcast(top))
    return existing.select("id", "external_id").unionByName(numbered.select((F.col("n") + F.col("top") + 1).cast("long").alias("id"), "external_id"))


def enroll_replace(references: DataFrame, incoming: DataFrame) -> DataFrame:
    """One reference per user of incoming (user_id, ts, status, ...): the last with status ok; other users keep theirs."""
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id")))
    new = incoming.filter("status = 'ok'").withColumn("_n", last).filter("_n = 1").select(*references.columns)
    return references.join(new.select("user_id"), "user_id", "left_anti").select(*references.columns).unionByName(new)


def _to_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for vectors in batches:
        yield pd.Series([None if v is None else np.asarray(v, "<f4").tobytes() for v in vectors], dtype=object)


def _from_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for blobs in batches:
        yield pd.Series([None if b is None or len(b) % 4 else np.frombuffer(b, "<f4") for b in blobs], dtype=object)


def _rounded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for vectors in batches:
        yield pd.Series([None if v is None else np.round(np.asarray(v, "<f4"), 5).tobytes() for v in vectors], dtype=object)


def vector_to_bytes(column):
    """Little-endian 32-bit floats."""
    return F.pandas_udf(_to_bytes, "binary")(column)


def vector_from_bytes(column):
    """The vector of such bytes; null for a length that isn't a multiple of four."""
    return F.pandas_udf(_from_bytes, "array<float>")(column)


def vector_hash(column, rounded=False):
    """SHA-256 of the bytes; the key of a query rounds to five decimals first."""
    return F.sha2(F.pandas_udf(_rounded if rounded else _to_bytes, "binary")(column), 256)


def hash_lookup(references: DataFrame, hash_col="encrypted_hash") -> DataFrame:
    """Hashes that occur more than once, with their number of rows and smallest id; the empty hash of old rows never counts."""
    return references.filter(F.col(hash_col) != "").groupBy(hash_col).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def dedupe_references(references: DataFrame) -> DataFrame:
    """One row for each (user_id, hash); rows with the empty hash all stay."""
    real = references.filter("encrypted_hash <> ''")
    nth = F.row_number().over(Window.partitionBy("user_id", "encrypted_hash").orderBy("id"))
    return real.withColumn("_n", nth).filter("_n = 1").drop("_n").unionByName(references.filter("encrypted_hash = '' OR encrypted_hash IS NULL"))


def encrypt_vectors(df: DataFrame, key: DataFrame, column="payload", name="encrypted") -> DataFrame:
    """AES-256-GCM with a random nonce, laid out nonce, tag, ciphertext; key is a one-row table (key binary), so that no plan shows it."""
    coded = df.crossJoin(F.broadcast(key.select(F.col("key").alias("_key")))).withColumn("_e", F.aes_encrypt(column, "_key", F.lit("GCM")))
    e, n = F.col("_e"), F.octet_length("_e")
    laid = F.concat(F.substring(e, 1, IV), F.substring(e, n - TAG + 1, F.lit(TAG)), F.substring(e, F.lit(IV + 1), n - IV - TAG))
    return coded.withColumn(name, laid).drop("_e", "_key")


def decrypt_vectors(df: DataFrame, key: DataFrame, column="encrypted", name="payload") -> DataFrame:
    """The reverse; what can't be decrypted is null, to be skipped and counted."""
    joined = df.crossJoin(F.broadcast(key.select(F.col("key").alias("_key"))))
    c, n = F.col(column), F.octet_length(column)
    spark_form = F.concat(F.substring(c, 1, IV), F.substring(c, F.lit(IV + TAG + 1), n - IV - TAG), F.substring(c, IV + 1, TAG))
    return joined.withColumn(name, F.try_aes_decrypt(spark_form, F.col("_key"), F.lit("GCM"))).drop("_key")


def decrypt_failures(decrypted: DataFrame, column="encrypted", name="payload") -> DataFrame:
    """n, n_failed: vectors that were encrypted, and those of them that couldn't be decrypted."""
    return decrypted.agg(F.count(column).alias("n"), F.count_if(F.col(column).isNotNull() & F.col(name).isNull()).alias("n_failed"))
