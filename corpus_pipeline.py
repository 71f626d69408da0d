"""A training corpus from raw documents: toxicity, near-duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns the columns of documents; the last returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.llm import bpe, mixing, simhash, suffixes, toxicity
from verilake.llm.common import cut, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by models learned from the labelled ones."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: equal or close fingerprints, or five-word shingles alike by 0.8."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in their first place only; n_chars follows the text."""
    return suffixes.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.emit_mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the ids, and the text that they decode to."""
    tokens = bpe.encode_and_decode(docs.select("doc_id", "source", "text"))
    return tokens.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_copies),
    ("suffixes", without_repeats),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL can't express the fitted models, the hashes and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is checkpointed for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
