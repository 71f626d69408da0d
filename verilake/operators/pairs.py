"""Pair lists over samples (sample_idx, identity, embedding)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilake.functions.exprs import dot
from verilake.operators.prefix import ordered_prefix


#: Samples of an identity that are paired in one go.
BLOCK = 1024


def genuine_pairs(samples: DataFrame, block=BLOCK) -> DataFrame:
    """a, b: all pairs of one identity, a < b.

    An identity of more than block samples is cut into k blocks of about that size, and each pair of blocks is a key of its
    own, so its pairs are dealt out; a sample meets each of the k blocks once. Only ids are joined.
    """
    ids = samples.select("identity", "sample_idx").filter("identity IS NOT NULL")
    large = ids.groupBy("identity").agg(F.ceil(F.count("*") / block).cast("int").alias("_k")).filter("_k > 1")
    cut = ids.join(large, "identity", "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("sample_idx"), F.col("_k")).cast("int"))
    left = cut.select("identity", F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_k") - 1)).alias("_j"), F.col("sample_idx").alias("_x"))
    right = cut.select("identity", F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"), F.col("_own").alias("_j"), F.col("sample_idx").alias("_y"))
    met = left.join(right, ["identity", "_i", "_j"]).filter("_i < _j OR _x < _y")
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def _draw(seed: int, side: str, n):
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{side}:"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long"), n)


def _sizes(ids: DataFrame):
    """Rows, those with an identity, smallest and largest sample_idx, distinct ones, and the sum of the squared sizes of identities."""
    squares = ids.filter("identity IS NOT NULL").groupBy("identity").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    return ids.agg(F.count("*").alias("n"), F.count("identity").alias("named"), F.min("sample_idx").alias("low"), F.max("sample_idx").alias("high"), F.countDistinct("sample_idx").alias("ids")).crossJoin(squares).first()


def impostor_pairs(samples: DataFrame, n_pairs: int, seed=7) -> DataFrame:
    """a, b, draw: n_pairs distinct unordered pairs of different identities, drawn evenly; all that there are, if these are fewer.

    Two places are drawn for each number by hash; equal identities and
    repeated pairs fall out, and the first n_pairs by draw stay. How many draws it takes follows from the identities' sizes; if
    they are too few after all, the number doubles. sample_idx must be 0 .. n - 1, else it raises.
    """
    ids = samples.select("sample_idx", "identity")
    sizes = _sizes(ids)
    n, squares = sizes.n, sizes.squares or 0
    if n and (sizes.low, sizes.high, sizes.ids) != (0, n - 1, n):
        raise ValueError(f"sample_idx must number the samples 0 .. {n - 1}, found {sizes.low} .. {sizes.high}, {sizes.ids} distinct")
    most = (sizes.named**2 - squares) // 2  # pairs of different identities
    if not most or n_pairs <= 0:
        return ids.limit(0).select(F.col("sample_idx").alias("a"), F.col("sample_idx").alias("b"), F.col("sample_idx").cast("long").alias("draw"))
    wanted = min(n_pairs, most)
    # Drawing until so many of the pairs have come takes about most * log(most / (most - wanted)) hits; a draw hits with the probability 2 * most / n^2.
    hits = most * math.log(most / max(most - wanted, 0.5))
    draws = int(1.1 * hits * n * n / (2 * most)) + 64
    pairs = _drawn(ids, draws, seed, n)
    while pairs.count() < wanted:
        draws *= 2
        pairs = _drawn(ids, draws, seed, n)
    ranked = ordered_prefix(pairs.withColumns({"_one": F.lit(1).cast("long"), "_major": F.shiftright("draw", 12)}), "_major", "draw", {"_nth": "_one"})
    return ranked.filter(F.col("_nth") <= n_pairs).select("a", "b", "draw")


def _drawn(ids: DataFrame, draws: int, seed: int, n: int) -> DataFrame:
    """a, b, draw: the distinct pairs of different identities of so many draws, with their first one."""
    drawn = ids.sparkSession.range(draws).select(F.col("id").alias("draw"))
    drawn = drawn.select("draw", _draw(seed, "a", F.lit(n)).alias("x"), _draw(seed, "b", F.lit(n)).alias("y"))
    placed = drawn.join(ids.select(F.col("sample_idx").alias("x"), F.col("identity").alias("ix")), "x").join(ids.select(F.col("sample_idx").alias("y"), F.col("identity").alias("iy")), "y").filter("ix <> iy")
    return placed.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("draw").alias("draw"))


def score_pairs(pairs: DataFrame, samples: DataFrame, places=6) -> DataFrame:
    """pairs with score, the dot product, rounded once; pairs with a missing side are left out (see missing_embeddings)."""
    side = lambda name: samples.select(F.col("sample_idx").alias(name), F.col("embedding").alias(f"_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.withColumn("score", F.round(dot(F.col("_a"), F.col("_b")), places)).drop("_a", "_b")


def pair_slices(pairs: DataFrame, face_counts: DataFrame) -> DataFrame:
    """pairs once for each slice: all, and single (both one face) or multi (either more); a count of 0, the default, is in all only."""
    count = lambda side, name: face_counts.select(F.col("sample_idx").alias(side), F.col("n_faces").alias(name))
    joined = pairs.join(count("a", "_na"), "a", "left").join(count("b", "_nb"), "b", "left").fillna(0, ["_na", "_nb"])
    na, nb = F.col("_na"), F.col("_nb")
    kind = F.when((na == 0) | (nb == 0), F.lit(None)).when((na == 1) & (nb == 1), "single").otherwise("multi")
    return joined.withColumn("slice", F.explode(F.array_compact(F.array(F.lit("all"), kind)))).drop("_na", "_nb")


def unique_pair_images(pairs: DataFrame) -> DataFrame:
    """sample_idx of every endpoint, once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("sample_idx")).distinct()


def missing_embeddings(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Endpoints without a sample."""
    return unique_pair_images(pairs).join(samples.select("sample_idx"), "sample_idx", "left_anti")


def gallery_probe_split(samples: DataFrame, sort_key="sample_idx") -> DataFrame:
    """samples with role: the first of each identity is its gallery row, the others are probes."""
    first = F.row_number().over(Window.partitionBy("identity").orderBy(sort_key)) == 1
    return samples.withColumn("role", F.when(first, "gallery").otherwise("probe"))


def dataset_stats(samples: DataFrame) -> DataFrame:
    """n_ids, n_images, min, mean and max images per identity, and identities with one image."""
    per = samples.groupBy("identity").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_ids"), F.sum("n").alias("n_images"), F.min("n").alias("min_per_id"), F.avg("n").alias("mean_per_id"), F.max("n").alias("max_per_id"), F.count_if(F.col("n") == 1).alias("single_image_ids"))
