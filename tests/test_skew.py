"""Large identities, hot names and sums: what one task gets of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verilake.operators import enroll, pairs, prefix, search


def test_pairs_of_a_large_identity_are_dealt_out(spark):
    samples = spark.range(20_000).select(F.col("id").alias("sample_idx"), F.when(F.col("id") < 19_900, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 30).cast("string"))).alias("identity"))
    wanted = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as with tables that can't be broadcast
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        tasks = [r.n for r in pairs.genuine_pairs(samples).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    total = 19_900 * 19_899 // 2 + sum(c * (c - 1) // 2 for c in (4 if i < 10 else 3 for i in range(30)))
    assert sum(tasks) == total and max(tasks) < 0.05 * total


def test_pairs_in_blocks_are_the_same(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "sample_idx long, identity string")
    expected = sorted((i, j) for i, x in rows for j, y in rows if i < j and x == y and x is not None)
    for block in (7, 1024):
        assert sorted(map(tuple, pairs.genuine_pairs(df, block).collect())) == expected


def test_impostors_when_one_identity_has_half_of_all(spark):
    df = spark.range(400).select(F.col("id").alias("sample_idx"), F.when(F.col("id") % 2 == 0, "big").otherwise(F.col("id").cast("string")).alias("identity"))
    for wanted in (300, 50_000, 200 * 200 + 200 * 199 // 2):
        got = pairs.impostor_pairs(df, wanted).collect()
        assert len({(r.a, r.b) for r in got}) == len(got) == wanted
        assert all(r.a < r.b and (r.a % 2 or r.b % 2) for r in got)
    again = {tuple(r) for r in pairs.impostor_pairs(df.repartition(7), 300).collect()}
    assert again == {tuple(r) for r in pairs.impostor_pairs(df, 300).collect()}
    with pytest.raises(ValueError, match="sample_idx"):
        pairs.impostor_pairs(df.filter("sample_idx <> 17"), 10)
    assert pairs.impostor_pairs(df.withColumn("identity", F.lit(None).cast("string")), 10).count() == 0


def test_names_with_one_beginning_are_dealt_out(spark):
    names = [f"user_{i:05}" for i in range(5000)]
    df = spark.createDataFrame([(n,) for n in names], "external_id string").repartition(6)
    assert len(prefix._splitters(df, ["external_id"])) == prefix.BUCKETS - 1
    made = prefix.dense_index(df, ["external_id"], "n")
    sizes = made.groupBy(F.col("n").between(0, 4999)).count().collect()
    assert [tuple(r) for r in sizes] == [(True, 5000)]
    assert [r.external_id for r in made.orderBy("n").collect()] == names
    ranges = df.withColumn("r", F.size(F.filter(F.array(*[F.lit(x.external_id) for x in prefix._splitters(df, ["external_id"])]), lambda e: e <= F.col("external_id"))))
    assert ranges.groupBy("r").count().agg(F.max("count")).first()[0] < 100
    existing = spark.createDataFrame([(7, "user_00003"), (9, "other")], "id long, external_id string")
    got = {r.external_id: r.id for r in enroll.enroll_users(existing, df.unionByName(df)).collect()}
    assert got == {"other": 9, "user_00003": 7} | {n: 10 + i for i, n in enumerate(n for n in names if n != "user_00003")}


def test_dense_numbers_with_ties_and_nulls(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None, "ä"]), rng.choice([1, 2, None]), i) for i in range(3000)]
    got = prefix.dense_index(spark.createDataFrame(rows, "x string, y int, i long"), ["x", "y", "i"], "n").orderBy("n").collect()
    order = sorted(rows, key=lambda r: tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in r))
    assert [(r.x, r.y, r.i) for r in got] == order and [r.n for r in got] == list(range(3000))
    assert prefix.dense_index(spark.createDataFrame([], "x string"), ["x"], "n").count() == 0


def test_centroids(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.choice([1, 1, 1, 2, 3])), rng.normal(size=5).tolist()) for _ in range(4000)] + [(8, [1.0] * 5), (8, [-1.0] * 5), (None, [1.0] * 5), (9, None)]
    df = spark.createDataFrame(rows, "identity long, embedding array<double>").repartition(9)
    got = {r.identity: r.centroid for r in search.user_centroids(df).collect()}
    assert set(got) == {1, 2, 3, 8} and got[8] is None
    for who in (1, 2, 3):
        total = np.sum([v for i, v in rows if i == who], 0)
        assert np.allclose(got[who], total / np.linalg.norm(total), atol=2e-6)
    held = df.filter("identity = 1").select("identity", F.col("embedding").alias("vector")).mapInPandas(search._sums, "identity long, vector array<double>")
    assert held.count() <= 9  # what is shuffled: one vector for each task
