"""Search by the metric index against plain matrix products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verilake.operators import search

SCHEMA = "sample_idx long, identity long, embedding array<float>"


def table(spark, vectors, first=0):
    rows = [(first + i, i % 50, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def clustered(rng, n, centres, spread=0.15):
    v = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, centres.shape[1]))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def by_hand(p, g, k, first, least=-np.inf):
    scores = np.round(p.astype(float) @ g.astype(float).T, search.PLACES)
    out = set()
    for i, row in enumerate(scores):
        order = [j for j in np.lexsort((np.arange(len(row)), -row))[:k] if row[j] >= least]
        out |= {(i, r + 1, first + j, row[j]) for r, j in enumerate(order)}
    return out


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    return clustered(rng, 700, centres), clustered(rng, 6000, centres)


def test_same_rows_as_all_pairs(spark, sets):
    p, g = sets
    probes, gallery = table(spark, p), table(spark, g, 1000)
    for k, least in ((1, None), (5, None), (2, 0.9)):
        got = {(r.probe_idx, r["rank"], r.sample_idx, r.similarity) for r in search.top_k_search(probes, gallery, k, least).collect()}
        assert got == by_hand(p, g, k, 1000, -np.inf if least is None else least)


def test_exhaustive_search(spark, sets):
    p, g = sets
    got = {(r.probe_idx, r["rank"], r.sample_idx, r.similarity) for r in search.exhaustive_search(table(spark, p), table(spark, g, 1000), 3).collect()}
    assert got == by_hand(p, g, 3, 1000)


def test_most_pairs_are_not_looked_at(spark, sets):
    p, g = sets
    made = search.products(table(spark, p), table(spark, g, 1000), 5)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    assert made.agg(F.sum("n")).first()[0] < 0.25 * len(p) * len(g)


def test_vectors_of_any_length(spark):
    rng = np.random.default_rng(5)
    g = rng.normal(size=(900, 6)).astype(np.float32) * rng.uniform(0.1, 4, (900, 1)).astype(np.float32)
    g[:5] = 0
    g[5:400] = g[5]  # one vector many times: ties go to the smaller number
    p = np.concatenate([rng.normal(size=(60, 6)), np.zeros((1, 6)), -g[5:6]]).astype(np.float32)
    got = {(r.probe_idx, r["rank"], r.sample_idx, r.similarity) for r in search.top_k_search(table(spark, p), table(spark, g), 7).collect()}
    assert got == by_hand(p, g, 7, 0)


def test_ranks(spark, sets):
    p, g = sets
    probes, gallery = table(spark, p), table(spark, g, 1000)
    scores = np.round(p.astype(float) @ g.astype(float).T, search.PLACES)
    expected = {}
    for i in range(len(p)):
        own = next((j for j in range(len(g)) if j % 50 == i % 50), None)
        expected[i] = 1 + int((scores[i] > scores[i, own]).sum() + (scores[i, :own] == scores[i, own]).sum())
    assert {r.probe_idx: r["rank"] for r in search.probe_ranks(probes, gallery).collect()} == expected
    some = search.probe_ranks(probes, gallery.filter("identity < 20"))
    assert some.filter("rank IS NULL").count() == sum(i % 50 >= 20 for i in range(len(p)))


def test_small_and_empty_galleries(spark, sets):
    p, g = sets
    probes = table(spark, p[:9])
    none = table(spark, g[:1]).limit(0)
    assert search.top_k_search(probes, none, 2).count() == 0
    assert [r["rank"] for r in search.probe_ranks(probes, none).collect()] == [None] * 9
    assert search.top_k_search(none, table(spark, g[:30]), 2).count() == 0
    got = {(r.probe_idx, r["rank"], r.sample_idx, r.similarity) for r in search.top_k_search(probes, table(spark, g[:3]), 5).collect()}
    assert got == by_hand(p[:9], g[:3], 5, 0)


def test_blocks_come_in_small_batches(spark, sets):
    """A packed block of probes has a MB at 64 numbers; a worker gets a few at once, however many a task has."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        search.top_k_search(table(spark, sets[0][:9]), table(spark, sets[1][:50]), 2)
        blocks = spark.range(40, numPartitions=1).select(F.expr("cast(repeat('x', 1048576) AS binary)").alias("p_vectors"))
        sizes = blocks.mapInPandas(lambda batches: (b.assign(n=len(b))[["n"]][:1] for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) == 40 and max(r.n for r in sizes) <= 9
    finally:
        spark.conf.set(name, before)
