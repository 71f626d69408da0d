"""Exact quantiles against DuckDB's, and their plan."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from verilake.operators import quantiles


def test_exact_quantiles(spark):
    rng = random.Random(8)
    rows = [("skewed", rng.lognormvariate(0, 4)) for _ in range(130_000)] + [("ties", float(rng.randrange(7))) for _ in range(20_001)]
    rows += [("one", 3.25), ("two", 1.0), ("two", 2.0), ("signs", -1e308), ("signs", 1e308), ("signs", 0.0), ("infinite", float("inf")), ("infinite", float("inf"))]
    rows += [("nulls", None)] * 5 + [(None, 4.0), (None, 5.0), ("equal", 0.1)] + [("equal", 0.1)] * 5000
    shares = [0.0, 0.0001, 0.25, 0.5, 0.95, 0.99, 1.0]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: (r.n, list(r.p)) for r in quantiles.exact_quantiles(df, "v", shares, ["k"]).collect() if r.k is not None}
    table = pd.DataFrame(rows, columns=["k", "v"])  # noqa: F841
    expected = duckdb.sql(f"SELECT k, count(v), quantile_cont(v, {shares}) FROM table WHERE v IS NOT NULL AND k IS NOT NULL AND NOT isinf(v) GROUP BY 1".replace("FROM table", "FROM \"table\"")).fetchall()
    assert {k: (n, p) for k, n, p in expected} == {k: x for k, x in got.items() if k != "infinite"}
    assert got["infinite"] == (2, [float("inf")] * 7)
    whole = quantiles.exact_quantiles(df.filter("k = 'skewed'"), "v", [0.95]).first()
    assert (whole.n, list(whole.p)) == (130_000, [got["skewed"][1][4]])


def test_no_values(spark):
    none = spark.createDataFrame([("a", None)], "k string, v double")
    assert quantiles.exact_quantiles(none, "v", [0.5], ["k"]).count() == 0
    assert quantiles.exact_quantiles(none, "v", [0.5]).count() == 0


def test_few_values_are_put_in_order(spark):
    """No buffer of all values, and what is ordered is a small part of them."""
    df = spark.range(400_000).select((F.col("id") * 7919 % 400_009).cast("double").alias("v"))
    made = quantiles.exact_quantiles(df, "v", [0.5, 0.95])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan.replace("approx_percentile(", "").replace("percentile_approx(", "")
    values = sorted(i * 7919 % 400_009 for i in range(400_000))
    place = 399_999 * 0.5
    assert made.first().p[0] == values[int(place)] + (values[int(place) + 1] - values[int(place)]) * 0.5
