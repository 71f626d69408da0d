"""Exact quantiles without gathering a group's values in one buffer.

A mergeable sketch of each group tells, for each quantile, between which two values it must lie: its error is at
most 1 / ACCURACY of the ranks, so the bounds are set twice as far apart. Then the data are read
again: what lies below the bounds is only counted, what lies above is left out, and of what lies
between (some 1 / 2500 of the ranks) equal values are added up and put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Values of groups that are ordered whole; for these the bounds could be less than a rank apart.
SMALL = 10 * ACCURACY


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys, n and p, an array of the quantiles of the values that aren't null, interpolated linearly between ranks; groups without values are left out.

    Without keys it gives one row, or none if there are no values. NaN counts as the largest value.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    edges = [min(max(q + d * 2 / ACCURACY, 0.0), 1.0) for q in shares for d in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.approx_percentile("_v", F.array(*map(F.lit, edges)), F.lit(ACCURACY)).alias("_e"))
    if not keys:
        sketch = sketch.filter("n > 0")
    if keys:  # null keys are a group as well
        own_keys = sketch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n", "_e")
        placed = counts.join(own_keys, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    else:
        placed = counts.crossJoin(sketch)
    small = F.col("n") <= SMALL
    low = lambda i: F.when(small | F.lit(edges[2 * i] == 0), F.lit(float("-inf"))).otherwise(F.col("_e")[2 * i])
    matters = lambda i: small | F.lit(edges[2 * i + 1] == 1) | (F.col("_v") <= F.col("_e")[2 * i + 1])
    # One entry for each quantile that the value matters to; all values below its bounds become one.
    own = [F.when(matters(i), F.struct(F.lit(i).alias("i"), F.when(F.col("_v") < low(i), F.lit(float("-inf"))).otherwise(F.col("_v")).alias("v"))) for i in range(len(shares))]
    near = placed.select(*keys, "n", "_c", F.explode(F.array_compact(F.array(*own))).alias("_x")).groupBy(*keys, "n", F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v")).agg(F.sum("_c").alias("_c"))
    order = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    place = (F.col("n") - 1) * F.element_at(F.array(*map(F.lit, map(float, shares))), F.col("_i") + 1)
    run = near.withColumns({"_upto": F.sum("_c").over(order), "_at": place})
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = run.groupBy(*keys, "n", "_i").agg(at(F.floor("_at")).alias("_a"), at(F.ceil("_at")).alias("_b"), F.first(F.col("_at") - F.floor("_at")).alias("_f"))
    # Equal neighbours aren't subtracted, as they may be infinite.
    value_at = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    listed = found.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("_i", value_at.alias("v")))).alias("_p"))
    return listed.select(*keys, "n", F.transform("_p", lambda x: x["v"]).alias("p"))
