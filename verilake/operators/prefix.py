"""Prefix sums and dense numbers over a whole table, without one task for all rows.

Rows are ordered by a major and then a minor column. Three levels add up to a row's
place: totals of smaller major values (one row each, in buckets cut at quantiles of the
major column), totals of lower minor buckets of the same major value, and the sum
inside one such cell. So neither many rows nor one hot value meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quantile buckets of the major column, and bits of the minor column inside one cell.
BUCKETS, CELL_BITS = 256, 12


def _edges(df: DataFrame, column: str, n: int) -> list[float]:
    """At most n quantile edges, the only values that reach the driver."""
    shares = [i / n for i in range(1, n)]
    found = df.agg(F.approx_percentile(F.col(column).cast("double"), F.array(*map(F.lit, shares)), F.lit(1000)).alias("e")).first().e
    return sorted(set(found or []))


def _bucket(column: str, edges: list[float]):
    """Number of edges up to the value; a search over a constant array."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(column)))


def ordered_prefix(df: DataFrame, major: str, minor: str, sums: dict[str, str], descending=False, keys=()) -> DataFrame:
    """df with a column for each of sums, {name: column}: the running sum in order of (major, minor), the row included, within keys.

    Minor values must be whole numbers. Rows equal in both take any order among them.
    """
    keys = list(keys)
    edges = _edges(df, major, BUCKETS)
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    rows = df.withColumn("_cell", F.shiftright(F.col(minor).cast("long"), CELL_BITS))
    names = [f"_t_{n}" for n in sums]
    zero = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    again = [F.sum(t).alias(t) for t in names]
    cells = rows.groupBy(*keys, major, "_cell").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    majors = cells.groupBy(*keys, major).agg(*again).withColumn("_bucket", _bucket(major, edges))
    buckets = majors.groupBy(*keys, "_bucket").agg(*again)
    buckets = buckets.select(*keys, "_bucket", *[zero(t, Window.partitionBy(*keys).orderBy(way("_bucket"))).alias(f"{t}_b") for t in names])
    majors = majors.select(*keys, "_bucket", major, *[zero(t, Window.partitionBy(*keys, "_bucket").orderBy(way(major))).alias(f"{t}_m") for t in names]).join(buckets, [*keys, "_bucket"])
    cells = cells.select(*keys, major, "_cell", *[zero(t, Window.partitionBy(*keys, major).orderBy("_cell")).alias(f"{t}_c") for t in names]).join(majors.drop("_bucket"), [*keys, major])
    offsets = cells.select(*keys, major, "_cell", *[(F.col(f"{t}_c") + F.col(f"{t}_m") + F.col(f"{t}_b")).alias(t) for t in names])
    inside = Window.partitionBy(*keys, major, "_cell").orderBy(minor).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({f"_i_{n}": F.sum(c).over(inside) for n, c in sums.items()}).join(offsets, [*keys, major, "_cell"])
    return summed.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_t_{n}")).alias(n) for n in sums])


#: Rows of the sample from which dense_index takes its splitters.
SAMPLE = 4096


def _splitters(df: DataFrame, columns: list[str]) -> list:
    """At most BUCKETS - 1 distinct rows (columns), in order, that cut df into ranges of about one size; from a sample by hash, so that they are the same each time."""
    sample = df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(SAMPLE)
    rows = sample.orderBy(*columns).collect()  # at most SAMPLE rows
    return list(dict.fromkeys(rows[i * len(rows) // BUCKETS] for i in range(1, BUCKETS))) if rows else []


def _range_of(own, edges: list):
    """Number of edges, in order, up to the value, by halving: eight comparisons for 255 edges."""

    def within(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(edges[mid] <= own, within(mid + 1, high)).otherwise(within(low, mid))

    return within(0, len(edges))


def dense_index(df: DataFrame, columns: list[str], name="sample_idx") -> DataFrame:
    """A number 0 .. n - 1 in order of the columns.

    Rows are cut into ranges of about one size at splitters from a sample. A range's rows are numbered by
    themselves, from the number of rows in the ranges before it on; these are at most BUCKETS counts.
    """
    kinds = [df.schema[c].dataType for c in columns]
    edges = [F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(row, kinds, columns)]) for row in _splitters(df, columns)]
    rows = df.withColumn("_range", _range_of(F.struct(*columns), edges))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*columns)) - 1
    return rows.withColumn("_nth", nth).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_range", "_nth", "_before")
