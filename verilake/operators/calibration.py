"""Thresholds from logs and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilake.operators.prefix import ordered_prefix
from verilake.operators.quantiles import exact_quantiles
from verilake.operators.recognition import sweep_confusion

LOW_DATA = 50


def find_best_thresholds(scored: DataFrame, n=100) -> DataFrame:
    """high: the last of n thresholds over [0, 1] with precision of .95, else .5; low: the last with precision of .5 and the best recall, else .3."""
    sweep = sweep_confusion(scored, n, 0.0, 1.0)
    high = F.max(F.when(F.col("precision") >= 0.95, F.col("threshold")))
    low = F.max(F.when(F.col("precision") >= 0.5, F.struct("recall", "threshold")))
    return sweep.agg(F.coalesce(high, F.lit(0.5)).alias("high"), F.coalesce(low["threshold"], F.lit(0.3)).alias("low"))


def auto_calibrate(log: DataFrame) -> DataFrame:
    """high, low, n and low_data from log rows (similarity, is_genuine) where both are known."""
    rows = log.filter("similarity IS NOT NULL AND is_genuine IS NOT NULL").select(F.col("similarity").alias("score"), F.col("is_genuine").cast("int").alias("label"))
    count = rows.agg(F.count("*").alias("n"))
    return find_best_thresholds(rows).crossJoin(count).withColumn("low_data", F.col("n") < LOW_DATA)


def best_separating_threshold(signals: DataFrame) -> DataFrame:
    """threshold, far, frr, gap: of the distinct values the one with the least (far, frr), the first at a tie.

    signals: value, clean (boolean). frr is the share of clean values below, far the
    share of the others from it on; NaN and null values don't count.
    """
    rows = signals.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = rows.groupBy("value").agg(F.count_if("clean").alias("c"), F.count_if(~F.col("clean")).alias("o")).withColumn("_z", F.lit(0))
    totals = rows.agg(F.count_if("clean").alias("nc"), F.count_if(~F.col("clean")).alias("no"), F.min(F.when(F.col("clean"), F.col("value"))).alias("lo"), F.max(F.when(~F.col("clean"), F.col("value"))).alias("hi"))
    run = ordered_prefix(counts, "value", "_z", {"cum_c": "c", "cum_o": "o"}).crossJoin(F.broadcast(totals))
    frr = F.when(F.col("nc") > 0, F.try_divide(F.col("cum_c") - F.col("c"), "nc")).otherwise(0.0)
    far = F.when(F.col("no") > 0, 1 - F.try_divide(F.col("cum_o") - F.col("o"), "no")).otherwise(0.0)
    best = run.agg(F.min(F.struct(far.alias("far"), frr.alias("frr"), "value")).alias("b"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return best.select(F.col("b.value").alias("threshold"), F.col("b.far").alias("far"), F.col("b.frr").alias("frr"), (F.col("lo") - F.col("hi")).alias("gap"))


def signal_stats(rows: DataFrame, signals: list[str], group="group") -> DataFrame:
    """n, min, max, mean and median of each signal in each group; NaN and null don't count."""
    stacked = rows.select(group, F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals])).alias("x")).select(group, "x.*")
    fine = stacked.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    plain = fine.groupBy(group, "signal").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    middle = exact_quantiles(fine, "value", (0.5,), [group, "signal"]).select(F.col(group).alias("_g"), F.col("signal").alias("_s"), "n", F.col("p")[0].alias("median"))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("signal") == F.col("_s"))
    return plain.join(middle, same).select(group, "signal", "n", "min", "max", "mean", "median")


def status_tally(rows: DataFrame) -> DataFrame:
    """Counts by status and reason, with the totals of each status and of all (null in the columns summed over; level tells which)."""
    return rows.rollup("status", "reason").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def reenroll_counters(rows: DataFrame) -> DataFrame:
    """Images by outcome, and users with and without an ok image."""
    per = rows.groupBy("person").agg(F.max((F.col("status") == "ok").cast("int")).alias("ok"))
    users = per.agg(F.count_if(F.col("ok") == 1).alias("users_ok"), F.count_if(F.col("ok") == 0).alias("users_fail"))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.agg(*[count(s) for s in ("ok", "spoof", "quality_reject", "error")]).crossJoin(users)
