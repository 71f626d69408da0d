"""Recognition metrics over scored pairs (pair_id, score, label 1 genuine / 0 impostor).

Everything but the ROC curve itself is an aggregate of counts. The curve has one point per
sample in order of (score descending, pair_id); its running counts come from
ordered_prefix. slices names key columns by which all is done at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilake.operators.prefix import ordered_prefix


def ratio(a, b, empty=0.0) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(empty))


def rates(df: DataFrame) -> DataFrame:
    """far, frr, tar, precision, recall from tp, fp, tn, fn; 0 on empty denominators, so tar is 1 without positives."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    frr = ratio(fn, tp + fn)
    return df.withColumns({"far": ratio(fp, fp + tn), "frr": frr, "tar": 1 - frr, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})


def confusion(scored: DataFrame, threshold: float, slices=()) -> DataFrame:
    """Counts and rates at one threshold; a score from the threshold on is positive."""
    up, genuine = F.col("score") >= threshold, F.col("label") == 1
    counts = {"tp": up & genuine, "fp": up & ~genuine, "tn": ~up & ~genuine, "fn": ~up & genuine}
    return rates(scored.groupBy(*slices).agg(*[F.count_if(c).alias(n) for n, c in counts.items()]))


def f1_at_threshold(scored: DataFrame, threshold: float, slices=()) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    return confusion(scored, threshold, slices).withColumn("f1", ratio(2 * p * r, p + r))


def grid_value(i, lo, hi, n) -> Column:
    """i-th of n evenly spaced values; the last is hi itself."""
    return F.when(i == n - 1, hi).otherwise(i * ((hi - lo) / (n - 1)) + lo)


def sweep_confusion(scored: DataFrame, n=200, lo=None, hi=None, slices=(), bounds: DataFrame | None = None) -> DataFrame:
    """Confusion at each of n thresholds from lo to hi (default: the scores' own range; bounds: a one-row table of both for all slices), in one pass over the rows.

    Each row falls into the cell of the largest threshold that it reaches; counts per
    threshold are sums over the cells above.
    """
    keys = list(slices)
    if bounds is not None:
        bounds = scored.select(*keys).distinct().crossJoin(F.broadcast(bounds.select("lo", "hi"))) if keys else bounds.select("lo", "hi")
    else:
        bounds = scored.groupBy(*keys).agg((F.min("score") if lo is None else F.lit(float(lo))).alias("lo"), (F.max("score") if hi is None else F.lit(float(hi))).alias("hi"))
    joined = scored.join(bounds, keys) if keys else scored.crossJoin(F.broadcast(bounds))
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    guess = F.when(step > 0, F.floor(F.try_divide(F.col("score") - F.col("lo"), step))).otherwise(n - 1)
    guess = F.greatest(F.lit(-1), F.least(F.lit(n - 1), guess.cast("int")))
    at = joined.withColumn("_g", guess)
    s, lo_c, hi_c = F.col("score"), F.col("lo"), F.col("hi")
    value = lambda i: grid_value(i, lo_c, hi_c, n)
    g = F.col("_g")
    cell = F.when((g < n - 1) & (s >= value(g + 1)), g + 1).when((g >= 0) & (s < value(g)), g - 1).otherwise(g)
    counts = at.groupBy(*keys, cell.alias("_cell")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    grid = bounds.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    totals = counts.groupBy(*keys).agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    every = grid.join(totals, keys) if keys else grid.crossJoin(totals)
    cells = counts.withColumnRenamed("_cell", "idx")
    full = every.join(cells, [*keys, "idx"], "left")
    above = Window.partitionBy(*keys).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumns({"tp": F.coalesce(F.sum("p").over(above), F.lit(0)), "fp": F.coalesce(F.sum("q").over(above), F.lit(0))})
    full = full.withColumns({"fn": F.col("pos") - F.col("tp"), "tn": F.col("neg") - F.col("fp"), "threshold": grid_value(F.col("idx"), F.col("lo"), F.col("hi"), n)})
    return rates(full.select(*keys, "idx", "threshold", "tp", "fp", "tn", "fn"))


def roc_points(scored: DataFrame, slices=()) -> DataFrame:
    """One row per sample: slices, idx from 1, score, label, tp, fp (running), pos, neg. Null scores and labels are left out."""
    keys = list(slices)
    rows = scored.filter("score IS NOT NULL AND label IS NOT NULL").select(*keys, "pair_id", "score", "label").withColumns({"_p": (F.col("label") == 1).cast("long"), "_n": (F.col("label") != 1).cast("long")})
    run = ordered_prefix(rows, "score", "pair_id", {"tp": "_p", "fp": "_n"}, descending=True, keys=keys)
    totals = rows.groupBy(*keys).agg(F.sum("_p").alias("pos"), F.sum("_n").alias("neg"))
    run = run.join(totals, keys) if keys else run.crossJoin(F.broadcast(totals))
    return run.select(*keys, (F.col("tp") + F.col("fp")).alias("idx"), "score", "label", "tp", "fp", "pos", "neg")


def roc_curve(points: DataFrame, slices=()) -> DataFrame:
    """threshold, far, tar, frr by idx from the points: one per sample, with (0, 0) before and (1, 1) after them.

    With one class only the curve is (0, 0, inf), (1, 1, -inf). The first and the last sample's rows give the end points as well, so
    the points are made once.
    """
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    point = lambda idx, at, far, tar: F.struct(idx.cast("long").alias("idx"), at.cast("double").alias("threshold"), far.alias("far"), tar.alias("tar"))
    own = F.when(both, point(F.col("idx"), F.col("score"), F.try_divide("fp", "neg"), F.try_divide("tp", "pos")))
    n = F.col("pos") + F.col("neg")
    first = F.when(F.col("idx") == 1, point(F.lit(0), F.when(both, F.col("score") + 1).otherwise(float("inf")), F.lit(0.0), F.lit(0.0)))
    last = F.when(F.col("idx") == n, point(n + 1, F.when(both, F.col("score") - 1).otherwise(float("-inf")), F.lit(1.0), F.lit(1.0)))
    made = points.select(*slices, F.explode(F.array_compact(F.array(own, first, last))).alias("_p"))
    return made.select(*slices, "_p.*").withColumn("frr", 1 - F.col("tar"))


def collapse_ties(points: DataFrame, slices=()) -> DataFrame:
    """The textbook curve: the last point of each score only."""
    keys = list(slices)
    last = points.groupBy(*keys, "score").agg(F.max(F.struct("idx", "label", "tp", "fp", "pos", "neg")).alias("m"))
    return last.select(*keys, F.col("m.idx").alias("idx"), "score", *[F.col(f"m.{c}").alias(c) for c in ("label", "tp", "fp", "pos", "neg")])


def auc(points: DataFrame, slices=()) -> DataFrame:
    """Area under the curve of all samples; 0.5 if a class is missing."""
    area = F.try_divide(F.sum(F.when(F.col("label") != 1, F.col("tp")).otherwise(0)), F.max("pos") * F.max("neg"))
    return points.groupBy(*slices).agg(F.when((F.max("pos") > 0) & (F.max("neg") > 0), area).otherwise(0.5).alias("auc"))


def tar_at_far(curve: DataFrame, target: float, slices=(), name="tar_at_far") -> DataFrame:
    """Largest tar, then largest threshold, among the points with far up to the target."""
    best = F.max(F.when(F.col("far") <= target, F.struct("tar", "threshold")))
    return curve.groupBy(*slices).agg(best.alias("b")).select(*slices, F.col("b.tar").alias(name), F.col("b.threshold").alias(f"{name}_threshold"))


def eer_point(curve: DataFrame, slices=()) -> DataFrame:
    """The first point at which far and frr are closest."""
    best = F.min(F.struct(F.abs(F.col("far") - F.col("frr")).alias("d"), "idx", "far", "frr", "threshold"))
    return curve.groupBy(*slices).agg(best.alias("b")).select(*slices, ((F.col("b.far") + F.col("b.frr")) / 2).alias("eer"), F.col("b.threshold").alias("eer_threshold"))


def curve_summary(points: DataFrame, targets: dict[str, float], slices=()) -> DataFrame:
    """slices, auc, eer, eer_threshold and, for each of targets {name: FAR}, name and name_threshold: what auc, eer_point and tar_at_far give, by one aggregate over the points.

    The curve's end points aren't made: they are compared with the best of the others.
    """
    far, tar = F.try_divide("fp", "neg"), F.try_divide("tp", "pos")
    frr = 1 - tar
    own = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.struct(F.abs(far - frr).alias("d"), "idx", far.alias("far"), frr.alias("frr"), F.col("score").alias("threshold")))
    area = F.try_divide(F.sum(F.when(F.col("label") != 1, F.col("tp")).otherwise(0)), F.max("pos") * F.max("neg"))
    best = {name: F.max(F.when((F.col("pos") > 0) & (F.col("neg") > 0) & (far <= target), F.struct(tar.alias("tar"), F.col("score").alias("threshold")))).alias(f"_{name}") for name, target in targets.items()}
    summed = points.groupBy(*slices).agg(F.max("score").alias("_hi"), F.min("score").alias("_lo"), F.count("*").alias("_n"), (F.min((F.col("pos") > 0) & (F.col("neg") > 0))).alias("_both"), area.alias("_area"), F.min(own).alias("_eer"), *best.values())
    infinite = F.lit(float("inf"))
    hi, lo = F.when(F.col("_both"), F.col("_hi") + 1).otherwise(infinite), F.when(F.col("_both"), F.col("_lo") - 1).otherwise(-infinite)
    end = lambda idx, far, frr, at: F.struct(F.lit(1.0).alias("d"), idx.cast("long").alias("idx"), F.lit(far).alias("far"), F.lit(frr).alias("frr"), at.alias("threshold"))
    eer = F.least(F.col("_eer"), end(F.lit(0), 0.0, 1.0, hi), end(F.col("_n") + 1, 1.0, 0.0, lo))
    out = [F.when(F.col("_both"), F.col("_area")).otherwise(0.5).alias("auc"), ((eer["far"] + eer["frr"]) / 2).alias("eer"), eer["threshold"].alias("eer_threshold")]
    for name, target in targets.items():
        ends = [F.struct(F.lit(0.0).alias("tar"), hi.alias("threshold")), *([F.struct(F.lit(1.0).alias("tar"), lo.alias("threshold"))] if target >= 1 else [])]
        top = F.greatest(F.col(f"_{name}"), *ends) if len(ends) else F.col(f"_{name}")
        out += [top["tar"].alias(name), top["threshold"].alias(f"{name}_threshold")]
    return summed.select(*slices, *out)


def _target_name(target: float) -> str:
    return "tar_at_far_" + f"{target:g}".replace(".", "_")


def _best_f1(scored: DataFrame, n: int) -> DataFrame:
    """low: the first of n thresholds with the best F1."""
    p, r = F.col("precision"), F.col("recall")
    f1 = sweep_confusion(scored, n).withColumn("f1", ratio(2 * p * r, p + r))
    return f1.agg(F.max(F.struct("f1", (-F.col("idx")).alias("first"), "threshold")).alias("b")).select(F.col("b.threshold").alias("low"))


def recommend_thresholds(scored: DataFrame, target=0.001, n=200) -> DataFrame:
    """high at the target FAR, low at the first best F1 of n thresholds, margin and the EER threshold."""
    curve = curve_summary(roc_points(scored), {"t": target}).select(F.col("t_threshold").alias("high"), "eer", "eer_threshold")
    return curve.crossJoin(_best_f1(scored, n)).select("high", "low", "eer", "eer_threshold", margin().alias("margin"))


def margin() -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col("high") - F.col("low"), F.col("high")))


def score_distribution(scored: DataFrame, bins=50, lo=-1.0, hi=1.0) -> DataFrame:
    """Genuine and impostor counts of each bin, left-closed, the last one closed; outside values are dropped, empty bins kept."""
    spark = scored.sparkSession
    step = (hi - lo) / bins
    edge = lambda i: F.when(i == bins, F.lit(hi)).otherwise(i * step + lo)
    s = F.col("score")
    g = F.least(F.lit(bins - 1), F.floor((s - lo) / step).cast("int"))
    rows = scored.filter((s >= lo) & (s <= hi)).withColumn("_g", g)
    g = F.col("_g")
    rows = rows.withColumn("bin", F.when((g < bins - 1) & (s >= edge(g + 1)), g + 1).when(s < edge(g), g - 1).otherwise(g))
    counts = rows.groupBy("bin").agg(F.count_if(F.col("label") == 1).alias("genuine"), F.count_if(F.col("label") != 1).alias("impostor"))
    empty = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = empty.join(F.broadcast(counts), "bin", "left")
    return full.select("bin", edge(F.col("bin")).alias("left_edge"), F.coalesce("genuine", F.lit(0)).alias("genuine"), F.coalesce("impostor", F.lit(0)).alias("impostor"))


def eval_1to1(scored: DataFrame, current=0.45, targets=(0.001, 0.01)) -> DataFrame:
    """One row: counts, TAR at each target, EER, AUC, recommended thresholds and the rates at the current one; an error if there are no pairs of one kind."""
    names = {_target_name(t): t for t in targets}
    up, genuine = F.col("score") >= current, F.col("label") == 1
    counts = scored.agg(F.count("*").alias("n_pairs"), F.count_if(genuine).alias("n_genuine"), F.count_if(F.col("label") == 0).alias("n_impostor"), *[F.count_if(c).alias(k) for k, c in (("_tp", up & genuine), ("_fp", up & ~genuine), ("_tn", ~up & ~genuine), ("_fn", ~up & genuine))])
    tp, fp, tn, fn = (F.col(c) for c in ("_tp", "_fp", "_tn", "_fn"))
    error = F.when((F.col("n_genuine") == 0) | (F.col("n_impostor") == 0), "no genuine or impostor pairs")
    summary = curve_summary(roc_points(scored), names | {"_high": 0.001}).withColumnRenamed("_high_threshold", "high").drop("_high")
    joined = counts.crossJoin(summary).crossJoin(_best_f1(scored, 200))
    curve = [c for name in names for c in (name, f"{name}_threshold")]
    return joined.select("n_pairs", "n_genuine", "n_impostor", error.alias("error"), *curve, "auc", "high", "low", "eer", "eer_threshold", margin().alias("margin"), ratio(fp, fp + tn).alias("current_far"), ratio(fn, tp + fn).alias("current_frr"))


def subset_metrics(scored: DataFrame, slices=("slice",), targets=(0.001, 0.01)) -> DataFrame:
    """TAR at the targets, AUC and EER of every slice in one pass; error where a class is missing."""
    keys = list(slices)
    points = roc_points(scored, keys)
    sizes = scored.filter("score IS NOT NULL AND label IS NOT NULL").groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("n_genuine"), F.count_if(F.col("label") != 1).alias("n_impostor"))
    out = sizes.join(curve_summary(points, {_target_name(t): t for t in targets}, keys), keys)
    return out.withColumn("error", F.when((F.col("n_genuine") == 0) | (F.col("n_impostor") == 0), "class missing"))


def fold_accuracy(scored: DataFrame) -> DataFrame:
    """Per fold the best accuracy over the thresholds at its own scores; mean and population deviation over the folds."""
    points = collapse_ties(roc_points(scored, ["fold"]), ["fold"])
    best = points.groupBy("fold").agg(F.max(F.try_divide(F.col("tp") + F.col("neg") - F.col("fp"), F.col("pos") + F.col("neg"))).alias("best"))
    return best.agg(F.count("*").alias("n_folds"), F.avg("best").alias("mean_accuracy"), F.coalesce(F.stddev_pop("best"), F.lit(0.0)).alias("std_accuracy"))


def cmc_curve(ranks: DataFrame, max_rank=50, gallery: DataFrame | None = None) -> DataFrame:
    """rank, accuracy from probe ranks (rank, null if the identity isn't in the gallery): the share found within each rank, up to max_rank and the gallery's size."""
    total = ranks.agg(F.count("*").alias("n"))
    counts = ranks.filter(F.col("rank") <= max_rank).groupBy("rank").agg(F.count("*").alias("c"))
    steps = ranks.sparkSession.range(1, max_rank + 1).select(F.col("id").alias("rank"))
    if gallery is not None:
        size = gallery.agg(F.count("*").alias("_size"))
        steps = steps.crossJoin(F.broadcast(size)).filter("rank <= _size").drop("_size")
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(F.broadcast(counts), "rank", "left").crossJoin(total).select("rank", ratio(F.coalesce(F.sum("c").over(run), F.lit(0)), F.col("n")).alias("accuracy"))
