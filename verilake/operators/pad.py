"""Presentation-attack evaluation over frames: source, label (1 live), attack_type, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilake.operators.recognition import curve_summary, ratio, roc_points, score_distribution, sweep_confusion

#: The attack types that always appear, and the accuracy that is asked for.
ATTACKS = ("print", "replay", "cutout")
TARGET = 0.98


def pad_confusion(frames: DataFrame, threshold: float, slices=()) -> DataFrame:
    """n, apcer, npcer, the pooled acer, accuracy and tpr; a score from the threshold on is accepted as live."""
    up, live = F.col("score") >= threshold, F.col("label") == 1
    c = {"tp": up & live, "fp": up & ~live, "tn": ~up & ~live, "fn": ~up & live}
    counts = frames.groupBy(*slices).agg(F.count("*").alias("n"), *[F.count_if(x).alias(n) for n, x in c.items()])
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    apcer, npcer = ratio(fp, fp + tn), ratio(fn, fn + tp)
    return counts.select(*slices, "n", "tp", "fp", "tn", "fn", apcer.alias("apcer"), npcer.alias("npcer"), ((apcer + npcer) / 2).alias("acer"), ratio(tp + tn, F.col("n")).alias("accuracy"), ratio(tp, tp + fn).alias("tpr"))


def apcer_per_type(frames: DataFrame, threshold: float) -> DataFrame:
    """attack_type, n, accepted, apcer and accuracy; every type appears, with 0 if it has no rows."""
    types = frames.sparkSession.createDataFrame([(t,) for t in ATTACKS], "attack_type string")
    counts = frames.filter("label = 0").groupBy("attack_type").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= threshold).alias("accepted"))
    joined = types.join(F.broadcast(counts), "attack_type", "left").fillna(0, ["n", "accepted"])
    apcer = ratio(F.col("accepted"), F.col("n"))
    return joined.select("attack_type", "n", "accepted", apcer.alias("apcer"), F.when(F.col("n") > 0, 1 - apcer).otherwise(0.0).alias("accuracy"))


def pad_eval_at(frames: DataFrame, threshold: float) -> DataFrame:
    """apcer_max over the types with rows, npcer, acer = their mean, accuracy, and an error if a class is missing."""
    top = apcer_per_type(frames, threshold).filter("n > 0").agg(F.coalesce(F.max("apcer"), F.lit(0.0)).alias("apcer_max"))
    own = pad_confusion(frames, threshold)
    both = own.crossJoin(top)
    return both.select("n", "apcer_max", "npcer", ((F.col("apcer_max") + F.col("npcer")) / 2).alias("acer"), "accuracy", F.when((F.col("tp") + F.col("fn") == 0) | (F.col("fp") + F.col("tn") == 0), "class missing").alias("error"))


def recommend_threshold_pad(frames: DataFrame, n=200, id_col="pair_id") -> DataFrame:
    """threshold, acer: the first of n thresholds with the least acer of pad_eval_at; with eer and auc."""
    bounds = frames.agg(F.coalesce(F.min("score"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("score"), F.lit(0.0)).alias("hi"))
    sweep = sweep_confusion(frames, n, slices=["attack_type"], bounds=bounds)
    attack, live = F.col("attack_type") != "live", F.col("attack_type") == "live"
    by = sweep.groupBy("idx", "threshold").agg(F.max(F.when(attack & (F.col("fp") + F.col("tn") > 0), F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")))).alias("apcer_max"), F.sum(F.when(live, F.col("fn"))).alias("fn"), F.sum(F.when(live, F.col("tp"))).alias("tp"))
    acer = (F.coalesce("apcer_max", F.lit(0.0)) + ratio(F.coalesce("fn", F.lit(0)), F.coalesce(F.col("fn") + F.col("tp"), F.lit(0)))) / 2
    best = by.select(acer.alias("acer"), "idx", "threshold").agg(F.min(F.struct("acer", "idx", "threshold")).alias("b")).select(F.col("b.threshold").alias("threshold"), F.col("b.acer").alias("acer"))
    points = roc_points(frames.withColumn("pair_id", F.col(id_col)))
    return best.crossJoin(curve_summary(points, {}))


def video_scores(frames: DataFrame) -> DataFrame:
    """Per source: mean and population deviation of the scores, n_frames, and label and type of its first frame."""
    return frames.groupBy("source").agg(
        F.avg("score").alias("score"), F.stddev_pop("score").alias("score_std"), F.count("*").alias("n_frames"), F.min_by("label", "frame_index").alias("label"), F.min_by("attack_type", "frame_index").alias("attack_type"), F.min("frame_index").alias("first_frame")
    )


def eval_pad(frames: DataFrame, threshold=0.859) -> DataFrame:
    """pad_eval_at at the present and at the recommended threshold, in one row.

    The recommended threshold goes along with the frames as a one-row table, and one aggregate by attack type counts at both.
    """
    best = recommend_threshold_pad(frames, id_col="frame_index").select(F.col("threshold").alias("_best"), "eer", "auc")
    live = F.col("label") == 1
    at = {"": F.col("score") >= threshold, "best_": F.col("score") >= F.col("_best")}
    counts = [F.count_if(up & kind).alias(f"_{name}{c}") for name, up in at.items() for c, kind in (("tp", live), ("fp", ~live))]
    types = frames.crossJoin(F.broadcast(best)).groupBy("attack_type", "_best", "eer", "auc").agg(F.count("*").alias("_n"), F.count_if(live).alias("_live"), *counts)
    spoof = F.col("_n") - F.col("_live")
    worst = lambda name: F.coalesce(F.max(F.when(F.col("attack_type").isin(*ATTACKS) & (spoof > 0), F.try_divide(f"_{name}fp", spoof))), F.lit(0.0))
    sums = [F.sum(f"_{name}{c}").alias(f"_{name}{c}") for name in at for c in ("tp", "fp")]
    whole = types.groupBy("_best", "eer", "auc").agg(F.sum("_n").alias("n"), F.sum("_live").alias("_l"), *sums, *[worst(name).alias(f"{name}apcer_max") for name in at])
    other = F.col("n") - F.col("_l")
    out = []
    for name in at:
        tp, fp = F.col(f"_{name}tp"), F.col(f"_{name}fp")
        missed = ratio(F.col("_l") - tp, F.col("_l"))
        out += [F.col(f"{name}apcer_max"), missed.alias(f"{name}npcer"), ((F.col(f"{name}apcer_max") + missed) / 2).alias(f"{name}acer"), ratio(tp + other - fp, F.col("n")).alias(f"{name}accuracy")]
    error = F.when((F.col("_l") == 0) | (other == 0), "class missing").alias("error")
    return whole.select("n", *out[:4], error, *out[4:], F.col("_best").alias("threshold"), "eer", "auc")


def separation(videos: DataFrame) -> DataFrame:
    """live_min, attack_max, whether they leave a strict gap, and mean deviation by class."""
    live = F.col("label") == 1
    out = videos.agg(F.min(F.when(live, F.col("score"))).alias("live_min"), F.max(F.when(~live, F.col("score"))).alias("attack_max"), F.avg(F.when(live, F.col("score_std"))).alias("live_std"), F.avg(F.when(~live, F.col("score_std"))).alias("attack_std"), F.min("n_frames").alias("min_frames"), F.max("n_frames").alias("max_frames"), F.avg("n_frames").alias("mean_frames"))
    return out.withColumn("strict_gap", F.coalesce(F.col("live_min") > F.col("attack_max"), F.lit(False)))


def active_gate_policy(frames: DataFrame) -> DataFrame:
    """n_attack and the rates of a gate that no recorded medium passes."""
    n = frames.filter("label = 0").agg(F.count("*").alias("n_attack"))
    return n.select("n_attack", F.lit(0).alias("spoof_accepted"), F.col("n_attack").alias("spoof_rejected"), F.lit(0.0).alias("spoof_accept_rate"), F.lit(1.0).alias("spoof_rejection_rate"), F.lit(True).alias("target_met"))


def eval_combined(frames: DataFrame, threshold=0.859) -> DataFrame:
    """Frame block, video block, separation and the target flags in one row."""
    videos = video_scores(frames)
    frame_block = pad_eval_at(frames, threshold).select(*[F.col(c).alias(f"frame_{c}") for c in ("n", "apcer_max", "npcer", "acer", "accuracy")])
    video_block = pad_eval_at(videos, threshold).select(*[F.col(c).alias(f"video_{c}") for c in ("n", "apcer_max", "npcer", "acer", "accuracy")])
    return frame_block.crossJoin(video_block).crossJoin(separation(videos)).withColumns({"frame_target_met": F.col("frame_accuracy") >= TARGET, "video_target_met": F.col("video_accuracy") >= TARGET})


def pad_score_distribution(frames: DataFrame, bins=50) -> DataFrame:
    return score_distribution(frames, bins, 0.0, 1.0)


def pad_dataset_stats(frames: DataFrame) -> DataFrame:
    """Rows by class, by attack type, by label, by medium (image, video_frame; where is_image tells) and in all, with one scan: kind, value, n."""
    columns = {"class": F.col("cls"), "attack_type": F.col("attack_type"), "label": F.col("label"), "all": F.lit("all")}
    if "is_image" in frames.columns:
        columns["medium"] = F.when(F.col("is_image"), "image").otherwise("video_frame")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in columns.items()])
    return frames.select(F.explode(kinds).alias("k")).select("k.*").groupBy("kind", "value").agg(F.count("*").alias("n"))


def face_drop_counts(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames with a face, for the metrics, and frames without by class."""
    drops = frames.groupBy("cls").agg(F.count("*").alias("n"), F.count_if(~F.col("face_detected")).alias("no_face"))
    return frames.filter("face_detected"), drops
