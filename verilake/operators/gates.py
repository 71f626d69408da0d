"""Quality gates, decisions, routing and admission as expressions over signal columns.

Each function takes a DataFrame with the named signal columns and adds result columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilake.functions.exprs import HIGH, LOW


def _first_reason(*checks: tuple[Column, str]) -> Column:
    """The first check that holds; a null signal never does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in checks])


def _col(name: str) -> Column:
    return F.col(name)


def quality_gate_image(df: DataFrame, mode="hard") -> DataFrame:
    """quality_warning, the first failing reason in any mode, and quality_hard_reject, only in mode hard."""
    reason = _first_reason(
        (_col("min_image_side") < 160, "image_too_small"),
        (_col("blur_score") < 45, "image_blurry"),
        (_col("brightness") < 35, "too_dark"),
        (_col("brightness") > 225, "too_bright"),
        (_col("contrast") < 18, "low_contrast"),
    )
    return df.withColumn("quality_warning", reason).withColumn("quality_hard_reject", F.lit(mode == "hard") & F.col("quality_warning").isNotNull())


def occlusion_flags(df: DataFrame, mask=True, glasses=True, sunglasses=True) -> DataFrame:
    """has_mask, has_glasses, has_sunglasses; null ratios never fire, mask and sunglasses need a face of 64."""
    side = F.coalesce(_col("min_face_side") >= 64, F.lit(False))
    fires = lambda on, c: F.lit(on) & F.coalesce(c, F.lit(False))
    return df.withColumns(
        {
            "has_mask": side & fires(mask, _col("lower_face_v_ratio") < 0.50),
            "has_glasses": fires(glasses, _col("eye_edge_density") > 0.25),
            "has_sunglasses": side & fires(sunglasses, _col("eye_dark_ratio") < 0.60),
        }
    )


def pose_check(df: DataFrame) -> DataFrame:
    """pose_bad from five landmarks (array of [x, y]) and the box; false for fewer points or a degenerate box."""
    p = F.col("landmarks")
    w, h = _col("x2") - _col("x1"), _col("y2") - _col("y1")
    eye = F.try_divide(F.abs(p[0][1] - p[1][1]), h)
    nose = F.try_divide(F.abs(p[2][0] - (p[0][0] + p[1][0]) / 2), w)
    usable = (F.size(p) >= 5) & (w > 0) & (h > 0)
    return df.withColumn("pose_bad", F.coalesce(F.when(usable, (eye > 0.12) | (nose > 0.18)), F.lit(False)))


def quality_gate_face(df: DataFrame, mode="hard", pose_mode="soft", light_mode="soft") -> DataFrame:
    """face_reason and face_reject of the face gate.

    Occlusion always blocks, then a side under 64; a side under 72 by mode; pose and light
    by their own modes; noise by mode. Wants the flags of occlusion_flags and, where there
    are any, pose_bad, shadow_bad, uniformity_bad and noise_bad.
    """
    has = lambda name: F.coalesce(_col(name), F.lit(False)) if name in df.columns else F.lit(False)
    occluded = has("has_mask") | has("has_glasses") | has("has_sunglasses")
    small, smallish = F.coalesce(_col("min_face_side") < 64, F.lit(False)), F.coalesce(_col("min_face_side") < 72, F.lit(False))
    checks = [(occluded, "remove_occlusion", "hard"), (small, "face_too_small", "hard"), (smallish, "face_too_small", mode), (has("pose_bad"), "bad_pose", pose_mode), (has("shadow_bad"), "shadow", light_mode), (has("uniformity_bad"), "uneven_light", light_mode), (has("noise_bad"), "noisy", mode)]
    reason = _first_reason(*[(c, r) for c, r, m in checks if m != "off"])
    reject = F.coalesce(*[F.when(c, F.lit(m == "hard")) for c, _, m in checks if m != "off"], F.lit(False))
    return df.withColumns({"face_reason": reason, "face_reject": reject})


def verification_decision(similarity, high=HIGH, low=LOW) -> Column:
    """no_match without a candidate or at low or less, match from high on, else low_confidence."""
    s = similarity
    return F.when(s.isNull(), "no_match").when(s >= high, "match").when(s <= low, "no_match").otherwise("low_confidence")


def confidence_label(status, similarity, high=HIGH, low=LOW) -> Column:
    """high, medium (low included) or low, for decision statuses only."""
    label = F.when(similarity >= high, "high").when(similarity >= low, "medium").otherwise("low")
    return F.when(status.isin("match", "no_match", "low_confidence") & similarity.isNotNull(), label)


def challenge_recommended(status, margin, low=0.05, high=0.20) -> Column:
    return F.coalesce((status == "match") & (margin > low) & (margin < high), F.lit(False))


def fuse_liveness(passive, texture, behaviour) -> Column:
    """score, risk and passed of three liveness signals; missing ones count as 0, a missing passive one changes the weights."""
    t, b = F.coalesce(texture, F.lit(0.0)), F.coalesce(behaviour, F.lit(0.0))
    score = F.when(passive.isNotNull(), 0.6 * passive + 0.25 * t + 0.15 * b).otherwise(0.7 * t + 0.3 * b)
    risk = F.when(score >= 0.8, "low").when(score >= 0.6, "medium").otherwise("high")
    return F.struct(score.alias("liveness"), risk.alias("risk"), (score >= 0.859).alias("passed"))


def route_outcome(attempts: DataFrame, require_liveness=True) -> tuple[DataFrame, DataFrame]:
    """Result rows and log rows of attempts with retry, quality_rejected, spoof, live_passed, similarity, liveness, user_id.

    A retry writes no log row; rejects and spoofs are logged with similarity 0; rows
    without a user are not logged.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(flag("retry"), "retry")
        .when(flag("quality_rejected"), "quality_reject")
        .when(flag("spoof"), "spoof_detected")
        .when(F.lit(require_liveness) & ~flag("live_passed"), "spoof_detected")
        .otherwise(verification_decision(F.col("similarity")))
    )
    results = attempts.withColumn("status", status)
    zero = F.col("status").isin("quality_reject", "spoof_detected") & (flag("quality_rejected") | flag("spoof"))
    logs = results.filter((F.col("status") != "retry") & F.col("user_id").isNotNull()).withColumn("log_similarity", F.when(zero, F.lit(0.0)).otherwise(F.col("similarity")))
    return results, logs


def classify_error(message, path="worker") -> Column:
    """status, reason and terminal_state of an error message, by the mapping of the worker or of the synchronous path."""
    m = F.lower(message)
    if path == "worker":
        reason = (
            F.when(m.contains("no face") | m.contains("not detected"), "no_face")
            .when(m.contains("multiple"), "multiple_faces")
            .when(m.contains("bad crop") | m.contains("empty face crop"), "bad_crop")
            .when(m.contains("low confidence"), "low_confidence")
            .otherwise("invalid_image")
        )
        status = F.when(reason.isin("no_face", "multiple_faces"), "no_face").when(reason.isin("bad_crop", "low_confidence"), "quality_reject").otherwise("processing_failed")
        state = F.when(reason == "invalid_image", "error").otherwise("reject")
    else:
        reason = F.when(m.contains("no face"), "no_face").when(m.contains("multiple"), "multiple_faces").when(m.contains("decode") | m.contains("image"), "invalid_image").otherwise("pipeline_error")
        status, state = F.lit("processing_failed"), F.lit("error")
    return F.struct(status.alias("status"), reason.alias("reason"), state.alias("terminal_state"))


def admission_decision(df: DataFrame, max_inflight=30, max_queue=15, max_delay_ms=1500.0, degrade_ms=500.0) -> DataFrame:
    """estimated_delay_ms, reject_reason and mode of queue snapshots: queue_len, inflight, slots, throughput."""
    delay = F.greatest(_col("queue_len"), F.greatest(F.lit(0), _col("inflight") - _col("slots"))) / F.greatest(F.lit(0.1), _col("throughput")) * 1000
    out = df.withColumn("estimated_delay_ms", delay)
    d = F.col("estimated_delay_ms")
    reason = F.when(_col("inflight") >= max_inflight, "inflight_limit").when(_col("queue_len") >= max_queue, "queue_overflow").when(d >= max_delay_ms, "estimated_delay")
    return out.withColumns({"reject_reason": reason, "mode": F.when(d >= max_delay_ms, "shed").when(d >= degrade_ms, "degrade").otherwise("normal")})


def job_stale(wait_seconds, age_ms, enabled=True, max_wait=0.0, max_age_ms=0.0) -> Column:
    """Longer than a limit that is set, strictly."""
    if not enabled:
        return F.lit(False)
    late = F.lit(False)
    if max_wait > 0:
        late = late | F.coalesce(wait_seconds > max_wait, F.lit(False))
    if max_age_ms > 0:
        late = late | F.coalesce(age_ms > max_age_ms, F.lit(False))
    return late


def sweep_verdict(df: DataFrame, max_far=0.001, max_frr=0.03) -> DataFrame:
    """verdict of each row of a sweep (far, frr): ok, or the first limit it breaks."""
    return df.withColumn("verdict", F.when(F.col("far") > max_far, "far_too_high").when(F.col("frr") > max_frr, "frr_too_high").otherwise("ok"))
