"""Challenge sessions: geometry of frames, actions, consistency and the verdict.

Frames: challenge_id, idx, x1..y2, yaw, pitch_signal, ear, mouth_width_ratio, passive_score.
A session has at most MAX_FRAMES frames that count, so its arrays stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilake.functions.exprs import iou

#: Fixed limits of a session.
MAX_FRAMES, MIN_FRAMES, MIN_VALID, REST = 30, 6, 4, 3
AREA_CV, IOU_MIN, EAR_DIP, YAW_MIN, PITCH_MIN, SMILE_MIN, THRESHOLD = 0.25, 0.30, 0.30, 25.0, 0.10, 0.04, 0.859


def eye_aspect(points, centre, radius) -> Column:
    """Height / width of the landmarks around an eye; null under four points or a width of 2."""
    near = F.filter(points, lambda p: F.sqrt((p[0] - centre[0]) * (p[0] - centre[0]) + (p[1] - centre[1]) * (p[1] - centre[1])) <= radius)
    xs, ys = F.transform(near, lambda p: p[0]), F.transform(near, lambda p: p[1])
    w, h = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    return F.when((F.size(near) >= 4) & (w >= 2.0), F.try_divide(h, w))


def frame_geometry(frames: DataFrame) -> DataFrame:
    """yaw, pitch_signal, mouth_width_ratio from lm5 (left eye, right eye, nose, mouth corners) and the box; ear from lm106, null without."""
    p = F.col("lm5")
    left, right = p[2][0] - p[0][0], p[1][0] - p[2][0]
    wide = left + right
    lean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(left - right, wide) * 1.2))
    eye, mouth = (p[0][1] + p[1][1]) / 2, (p[3][1] + p[4][1]) / 2
    out = frames.withColumns(
        {
            "yaw": F.when(wide < 1e-6, 0.0).otherwise(F.degrees(F.asin(lean))),
            "pitch_signal": F.when(mouth - eye < 1e-6, 0.0).otherwise(F.try_divide(p[2][1] - eye, mouth - eye)),
            "mouth_width_ratio": F.when(F.col("x2") - F.col("x1") < 1, 0.0).otherwise(F.try_divide(F.abs(p[3][0] - p[4][0]), F.col("x2") - F.col("x1"))),
        }
    )
    if "lm106" not in frames.columns:
        return out.withColumn("ear", F.lit(None).cast("double"))
    gap = F.sqrt((p[0][0] - p[1][0]) * (p[0][0] - p[1][0]) + (p[0][1] - p[1][1]) * (p[0][1] - p[1][1]))
    radius = F.greatest(F.lit(4.0), gap * 0.2)
    a, b = eye_aspect(F.col("lm106"), p[0], radius), eye_aspect(F.col("lm106"), p[1], radius)
    return out.withColumn("ear", F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)))


def first_frames(frames: DataFrame) -> DataFrame:
    """The frames that count: the first MAX_FRAMES of each session, with their place n."""
    own = F.row_number().over(Window.partitionBy("challenge_id").orderBy("idx"))
    return frames.withColumn("n", own).filter(F.col("n") <= MAX_FRAMES)


def track_consistency(frames: DataFrame) -> DataFrame:
    """challenge_id, n_frames, consistent: enough frames, a steady box area and an unbroken track."""
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    rows = first_frames(frames).withColumn("box", box)
    rows = rows.withColumn("before", F.lag("box").over(Window.partitionBy("challenge_id").orderBy("n")))
    area = (F.col("box.x2") - F.col("box.x1")) * (F.col("box.y2") - F.col("box.y1"))
    b, a = F.col("before"), F.col("box")
    step = F.when(b.isNotNull(), iou(_fields(b), _fields(a), clamp=False))
    own = rows.groupBy("challenge_id").agg(F.count("*").alias("n_frames"), F.avg(area).alias("m"), F.stddev_pop(area).alias("s"), F.min(step).alias("o"))
    fine = (F.col("n_frames") >= MIN_FRAMES) & (F.col("m") > 1e-6) & (F.try_divide("s", "m") <= AREA_CV) & (F.coalesce("o", F.lit(1.0)) >= IOU_MIN)
    return own.select("challenge_id", "n_frames", F.coalesce(fine, F.lit(False)).alias("consistent"))


class _fields:
    """Fields of a struct column as attributes."""

    def __init__(self, column: Column):
        self.x1, self.y1, self.x2, self.y2 = (column[c] for c in ("x1", "y1", "x2", "y2"))


def action_columns(ear, yaw, pitch, mouth) -> dict[str, Column]:
    """blink, turn, turn_side, nod, smile from the arrays of a session's valid values, against the mean of the first three."""
    mean3 = lambda a: F.try_divide(F.aggregate(F.slice(a, 1, REST), F.lit(0.0), lambda s, x: s + x), F.least(F.lit(REST), F.size(a)))
    valid = lambda a: F.size(a) >= MIN_VALID
    blink = valid(ear) & (mean3(ear) > 1e-6) & (F.array_min(ear) <= mean3(ear) * (1 - EAR_DIP)) & (F.try_element_at(ear, F.lit(-1)) >= mean3(ear) * (1 - EAR_DIP * 0.5))
    up, down = F.array_max(yaw) - mean3(yaw), mean3(yaw) - F.array_min(yaw)
    turn = valid(yaw) & (F.greatest(up, down) >= YAW_MIN)
    side = F.when(turn, F.when((up >= YAW_MIN) & (up >= down), "right").otherwise("left")).otherwise("")
    nod = valid(pitch) & (F.greatest(F.array_max(pitch) - mean3(pitch), mean3(pitch) - F.array_min(pitch)) >= PITCH_MIN)
    smile = valid(mouth) & (F.array_max(mouth) - mean3(mouth) >= SMILE_MIN)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return {"blink": flag(blink), "turn": flag(turn), "turn_side": F.coalesce(side, F.lit("")), "nod": flag(nod), "smile": flag(smile)}


def detect_actions(frames: DataFrame) -> DataFrame:
    """challenge_id and blink, turn, nod, smile of the frames that count."""
    names = ("ear", "yaw", "pitch_signal", "mouth_width_ratio")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("n", F.col(c).cast("double").alias("v"))))), lambda s: s["v"])
    own = first_frames(frames).groupBy("challenge_id").agg(*[ordered(c).alias(c) for c in names])
    return own.select("challenge_id", *[c.alias(n) for n, c in action_columns(*map(F.col, names)).items()])


def verdict_columns(n, consistent, actions, performed: dict[str, Column], passive, threshold=THRESHOLD) -> dict[str, Column]:
    """is_live, confidence and reason of a session."""
    did = {"blink": "blink", "turn_left": "turn", "turn_right": "turn", "nod": "nod", "smile": "smile"}
    done = F.array_compact(F.array(*[F.when(performed[c], F.lit(a)) for a, c in did.items()]))
    asked = F.array_distinct(actions)
    missing = F.array_except(asked, done)
    share = F.coalesce(F.try_divide(F.size(asked) - F.size(missing), F.size(asked)), F.lit(0.0))
    score = 0.5 * share + 0.3 * F.coalesce(passive, F.lit(0.0)) + F.when(consistent, 0.2).otherwise(0.0)
    reason = (
        F.when(n < MIN_FRAMES, "too_few_frames")
        .when(~consistent, "consistency_fail")
        .when(F.size(missing) > 0, F.concat(F.lit("actions_incomplete:"), F.array_join(missing, ",")))
        .when(score >= threshold, "ok")
        .otherwise("below_threshold")
    )
    confidence = F.when(n < MIN_FRAMES, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return {"is_live": reason == "ok", "confidence": confidence, "reason": reason}


def challenge_verdict(frames: DataFrame, challenges: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """challenge_id, is_live, confidence, reason, n_frames of each challenge (challenge_id, actions)."""
    passive = first_frames(frames).groupBy("challenge_id").agg(F.avg("passive_score").alias("passive"))
    rows = challenges.join(track_consistency(frames), "challenge_id", "left").join(detect_actions(frames), "challenge_id", "left").join(passive, "challenge_id", "left")
    n = F.coalesce("n_frames", F.lit(0))
    performed = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("blink", "turn", "nod", "smile")}
    made = verdict_columns(n, F.coalesce("consistent", F.lit(False)), F.col("actions"), performed, F.col("passive"), threshold)
    return rows.select("challenge_id", *[c.alias(k) for k, c in made.items()], n.alias("n_frames"))


def _session_stages(actions, threshold):
    """The verdict from a session's frames in stages: each gives columns from those before it, by name."""
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))
    values = lambda own, c: F.transform(F.filter(own, lambda f: f[c].isNotNull()), lambda f: f[c].cast("double"))
    signals = ("ear", "yaw", "pitch_signal", "mouth_width_ratio", "passive_score")

    def lists(c):
        own = c["own"]
        areas = F.transform(own, lambda f: ((f["x2"] - f["x1"]) * (f["y2"] - f["y1"])).cast("double"))
        steps = F.transform(F.slice(own, 2, MAX_FRAMES), lambda f, i: iou(_fields(own[i]), _fields(f), clamp=False))
        return {"n": F.size(own), "areas": areas, "steps": steps} | {k: values(own, k) for k in signals}

    def parts(c):
        n, m = c["n"], c["m"]
        spread = F.sqrt(F.greatest(F.lit(0.0), mean(F.transform(c["areas"], lambda x: x * x)) - m * m))
        consistent = F.coalesce((n >= MIN_FRAMES) & (m > 1e-6) & (F.try_divide(spread, m) <= AREA_CV) & (F.coalesce(F.array_min(c["steps"]), F.lit(1.0)) >= IOU_MIN), F.lit(False))
        return {"consistent": consistent, "passive": mean(c["passive_score"])} | action_columns(*[c[k] for k in signals[:4]])

    return [
        lambda c: {"own": F.slice(c["frames"], 1, MAX_FRAMES)},
        lists,
        lambda c: {"m": mean(c["areas"])},
        parts,
        lambda c: verdict_columns(c["n"], c["consistent"], actions, c, c["passive"], threshold) | {"n_frames": c["n"]},
    ]


def session_verdict(frames, actions, threshold=THRESHOLD) -> dict[str, Column]:
    """The verdict from one array of frame structs (n, x1..y2 and the signals) in order; for sessions gathered by a stream."""
    known, made = {"frames": frames}, {}
    for stage in _session_stages(actions, threshold):
        made = stage(known)
        known |= made
    return made


def session_verdicts(sessions: DataFrame, actions, threshold=THRESHOLD) -> DataFrame:
    """sessions with their verdicts in place of their frames; each stage is a projection, so that no part is computed anew wherever it is used."""
    rows, known, made = sessions, {"frames": F.col("frames")}, {}
    for stage in _session_stages(actions, threshold):
        made = stage(known)
        rows = rows.withColumns({f"_{k}": c for k, c in made.items()})
        known |= {k: F.col(f"_{k}") for k in made}
    return rows.select(*[c for c in sessions.columns if c != "frames"], *[F.col(f"_{k}").alias(k) for k in made])
