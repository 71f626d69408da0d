"""Known answers of gates, attacks, challenges, windows, enrolment, telemetry, sources and streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verilake.functions import exprs
from verilake.functions.redact import is_biometric_key, redact_bytes, redact_fields, sanitize_result
from verilake.operators import calibration, challenge, enroll, gates, pad, telemetry, windows
from verilake.sources import files
from verilake.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("s", "status", "label"), [(0.45, "match", "high"), (0.30, "no_match", "medium"), (0.31, "low_confidence", "medium"), (0.1, "no_match", "low"), (None, "no_match", None)])
def test_decision_limits(spark, s, status, label):
    c = F.lit(s).cast("double")
    assert one(spark, gates.verification_decision(c)) == status
    assert one(spark, gates.confidence_label(F.lit(status), c)) == label


@pytest.mark.parametrize(("m", "want"), [(0.05, False), (0.06, True), (0.2, False), (None, False)])
def test_challenge_limits(spark, m, want):
    assert one(spark, gates.challenge_recommended(F.lit("match"), F.lit(m).cast("double"))) is want


def test_stale(spark):
    wait, age = F.lit(10.0), F.lit(500.0)
    assert one(spark, gates.job_stale(wait, age, False, 1, 1)) is False
    assert one(spark, gates.job_stale(wait, age, True, 10.0, 0)) is False
    assert one(spark, gates.job_stale(wait, age, True, 9.0, 0)) is True
    assert one(spark, gates.job_stale(wait, age, True, 0, 499.0)) is True


def test_retry_writes_no_log(spark):
    rows = [(1, 7, True, False, False, True, 0.9), (2, 7, False, True, False, True, 0.9), (3, None, False, False, False, True, 0.9), (4, 7, False, False, False, True, 0.9)]
    df = spark.createDataFrame(rows, "id int, user_id int, retry boolean, quality_rejected boolean, spoof boolean, live_passed boolean, similarity double")
    results, logs = gates.route_outcome(df)
    assert {r.id: r.status for r in results.collect()} == {1: "retry", 2: "quality_reject", 3: "match", 4: "match"}
    assert {r.id: r.log_similarity for r in logs.collect()} == {2: 0.0, 4: 0.9}


def frames(spark, rows):
    return spark.createDataFrame([(i, s, x, t) for i, (s, x, t) in enumerate(rows)], "frame_index long, score double, label int, attack_type string")


def test_pad(spark):
    r = pad.pad_confusion(frames(spark, [(0.6, 1, "live"), (0.4, 1, "live"), (0.55, 0, "print"), (0.45, 0, "print")]), 0.5).first()
    assert (r.apcer, r.npcer, r.acer) == (0.5, 0.5, 0.5)
    rows = [(0.9, 0, "print"), (0.7, 0, "print"), (0.2, 0, "print"), (0.1, 0, "replay"), (0.05, 0, "replay"), (0.8, 0, "cutout")]
    got = {r.attack_type: r.apcer for r in pad.apcer_per_type(frames(spark, rows), 0.5).collect()}
    assert got["print"] == pytest.approx(2 / 3) and got["replay"] == 0 and got["cutout"] == 1
    absent = {r.attack_type: r.n for r in pad.apcer_per_type(frames(spark, [(0.9, 1, "live"), (0.2, 0, "print")]), 0.5).collect()}
    assert absent == {"print": 1, "replay": 0, "cutout": 0}
    assert pad.pad_eval_at(frames(spark, [(0.9, 1, "live")]), 0.5).first().error is not None


def test_video_and_combined(spark):
    rows = [("c1", 0.3, 0, "cutout"), ("c1", 0.4, 0, "cutout"), ("c2", 0.35, 0, "cutout"), ("c2", 0.45, 0, "cutout"), ("l1", 0.9, 1, "live"), ("l1", 0.92, 1, "live"), ("l2", 0.88, 1, "live"), ("l2", 0.95, 1, "live")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "frame_index long, source string, score double, label int, attack_type string")
    got = {r.source: r for r in pad.video_scores(df).collect()}
    assert got["c1"].score == pytest.approx(0.35) and got["c1"].score_std == pytest.approx(0.05) and got["l1"].n_frames == 2
    r = pad.eval_combined(df, 0.7).first()
    assert r.strict_gap and r.video_accuracy == 1
    best = pad.recommend_threshold_pad(df, id_col="frame_index").first()
    assert 0.45 < best.threshold <= 0.88 and best.acer == 0


RESTING = dict(x1=100.0, y1=100.0, x2=200.0, y2=200.0, yaw=0.0, pitch_signal=0.5, ear=0.3, mouth_width_ratio=0.3, passive_score=1.0)


def session(spark, n, **changes):
    rows = []
    for i in range(n):
        row = dict(RESTING, challenge_id=1, idx=i)
        for at, own in changes.get("at", {}).items():
            if at == i:
                row.update(own)
        rows.append(row)
    columns = ["challenge_id", "idx", *RESTING]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], "challenge_id long, idx long, " + ", ".join(f"{c} double" for c in RESTING))


def verdict(spark, df, actions):
    return challenge.challenge_verdict(df, spark.createDataFrame([(1, actions)], "challenge_id long, actions array<string>")).first()


def test_challenge(spark):
    good = session(spark, 10, at={5: {"ear": 0.1}, 7: {"mouth_width_ratio": 0.4}})
    r = verdict(spark, good, ["blink", "smile"])
    assert r.reason == "ok" and r.confidence == pytest.approx(1.0)
    assert verdict(spark, session(spark, 3), ["blink"]).reason == "too_few_frames"
    assert verdict(spark, session(spark, 10, at={9: dict(x1=500.0, x2=600.0, y1=500.0, y2=600.0)}), ["blink"]).reason == "consistency_fail"
    assert verdict(spark, session(spark, 10), ["blink"]).reason == "actions_incomplete:blink"
    dark = session(spark, 10, at={i: {"passive_score": 0.0} | ({"ear": 0.1} if i == 5 else {}) for i in range(10)})
    r = verdict(spark, dark, ["blink"])
    assert r.reason == "below_threshold" and r.confidence == pytest.approx(0.7)
    assert [challenge.track_consistency(session(spark, n)).first().consistent for n in (8, 5)] == [True, False]


def test_geometry(spark):
    lm = [[40.0, 50.0], [60.0, 50.0], [50.0, 80.0], [45.0, 80.0], [55.0, 80.0]]
    r = challenge.frame_geometry(spark.createDataFrame([(lm, 30.0, 70.0)], "lm5 array<array<double>>, x1 double, x2 double")).first()
    assert r.yaw == 0 and r.pitch_signal == 1 and r.mouth_width_ratio == pytest.approx(10 / 40) and r.ear is None
    eye = [[-8.0, 3.0], [8.0, 3.0], [-8.0, -3.0], [8.0, -3.0]]
    points = F.array(*[F.array(*map(F.lit, p)) for p in eye])
    centre = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, challenge.eye_aspect(points, centre, F.lit(10.0))) == pytest.approx(6 / 16)
    assert one(spark, challenge.eye_aspect(F.slice(points, 1, 3), centre, F.lit(10.0))) is None


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_anchored_windows(spark):
    df = spark.createDataFrame([("k", i, at(s)) for i, s in enumerate([0, 9.999, 10, 15, 20, 21, 40])], "key string, event_id long, ts timestamp")
    got = [(r.nth, r.repeat) for r in windows.anchored_window_verdict(df, 10).orderBy("event_id").collect()]
    assert got == [(1, False), (2, True), (1, False), (2, True), (1, False), (2, True), (1, False)]
    limited = [r.repeat for r in windows.anchored_window_verdict(df, 60, limit=3).orderBy("event_id").collect()]
    assert limited == [False] * 3 + [True] * 4


def test_tokens(spark):
    issued = spark.createDataFrame([("a", at(0)), ("b", at(0))], "token string, ts timestamp")
    used = spark.createDataFrame([("a", 1, at(5)), ("a", 2, at(6)), ("b", 3, at(120)), ("c", 4, at(1)), (None, 5, at(1))], "token string, event_id long, ts timestamp")
    assert {r.event_id: r.valid for r in windows.consume_tokens(issued, used).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_enrol_and_crypto(spark):
    refs = spark.createDataFrame([(1, 1, at(0), "h1"), (2, 2, at(0), "h2")], "id long, user_id long, ts timestamp, encrypted_hash string")
    new = spark.createDataFrame([(3, 1, at(1), "h3", "ok"), (4, 1, at(2), "h4", "ok"), (5, 2, at(2), "h5", "spoof")], "id long, user_id long, ts timestamp, encrypted_hash string, status string")
    assert sorted(r.id for r in enroll.enroll_replace(refs, new).collect()) == [2, 4]
    users = enroll.enroll_users(spark.createDataFrame([(4, "u")], "id long, external_id string"), spark.createDataFrame([("u",), ("b",), ("a",), (None,)], "external_id string"))
    assert {r.external_id: r.id for r in users.collect()} == {"u": 4, "a": 5, "b": 6}
    key = spark.createDataFrame([(b"0" * 32,)], "key binary")
    coded = enroll.encrypt_vectors(spark.createDataFrame([(b"abcd",)], "payload binary"), key)
    assert bytes(enroll.decrypt_vectors(coded.drop("payload"), key).first().payload) == b"abcd" and len(coded.first().encrypted) == 4 + 28
    assert enroll.decrypt_vectors(spark.createDataFrame([(b"x" * 40,)], "encrypted binary"), key).first().payload is None


def test_calibration(spark):
    rng = np.random.default_rng(0)
    rows = [(float(s), True) for s in rng.normal(0.75, 0.05, 100)] + [(float(s), False) for s in rng.normal(0.25, 0.05, 100)]
    r = calibration.auto_calibrate(spark.createDataFrame(rows, "similarity double, is_genuine boolean")).first()
    assert 0.4 < r.high < 1 and 0.1 < r.low <= r.high and not r.low_data
    few = calibration.auto_calibrate(spark.createDataFrame(rows[:6], "similarity double, is_genuine boolean")).first()
    assert few.low_data
    s = calibration.best_separating_threshold(spark.createDataFrame([(0.9, True), (0.7, True), (0.3, False), (float("nan"), True)], "value double, clean boolean")).first()
    assert (s.threshold, s.far, s.frr) == (0.7, 0.0, 0.0) and s.gap == pytest.approx(0.4)


def test_telemetry(spark):
    rows = spark.createDataFrame([("d", float(x)) for x in (1, 2, 4)], "stage string, value_ms double")
    r = telemetry.stage_latency_table(rows).first()
    assert r.p50 == 2 and r.p95 == pytest.approx(3.8)
    snap = lambda xs: spark.createDataFrame(xs, "le double, cumulative long")
    inf = float("inf")
    assert telemetry.histogram_delta_quantile(snap([(1.0, 0), (2.0, 0), (inf, 0)]), snap([(1.0, 0), (2.0, 10), (inf, 10)]), 0.5).first().value == pytest.approx(1.5)
    assert telemetry.histogram_delta_quantile(snap([(1.0, 0), (inf, 0)]), snap([(1.0, 1), (inf, 10)]), 0.95).first().value == 1.0
    assert telemetry.histogram_delta_quantile(snap([(1.0, 5), (inf, 5)]), snap([(1.0, 5), (inf, 5)]), 0.95).first().value is None


def test_expressions(spark):
    f = lambda n, total: one(spark, exprs.uniform_frame_indices(F.lit(n), F.lit(total)))
    assert f(3, 11) == [0, 5, 10] and f(5, 1) == [0] and f(5, 0) == [] and f(10, 3) == [0, 1, 2]
    assert one(spark, exprs.redact_text(F.lit("A" * 400))) == "[REDACTED:b64]" and one(spark, exprs.redact_text(F.lit("token=abc123=="))) == "token=abc123=="
    assert one(spark, exprs.redact_text(F.lit("[" + "0.1, " * 60 + "1]"))) == "[REDACTED:array]"
    assert one(spark, exprs.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and one(spark, exprs.l2_normalize(F.array(F.lit(0.0)))) is None
    assert one(spark, exprs.client_ip(F.lit(" "), F.lit(" 1.1.1.1 , 2.2.2.2"), F.lit("h"))) == "1.1.1.1"


def test_redaction(spark):
    assert all(map(is_biometric_key, ("embedding", "EMBEDDING", "user_embedding", "face_crop_x")))
    assert not any(map(is_biometric_key, ("image_url", "align_crop_ms", "face_count")))
    changed = lambda f, doc: json.loads(one(spark, f(F.lit(json.dumps(doc)))))
    assert changed(redact_fields, {"a": {"embedding": [1, {"x": 2}]}, "n": 1, "t": ["A" * 300]}) == {"a": {"embedding": ["[REDACTED]", {"x": "[REDACTED]"}]}, "n": 1, "t": ["[REDACTED:b64]"]}
    assert changed(sanitize_result, {"a": [{"timings": 1, "b": 2}], "error": 3}) == {"a": [{"b": 2}]}
    assert one(spark, redact_fields(F.lit("{broken"))) is None
    assert [r.b for r in spark.createDataFrame([(b"abc",), (None,)], "x binary").select(redact_bytes("x").alias("b")).collect()] == ["[REDACTED:bytes:3]", None]


def test_sources(spark, tmp_path):
    for name in ("id_a/2.jpg", "id_a/1.jpg", "id_a/note.txt", "id_b/1.PNG"):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_bytes(b"x")
    got = [(r.identity, r.file) for r in files.read_identity_manifest(spark, str(tmp_path / "root")).orderBy("sample_idx").collect()]
    assert got == [("id_a", "1.jpg"), ("id_a", "2.jpg"), ("id_b", "1.PNG")]
    samples = spark.createDataFrame([(0, "a", [1.0])], "sample_idx long, identity string, embedding array<double>")
    base = str(tmp_path / "sets")
    assert files.read_samples(spark, base, "orig", 512) is None
    assert files.get_or_build_samples(spark, base, "orig", 512, lambda: samples).count() == 1 and (tmp_path / "sets/orig_det512").is_dir()
    (tmp_path / "pairs.csv").write_text("image_a,image_b,is_same,fold_id\nJo_Do_0001.jpg,Al_0002.JPG,1,3\n")
    r = files.read_pairs_csv(spark, str(tmp_path / "pairs.csv"), "/r").first()
    assert (r.a, r.b, r.label, r.fold) == ("/r/Jo_Do/Jo_Do_0001.jpg", "/r/Al/Al_0002.JPG", 1, 3)
    frame = spark.createDataFrame([("/p/live_video/a.mp4",), ("/p/Cutout Printouts/b.jpg",), ("/p/x/c.jpg",), ("/p/replay/d.txt",)], "path string")
    rows = files.pad_manifest(frame, 4).collect()
    assert len(rows) == 5 and {r.attack_type for r in rows} == {"live", "cutout"}
    (tmp_path / "art").mkdir()
    (tmp_path / "art/r_job_rows.jsonl").write_text(json.dumps({"timings": {"detect_ms": 5, "flag": True}}) + "\n")
    (tmp_path / "art/sum.json").write_text(json.dumps({"detect_ms": 99, "deep": ['{"search_ms": "7"}'], "encode_ms": True}))
    got = {(r.stage, r.value_ms) for r in files.read_benchmark_artifacts(spark, str(tmp_path / "art")).collect()}
    assert got == {("detect", 5.0), ("search", 7.0)}
    files.write_curve_csv(spark.createDataFrame([(1, 0.123456789, 0.5)], "idx long, a double, b double"), str(tmp_path / "curve"), "idx")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "curve"), header=True).collect()] == [("1", "0.123457", "0.5")]
    files.write_eval_report(spark.createDataFrame([(2, 1.5)], "z long, a double"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first().value == '{"a":1.5,"z":2}'
    files.write_pad_predictions(spark.createDataFrame([("c", True), ("c", False)], "cls string, face_detected boolean"), str(tmp_path / "pred"))
    kept, drops = files.read_pad_predictions(spark, str(tmp_path / "pred"))
    assert kept.count() == 1 and drops.first().no_face == 1


def test_all_artifacts_are_read(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a_job_rows.jsonl").write_text(json.dumps({"detect_ms": 5}) + "\n")
    (tmp_path / "deep/other.jsonl").write_text(json.dumps({"detect_ms": 6, "align_ms": 2}) + "\nbroken\n" + json.dumps({"align_ms": 3}) + "\n")
    (tmp_path / "deep/t.CSV").write_text('x.encode_ms,detect_ms,note\n4,9,"{""search_ms"": 7}"\n,8,"two\nlines"\nbad,,\n')
    got = sorted((r.stage, r.value_ms) for r in files.read_benchmark_artifacts(spark, str(tmp_path)).collect())
    assert got == [("align", 2.0), ("align", 3.0), ("detect", 5.0), ("encode", 4.0), ("search", 7.0)]


def test_streams_match_batch(spark, tmp_path):
    events = spark.createDataFrame([("k", i, at(s)) for i, s in enumerate([0, 3, 10, 12, 30, 31])], "key string, event_id long, ts timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    live = streams.events_stream(spark, str(tmp_path))
    got = {r.event_id: r.repeat for r in streams.available(streams.stream_anti_replay(live)).collect()}
    want = {r.event_id: r.repeat for r in windows.anchored_window_verdict(events, 10).collect()}
    assert got == want


def test_sessions_without_signals_and_tables_without_rows(spark):
    from verilake.operators import challenge, telemetry

    schema = "challenge_id long, idx int, x1 double, y1 double, x2 double, y2 double, yaw double, pitch_signal double, ear double, mouth_width_ratio double, passive_score double"
    frames = spark.createDataFrame([(1, i, 0.0, 0.0, 10.0, 10.0, None, None, None, None, None) for i in range(8)], schema)
    asked = spark.createDataFrame([(1, ["blink"]), (2, ["nod"])], "challenge_id long, actions array<string>")
    got = {r.challenge_id: (r.is_live, r.reason) for r in challenge.challenge_verdict(frames, asked).collect()}
    assert got == {1: (False, "actions_incomplete:blink"), 2: (False, "too_few_frames")}
    assert challenge.detect_actions(frames).collect()[0].blink is False
    names = [c for c in frames.columns if c not in ("challenge_id", "idx")]
    gathered = frames.groupBy("challenge_id").agg(F.sort_array(F.collect_list(F.struct("idx", *names))).alias("frames"))
    made = challenge.session_verdict(F.col("frames"), F.array(F.lit("blink")))
    assert gathered.select(*[c.alias(k) for k, c in made.items()]).first().reason == "actions_incomplete:blink"
    none = telemetry.slo_summary(spark.createDataFrame([], "ok boolean, latency_ms double")).first()
    assert none.n == 0 and none.error_rate is None


def test_small_metric_values_are_read(spark):
    from verilake.sources import files

    lines = spark.createDataFrame([("m 2.5e-05",), ('h_bucket{le="0.1"} 3',)], "value string")
    assert {(r.metric, r.le, r.value) for r in files.parse_metric_snapshots(lines).collect()} == {("m", None, 2.5e-05), ("h_bucket", 0.1, 3.0)}
