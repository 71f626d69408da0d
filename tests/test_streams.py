"""Stateful streams against plain folds, in one batch and in many; what is left of the state when the last timer has fired."""

import datetime
import random

import pytest

from verilake.streaming import streams

BASE = datetime.datetime(2024, 5, 1)
SECOND = 1_000_000


def micros(t: datetime.datetime) -> int:
    return round((t - BASE).total_seconds() * SECOND)


@pytest.fixture
def feed(spark, tmp_path):
    """Rows (seconds first) written as files in order of time, and read as a stream, one file a batch or all at once."""

    def build(rows, schema, files=1):
        rows = sorted(rows, key=lambda r: r[0])
        folder = f"{tmp_path}/in-{random.random()}"
        for k in range(files):
            part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
            random.Random(k).shuffle(part)
            made = [(BASE + datetime.timedelta(seconds=r[0]), *r[1:]) for r in part]
            spark.createDataFrame(made, f"ts timestamp, {schema}").coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(f"ts timestamp, {schema}").option("maxFilesPerTrigger", 1 if files > 1 else 1000).parquet(folder)

    return build


def state_rows(spark, place: str, name: str) -> int:
    with streams.rocksdb_state(spark):
        return spark.read.format("statestore").option("path", f"{place}/state").option("stateVarName", name).load().count()


def anchored(rows, seconds, limit):
    out, state = {}, {}
    for t, key, event in sorted(rows, key=lambda r: (r[0], r[2])):
        anchor, nth = state.get(key, (None, 0))
        if anchor is None or t - anchor >= seconds:
            anchor, nth = t, 0
        state[key] = anchor, nth + 1
        out[event] = nth + 1, nth + 1 > limit
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_windows(spark, feed, tmp_path, files):
    rng = random.Random(1)
    rows = [(float(rng.randrange(400)), rng.choice("abcd"), i) for i in range(300)]
    rows += [(90.0, "hot", 1000 + i) for i in range(3000)]  # ties in time, by event_id
    rows += [(5000.0, "end", 9000), (5000.0, None, 9001)]  # moves the watermark beyond all windows but its own
    stream = feed(rows, "key string, event_id long", files)
    place = f"{tmp_path}/run{files}"
    got = streams.available(streams.stream_rate_limit(stream, 3, 10), place=place).collect()
    expected = anchored([r for r in rows if r[1]], 10, 3)
    if files == 1:
        assert {r.event_id: (r.nth, r.repeat) for r in got} == expected
    assert len(got) == len(expected)
    # Of keys and timers only the last event's are left.
    assert state_rows(spark, place, "window") == 1


def sessions_by_hand(rows, idle, total, watermark):
    """(challenge, start, frames that count) of the sessions that have ended; in whole microseconds."""
    idle, total, watermark = (round(x * SECOND) for x in (idle, total, watermark))
    out = []
    for key in sorted({r[1] for r in rows}):
        own = sorted((round(r[0] * SECOND), r[2], r[3]) for r in rows if r[1] == key)
        start = last = None
        count, done = 0, False
        for t, _, x1 in own:
            if start is not None and (t - last >= idle or t - start >= total):
                if not done:
                    out.append((key, start, count))
                start = None
            if start is None:
                start, count, done = t, 0, False
            last = t
            if not done and x1 is not None:
                count += 1
                if count == 30:
                    out.append((key, start, 30))
                    done = True
        if not done and min(last + idle, start + total) <= watermark:
            out.append((key, start, count))
    return sorted(out)


FRAME = "challenge_id long, idx long, x1 double, y1 double, x2 double, y2 double, yaw double, pitch_signal double, ear double, mouth_width_ratio double, passive_score double"


def frame(t, key, idx, face=True):
    box = (10.0, 10.0, 60.0, 60.0) if face else (None,) * 4
    return (t, key, idx, *box, 0.0, 0.5, 0.1 if 3 <= idx % 30 < 5 else 0.3, 0.3, 1.0)


@pytest.mark.parametrize("files", [1, 5])
def test_sessions(spark, feed, tmp_path, files):
    rng = random.Random(2)
    rows = [frame(i * 0.005, 1, i) for i in range(10_000)]  # 50 seconds, 30 frames count
    rows += [frame(i * 1.0, 2, i, i % 3 == 0) for i in range(100)]  # 60 seconds end it, frames without a face keep it alive
    rows += [frame(t, 3, i) for i, t in enumerate([0.0, 1, 2, 7, 8, 20.5])]  # 5 seconds end it
    rows += [frame(float(i), 4, i, False) for i in range(8)]  # no face at all
    t = 0.0
    for i in range(300):
        t += rng.choice([0.2, 0.5, 1.0, 4.9, 5.0, 6.0])
        rows.append(frame(round(t, 1), 5, i, rng.random() < 0.8))
    rows.append(frame(20_000.0, 9, 0))
    place = f"{tmp_path}/run{files}"
    got = streams.available(streams.stream_challenge_sessions(feed(rows, FRAME, files), ["blink"]), place=place).collect()
    expected = sessions_by_hand([r[:4] for r in rows], 5.0, 60.0, 20_000 - 600)
    assert sorted((r.challenge_id, micros(r.start), r.n_frames) for r in got) == expected
    first = next(r for r in got if r.challenge_id == 1)
    assert (first.n_frames, first.reason) == (30, "ok") or first.reason.startswith("actions")
    assert [r.n_frames for r in got if r.challenge_id == 4] == [0]
    assert state_rows(spark, place, "session") == 1 and state_rows(spark, place, "frames") == 1


@pytest.mark.parametrize("files", [1, 3])
def test_jobs(spark, feed, tmp_path, files):
    rows = [
        (0.0, 1, "accepted"), (10.0, 1, "claimed"), (20.0, 1, "done"), (30.0, 1, "claimed"),  # gone 300 s later
        (0.0, 2, "accepted"), (400.0, 2, "claimed"), (500.0, 2, "done"),  # expired at 300, gone at 600
        (0.0, 3, "accepted"), (300.0, 3, "error"),  # just in time
        (0.0, 4, "done"), (300.0, 4, "accepted"),  # gone, then anew, then expired
        (5.0, 5, "unknown"), (5.0, 6, None),
        (9000.0, 7, "accepted"),
    ]
    place = f"{tmp_path}/run{files}"
    got = streams.available(streams.stream_job_lifecycle(feed(rows, "job_id long, status string", files)), place=place).collect()
    base = int((BASE - datetime.datetime(1970, 1, 1)).total_seconds())
    assert sorted((r.job_id, r.since / SECOND - base, r.status) for r in got) == [
        (1, 0.0, "accepted"), (1, 10.0, "claimed"), (1, 20.0, "done"), (1, 320.0, "gone"),
        (2, 0.0, "accepted"), (2, 300.0, "expired"), (2, 600.0, "gone"),
        (3, 0.0, "accepted"), (3, 300.0, "error"), (3, 600.0, "gone"),
        (4, 0.0, "done"), (4, 300.0, "accepted"), (4, 300.0, "gone"), (4, 600.0, "expired"), (4, 900.0, "gone"),
        (7, 9000.0, "accepted"),
    ]
    assert state_rows(spark, place, "job") == 1


def test_tokens_and_webhooks(spark, feed, tmp_path):
    issued = feed([(0.0, "a"), (0.0, "b"), (5.0, "c"), (0.0, None), (900.0, "a")], "token string")
    consumed = feed([(10.0, "a", 1), (11.0, "a", 2), (120.0, "b", 3), (4.0, "c", 4), (5.0, "c", 5), (7.0, "x", 6), (950.0, "a", 7), (9.0, None, 8)], "token string, event_id long")
    place = f"{tmp_path}/tokens"
    got = streams.available(streams.stream_token_consume(issued, consumed), place=place).collect()
    assert sorted((r.token, r.event_id) for r in got) == [("a", 1), ("a", 7), ("c", 5)]
    notices = feed([(0.0, 1, 10), (3599.0, 1, 11), (3600.0, 1, 12), (7300.0, 1, 13), (5.0, 2, 14)], "job_id long, event_id long")
    sent = streams.available(streams.stream_webhook_dedup(notices)).collect()
    assert sorted((r.job_id, r.event_id) for r in sent) == [(1, 10), (1, 12), (1, 13), (2, 14)]


def test_timers_and_lists_by_bucket(spark, feed, tmp_path, monkeypatch):
    """Of 3,000 live keys the store has a list and a timer for each bucket, not for each key."""
    monkeypatch.setattr(streams, "BUCKETS", 8, raising=False)
    rows = [(float(i % 50), f"k{i}", i) for i in range(3000)]
    place = f"{tmp_path}/run"
    got = streams.available(streams.stream_rate_limit(feed(rows, "key string, event_id long"), 3, 100), place=place)
    assert sorted((r.key, r.event_id, r.nth, r.repeat) for r in got.collect()) == sorted((f"k{i}", i, 1, False) for i in range(3000))
    assert state_rows(spark, place, "window") == 3000
    with streams.rocksdb_state(spark):
        store = spark.read.format("statestore").option("path", f"{place}/state")
        assert store.option("stateVarName", "window").option("flattenCollectionTypes", "false").load().count() <= 8
        assert spark.read.format("statestore").option("path", f"{place}/state").option("readRegisteredTimers", "true").load().count() <= 8


@pytest.mark.parametrize("files", [1, 4])
def test_sessions_keep_nulls(spark, feed, tmp_path, files):
    """A null signal stays null in the state and beyond, NaN stays NaN; the verdict in stages is that in one expression."""
    from pyspark.sql import functions as F

    from verilake.operators import challenge
    from verilake.streaming import processors

    rows = [(float(i), 1, i, 10.0, 10.0, 60.0, 60.0, 0.0, 0.5, None if i % 2 else 0.3, 0.3, float("nan") if i == 3 else 1.0) for i in range(12)]
    rows.append(frame(9000.0, 2, 0))
    got = streams.available(streams.stream_challenge_sessions(feed(rows, FRAME, files), ["blink"]), place=f"{tmp_path}/run{files}").collect()
    frames = [tuple(r[3:]) for r in rows[:12]]
    one = spark.createDataFrame([(frames,)], f"frames array<struct<{', '.join(f'{c}: double' for c in processors.SIGNALS)}>>")
    made = one.select(*[c.alias(k) for k, c in challenge.session_verdict(F.col("frames"), F.array(F.lit("blink"))).items()]).first()
    assert [(r.is_live, str(r.confidence), r.reason, r.n_frames) for r in got] == [(made.is_live, str(made.confidence), made.reason, made.n_frames)]
