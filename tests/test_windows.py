"""Anchored windows and main faces against plain loops, and how the work on one key is dealt out."""

import datetime
import random
import time

from pyspark.sql import functions as F

from verilake.operators import windows

BASE = datetime.datetime(2024, 5, 1)


def by_hand(rows, seconds, limit):
    out, state = {}, {}
    for t, key, event in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        anchor, nth = state.get(key, (None, 0))
        if anchor is None or t - anchor >= seconds:
            anchor, nth = t, 0
        state[key] = anchor, nth + 1
        out[event] = key, anchor, nth + 1, nth + 1 > limit
    return out


def test_anchored_windows(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(9000), "dense", i) for i in range(4000)]
    rows += [(rng.randrange(900) * 5, "regular", 10_000 + i) for i in range(2000)]  # phases that never meet, many ties
    rows += [(rng.randrange(40) * 997, "sparse", 20_000 + i) for i in range(60)]
    rows += [(700 + rng.randrange(9), "one window", 30_000 + i) for i in range(50)]
    rows += [(640 * i + d, "edges", 40_000 + 10 * i + d + 3) for i in range(20) for d in (-3, 0, 3)]  # at the blocks' borders
    rows += [(-5000 + 7 * i, "before", 50_000 + i) for i in range(1500)]
    rows += [(rng.randrange(5000), f"k{rng.randrange(300)}", 60_000 + i) for i in range(1500)]
    rows += [(None, "dense", 90_000), (5, None, 90_001)]
    made = [(None if t is None else BASE + datetime.timedelta(seconds=t), k, e, "x") for t, k, e in rows]
    events = spark.createDataFrame(made, "ts timestamp, user string, event_id long, _n string").repartition(6)
    got = windows.anchored_window_verdict(events, 10, 3, key="user")
    assert got.columns == ["ts", "user", "event_id", "_n", "nth", "repeat", "anchor"]
    found = {r.event_id: (r.user, (r.anchor - BASE).total_seconds(), r.nth, r.repeat) for r in got.collect()}
    assert found == by_hand(rows, 10, 3)


def test_times_before_1970(spark):
    rows = [(-3000 + 3 * i, "k", i) for i in range(2000)]
    epoch = datetime.datetime(1970, 1, 1)
    events = spark.createDataFrame([(epoch + datetime.timedelta(seconds=t), k, e) for t, k, e in rows], "ts timestamp, key string, event_id long")
    found = {r.event_id: ((r.anchor - epoch).total_seconds(), r.nth) for r in windows.anchored_window_verdict(events, 10).collect()}
    assert found == {e: x[1:3] for e, x in by_hand(rows, 10, 1).items()}


def test_one_key_is_dealt_out(spark):
    """A million events of one key: in linear time, in blocks over all tasks; what is followed in one task is a small part of them."""

    def seconds(n):
        events = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1_300_000).alias("ts"))
        start = time.time()
        row = windows.anchored_window_verdict(events, 10).agg(F.count("*").alias("n"), F.sum("nth").alias("s"), F.count_if("repeat").alias("r")).first()
        # A window of 10 s holds 8 events, 1.3 s apart.
        assert (row.n, row.r) == (n, n - n // 8) and row.s == n // 8 * 36
        return time.time() - start

    seconds(80_000)
    few, many = seconds(250_000), seconds(1_000_000)
    assert many < 8 * few
    times = spark.range(100_000).select(F.lit("k").alias("_key"), F.expr(f"id * 1300000 div {10_000_000 * windows.BLOCK}").alias("_block"), (F.col("id") * 1_300_000).alias("_at"), F.lit(1).alias("_n"))
    dealt = times.repartition(8, "_key", "_block").sortWithinPartitions("_key", "_block", "_at")
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 25_000
    tables = dealt.mapInPandas(windows._tables(10_000_000), "_key string, _block long, _upto long, _anchor long, _tail long")
    assert tables.count() < 100_000 / 20


def test_no_events(spark):
    events = spark.createDataFrame([], "ts timestamp, key string, event_id long")
    assert windows.anchored_window_verdict(events, 10).collect() == []


def test_main_faces(spark):
    rng = random.Random(6)
    rows = []
    for image in range(300):
        for i in range(rng.randint(1, 7)):
            x, y = rng.choice([0.0, 3.0, 40.0, 44.0]), rng.choice([0.0, 2.0, 30.0])
            rows.append((image, i, x, y, x + rng.choice([10.0, 12.0, 0.0, -4.0]), y + rng.choice([10.0, 11.0]), rng.choice([0.5, 0.7, 0.9, None])))
    expected = {}
    size = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    for image in range(300):
        faces = []
        for _, i, *box, c in sorted(r for r in rows if r[0] == image):
            for f in faces:
                a = f["first"]
                inner = max(0.0, min(a[2], box[2]) - max(a[0], box[0])) * max(0.0, min(a[3], box[3]) - max(a[1], box[1]))
                union = size(a) + size(box) - inner
                if union > 0 and inner / union >= 0.5:
                    f["all"].append((c or 0.0, -i, size(box)))
                    break
            else:
                faces.append({"first": box, "all": [(c or 0.0, -i, size(box))]})
        tops = [max(f["all"]) for f in faces]
        top = max(c * s for c, _, s in tops)
        expected[image] = next(-i for c, i, s in tops if c * s == top), len(faces)
    table = spark.createDataFrame(rows, "image long, det_idx long, x1 double, y1 double, x2 double, y2 double, confidence double").repartition(5)
    assert {r.image: (r.det_idx, r.n_groups) for r in windows.select_main_face(table).collect()} == expected
