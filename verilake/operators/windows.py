"""Ordered folds: windows anchored at their first event, single-use tokens, access to challenges, the main face.

A window anchored at an event holds all that come less than W later; the first event at W
or later opens the next one. This is neither a tumbling nor a session window: where an
event falls depends on all before it. To split a key, its distinct times are cut into blocks
of BLOCK windows' length. What a block does to the windows depends on one number, the first time at which
an event opens a new one, which lies in the block's first W, so a short table tells it. These tables, not the events,
are followed from block to block; then each block is folded by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilake.functions.exprs import area, iou

#: Length of a block in windows: the tables hold about one in so many of a key's times.
BLOCK = 64
#: Rows of one Arrow batch of results.
_ROWS = 10_000


def _blocks(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """(key, block) and an iterator of the rows of each block; rows come sorted by these, and a block may go over several batches."""
    rows = (row for batch in batches for row in zip(batch["_key"], batch["_block"], *(batch[c] for c in columns)))
    return groupby(rows, lambda row: row[:2])


def _tables(step: int):
    """What each block does, by the first time that opens a window: (upto, anchor, tail) for times up to upto; anchor is the block's last one, tail the number of events from it on."""

    def table(key, block, times: list[int], counts: list[int]) -> list[tuple]:
        n = len(times)
        after = [0] * (n + 1)  # events from each time on
        for i in range(n - 1, -1, -1):
            after[i] = after[i + 1] + counts[i]
        last, following = [0] * n, n
        for i in range(n - 1, -1, -1):
            while following > 0 and times[following - 1] >= times[i] + step:
                following -= 1
            last[i] = i if following == n else last[following]
        out: list[list] = []
        limit = (block * BLOCK + 1) * step  # the window before began before the block, so it ends before this
        for i in range(n):
            if out and out[-1][3] == times[last[i]]:
                out[-1][2] = times[i]
            else:
                out.append([key, block, times[i], times[last[i]], after[last[i]]])
            if times[i] >= limit:
                break
        out.append([key, block, _NEVER, None, after[0]])  # no time of the block opens one
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        for (key, block), rows in _blocks(batches, "_at", "_n"):
            _, _, times, counts = zip(*rows)
            out += table(key, int(block), list(map(int, times)), list(map(int, counts)))
            if len(out) >= _ROWS:
                yield pd.DataFrame(out, columns=["_key", "_block", "_upto", "_anchor", "_tail"]).astype({"_anchor": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=["_key", "_block", "_upto", "_anchor", "_tail"]).astype({"_anchor": "Int64"})

    return run


_NEVER = (1 << 63) - 1


def _entries(step: int):
    """The window that each block of a key begins in: its anchor and its events so far; null where the key begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = anchor = None
        n, out = 0, []
        for (own, block), rows in _blocks(batches, "_upto", "_anchor", "_tail"):
            if own != key:
                key, anchor, n = own, None, 0
            out.append((own, block, anchor, n))
            opens = -_NEVER if anchor is None else anchor + step
            for _, _, upto, last, tail in rows:
                if upto >= opens:
                    anchor, n = (anchor, n + tail) if pd.isna(last) else (int(last), tail)
                    break
            if len(out) >= _ROWS:
                yield pd.DataFrame(out, columns=["_key", "_block", "_at", "_n"]).astype({"_at": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=["_key", "_block", "_at", "_n"]).astype({"_at": "Int64"})

    return run


def _folded(step: int):
    """_key, _at, _anchor and _before, the number of earlier events of the window, for each time; a block's first row says which window it begins in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        for (key, _), rows in _blocks(batches, "_entry", "_at", "_n"):
            anchor, before = None, 0
            for _, _, entry, at, n in rows:
                if entry:
                    anchor, before = (None if pd.isna(at) else int(at)), n
                    continue
                if anchor is None or at - anchor >= step:
                    anchor, before = int(at), 0
                out.append((key, at, anchor, before))
                before += n
                if len(out) >= _ROWS:
                    yield pd.DataFrame(out, columns=["_key", "_at", "_anchor", "_before"])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=["_key", "_at", "_anchor", "_before"])

    return run


def anchored_window_verdict(events: DataFrame, seconds: float, limit=1, key="key", ts="ts", tie="event_id") -> DataFrame:
    """events with anchor (start of the window), nth (place in it) and repeat (nth > limit).

    limit 1 flags repeats (replays, second notifications); limit n is a rate limit, whose
    rejected events still count. Rows with a null key or time are left out.
    """
    step = int(seconds * 1_000_000)
    rows = events.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).filter(F.col(key).isNotNull() & F.col("_at").isNotNull())
    kind = rows.schema[key].dataType.simpleString()
    times = rows.groupBy(F.col(key).alias("_key"), F.expr(f"_at div {step * BLOCK}").alias("_block"), "_at").agg(F.count("*").alias("_n"))
    sorted_by = lambda df, own, *more: df.repartition(*own).sortWithinPartitions(*own, *more)
    tables = sorted_by(times, ["_key", "_block"], "_at").mapInPandas(_tables(step), f"_key {kind}, _block long, _upto long, _anchor long, _tail long")
    entries = sorted_by(tables, ["_key"], "_block", "_upto").mapInPandas(_entries(step), f"_key {kind}, _block long, _at long, _n long")
    both = entries.withColumn("_entry", F.lit(True)).unionByName(times.withColumn("_entry", F.lit(False)))
    placed = sorted_by(both, ["_key", "_block"], F.col("_entry").desc(), "_at").mapInPandas(_folded(step), f"_key {kind}, _at long, _anchor long, _before long")
    # Events of one key at one time are numbered among themselves.
    nth = F.row_number().over(Window.partitionBy("_key", "_at").orderBy(tie))
    numbered = rows.withColumnRenamed(key, "_key").withColumn("_same", nth).join(placed, ["_key", "_at"]).withColumn("nth", (F.col("_before") + F.col("_same")).cast("int"))
    return numbered.select(*[F.col("_key").alias(c) if c == key else F.col(c) for c in events.columns], "nth", (F.col("nth") > limit).alias("repeat"), F.timestamp_micros("_anchor").alias("anchor"))


def consume_tokens(issued: DataFrame, consumed: DataFrame, ttl_seconds=120) -> DataFrame:
    """consumed (token, event_id, ts) with valid: the first within ttl of the token's issue; unknown, late, early and second ones are false."""
    life = F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    live = issued.select(F.col("token").alias("_t"), F.col("ts").alias("_from"))
    hit = (F.col("token") == F.col("_t")) & (F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_from") + life)
    joined = consumed.join(live, hit, "left")
    first = F.row_number().over(Window.partitionBy("token", F.col("_t").isNotNull()).orderBy("ts", "event_id")) == 1
    return joined.withColumn("valid", F.col("_t").isNotNull() & first).select(*consumed.columns, "valid")


def challenge_access(issued: DataFrame, attempts: DataFrame, ttl_seconds=60) -> DataFrame:
    """attempts (challenge_id, event_id, ts, ws_token) with code: ok, 4410 unknown or expired, 4401 wrong token, 4409 already streaming.

    The first attempt with the right token in time opens the stream, which re-arms the time
    to live; later ones find it in use until that has passed, and then expired.
    """
    live = issued.select(F.col("challenge_id").alias("_c"), F.col("ts").alias("_from"), F.col("ws_token").alias("_w"))
    life = F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    rows = attempts.join(live, F.col("challenge_id") == F.col("_c"), "left")
    early = F.col("_c").isNotNull() & (F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_from") + life)
    right = F.coalesce(F.col("ws_token") == F.col("_w"), F.lit(False))
    rows = rows.withColumns({"_early": F.coalesce(early, F.lit(False)), "_right": right})
    opened = F.min(F.when(F.col("_early") & F.col("_right"), F.struct("ts", "event_id"))).over(Window.partitionBy("challenge_id"))
    rows = rows.withColumn("_opened", opened)
    mine = (F.col("_opened.ts") == F.col("ts")) & (F.col("_opened.event_id") == F.col("event_id"))
    after = F.struct("ts", "event_id") > F.col("_opened")
    alive = F.when(F.coalesce(after, F.lit(False)), F.col("ts") < F.col("_opened.ts") + life).otherwise(F.col("_early"))
    code = F.when(~alive, "4410").when(~F.col("_right"), "4401").when(mine, "ok").otherwise("4409")
    return rows.withColumn("code", code).select(*attempts.columns, "code")


class _Box:
    """The corners in a struct column."""

    def __init__(self, struct):
        self.x1, self.y1, self.x2, self.y2 = (struct[c] for c in ("x1", "y1", "x2", "y2"))


def select_main_face(detections: DataFrame) -> DataFrame:
    """image, det_idx, n_groups: detections that overlap a group's first by half or more are one face; the most confident of each stands for it, and the largest confidence x area wins, the first at a tie.

    An image's detections are folded into an array of groups, each its first box and its best detection.
    """
    names = ("x1", "y1", "x2", "y2", "confidence")
    face = F.struct("det_idx", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    images = detections.groupBy("image").agg(F.sort_array(F.collect_list(face)).alias("faces"))
    number = detections.schema["det_idx"].dataType.simpleString()
    group = f"struct<box: struct<x1: double, y1: double, x2: double, y2: double>, confidence: double, weight: double, det_idx: {number}>"

    def entry(box, f):
        own = _Box(f)
        return F.struct(box.alias("box"), f["confidence"].alias("confidence"), (f["confidence"] * area(own.x1, own.y1, own.x2, own.y2)).alias("weight"), f["det_idx"].alias("det_idx"))

    def add(groups, f):
        nth = F.array_position(F.transform(groups, lambda g: iou(_Box(g["box"]), _Box(f)) >= 0.5), True)
        better = F.transform(groups, lambda g, i: F.when((i + 1 == nth) & (f["confidence"] > g["confidence"]), entry(g["box"], f)).otherwise(g))
        return F.when(nth > 0, better).otherwise(F.array_append(groups, entry(F.struct(*[f[c].alias(c) for c in names[:4]]), f)))

    groups = F.aggregate("faces", F.array().cast(f"array<{group}>"), add)
    best = F.array_max(F.transform("groups", lambda g, i: F.struct(g["weight"].alias("w"), (-i).alias("i"), g["det_idx"].alias("det_idx"))))
    return images.select("image", groups.alias("groups")).select("image", best["det_idx"].alias("det_idx"), F.size("groups").cast("long").alias("n_groups"))


def first_usable_image(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per person the first image with status ok, and the images up to it, which are those that count."""
    first = images.filter("status = 'ok'").groupBy("person").agg(F.min("position").alias("first_ok"))
    seen = images.join(first, "person", "left").filter("first_ok IS NULL OR position <= first_ok")
    return images.join(first, "person").filter("position = first_ok").drop("first_ok"), seen.drop("first_ok")
