"""Streaming operators: streams in, streams out; event time with watermarks.

Late rows are dropped after the watermark: RATE_DELAY for rates, the time to live for
stateful operators. available() runs a stream over what is there now and gives the result
as a table, which is how the streams are compared with their batch twins.

Stateful operators are in processors.py.
"""

from __future__ import annotations

import contextlib
import functools
import operator
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.operators.challenge import session_verdicts
from verilake.streaming import processors

RATE_DELAY = "10 minutes"
#: Into so many buckets a stateful stream's keys are dealt; a stream that goes on from its state must keep the number.
BUCKETS = 1024
BOUNDS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000)


def events_stream(spark: SparkSession, sf_dir: str, name="events") -> DataFrame:
    """A table's files as a stream; ts is an event time."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    rows = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir or the context; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="verilake-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, outside the JVM's heap, as transformWithState asks; the session's setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def available(stream: DataFrame, mode="append", place: str | None = None) -> DataFrame:
    """Run a stream over what is there now; the result as a table in place, by default a folder of its own in the shared checkpoint folder."""
    spark = stream.sparkSession
    place = place or f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    keep = place + ("/out" if mode == "complete" else "/out/batch={}")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(keep.format(number))

    with rocksdb_state(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out").select(*stream.columns)


def stream_result_rate(log: DataFrame) -> DataFrame:
    """start, kind, value, n and per_second over 5 minutes, every minute: of all verifications (kind total), by result, and of quality rejects in all (reject) and by reason (reject_reason).

    log: ts, result, and reject_reason, null where quality rejected nothing; without that column there are no rejects.
    """
    kinds = [F.struct(F.lit("total").alias("kind"), F.lit("all").alias("value")), F.struct(F.lit("result"), F.col("result").cast("string"))]
    if "reject_reason" in log.columns:
        reason = F.col("reject_reason").cast("string")
        kinds += [F.when(reason.isNotNull(), F.struct(F.lit("reject"), F.lit("all"))), F.when(reason.isNotNull(), F.struct(F.lit("reject_reason"), reason))]
    kinds = [F.when(k.isNotNull(), k).cast("struct<kind: string, value: string>") for k in kinds]
    rows = log.withWatermark("ts", RATE_DELAY).select("ts", F.explode(F.array_compact(F.array(*kinds))).alias("k"))
    counts = rows.groupBy(F.window("ts", "5 minutes", "1 minute"), "k.kind", "k.value").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "kind", "value", "n", (F.col("n") / 300).alias("per_second"))


def bucket_quantile(counts: list, total, q: float, bounds=BOUNDS):
    """The q-quantile from bucket counts, cumulative up to each bound, by interpolation; beyond the last bound it is that bound."""
    value, steps = F.lit(float(bounds[-1])), []
    for i, (c, top) in enumerate(zip(counts, bounds)):
        steps.append((c, counts[i - 1] if i else F.lit(0), float(bounds[i - 1]) if i else 0.0, float(top)))
    for c, before, low, top in reversed(steps):
        inside = F.when(c - before <= 0, F.lit(top)).otherwise(low + F.try_divide(total * q - before, c - before) * (top - low))
        value = F.when(c >= total * q, inside).otherwise(value)
    return F.when(total > 0, value)


def stream_latency_quantiles(samples: DataFrame, window="5 minutes", slide: str | None = "1 minute") -> DataFrame:
    """start, stage, n, p95, p99 of each window from bucket counts, which add up across tasks unlike percentiles; samples: ts, stage, value_ms."""
    over = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = [F.count_if(F.col("value_ms") <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)]
    own = samples.withWatermark("ts", RATE_DELAY).groupBy(over, "stage").agg(F.count("*").alias("n"), *counts)
    b = [F.col(f"b{i}") for i in range(len(BOUNDS))]
    return own.select(F.col("window.start").alias("start"), "stage", "n", bucket_quantile(b, F.col("n"), 0.95).alias("p95"), bucket_quantile(b, F.col("n"), 0.99).alias("p99"))


def stream_slo_alerts(requests: DataFrame, window="5 minutes", p95_ms=1000.0, error_share=0.005, queue_p95_ms=500.0) -> DataFrame:
    """start, n, p95, error_share, queue_p95 and alert of the tumbling windows that break a limit, a row for each: latency, errors, queue; requests: ts, ok, value_ms, and queue_ms, without which queue_p95 is null."""
    queue = F.col("queue_ms") if "queue_ms" in requests.columns else F.lit(None).cast("double")
    rows = requests.withColumn("_q", queue).withWatermark("ts", RATE_DELAY)
    counts = [F.count_if(F.col(c) <= b).alias(f"{c}_{i}") for c in ("value_ms", "_q") for i, b in enumerate(BOUNDS)]
    own = rows.groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), F.count("_q").alias("_n"), F.count_if(~F.col("ok")).alias("errors"), *counts)
    p95 = lambda c, n: bucket_quantile([F.col(f"{c}_{i}") for i in range(len(BOUNDS))], F.col(n), 0.95)
    made = own.select(F.col("window.start").alias("start"), "n", p95("value_ms", "n").alias("p95"), (F.col("errors") / F.col("n")).alias("error_share"), p95("_q", "_n").alias("queue_p95"))
    broken = {"latency": F.col("p95") > p95_ms, "errors": F.col("error_share") > error_share, "queue": F.col("queue_p95") > queue_p95_ms}
    return made.withColumn("alert", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in broken.items()]))))


def _micros(ts="ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _by_bucket(rows: DataFrame, key: str, processor, made: str) -> DataFrame:
    """rows through a stateful processor, by buckets of keys; it gets the key's type first."""
    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(processor(kind), made.format(kind=kind), "append", "EventTime")


def stream_anchored(events: DataFrame, seconds: float, limit=1, delay: str | None = None) -> DataFrame:
    """key, event_id, nth, repeat: windows anchored at their first event; events: key, event_id, ts.

    State is one (anchor, count) for each key with a live window; it is cleared when the watermark has passed the window's end.
    """
    rows = events.filter("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay or f"{int(seconds)} seconds").select("key", "event_id", "ts", _micros().alias("at"))
    return _by_bucket(rows, "key", lambda kind: processors.Windows(kind, seconds, limit), "key {kind}, event_id long, nth int, repeat boolean")


def stream_anti_replay(events: DataFrame, seconds=10) -> DataFrame:
    """repeat marks an event whose hash (key) was seen in the window that its first use opened."""
    return stream_anchored(events, seconds, 1)


def stream_rate_limit(events: DataFrame, limit: int, seconds=60) -> DataFrame:
    """repeat marks the events over the limit of their window; they count as well."""
    return stream_anchored(events, seconds, limit)


def stream_webhook_dedup(notifications: DataFrame, seconds=3600) -> DataFrame:
    """job_id, event_id of the notifications that go out: the first of each job, and the first after each window of so many seconds that one has opened."""
    return stream_anchored(notifications.withColumnRenamed("job_id", "key"), seconds, 1).filter("NOT repeat").select(F.col("key").alias("job_id"), "event_id")


def stream_token_consume(issued: DataFrame, consumed: DataFrame, ttl_seconds=120) -> DataFrame:
    """token, event_id, ts of the consumption that takes each token: the first within ttl of its issue (token, ts); consumed: token, event_id, ts.

    Both streams are one, so that issue and consumption of a batch meet in order of their times. A token issued again starts a new life.
    """
    i = issued.select("token", F.lit(-1).cast("long").alias("event_id"), "ts")
    rows = i.unionByName(consumed.select("token", F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"), "ts")).filter("token IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withWatermark("ts", f"{ttl_seconds} seconds").select("token", "event_id", "ts", _micros().alias("at"))
    taken = _by_bucket(rows, "token", lambda kind: processors.Tokens(kind, ttl_seconds), "token {kind}, event_id long, at long")
    return taken.select("token", "event_id", F.timestamp_micros("at").alias("ts"))


def stream_challenge_sessions(frames: DataFrame, actions: list[str], idle=5.0, total=60.0, delay=RATE_DELAY) -> DataFrame:
    """challenge_id, start, is_live, confidence, reason, n_frames of each session at its end; frames as for challenge_verdict, with ts.

    A session ends with its last frame that counts (MAX_FRAMES), after idle seconds without a frame, or total seconds
    after its first. Frames without a face (no box) keep it alive and don't count. What comes
    after its last frame that counts, before it would have ended otherwise, is dropped.
    """
    rows = frames.filter("challenge_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    missing = functools.reduce(operator.add, [F.when(F.col(c).cast("double").isNull(), 1 << i).otherwise(0) for i, c in enumerate(processors.SIGNALS)])
    rows = rows.select("challenge_id", "ts", _micros().alias("at"), F.col("idx").cast("long").alias("idx"), missing.alias("missing"), *[F.col(c).cast("double").alias(c) for c in processors.SIGNALS])
    ended = _by_bucket(rows, "challenge_id", lambda kind: processors.Sessions(kind, idle, total), f"challenge_id {{kind}}, start long, frames array<struct<{processors.FRAME}>>")
    given = lambda f, i, c: F.when(F.getbit(f["missing"], F.lit(i)) == 0, F.coalesce(f[c], F.lit(float("nan")))).alias(c)
    frames = F.transform("frames", lambda f: F.struct(*[given(f, i, c) for i, c in enumerate(processors.SIGNALS)]))
    ended = ended.select("challenge_id", F.timestamp_micros("start").alias("start"), frames.alias("frames"))
    return session_verdicts(ended, F.array(*map(F.lit, actions)))


def stream_job_lifecycle(events: DataFrame, stale_seconds=300.0, ttl_seconds=300.0, delay="1 minute") -> DataFrame:
    """job_id, status, since (microseconds) whenever a job moves on; events: job_id, status, ts.

    accepted, claimed, done and error come from events, in this order, and a later one of a lower rank changes nothing. A job that stays open for
    longer than stale_seconds is expired; a result (done, error, expired) is gone after
    ttl_seconds, and with it the job's state. An event after that starts the job anew.
    """
    rows = events.filter("job_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay).select("job_id", "status", "ts", _micros().alias("at"))
    return _by_bucket(rows, "job_id", lambda kind: processors.Jobs(kind, stale_seconds, ttl_seconds), "job_id {kind}, status string, since long")
