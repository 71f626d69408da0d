"""Stage timings, histograms, capacity and service levels from logs and snapshots."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilake.operators.quantiles import exact_quantiles

#: Fixed key names. Stages of a pipeline, and the terms that a job's processing time is made of.
PIPELINE_STAGES = ("preprocess_ms", "detect_ms", "align_ms", "encode_ms", "search_ms", "liveness_ms", "decision_ms")
ALIASES = {"detect_ms": "fast_detect_ms", "align_ms": "align_crop_ms", "search_ms": "vector_search_ms"}
ACCOUNTED = (
    "b64_decode_ms", "image_decode_ms", "downscale_ms", "jpeg_reencode_ms", "batch_collect_wait_ms", "batch_verify_loop_wait_ms", "preprocess_ms", "quality_gate_pre_ms", "encode_semaphore_wait_ms", "detect_ms",
    "align_crop_ms", "quality_gate_face_ms", "liveness_ms", "encode_ms", "vector_search_ms", "anti_replay_ms", "is_genuine_ms", "decision_ms", "verification_log_write_ms", "result_write_ms",
)
#: Upper bounds of histogram buckets.
QUEUE_DELAY_MS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000)
REQUEST_SECONDS = (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0)
STAGE_SECONDS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)


def normalize_stage_timings(df: DataFrame, column="timings") -> DataFrame:
    """The map with the seven stage keys from their own or older names, missing ones 0, and pipeline_total_ms, their sum."""
    get = lambda k: F.try_element_at(column, F.lit(k)).cast("double")
    stages = {k: F.coalesce(get(k), get(ALIASES[k]) if k in ALIASES else F.lit(None).cast("double"), F.lit(0.0)) for k in PIPELINE_STAGES}
    total = sum(stages.values(), F.lit(0.0))
    added = F.create_map(*[x for k, v in stages.items() for x in (F.lit(k), v)], F.lit("pipeline_total_ms"), total)
    rest = F.map_filter(F.transform_values(column, lambda k, v: v.cast("double")), lambda k, v: ~k.isin(*PIPELINE_STAGES, "pipeline_total_ms"))
    return df.withColumn(column, F.map_concat(rest, added))


def job_latency_columns(df: DataFrame, column="timings") -> DataFrame:
    """queue_delay, dequeue_to_start, processing, e2e and unattributed (ms, floored at 0) from created_at, dequeued_at, started_at, finished_at in seconds."""
    c, d, s, f = (F.col(x) for x in ("created_at", "dequeued_at", "started_at", "finished_at"))
    span = lambda a, b: F.greatest(F.lit(0.0), (b - a) * 1000.0)
    accounted = sum((F.coalesce(F.try_element_at(column, F.lit(k)).cast("double"), F.lit(0.0)) for k in ACCOUNTED), F.lit(0.0)) if column in df.columns else F.lit(0.0)
    out = df.withColumns({"queue_delay_ms": span(c, F.coalesce(d, s)), "dequeue_to_start_ms": F.when(d.isNotNull(), span(d, s)).otherwise(0.0), "processing_ms": span(s, f), "e2e_ms": span(c, f)})
    return out.withColumn("unattributed_ms", F.greatest(F.lit(0.0), F.col("processing_ms") - accounted))


def job_result_metrics(df: DataFrame, column="result") -> DataFrame:
    """total, queue and processing ms of a result document (JSON text): from timings in ms, else timestamps in ns, else metrics in s."""
    schema = "timings map<string,string>, timestamps map<string,string>, metrics map<string,string>"
    doc = F.from_json(column, schema)
    at = lambda part, key: F.try_element_at(doc[part], F.lit(key)).try_cast("double")
    span = lambda a, b: (at("timestamps", b) / 1e9 - at("timestamps", a) / 1e9) * 1000.0
    modern = doc["timings"].isNotNull() | doc["timestamps"].isNotNull()
    pick = lambda new, old: F.when(modern, new).otherwise(at("metrics", old) * 1000.0)
    return df.withColumns(
        {
            "total_ms": pick(F.coalesce(at("timings", "job_total_server_ms"), span("accepted_at_ns", "result_written_at_ns")), "total_latency"),
            "queue_ms": pick(at("timings", "queue_wait_ms"), "queue_delay"),
            "process_ms": pick(F.coalesce(at("timings", "pipeline_total_ms"), at("timings", "result_write_ms"), span("processing_started_at_ns", "processing_finished_at_ns")), "processing_time"),
        }
    )


def stage_latency_table(samples: DataFrame, client: DataFrame | None = None, stages: Iterable[str] = ()) -> DataFrame:
    """stage, n, p50, p95, p99, mean and share of the client's p95 (else the server's), from (stage, value_ms).

    Percentiles interpolate. poll_overhead, where it has no samples, is client - server
    by quantile, floored at 0. client (n, p50, p95, p99, mean; at most one row) is a summary that stands for the
    client's samples, unless these have a priority above 0 (a column of samples). Of stages, those without samples get a row with n 0 and nulls.
    """
    names = ("p50", "p95", "p99")
    fine = samples.filter("value_ms IS NOT NULL")
    level = F.max("priority") if "priority" in samples.columns else F.lit(0)
    means = fine.groupBy("stage").agg(F.avg("value_ms").alias("mean"), level.alias("_level"))
    own = exact_quantiles(fine, "value_ms", (0.5, 0.95, 0.99), ["stage"]).join(means, "stage").select("stage", "n", *[F.col("p")[i].alias(c) for i, c in enumerate(names)], "mean", "_level")
    if client is not None:
        stands = client.select(F.lit("client_terminal_e2e").alias("stage"), F.col("n").cast("long").alias("n"), *names, "mean", F.lit(0).alias("_level"))
        beaten = F.broadcast(stands.select("stage"))  # one row
        own = own.filter("_level > 0 OR stage <> 'client_terminal_e2e'").unionByName(own.filter("_level = 0 AND stage = 'client_terminal_e2e'").join(beaten, "stage", "left_anti"))
        first = own.filter("stage = 'client_terminal_e2e'").select("stage")
        own = own.unionByName(stands.join(first, "stage", "left_anti"))
    own = own.drop("_level")
    side = lambda s: own.filter(F.col("stage") == s)
    c, v = side("client_terminal_e2e").alias("c"), side("job_total_server").alias("v")
    floor = lambda x: F.greatest(F.lit(0.0), F.col(f"c.{x}") - F.col(f"v.{x}")).alias(x)
    poll = c.crossJoin(v).select(F.lit("poll_overhead").alias("stage"), F.least("c.n", "v.n").alias("n"), *[floor(x) for x in (*names, "mean")]).join(side("poll_overhead").select("stage"), "stage", "left_anti")
    full = own.unionByName(poll)
    base = full.agg(F.coalesce(F.max(F.when(F.col("stage") == "client_terminal_e2e", F.col("p95"))), F.max(F.when(F.col("stage") == "job_total_server", F.col("p95")))).alias("_base"))
    out = full.crossJoin(F.broadcast(base)).withColumn("share", F.when(F.col("_base") > 0, F.try_divide("p95", "_base"))).drop("_base")
    if not stages:
        return out
    every = samples.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    return every.join(out, "stage", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def nearest_rank_stats(samples: DataFrame, key="stage", value="value_ms") -> DataFrame:
    """n, p50 and p95 as the sorted values at int(n q), and max, by key; equal values are summed up before any order is made."""
    counts = samples.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(key).orderBy(value)
    run = counts.withColumns({"upto": F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy(key))})
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col(value)))
    return run.groupBy(key).agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("max"))


def histogram_observe(values: DataFrame, bounds=QUEUE_DELAY_MS, value="value", keys=()) -> DataFrame:
    """keys, le, cumulative: how many values are at most le; the last le is infinite."""
    tops = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    first = F.size(F.filter(tops, lambda b: b < F.col(value)))
    counts = values.filter(F.col(value).isNotNull()).groupBy(*keys, first.alias("i")).agg(F.count("*").alias("c"))
    every = counts.select(*keys).distinct() if keys else values.sparkSession.range(1).select(F.lit(1).alias("_one"))
    grid = every.select(*keys, F.posexplode(tops).alias("i", "le"))
    run = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(counts, [*keys, "i"], "left").select(*keys, "le", F.coalesce(F.sum("c").over(run), F.lit(0)).cast("long").alias("cumulative"))


def histogram_delta_quantile(before: DataFrame, after: DataFrame, q: float, keys=()) -> DataFrame:
    """keys, value: the q-quantile of what was added between two snapshots (le, cumulative), by linear interpolation.

    Differences are floored at 0. Null without a side or without growth. In the infinite
    bucket it is the bound before it; in a bucket without span it is the bucket's bound.
    """
    keys = list(keys)
    a, b = before.select(*keys, "le", F.col("cumulative").alias("_a")), after.select(*keys, "le", F.col("cumulative").alias("_b"))
    joined = a.join(b, [*keys, "le"], "full_outer")
    order = Window.partitionBy(*keys).orderBy("le")
    delta = joined.withColumn("_d", F.greatest(F.lit(0.0), F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).cast("double"))
    rows = delta.withColumns({"_pd": F.coalesce(F.lag("_d").over(order), F.lit(0.0)), "_pu": F.coalesce(F.lag("le").over(order), F.lit(0.0))})
    inf = F.col("le") == float("inf")
    total = joined.groupBy(*keys).agg(F.max(F.when(inf, F.col("_a"))).alias("ta"), F.max(F.when(inf, F.col("_b"))).alias("tb")).withColumn("_t", F.greatest(F.lit(0), F.col("tb") - F.col("ta")))
    full = rows.join(total.select(*keys, "_t"), keys) if keys else rows.crossJoin(total.select("_t"))
    target = F.col("_t") * q
    span = F.col("_d") - F.col("_pd")
    value = F.when(F.col("le") == float("inf"), F.col("_pu")).when(span <= 0, F.col("le")).otherwise(F.col("_pu") + F.try_divide(target - F.col("_pd"), span) * (F.col("le") - F.col("_pu")))
    hit = (F.col("_t") > 0) & (F.col("_d") >= target)
    return full.groupBy(*keys).agg(F.min(F.when(hit, F.struct("le", value.alias("v")))).alias("b")).select(*keys, F.col("b.v").alias("value"))


def counter_delta(before: DataFrame, after: DataFrame, key="metric") -> DataFrame:
    """key, delta: growth of a counter (value), floored at 0; null if a side is missing."""
    a, b = before.select(key, F.col("value").alias("_a")), after.select(key, F.col("value").alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest(F.lit(0.0), F.col("_b") - F.col("_a"))).alias("delta"))


def capacity_curve(jobs: DataFrame, delays: Mapping[str, str] = {"queue": "queue_delay_ms"}) -> DataFrame:
    """One row per offered rate: jobs, shares completed and failed, p50 and p95 of each delay, and validity.

    jobs: rate, status, queue_left, inflight_left and the delays, {name: column}, which give name_p50 and name_p95. A rate is valid if some
    jobs completed and none were left waiting or running.
    """
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    out = jobs.groupBy("rate").agg(F.count("*").alias("n"), F.count_if(done).alias("completed"), F.count_if(failed).alias("failed"), F.max("queue_left").alias("queue_left"), F.max("inflight_left").alias("inflight_left"))
    found = exact_quantiles(_stacked(jobs, delays, ["rate"]), "value", (0.5, 0.95), ["rate", "measure"])
    at = lambda name, i: F.max(F.when(F.col("measure") == name, F.col("p")[i]))
    wide = found.groupBy("rate").agg(*[at(name, i).alias(f"{name}_{p}") for name in delays for i, p in enumerate(("p50", "p95"))])
    valid = (F.col("completed") > 0) & (F.col("queue_left") == 0) & (F.col("inflight_left") == 0)
    return out.join(wide, "rate", "left").select("rate", "n", (F.col("completed") / F.col("n")).alias("completed_share"), (F.col("failed") / F.col("n")).alias("failed_share"), *[f"{name}_{p}" for name in delays for p in ("p50", "p95")], valid.alias("valid"))


def _stacked(df: DataFrame, measures: Mapping[str, str], keys=()) -> DataFrame:
    """keys, measure, value: a row for each of the measures, {name: column}."""
    own = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(c).cast("double").alias("value")) for name, c in measures.items()])
    return df.select(*keys, F.explode(own).alias("_m")).select(*keys, "_m.*")


def audit_by_ip(log: DataFrame) -> DataFrame:
    """Verifications and failures by request_ip."""
    return log.filter("request_ip IS NOT NULL").groupBy("request_ip").agg(F.count("*").alias("n"), F.count_if(~F.col("result")).alias("failures"))


def slo_summary(requests: DataFrame, p95_target=1000.0, error_budget=0.005, queue_target=1000.0, total_target=2000.0, reject_target=0.2) -> DataFrame:
    """n, availability, error_rate, p95, whether each is met, and the share of the error budget that is used; requests: ok, latency_ms. Without requests n is 0 and the rest null.

    With a column queue_ms or total_ms, also its p95 and whether that is below its target; with
    quality_rejected, also the share of rejects and whether it is.
    """
    targets = {"p95": ("latency_ms", p95_target)} | {f"{c}_p95": (f"{c}_ms", t) for c, t in (("queue", queue_target), ("total", total_target)) if f"{c}_ms" in requests.columns}
    rejects = {"_r": F.count_if("quality_rejected")} if "quality_rejected" in requests.columns else {}
    own = requests.agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"), *[c.alias(k) for k, c in rejects.items()])
    found = exact_quantiles(_stacked(requests, {k: c for k, (c, _) in targets.items()}), "value", (0.95,), ["measure"])
    wide = found.agg(*[F.max(F.when(F.col("measure") == k, F.col("p")[0])).alias(k) for k in targets])
    rate = F.try_divide("errors", "n")
    more = [c for k, (_, t) in targets.items() if k != "p95" for c in (F.col(k), (F.col(k) < t).alias(f"{k}_met"))]
    if rejects:
        share = F.try_divide("_r", "n")
        more += [share.alias("reject_share"), (share < reject_target).alias("reject_met")]
    return own.crossJoin(wide).select("n", (1 - rate).alias("availability"), rate.alias("error_rate"), "p95", (F.col("p95") < p95_target).alias("p95_met"), (rate < error_budget).alias("errors_met"), (rate / error_budget).alias("budget_used"), *more)
