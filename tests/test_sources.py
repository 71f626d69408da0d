"""Sample sets that are published at once, load-test summaries, tables of latencies, small galleries."""

import json

import pytest
from pyspark.sql import functions as F

from verilake.operators import enroll, recognition, telemetry
from verilake.sources import files


def ids(df):
    return sorted(r.i for r in df.collect())


def test_sample_sets_are_published_at_once(spark, tmp_path):
    base = str(tmp_path)
    assert files.read_samples(spark, base, "s", 320) is None
    assert files.read_samples_meta(spark, base, "s", 320) is None
    one, two = spark.range(5).select(F.col("id").alias("i")), spark.range(7).select(F.col("id").alias("i"))
    files.write_samples(one, base, "s", 320)
    held = files.read_samples(spark, base, "s", 320)
    # A write that breaks off in the rows, and one that breaks off before its manifest.
    with pytest.raises(Exception, match="(?i)boom"):
        files.write_samples(two.filter(F.when(F.col("i") < 6, F.lit(True)).otherwise(F.raise_error(F.lit("boom")).cast("boolean"))), base, "s", 320)
    two.write.parquet(f"{files.sample_set_path(base, 's', 320)}/versions/0-left-over")
    assert ids(files.read_samples(spark, base, "s", 320)) == list(range(5))
    files.write_samples(two, base, "s", 320)
    assert ids(files.read_samples(spark, base, "s", 320)) == list(range(7))
    assert ids(held) == list(range(5))  # who began before the new set was there reads on
    files.write_samples(one.limit(0), base, "s", 320)
    assert ids(files.read_samples(spark, base, "s", 320)) == []
    folder = tmp_path / "s_det320"
    assert len(list((folder / "versions").iterdir())) == 2 and len(list((folder / "manifests").glob("*.json"))) == 2
    meta = files.read_samples_meta(spark, base, "s", 320).first()
    assert (meta.n, meta.slug, meta.det_size) == (0, "s", 320)
    # Rows that went missing.
    (next(p for p in (folder / "versions" / meta.version).iterdir() if p.name.endswith(".parquet"))).unlink()
    assert files.get_or_build_samples(spark, base, "s", 320, lambda: two).count() == 7


def test_client_summaries(spark, tmp_path):
    block = {"med": 5, "p(95)": 9.5, "p(99)": "12", "avg": 6.25}
    documents = {
        "b.json": {"metrics": {"client_e2e_ms": block, "iterations": {"count": 40}, "completed": {"count": 30}}},
        "c.json": {"metrics": {"client_terminal_e2e_ms": {**block, "count": 7}}},
        "deep/a.JSON": {"metrics": {"client_e2e_ms": {"p(50)": 1, "values": {"count": 3}}}},
        "none.json": {"metrics": {"client_e2e_ms": block}},
        "other.json": {"metrics": {"client_e2e_ms": 5}, "detect_ms": 3},
        "list.json": [1, 2],
    }
    (tmp_path / "deep").mkdir()
    for name, doc in documents.items():
        (tmp_path / name).write_text(json.dumps(doc))
    (tmp_path / "broken.json").write_text("{")
    lines = spark.createDataFrame([(k, json.dumps(d)) for k, d in documents.items()], "path string, value string")
    assert sorted(tuple(r) for r in files.client_summaries(lines).collect()) == [("b.json", 30, 5.0, 9.5, 12.0, 6.25), ("c.json", 7, 5.0, 9.5, 12.0, 6.25), ("deep/a.JSON", 3, 1.0, None, None, None)]
    assert tuple(files.read_client_summary(spark, str(tmp_path)).first()) == (30, 5.0, 9.5, 12.0, 6.25)


def test_client_summary_in_the_table(spark):
    samples = spark.createDataFrame([("client_terminal_e2e", 100.0, 0), ("job_total_server", 4.0, 0)], "stage string, value_ms double, priority int")
    summary = spark.createDataFrame([(30, 5.0, 9.5, 12.0, 6.0)], "n long, p50 double, p95 double, p99 double, mean double")
    stages = ["detect", "job_total_server", "client_terminal_e2e", "poll_overhead"]
    rows = {r.stage: r for r in telemetry.stage_latency_table(samples, summary, stages).collect()}
    assert tuple(rows["detect"]) == ("detect", 0, None, None, None, None, None)
    assert (rows["client_terminal_e2e"].n, rows["client_terminal_e2e"].p95, rows["poll_overhead"].p95, rows["poll_overhead"].n) == (30, 9.5, 5.5, 1)
    # Samples of job rows come before the summary, others after it; without a summary they count.
    first = telemetry.stage_latency_table(samples.withColumn("priority", F.lit(1)), summary, stages).filter("stage = 'client_terminal_e2e'").first()
    none = telemetry.stage_latency_table(samples, summary.limit(0), stages).filter("stage = 'client_terminal_e2e'").first()
    assert (first.n, first.p95, none.n, none.p95) == (1, 100.0, 1, 100.0)


def test_ranks_end_with_the_gallery(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "probe_idx long, rank int")
    got = [(r.rank, r.accuracy) for r in recognition.cmc_curve(ranks, gallery=spark.range(2)).orderBy("rank").collect()]
    assert got == [(1, pytest.approx(1 / 3)), (2, pytest.approx(2 / 3))]
    assert recognition.cmc_curve(ranks, 5).count() == 5


def test_vectors_that_cannot_be_decrypted_are_counted(spark):
    key = spark.createDataFrame([(b"k" * 32,)], "key binary")
    coded = enroll.encrypt_vectors(spark.createDataFrame([(1, b"abcd"), (2, b"efgh")], "id long, payload binary"), key)
    broken = coded.withColumn("encrypted", F.when(F.col("id") == 2, F.reverse(F.hex("encrypted")).cast("binary")).otherwise(F.col("encrypted"))).drop("payload")
    got = enroll.decrypt_failures(enroll.decrypt_vectors(broken.unionByName(broken.limit(1).withColumn("encrypted", F.lit(None).cast("binary"))), key)).first()
    assert (got.n, got.n_failed) == (2, 1)


def test_service_tables_by_jdbc(spark, tmp_path):
    """A database in the driver's JVM: ranges between the bounds that are there, text keys by an expression of the database."""
    jdbc = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    users = spark.range(5_000_000_000, 5_000_000_400).select(F.col("id"), F.lit("x").alias("name"))
    jobs = spark.range(300).select(F.when(F.col("id") > 0, F.repeat(F.lit("j"), F.col("id").cast("int"))).alias("job_id"), F.col("id").alias("n"))
    one = spark.range(1).select(F.lit(7).cast("long").alias("id"))
    for name, table in (("users", users), ("jobs", jobs), ("one", one), ("nothing", users.limit(0))):
        table.coalesce(1).write.format("jdbc").options(**jdbc, dbtable=name).mode("append").save()
    found = files.read_service_tables(spark, jdbc=jdbc, tables={"users": "id", "jobs": "job_id", "one": "id", "nothing": "id"}, parts=8, text_part="MOD(LENGTH({column}), {n})")
    sizes = {t: [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()] for t, df in found.items()}
    assert (sum(sizes["users"]), sum(sizes["jobs"]), sum(sizes["one"]), sum(sizes["nothing"])) == (400, 300, 1, 0)
    assert len(sizes["users"]) == 8 and max(sizes["users"]) <= 60  # bounds of 0 .. 1e9 would give one part all rows
    assert len(sizes["jobs"]) == 8 and max(sizes["jobs"]) <= 45
    assert found["jobs"].filter("job_id IS NULL").count() == 1
    users.write.parquet(f"{tmp_path}/snap/users")
    assert files.read_service_tables(spark, f"{tmp_path}/snap", tables={"users": "id"})["users"].count() == 400


def test_ranges_by_halving(spark):
    """A row is compared with few of the edges, and is in the range that all comparisons give."""
    from verilake.operators import prefix

    rows = [(None, "x"), *[(f"k{i % 7}", f"é{i:03d}") for i in range(600)], ("k3", None)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(3)
    made = prefix.dense_index(df, ["a", "b"]).collect()
    order = sorted(rows, key=lambda t: [(v is not None, (v or "").encode()) for v in t])
    assert [(r.a, r.b) for r in sorted(made, key=lambda r: r.sample_idx)] == order
    plan = prefix.dense_index(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "lambda" not in plan


def test_artifacts_read_once(spark, tmp_path):
    """Job rows come first for their stages only, and the other files are read once."""
    from verilake.sources import files

    (tmp_path / "a_job_rows.jsonl").write_text('{"search_ms": 1}\n{"search_ms": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"search_ms": 9, "align_ms": 3}\n')
    (tmp_path / "c.json").write_text('{"deep": [{"align_ms": 4}, {"search_ms": 8}]}')
    (tmp_path / "d.csv").write_text("x.detect_ms,y\n5,1\n")
    found = files.read_benchmark_artifacts(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("align", 3.0, 0), ("align", 4.0, 0), ("detect", 5.0, 0), ("search", 1.0, 1), ("search", 2.0, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_walk_csv") == 1
