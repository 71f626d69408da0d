"""Sources and sinks: manifests, sample sets, pair lists, logs, snapshots, reports.

Readers of text take a DataFrame with a column value (as spark.read.text gives), so that
the same functions work on files and on tables.
"""

from __future__ import annotations

import csv
import io
import json
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.operators.prefix import dense_index

#: File kinds and the classes of an attack data set.
IMAGES = ("jpg", "jpeg", "png", "bmp", "webp")
VIDEOS = ("mp4", "mov", "avi", "mkv")
CLASSES = {"live_selfie": (1, "live"), "live_video": (1, "live"), "printouts": (0, "print"), "cut-out printouts": (0, "cutout"), "replay": (0, "replay")}
CLASS_ALIASES = {"cut-out printouts": "cut-out printouts", "cutout printouts": "cut-out printouts", "cut-out": "cut-out printouts"}
#: The stages and the keys that name them in documents.
STAGE_KEYS = {
    "admission": ["admission_ms"], "enqueue": ["enqueue_ms"], "queue_wait": ["queue_wait_ms"], "batch_wait": ["batch_wait_ms"], "worker_semaphore_wait": ["worker_semaphore_wait_ms"], "pipeline_total": ["pipeline_total_ms"],
    "preprocess": ["preprocess_ms"], "detect": ["detect_ms"], "align": ["align_ms"], "encode": ["encode_ms"], "search": ["search_ms"], "liveness": ["liveness_ms"], "decision": ["decision_ms"], "result_write": ["result_write_ms"],
    "job_total_server": ["job_total_server_ms"], "server_wait": ["server_wait_ms", "wait_block_ms", "wait_route_ms"], "wait_lookup": ["wait_lookup_ms", "result_fetch_ms"], "result_visible_age": ["result_visible_age_ms"],
    "wait_empty_cycles": ["wait_empty_cycles", "poll_cycles"], "client_terminal_e2e": ["client_terminal_e2e_ms", "client_e2e_ms"], "poll_overhead": ["poll_overhead_ms"],
}
_STAGE = {key: stage for stage, keys in STAGE_KEYS.items() for key in keys}


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path of every file below root; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def identity_manifest(paths: DataFrame) -> DataFrame:
    """sample_idx, identity, file: images in their identity's folder, numbered in order of (identity, file); other files are left out."""
    part = F.split("path", "/")
    rows = paths.select(F.try_element_at(part, F.lit(-2)).alias("identity"), F.try_element_at(part, F.lit(-1)).alias("file"))
    kind = F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1))
    return dense_index(rows.filter(kind.isin(*IMAGES)), ["identity", "file"])


def read_identity_manifest(spark: SparkSession, root: str) -> DataFrame:
    return identity_manifest(list_files(spark, root))


def sample_set_path(base: str, slug: str, det_size: int) -> str:
    return f"{base}/{slug}_det{det_size}"


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _manifest(spark: SparkSession, path: str):
    """The last manifest of a sample set: version, n, slug, det_size; None without one."""
    files, place = _hadoop(spark, f"{path}/manifests")
    if not files.exists(place):
        return None
    names = sorted(s.getPath().getName() for s in files.listStatus(place) if s.getPath().getName().endswith(".json"))
    return spark.read.schema("version string, n long, slug string, det_size int").json(f"{path}/manifests/{names[-1]}").first() if names else None


def write_samples(samples: DataFrame, base: str, slug: str, det_size: int) -> None:
    """Publish a sample set: its rows in a folder of their own, then a manifest that names it.

    The manifest is one small file, put in place by a rename, so that readers see the set before or the new one, and never
    a part. What a write that was broken off leaves isn't named by any. The version before stays for readers that
    have begun; older ones are deleted.
    """
    spark, path = samples.sparkSession, sample_set_path(base, slug, det_size)
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    samples.write.parquet(f"{path}/versions/{version}")
    n = spark.read.schema(samples.schema).parquet(f"{path}/versions/{version}").count()
    files, target = _hadoop(spark, f"{path}/manifests/{version}.json")
    hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/.{version}")
    stream = files.create(hidden)
    stream.write(bytearray(json.dumps({"version": version, "n": n, "slug": slug, "det_size": det_size}).encode()))
    stream.close()
    if not files.rename(hidden, target):
        raise OSError(f"could not publish {target}")
    for folder in ("manifests", "versions"):
        every = sorted((s.getPath() for s in files.listStatus(_hadoop(spark, f"{path}/{folder}")[1])), key=lambda p: p.getName())
        for old in every:
            if old.getName().removesuffix(".json") < _before(spark, path, version):
                files.delete(old, True)


def _before(spark: SparkSession, path: str, version: str) -> str:
    """The version that was published before this one, or this one."""
    files, place = _hadoop(spark, f"{path}/manifests")
    names = sorted(s.getPath().getName().removesuffix(".json") for s in files.listStatus(place) if s.getPath().getName().endswith(".json"))
    earlier = [n for n in names if n < version]
    return earlier[-1] if earlier else version


def read_samples_meta(spark: SparkSession, base: str, slug: str, det_size: int) -> DataFrame | None:
    """The manifest of a sample set as a one-row table, or None."""
    found = _manifest(spark, sample_set_path(base, slug, det_size))
    return None if found is None else spark.createDataFrame([tuple(found)], "version string, n long, slug string, det_size int")


def read_samples(spark: SparkSession, base: str, slug: str, det_size: int) -> DataFrame | None:
    """The sample set that was published last, or None if there is none or its rows aren't as many as its manifest says."""
    path = sample_set_path(base, slug, det_size)
    found = _manifest(spark, path)
    if found is None:
        return None
    try:
        samples = spark.read.parquet(f"{path}/versions/{found.version}")
    except AnalysisException:  # no file is left
        return None
    return samples if samples.count() == found.n else None


def get_or_build_samples(spark: SparkSession, base: str, slug: str, det_size: int, build, force=False) -> DataFrame:
    found = None if force else read_samples(spark, base, slug, det_size)
    if found is None:
        write_samples(build(), base, slug, det_size)
        found = read_samples(spark, base, slug, det_size)
    return found


def parse_pairs(rows: DataFrame, root="", layout="raw") -> DataFrame:
    """a, b, label, fold from image_a, image_b (or image_a_path, image_b_path), is_same, fold_id.

    Layout raw takes the person's folder from the file name without its number.
    """
    person = lambda c: F.regexp_replace(c, r"(?i)_\d{4}\.(jpg|jpeg|png)$", "")
    place = (lambda s: F.concat_ws("/", F.lit(root), person(f"image_{s}"), F.col(f"image_{s}"))) if layout == "raw" else (lambda s: F.concat_ws("/", F.lit(root), F.col(f"image_{s}_path")))
    return rows.select(place("a").alias("a"), place("b").alias("b"), F.col("is_same").cast("int").alias("label"), F.col("fold_id").cast("int").alias("fold"))


def read_pairs_csv(spark: SparkSession, path: str, root: str, layout="raw") -> DataFrame:
    names = ("image_a", "image_b") if layout == "raw" else ("image_a_path", "image_b_path")
    return parse_pairs(spark.read.csv(path, header=True).select(*names, "is_same", "fold_id"), root, layout)


def pad_manifest(paths: DataFrame, n_frames=30) -> DataFrame:
    """cls, label, attack_type, path, is_image, frame_index: a row per image, n_frames rows per video; unknown classes and kinds are left out."""
    known = F.create_map(*[x for k, (label, kind) in CLASSES.items() for x in (F.lit(k), F.struct(F.lit(label).alias("label"), F.lit(kind).alias("attack_type")))])
    alias = F.create_map(*[F.lit(x) for kv in CLASS_ALIASES.items() for x in kv])
    folder = F.try_element_at(F.split("path", "/"), F.lit(-2))
    low = F.lower(F.trim(folder))
    rows = paths.withColumn("cls", F.coalesce(F.try_element_at(alias, low), low)).withColumn("_k", F.try_element_at(known, F.col("cls")))
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    rows = rows.withColumns({"is_image": kind.isin(*IMAGES), "_video": kind.isin(*VIDEOS)}).filter("_k IS NOT NULL AND (is_image OR _video)")
    frames = F.when(F.col("is_image"), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(n_frames - 1)))
    return rows.select("cls", F.col("_k.label").alias("label"), F.col("_k.attack_type").alias("attack_type"), "path", "is_image", F.explode(frames).alias("frame_index"))


def extract_job_rows(lines: DataFrame, marker="JOB_ROW ") -> DataFrame:
    """payload (JSON text) of every line with the marker; lines whose payload isn't JSON are left out."""
    after = F.trim(F.expr(f"substring(value, instr(value, '{marker}') + {len(marker)})"))
    cut = F.rtrim(F.substring_index(after, " source=", 1))
    bare = F.regexp_replace(F.regexp_replace(cut, r'"$', ""), r'^"', "")
    payload = F.replace(bare, F.lit('\\"'), F.lit('"'))
    rows = lines.filter(F.col("value").contains(marker)).select(payload.alias("payload"))
    return rows.filter(F.try_parse_json("payload").isNotNull() & (F.length("payload") > 0))


def job_rows(payloads: DataFrame) -> DataFrame:
    """job_id, status, timings and timestamps of job-row payloads."""
    schema = "job_id string, status string, timings map<string,double>, timestamps map<string,bigint>"
    return payloads.select(F.from_json("payload", schema).alias("j")).select("j.*")


def parse_metric_snapshots(lines: DataFrame, keys=()) -> DataFrame:
    """keys, metric, le, value from exposition text; le is null for plain values, +Inf is infinity; several label sets give the largest value."""
    v = F.col("value")
    name, labels, number = (F.regexp_extract(v, r"^([A-Za-z_:][\w:]*)(?:\{([^}]*)\})? ([0-9.eE+-]+)$", i) for i in (1, 2, 3))
    le = F.regexp_extract(labels, r'^le="([^"]+)"$', 1)
    bound = F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.try_cast("double"))
    rows = lines.select(*keys, name.alias("metric"), bound.alias("le"), number.try_cast("double").alias("value")).filter("metric <> '' AND value IS NOT NULL")
    return rows.groupBy(*keys, "metric", "le").agg(F.max("value").alias("value"))


def _opened(text: str):
    """The JSON inside a text, or None."""
    if text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _number(value) -> float | None:
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        return None
    try:
        return float(value)
    except ValueError:
        return None


def stage_samples(obj, out: list[tuple[str, float]]) -> None:
    """(stage, value) of every number under a stage's key, at any depth, in document order; JSON inside text is opened."""
    pending = [(None, obj)]  # (stage that the value is named by, value)
    while pending:
        stage, value = pending.pop()
        if isinstance(value, dict):
            pending += [(_STAGE.get(str(key).split(".")[-1]), inner) for key, inner in reversed(value.items())]
        elif stage is not None:
            number = _number(value)
            if number is not None:
                out.append((stage, number))
        elif isinstance(value, list):
            pending += [(None, inner) for inner in reversed(value)]
        elif isinstance(value, str):
            pending.append((None, _opened(value)))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[tuple[str, float]] = []
        for text in batch["value"]:
            if text:
                stage_samples(text, out)
        yield pd.DataFrame(out, columns=["stage", "value_ms"])


def collect_stage_samples(documents: DataFrame) -> DataFrame:
    """stage, value_ms from JSON documents (value) of unknown shape."""
    return documents.select("value").mapInPandas(_walk, "stage string, value_ms double")


def prefer_primary(samples: DataFrame) -> DataFrame:
    """Samples (stage, value_ms, priority) of each stage's highest priority only."""
    best = samples.groupBy("stage").agg(F.max("priority").alias("priority"))
    return samples.join(F.broadcast(best), ["stage", "priority"], "left_semi")


def csv_samples(text: str, out: list[tuple[str, float]]) -> None:
    """(stage, value) of a CSV text: its columns named by stages, and the JSON in other cells. A row with too many cells, or a broken one, ends it."""
    try:
        for row in csv.DictReader(io.StringIO(text, newline="")):
            for key, value in row.items():
                if key is None:
                    return
                if value:
                    number = len(out)
                    stage_samples({key: value} if key.split(".")[-1] in _STAGE else value, out)
                    if len(out) == number and key.split(".")[-1] in _STAGE:
                        stage_samples(value, out)
    except csv.Error:
        return


def _walk_csv(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[tuple[str, float]] = []
        for text in batch["value"]:
            if text:
                csv_samples(text, out)
        yield pd.DataFrame(out, columns=["stage", "value_ms"])


def read_benchmark_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """stage, value_ms, priority of a tree of json, jsonl and csv artifacts; job-row files (priority 1) come before all others (0)."""
    read = lambda glob, whole: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=whole)
    lines = read("*.[jJ][sS][oO][nN][lL]", False)
    primary = F.col("_metadata.file_name").endswith("_job_rows.jsonl")
    first = collect_stage_samples(lines.filter(primary))
    others = collect_stage_samples(lines.filter(~primary)).unionByName(collect_stage_samples(read("*.[jJ][sS][oO][nN]", True)))
    others = others.unionByName(read("*.[cC][sS][vV]", True).mapInPandas(_walk_csv, "stage string, value_ms double"))
    # Only the job rows tell which stages are theirs, so that no other file is read twice; the stages are a few names.
    others = others.join(F.broadcast(first.select("stage").distinct()), "stage", "left_anti")
    return first.select("stage", "value_ms", F.lit(1).alias("priority")).unionByName(others.select("stage", "value_ms", F.lit(0).alias("priority")))


#: Keys of a load test's summary, in order of preference.
CLIENT_BLOCKS = ("client_e2e_ms", "client_terminal_e2e_ms")
COUNT_BLOCKS = ("completed", "result_passes", "terminal_done", "iterations")
SUMMARY_KEYS = {"p50": ("p(50)", "med", "median"), "p95": ("p(95)",), "p99": ("p(99)",), "mean": ("avg", "mean")}


def client_summaries(documents: DataFrame) -> DataFrame:
    """path, n, p50, p95, p99, mean of the load-test summaries among JSON documents (path, value).

    n is the count of the client's block (its own or that of its values), else that of the first other block that has one; without any, the summary doesn't count.
    """
    text = "map<string,string>"
    metrics = F.from_json(F.col("value"), f"metrics {text}")["metrics"]
    block = lambda k: F.from_json(F.try_element_at("_m", F.lit(k)), text)
    own = F.coalesce(*[F.when(F.size(block(k)) > 0, block(k)) for k in CLIENT_BLOCKS])
    number = lambda m, k: F.try_element_at(m, F.lit(k)).try_cast("double")
    rows = documents.select("path", metrics.alias("_m")).filter("_m IS NOT NULL").withColumn("_b", own).filter("_b IS NOT NULL")
    inner = F.from_json(F.try_element_at("_b", F.lit("values")), text)
    count = F.coalesce(number(F.col("_b"), "count"), number(inner, "count"), *[number(block(k), "count") for k in COUNT_BLOCKS])
    return rows.select("path", F.floor(count).alias("n"), *[F.coalesce(*[number(F.col("_b"), k) for k in keys]).alias(c) for c, keys in SUMMARY_KEYS.items()]).filter("n IS NOT NULL")


def read_client_summary(spark: SparkSession, root: str) -> DataFrame:
    """The first summary, by path, of the JSON artifacts of a tree, as stage_latency_table takes it; no row if there is none."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(root, wholetext=True)
    found = client_summaries(read.select(F.col("_metadata.file_path").alias("path"), "value"))
    first = found.agg(F.min(F.struct(*found.columns)).alias("s")).filter("s IS NOT NULL")
    return first.select("s.*").drop("path")


#: Tables of the service, and the column that each is read in parts by.
SERVICE_TABLES = {"users": "id", "embeddings": "id", "verification_logs": "id", "verification_jobs": "job_id"}
#: Which part of n a text key is in; PostgreSQL's hash of a text.
TEXT_PART = "MOD(ABS(HASHTEXT({column})::BIGINT), {n})"


def read_service_tables(spark: SparkSession, base: str | None = None, jdbc: dict | None = None, tables: dict[str, str] | None = None, parts=64, text_part=TEXT_PART) -> dict[str, DataFrame]:
    """The service's tables from Parquet snapshots, or by JDBC in parts; tables: {name: column to part by}.

    Whole-number columns are cut into ranges between their smallest and largest value, which a query of the database tells first.
    Text columns are cut by a hash that the database computes (text_part, with column and n). Null keys are in the first part.
    """
    tables = SERVICE_TABLES if tables is None else tables
    if base is not None:
        return {t: spark.read.parquet(f"{base}/{t}") for t in tables}
    return {t: _read_in_parts(spark, jdbc, t, column, parts, text_part) for t, column in tables.items()}


def _read_in_parts(spark: SparkSession, jdbc: dict, table: str, column: str, parts: int, text_part: str) -> DataFrame:
    kind, name = spark.read.format("jdbc").options(**jdbc, dbtable=table).load().schema[column].dataType.typeName(), f'"{column}"'
    if kind == "string":
        which = text_part.format(column=name, n=parts)
        predicates = [f"{which} = {i}" + (f" OR {name} IS NULL" if i == 0 else "") for i in range(parts)]
        rest = {k: v for k, v in jdbc.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(jdbc["url"], table, predicates=predicates, properties=rest)
    low, high = spark.read.format("jdbc").options(**jdbc, dbtable=f"(SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}) bounds").load().first()
    if low is None or low == high:
        return spark.read.format("jdbc").options(**jdbc, dbtable=table).load()
    ranges = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**jdbc, dbtable=table, **ranges).load()


def write_pad_predictions(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").parquet(path)


def read_pad_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames with a face, and the counts by class of those without."""
    from verilake.operators.pad import face_drop_counts

    return face_drop_counts(spark.read.parquet(path))


def report_json(summary: DataFrame) -> DataFrame:
    """One JSON text per row with its keys in order; arrays are left out."""
    plain = sorted(name for name, kind in summary.dtypes if not kind.startswith("array"))
    return summary.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("value"))


def write_eval_report(summary: DataFrame, path: str) -> None:
    report_json(summary).coalesce(1).write.mode("overwrite").text(path)


def _fmt6(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([None if v is None or v != v else f"{v:.6g}" for v in batch], dtype=object)


def format_6g(column):
    """Six significant digits without trailing zeros."""
    return F.pandas_udf(_fmt6, "string")(column)


def write_curve_csv(curve: DataFrame, path: str, order: str) -> None:
    """A curve's columns in six digits, ordered across the files."""
    numbers = [F.col(c) if kind in ("int", "bigint", "string") else format_6g(F.col(c)).alias(c) for c, kind in curve.dtypes]
    curve.repartitionByRange(order).sortWithinPartitions(order).select(*numbers).write.mode("overwrite").csv(path, header=True)


def write_latency_table(table: DataFrame, path: str) -> None:
    """stage, n and the numbers in three decimals, blanks for what is missing. Rounding to nine first keeps a last bit from deciding at a half."""
    from verilake.functions.exprs import format_number

    table.select("stage", "n", *[format_number(F.round(c, 9)).alias(c) for c in ("p50", "p95", "p99", "mean", "share")]).coalesce(1).sortWithinPartitions("stage").write.mode("overwrite").csv(path, header=True, emptyValue="")
