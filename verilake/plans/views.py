"""Views of the star-schema tables as the library's own entities, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

VIEWS = {
    "samples": "SELECT vec_id AS sample_idx, label AS identity, embedding FROM {embeddings}",
    "pair_list": """
        SELECT x.vec_id AS pair_id, x.vec_id AS a, y.vec_id AS b, CASE WHEN x.label = y.label THEN 1 ELSE 0 END AS label, x.vec_id % 10 AS fold
        FROM (SELECT e.vec_id, e.label, (e.vec_id * 7 + 13) % c.n AS other FROM {embeddings} e CROSS JOIN (SELECT count(*) AS n FROM {embeddings}) c) x
        JOIN {embeddings} y ON y.vec_id = x.other""",
    "face_counts": "SELECT vec_id AS sample_idx, CASE WHEN vec_id % 17 = 0 THEN 0 WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END AS n_faces FROM {embeddings}",
    "attempts": "SELECT vec_id AS probe_idx, CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 4 = 0 THEN (label + 1) % 11 ELSE label END AS expected_identity, vec_id % 2 = 0 AS fallback FROM {embeddings}",
    "verification_log": """
        SELECT event_id AS id, user_id, round((value % 10) / 20 + CASE WHEN event_type IN ('purchase', 'signup') THEN 0.4 ELSE 0.0 END, 4) AS similarity,
               CASE WHEN event_type IN ('purchase', 'signup') THEN true WHEN event_type IN ('click', 'view') THEN false END AS is_genuine,
               (value % 10) / 20 >= 0.25 AS result, concat('10.0.', CAST(user_id % 7 AS STRING), '.', CAST(user_id % 11 AS STRING)) AS request_ip, ts AS created_at
        FROM {events}""",
    "scored": """
        SELECT event_id AS pair_id, round((value % 10) / 20 + CASE WHEN event_type IN ('purchase', 'signup') THEN 0.2 ELSE 0.0 END, 4) AS score,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS label, event_id % 10 AS fold, CASE user_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'single' ELSE 'multi' END AS slice
        FROM {events} WHERE event_type <> 'error'""",
    "all_frames": """
        SELECT event_id AS frame_index, concat(CAST(user_id AS STRING), '_', CAST(event_id % 5 AS STRING)) AS source,
               CASE user_id % 5 WHEN 0 THEN 'live_selfie' WHEN 1 THEN 'live_video' WHEN 2 THEN 'printouts' WHEN 3 THEN 'cut-out printouts' ELSE 'replay' END AS cls,
               CASE WHEN user_id % 5 < 2 THEN 1 ELSE 0 END AS label, CASE user_id % 5 WHEN 2 THEN 'print' WHEN 3 THEN 'cutout' WHEN 4 THEN 'replay' ELSE 'live' END AS attack_type,
               round((value % 10) / 20 + CASE WHEN user_id % 5 < 2 THEN 0.45 WHEN user_id % 5 = 3 THEN 0.25 ELSE 0.1 END, 4) AS score, event_id % 23 <> 0 AS face_detected
        FROM {events}""",
    "detections": """
        SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS det_idx,
               CAST(l_partkey % 40 AS DOUBLE) AS x1, CAST(l_suppkey % 40 AS DOUBLE) AS y1, CAST(l_partkey % 40 + 40 + l_quantity AS DOUBLE) AS x2, CAST(l_suppkey % 40 + 40 + l_quantity AS DOUBLE) AS y2,
               CAST(0.5 + l_discount * 4 AS DOUBLE) AS confidence
        FROM {lineitem}""",
    "challenge_frames": """
        SELECT user_id * 10 + event_id % 10 AS challenge_id, event_id AS idx, 100 + value % 10 AS x1, 100 + value % 7 AS y1, 200 + value % 10 AS x2, 200 + value % 7 AS y2,
               (value * 7) % 60 AS yaw, 0.5 + (value % 3) / 10 AS pitch_signal, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 0.1 + (value % 5) / 20 END AS ear,
               0.3 + (value % 2) / 20 AS mouth_width_ratio, (value % 10) / 10 AS passive_score, ts
        FROM {events}""",
    "session_input": """
        SELECT user_id AS challenge_id, event_id AS idx, CASE WHEN event_id % 11 <> 0 THEN 100 + value % 10 END AS x1, 100 + value % 7 AS y1, 200 + value % 10 AS x2, 200 + value % 7 AS y2,
               (value * 7) % 60 AS yaw, 0.5 + (value % 3) / 10 AS pitch_signal, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 0.1 + (value % 5) / 20 END AS ear,
               0.3 + (value % 2) / 20 AS mouth_width_ratio, (value % 10) / 10 AS passive_score, ts
        FROM {events}""",
    "job_events": """
        SELECT CAST(floor(event_id / 4) AS BIGINT) AS job_id, CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'claimed' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' END AS status, ts
        FROM {events}""",
    "stage_samples": """
        SELECT CASE event_type WHEN 'click' THEN 'detect' WHEN 'view' THEN 'encode' WHEN 'signup' THEN 'search' WHEN 'purchase' THEN 'job_total_server' ELSE 'client_terminal_e2e' END AS stage, value AS value_ms
        FROM {events}""",
    "access_log": "SELECT concat(CAST(user_id AS STRING), ':', CAST(event_id % 3 AS STRING)) AS key, event_id, ts FROM {events}",
    "token_issue": "SELECT concat(CAST(user_id AS STRING), '_', CAST(CAST(ts AS DATE) AS STRING)) AS token, min(ts) AS ts FROM {events} WHERE event_type = 'signup' GROUP BY 1",
    "token_issue_all": "SELECT concat(CAST(user_id AS STRING), '_', CAST(CAST(ts AS DATE) AS STRING)) AS token, ts FROM {events} WHERE event_type = 'signup'",
    "token_consume": "SELECT concat(CAST(user_id AS STRING), '_', CAST(CAST(ts AS DATE) AS STRING)) AS token, event_id, ts FROM {events} WHERE event_type = 'click'",
    "challenge_issue": "SELECT user_id * 100 + day(ts) AS challenge_id, min(ts) AS ts, CAST(min(event_id) % 2 AS STRING) AS ws_token FROM {events} WHERE event_type = 'signup' GROUP BY 1",
    "challenge_attempt": "SELECT user_id * 100 + day(ts) AS challenge_id, event_id, ts, CAST(event_id % 2 AS STRING) AS ws_token FROM {events} WHERE event_type = 'view'",
    "quality_signals": """
        SELECT l_orderkey * 10 + l_linenumber AS image_id, 100 + l_partkey % 200 AS min_image_side, CAST(l_quantity * 4 AS DOUBLE) AS blur_score, CAST(l_extendedprice % 256 AS DOUBLE) AS brightness, CAST(l_tax * 500 AS DOUBLE) AS contrast,
               40 + l_suppkey % 100 AS min_face_side, CAST(0.3 + l_discount * 7 AS DOUBLE) AS lower_face_v_ratio, CAST(l_tax * 4 AS DOUBLE) AS eye_edge_density,
               CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(0.4 + l_discount * 5 AS DOUBLE) END AS eye_dark_ratio
        FROM {lineitem}""",
    "log_text": "SELECT doc_id, concat(text, ' ', repeat('A', CAST(doc_id % 400 AS INT))) AS text FROM {documents}",
    "verify_attempts": """
        SELECT event_id AS id, CASE WHEN event_id % 31 = 0 THEN NULL ELSE user_id END AS user_id, event_id % 19 = 0 AS retry, event_id % 17 = 0 AS quality_rejected, event_id % 13 = 0 AS spoof,
               event_id % 7 <> 0 AS live_passed, CASE WHEN event_id % 29 = 0 THEN NULL ELSE round((value % 20) / 20, 4) END AS similarity, round((value % 7) / 28, 4) AS margin
        FROM {events}""",
    "liveness_signals": "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (value % 10) / 10 END AS passive, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (value % 8) / 8 END AS texture, (value % 4) / 4 AS behaviour FROM {events}",
    "queue_snapshots": "SELECT event_id AS id, event_id % 20 AS queue_len, user_id % 40 AS inflight, event_id % 8 AS slots, (value % 30) / 2 AS throughput FROM {events}",
    "jobs": """
        SELECT event_id AS job_id, event_id % 3 * 2 + 8 AS rate, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'completed' END AS status, value AS queue_delay_ms,
               CAST(value AS DOUBLE) AS created_at, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value + 1.5 END AS dequeued_at, value + 2.25 AS started_at, value + 2.25 + (value % 9) / 8 AS finished_at,
               CASE WHEN user_id % 50 = 0 AND event_id % 3 = 2 THEN 1 ELSE 0 END AS queue_left, 0 AS inflight_left, value % 11 AS detect_ms, value % 5 AS fast_detect_ms, value % 13 AS vector_search_ms
        FROM {events}""",
    "log_lines": """
        SELECT CASE WHEN event_id % 3 = 0 THEN concat('time=1 msg="JOB_ROW {{\\"job_id\\":\\"', CAST(event_id AS STRING), '\\",\\"status\\":\\"', event_type, '\\"}}" source=console')
                    WHEN event_id % 3 = 1 THEN concat('JOB_ROW {{"job_id":"', CAST(event_id AS STRING), '"') ELSE concat('other line ', event_type) END AS value
        FROM {events}""",
    "paths": """
        SELECT concat('file:/data/', n_name, '/', CAST(c_custkey AS STRING), CASE c_custkey % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' WHEN 3 THEN '.jpeg' ELSE '.mov' END) AS path, n_name AS folder, c_custkey
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "pad_paths": """
        SELECT concat('/pad/', CASE c_custkey % 7 WHEN 0 THEN 'live_selfie' WHEN 1 THEN 'Live_Video' WHEN 2 THEN 'printouts' WHEN 3 THEN 'Cutout Printouts' WHEN 4 THEN 'replay' WHEN 5 THEN 'cut-out' ELSE 'other' END,
                      '/', CAST(c_custkey AS STRING), CASE c_custkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.mp4' ELSE '.md' END) AS path
        FROM {customer}""",
    "pair_rows": """
        SELECT concat(replace(a.n_name, ' ', '_'), '_000', CAST(a.n_nationkey % 10 AS STRING), '.jpg') AS image_a, concat(replace(b.n_name, ' ', '_'), '_0012.JPG') AS image_b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 0 END AS is_same, (a.n_nationkey + b.n_nationkey) % 10 AS fold_id
        FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey OR a.n_nationkey = b.n_nationkey + 1""",
    "references_": "SELECT c_custkey AS id, c_custkey % 400 AS user_id, o_first AS ts, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE md5(CAST(c_custkey % 300 AS STRING)) END AS encrypted_hash FROM {customer} JOIN (SELECT o_custkey, min(o_orderdate) AS o_first FROM {orders} GROUP BY 1) o ON o_custkey = c_custkey",
    "enrolments": "SELECT o_orderkey AS id, o_custkey % 500 AS user_id, o_orderdate AS ts, md5(CAST(o_orderkey AS STRING)) AS encrypted_hash, CASE o_orderkey % 4 WHEN 0 THEN 'spoof' WHEN 1 THEN 'error' ELSE 'ok' END AS status FROM {orders}",
    "image_series": "SELECT o_custkey AS person, o_orderkey AS position, CASE o_orderkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'spoof' WHEN 2 THEN 'quality_reject' ELSE 'error' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'blurry' ELSE 'dark' END AS reason FROM {orders}",
    "metric_lines": """
        SELECT concat('queue_delay_ms_bucket{{le="', CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '10' WHEN 'signup' THEN '100' ELSE '+Inf' END, '"}} ', CAST(CAST(value AS INT) AS STRING)) AS value FROM {events}
        UNION ALL SELECT concat('inflight{{worker="', CAST(user_id AS STRING), '"}} ', CAST(CAST(value AS INT) AS STRING)) FROM {events}
        UNION ALL SELECT concat('# HELP inflight ', event_type) FROM {events}""",
    "error_lines": """
        SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'No face in image' WHEN 1 THEN 'Face not detected' WHEN 2 THEN 'Multiple faces not allowed' WHEN 3 THEN 'bad crop' WHEN 4 THEN 'Low confidence face' WHEN 5 THEN 'cannot decode' ELSE event_type END AS message
        FROM {events}""",
    "logits": "SELECT event_id AS id, value % 5 AS l0, value % 7 AS l1, (value * 3) % 11 AS l2 FROM {events}",
    "headers": "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN concat('10.1.', CAST(user_id AS STRING), '.1') WHEN event_id % 3 = 1 THEN ' ' END AS real_ip, CASE WHEN event_id % 4 < 2 THEN concat(' 10.2.0.', CAST(user_id % 9 AS STRING), ' , 10.9.9.9') END AS forwarded, CASE WHEN event_id % 5 > 0 THEN '127.0.0.1' END AS host FROM {events}",
}

_USED = re.compile(r"(?<!\{)\{(\w+)\}")


class Views:
    """Tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = VIEWS[name]
        return self.spark.sql(text, **{t: self(t) for t in set(_USED.findall(text))})


def duckdb_view(name: str) -> str:
    """A view's text for DuckDB, where the tables have their own names."""
    return _USED.sub(r"\1", VIEWS[name]).replace("{{", "{").replace("}}", "}")


def with_views(sql: str) -> str:
    """sql with the views that it names put before it."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not named:
        return sql
    ctes = ", ".join(f"{v} AS ({duckdb_view(v)})" for v in named)
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\s", body, re.I):
        return f"WITH RECURSIVE {ctes}, " + re.sub(r"^WITH\s+RECURSIVE\s", "", body, flags=re.I)
    return f"WITH {ctes}, " + body[5:] if re.match(r"WITH\s", body, re.I) else f"WITH {ctes} {body}"
