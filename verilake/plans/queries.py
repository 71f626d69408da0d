"""Registered queries of the library's operators, each with its DuckDB twin."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilake.functions import exprs
from verilake.functions.redact import redact_fields, sanitize_result
from verilake.operators import calibration, challenge, enroll, gates, pad, pairs, recognition, search, telemetry, windows
from verilake.plans.views import VIEWS, Views, with_views
from verilake.sources import files
from verilake.streaming import streams

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register v -> DataFrame under the function's name; sql may name any view."""

    def register(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return register


def _pairs(v: Views) -> DataFrame:
    return pairs.score_pairs(v("pair_list"), v("samples"))


def _frames(v: Views) -> DataFrame:
    return pad.face_drop_counts(v("all_frames"))[0]


def _split(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = pairs.gallery_probe_split(v("samples"))
    return rows.filter("role = 'probe'").drop("role"), rows.filter("role = 'gallery'").drop("role")


# --- flagship -------------------------------------------------------------------------

NEAREST = """
split AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY sample_idx) AS n FROM samples),
near AS (SELECT p.sample_idx AS probe_idx, p.identity AS own, g.sample_idx AS hit, g.identity AS hit_identity, round(list_inner_product(p.embedding::DOUBLE[], g.embedding::DOUBLE[]), 6) AS similarity
         FROM split p CROSS JOIN split g WHERE p.n > 1 AND g.n = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY probe_idx ORDER BY similarity DESC, hit) AS rank FROM near)"""


@query(f"""WITH {NEAREST}, margins AS (SELECT probe_idx, max(CASE WHEN rank = 1 THEN similarity END) AS top1, max(CASE WHEN rank = 1 THEN similarity END) - coalesce(max(CASE WHEN rank = 2 THEN similarity END), 0) AS margin FROM ranked WHERE rank <= 2 GROUP BY 1)
SELECT CASE WHEN top1 >= 0.45 THEN 'match' WHEN top1 <= 0.30 THEN 'no_match' ELSE 'low_confidence' END AS status, count(*) AS n, round(avg(margin), 6) AS mean_margin FROM margins GROUP BY 1""")
def verify_batch(v):
    probes, gallery = _split(v)
    margins = search.top2_margin(search.top_k_search(probes, gallery, 2))
    return margins.withColumn("status", gates.verification_decision(F.col("top1"))).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("margin"), 6).alias("mean_margin"))


# --- search -----------------------------------------------------------------------------


@query(f"WITH {NEAREST} SELECT probe_idx, rank, hit AS sample_idx, similarity FROM ranked WHERE rank <= 5")
def top_k_search(v):
    probes, gallery = _split(v)
    return search.top_k_search(probes, gallery, 5)


@query(f"WITH {NEAREST} SELECT probe_idx, rank, hit AS sample_idx, similarity FROM ranked WHERE rank <= 2 AND similarity >= 0.3")
def top_k_search_threshold(v):
    probes, gallery = _split(v)
    return search.top_k_search(probes, gallery, 2, sim_threshold=0.3)


@query(f"WITH {NEAREST} SELECT probe_idx, max(CASE WHEN rank = 1 THEN similarity END) AS top1, max(CASE WHEN rank = 1 THEN hit END) AS top1_idx, round(max(CASE WHEN rank = 1 THEN similarity END) - coalesce(max(CASE WHEN rank = 2 THEN similarity END), 0), 6) AS margin FROM ranked WHERE rank <= 2 GROUP BY 1")
def top2_margin(v):
    probes, gallery = _split(v)
    return search.top2_margin(search.top_k_search(probes, gallery, 2)).withColumn("margin", F.round("margin", 6))


@query(f"""WITH {NEAREST}, ranks AS (SELECT s.sample_idx, (SELECT min(rank) FROM ranked r WHERE r.probe_idx = s.sample_idx AND r.hit_identity = s.identity) AS rank FROM split s WHERE n > 1)
SELECT r.rank AS rank, round((SELECT count(*) FROM ranks WHERE ranks.rank <= r.rank) / (SELECT count(*) FROM ranks), 9) AS accuracy FROM (SELECT unnest(range(1, least(51, (SELECT count(*) + 1 FROM split WHERE n = 1)))) AS rank) r""")
def cmc_curve(v):
    probes, gallery = _split(v)
    return recognition.cmc_curve(search.probe_ranks(probes, gallery), gallery=gallery).withColumn("accuracy", F.round("accuracy", 9))


@query(f"WITH {NEAREST} SELECT (SELECT count(*) FROM split WHERE n > 1) AS n_probes, (SELECT count(*) FROM split WHERE n > 1) - count_if(rank = 1) AS n_mismatch FROM ranked")
def search_consistency(v):
    probes, gallery = _split(v)
    return search.search_consistency(probes, search.top_k_search(probes, gallery, 1), search.exhaustive_search(probes, gallery, 1))


CENTROIDS = """parts AS (SELECT identity, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM samples),
means AS (SELECT identity, pos, avg(x::DOUBLE) AS m FROM parts GROUP BY 1, 2),
cents AS (SELECT identity, list(m ORDER BY pos) AS v, sqrt(sum(m * m)) AS n FROM means GROUP BY 1)"""


@query(f"WITH {CENTROIDS} SELECT identity, pos - 1 AS pos, round(m / n, 4) AS x FROM means JOIN cents USING (identity)")
def user_centroids(v):
    return search.user_centroids(v("samples"), 4).select("identity", F.posexplode("centroid").alias("pos", "x")).select("identity", F.col("pos").cast("long").alias("pos"), "x")


@query(f"""WITH {NEAREST} SELECT a.probe_idx, a.expected_identity,
  CASE WHEN a.expected_identity IS NULL THEN a.fallback WHEN a.expected_identity NOT IN (SELECT identity FROM samples) THEN false ELSE coalesce(r.hit_identity = a.expected_identity, false) END AS is_genuine
FROM attempts a LEFT JOIN ranked r ON r.probe_idx = a.probe_idx AND r.rank = 1""")
def resolve_is_genuine(v):
    probes, gallery = _split(v)
    top1 = search.top2_margin(search.top_k_search(probes, gallery, 2))
    return search.resolve_is_genuine(v("attempts"), v("samples"), top1)


@query(f"""WITH {CENTROIDS} SELECT a.probe_idx, a.expected_identity,
  CASE WHEN a.expected_identity IS NULL THEN a.fallback WHEN c.identity IS NULL THEN false ELSE list_inner_product(s.embedding::DOUBLE[], list_transform(c.v, lambda x: round(x / c.n, 6))) >= 0.45 END AS is_genuine
FROM attempts a JOIN samples s ON s.sample_idx = a.probe_idx LEFT JOIN cents c ON c.identity = a.expected_identity""")
def resolve_is_genuine_centroid(v):
    return search.resolve_is_genuine(v("attempts"), v("samples"), v("samples").limit(0).select(F.col("sample_idx").alias("probe_idx"), F.col("sample_idx").alias("top1_idx")), simple=False)


# --- pairs ------------------------------------------------------------------------------


@query("SELECT x.sample_idx AS a, y.sample_idx AS b FROM samples x JOIN samples y ON x.identity = y.identity AND x.sample_idx < y.sample_idx")
def genuine_pairs(v):
    return pairs.genuine_pairs(v("samples"))


@query("""WITH c AS (SELECT count(*) AS n FROM samples), d AS (SELECT unnest(range(0, 8 * n)) AS draw FROM c),
x AS (SELECT draw, ('0x' || substr(md5('7:a:' || draw), 1, 12))::BIGINT % n AS x, ('0x' || substr(md5('7:b:' || draw), 1, 12))::BIGINT % n AS y FROM d, c),
p AS (SELECT least(x, y) AS a, greatest(x, y) AS b, min(draw) AS draw FROM x JOIN samples s ON s.sample_idx = x JOIN samples t ON t.sample_idx = y WHERE s.identity <> t.identity GROUP BY 1, 2)
SELECT a, b, draw FROM (SELECT *, row_number() OVER (ORDER BY draw) AS k FROM p) WHERE k <= (SELECT n FROM c)""")
def impostor_pairs(v):
    return pairs.impostor_pairs(v("samples"), v("samples").count())


SCORED_PAIRS = "sp AS (SELECT p.*, round(list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS score FROM pair_list p JOIN samples x ON x.sample_idx = a JOIN samples y ON y.sample_idx = b)"


@query(f"WITH {SCORED_PAIRS} SELECT pair_id, a, b, label, fold, score FROM sp")
def score_pairs(v):
    return _pairs(v)


@query(f"""WITH {SCORED_PAIRS}, f AS (SELECT sp.*, coalesce(x.n_faces, 0) AS na, coalesce(y.n_faces, 0) AS nb FROM sp LEFT JOIN face_counts x ON x.sample_idx = a LEFT JOIN face_counts y ON y.sample_idx = b)
SELECT slice, count(*) AS n, count_if(label = 1) AS n_genuine FROM (SELECT 'all' AS slice, label FROM f UNION ALL SELECT CASE WHEN na = 1 AND nb = 1 THEN 'single' ELSE 'multi' END, label FROM f WHERE na > 0 AND nb > 0) GROUP BY 1""")
def pair_slices(v):
    return pairs.pair_slices(_pairs(v), v("face_counts")).groupBy("slice").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_genuine"))


@query("SELECT DISTINCT sample_idx FROM (SELECT a AS sample_idx FROM pair_list UNION ALL SELECT b FROM pair_list)")
def unique_pair_images(v):
    return pairs.unique_pair_images(v("pair_list"))


@query("SELECT a AS sample_idx FROM pair_list UNION SELECT b FROM pair_list EXCEPT SELECT sample_idx FROM samples WHERE sample_idx % 3 <> 0")
def missing_embeddings(v):
    return pairs.missing_embeddings(v("pair_list"), v("samples").filter("sample_idx % 3 <> 0"))


@query("SELECT sample_idx, identity, CASE WHEN row_number() OVER (PARTITION BY identity ORDER BY sample_idx) = 1 THEN 'gallery' ELSE 'probe' END AS role FROM samples")
def gallery_probe_split(v):
    return pairs.gallery_probe_split(v("samples")).drop("embedding")


@query("SELECT count(*) AS n_ids, sum(n)::BIGINT AS n_images, min(n) AS min_per_id, avg(n) AS mean_per_id, max(n) AS max_per_id, count_if(n = 1) AS single_image_ids FROM (SELECT identity, count(*) AS n FROM samples GROUP BY 1)")
def dataset_stats(v):
    return pairs.dataset_stats(v("samples"))


# --- recognition metrics ----------------------------------------------------------------

RATES = "CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS far, CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END AS frr, 1 - CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END AS tar, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall"


def _conf(source: str, t: str) -> str:
    return f"SELECT count_if(score >= {t} AND label = 1) AS tp, count_if(score >= {t} AND label = 0) AS fp, count_if(score < {t} AND label = 0) AS tn, count_if(score < {t} AND label = 1) AS fn FROM {source}"


@query(f"SELECT *, {RATES} FROM ({_conf('scored', '0.45')})")
def confusion(v):
    return recognition.confusion(v("scored"), 0.45)


@query(f"SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (SELECT *, {RATES} FROM ({_conf('scored', '0.3')}))")
def f1_at_threshold(v):
    return recognition.f1_at_threshold(v("scored"), 0.3)


GRID = """b AS (SELECT min(score) AS lo, max(score) AS hi FROM scored),
grid AS (SELECT i AS idx, CASE WHEN i = 199 THEN hi ELSE i * ((hi - lo) / 199) + lo END AS threshold FROM b, (SELECT unnest(range(0, 200)) AS i)),
counts AS (SELECT score, count_if(label = 1) AS p, count_if(label = 0) AS q FROM scored GROUP BY 1),
sweep AS (SELECT idx, threshold, coalesce(sum(p) FILTER (score >= threshold), 0)::BIGINT AS tp, coalesce(sum(q) FILTER (score >= threshold), 0)::BIGINT AS fp, coalesce(sum(q) FILTER (score < threshold), 0)::BIGINT AS tn, coalesce(sum(p) FILTER (score < threshold), 0)::BIGINT AS fn FROM grid, counts GROUP BY 1, 2)"""


@query(f"WITH {GRID} SELECT *, {RATES} FROM sweep")
def sweep_confusion(v):
    return recognition.sweep_confusion(v("scored"))


@query(f"WITH {GRID}, r AS (SELECT *, {RATES} FROM sweep) SELECT idx, threshold, far, frr, CASE WHEN far > 0.001 THEN 'far_too_high' WHEN frr > 0.03 THEN 'frr_too_high' ELSE 'ok' END AS verdict FROM r")
def sweep_verdict(v):
    return gates.sweep_verdict(recognition.sweep_confusion(v("scored"))).select("idx", "threshold", "far", "frr", "verdict")


def _roc(source: str = "scored", key: str = "") -> str:
    part = f"PARTITION BY {key} " if key else ""
    k = f"{key}, " if key else ""
    own = f"PARTITION BY {key}" if key else ""
    g = f"GROUP BY {key}" if key else ""
    return f"""points AS (SELECT {k}row_number() OVER w AS idx, score, label, count_if(label = 1) OVER w AS tp, count_if(label = 0) OVER w AS fp, count_if(label = 1) OVER ({own}) AS pos, count_if(label = 0) OVER ({own}) AS neg
  FROM {source} WINDOW w AS ({part}ORDER BY score DESC, pair_id ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT {k}idx, score AS threshold, fp / neg AS far, tp / pos AS tar, 1 - tp / pos AS frr FROM points
  UNION ALL SELECT {k}0, max(score) + 1, 0, 0, 1 FROM points {g} UNION ALL SELECT {k}count(*) + 1, min(score) - 1, 1, 1, 0 FROM points {g}),
area AS (SELECT {k}sum(CASE WHEN label = 0 THEN tp ELSE 0 END) / (max(pos) * max(neg)) AS auc FROM points {g}),
eer AS (SELECT {k}(far + frr) / 2 AS eer, threshold AS eer_threshold FROM (SELECT *, row_number() OVER ({part}ORDER BY abs(far - frr), idx) AS n FROM curve) WHERE n = 1)"""


def _at(target: str, name: str, key: str = "") -> str:
    k, g = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return f"(SELECT {k}max({{'tar': tar, 't': threshold}}).tar AS {name}, max({{'tar': tar, 't': threshold}}).t AS {name}_threshold FROM curve WHERE far <= {target} {g})"


@query(f"WITH {_roc()} SELECT * FROM curve")
def roc_curve(v):
    return recognition.roc_curve(recognition.roc_points(v("scored"))).select("idx", "threshold", "far", "tar", "frr")


@query(f"WITH {_roc()} SELECT max(idx) AS idx, score, max(tp) AS tp, max(fp) AS fp FROM points GROUP BY score")
def roc_collapsed(v):
    return recognition.collapse_ties(recognition.roc_points(v("scored"))).select("idx", "score", "tp", "fp")


@query(f"WITH {_roc()} SELECT * FROM area")
def auc(v):
    return recognition.auc(recognition.roc_points(v("scored")))


@query(f"WITH {_roc()} SELECT * FROM {_at('0.01', 'tar_at_far')}")
def tar_at_far(v):
    return recognition.tar_at_far(recognition.roc_curve(recognition.roc_points(v("scored"))), 0.01)


@query(f"WITH {_roc()} SELECT * FROM eer")
def eer_point(v):
    return recognition.eer_point(recognition.roc_curve(recognition.roc_points(v("scored"))))


RECOMMEND = f"""{_roc()}, {GRID}, r AS (SELECT *, {RATES} FROM sweep), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r),
rec AS (SELECT tar_at_far_threshold AS high, (SELECT threshold FROM f ORDER BY f1 DESC, idx LIMIT 1) AS low FROM {_at('0.001', 'tar_at_far')})"""


@query(f"WITH {RECOMMEND} SELECT high, low, eer, eer_threshold, greatest(0, least(high - low, high)) AS margin FROM rec, eer")
def recommend_thresholds(v):
    return recognition.recommend_thresholds(v("scored"))


@query("""WITH b AS (SELECT unnest(range(0, 50)) AS bin), e AS (SELECT bin::INT AS bin, bin * 0.04::DOUBLE + -1.0::DOUBLE AS left_edge, CASE WHEN bin = 49 THEN 1.0 ELSE (bin + 1) * 0.04::DOUBLE + -1.0::DOUBLE END AS right_edge FROM b)
SELECT bin, left_edge, coalesce(count_if(label = 1), 0) AS genuine, coalesce(count_if(label = 0), 0) AS impostor FROM e LEFT JOIN scored ON score >= left_edge AND (score < right_edge OR bin = 49 AND score <= 1) GROUP BY 1, 2""")
def score_distribution(v):
    return recognition.score_distribution(v("scored"))


EVAL = f"""WITH {RECOMMEND}, n AS (SELECT count(*) AS n_pairs, count_if(label = 1) AS n_genuine, count_if(label = 0) AS n_impostor FROM scored), c AS (SELECT {RATES} FROM ({_conf('scored', '0.45')}))
SELECT n.*, NULL::VARCHAR AS error, a.*, b.*, auc, high, low, eer, eer_threshold, greatest(0, least(high - low, high)) AS margin, c.far AS current_far, c.frr AS current_frr
FROM n, {_at('0.001', 'tar_at_far_0_001')} a, {_at('0.01', 'tar_at_far_0_01')} b, area, rec, eer, c"""


@query(EVAL)
def eval_1to1(v):
    return recognition.eval_1to1(v("scored"))


@query(f"""WITH {_roc('scored', 'slice')} SELECT p.slice, max(pos) AS n_genuine, max(neg) AS n_impostor, NULL::VARCHAR AS error, any_value(a.tar_at_far_0_001) AS tar_at_far_0_001, any_value(a.tar_at_far_0_001_threshold) AS tar_at_far_0_001_threshold,
any_value(b.tar_at_far_0_01) AS tar_at_far_0_01, any_value(b.tar_at_far_0_01_threshold) AS tar_at_far_0_01_threshold, any_value(auc) AS auc, any_value(eer) AS eer, any_value(eer_threshold) AS eer_threshold
FROM points p JOIN {_at('0.001', 'tar_at_far_0_001', 'slice')} a USING (slice) JOIN {_at('0.01', 'tar_at_far_0_01', 'slice')} b USING (slice) JOIN area USING (slice) JOIN eer USING (slice) GROUP BY p.slice""")
def subset_metrics(v):
    return recognition.subset_metrics(v("scored"))


@query("""WITH c AS (SELECT fold, score, count_if(label = 1) AS p, count_if(label = 0) AS q FROM scored GROUP BY 1, 2),
a AS (SELECT fold, (sum(p) OVER (PARTITION BY fold ORDER BY score DESC) + sum(q) OVER (PARTITION BY fold) - sum(q) OVER (PARTITION BY fold ORDER BY score DESC)) / sum(p + q) OVER (PARTITION BY fold) AS acc FROM c)
SELECT count(*) AS n_folds, round(avg(best), 9) AS mean_accuracy, round(stddev_pop(best), 9) AS std_accuracy FROM (SELECT fold, max(acc) AS best FROM a GROUP BY 1)""")
def fold_accuracy(v):
    return recognition.fold_accuracy(v("scored")).select("n_folds", F.round("mean_accuracy", 9).alias("mean_accuracy"), F.round("std_accuracy", 9).alias("std_accuracy"))


# --- presentation attacks ---------------------------------------------------------------

FRAMES = "frames AS (SELECT * FROM all_frames WHERE face_detected)"


@query("SELECT cls, count(*) AS n, count_if(NOT face_detected) AS no_face FROM all_frames GROUP BY 1")
def pad_predictions(v):
    return pad.face_drop_counts(v("all_frames"))[1]


def _padc(source: str, t: str) -> str:
    return f"SELECT n, tp, fp, tn, fn, apcer, npcer, (apcer + npcer) / 2 AS acer, (tp + tn) / n AS accuracy, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS tpr FROM (SELECT count(*) OVER () * 0 + n AS n, tp, fp, tn, fn, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS apcer, CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END AS npcer FROM (SELECT count(*) AS n, count_if(score >= {t} AND label = 1) AS tp, count_if(score >= {t} AND label = 0) AS fp, count_if(score < {t} AND label = 0) AS tn, count_if(score < {t} AND label = 1) AS fn FROM {source}))"


def _apcer(source: str, t: str) -> str:
    return f"SELECT a.attack_type, count(label) AS n, count_if(score >= {t}) AS accepted, CASE WHEN count(label) > 0 THEN count_if(score >= {t}) / count(label) ELSE 0 END AS apcer, CASE WHEN count(label) > 0 THEN 1 - count_if(score >= {t}) / count(label) ELSE 0 END AS accuracy FROM (VALUES ('print'), ('replay'), ('cutout')) a(attack_type) LEFT JOIN (SELECT * FROM {source} WHERE label = 0) f ON f.attack_type = a.attack_type GROUP BY 1"


def _pad_at(source: str, t: str) -> str:
    return f"SELECT c.n, apcer_max, npcer, (apcer_max + npcer) / 2 AS acer, accuracy, NULL::VARCHAR AS error FROM ({_padc(source, t)}) c, (SELECT coalesce(max(apcer), 0) AS apcer_max FROM ({_apcer(source, t)}) WHERE n > 0)"


@query(f"WITH {FRAMES} {_padc('frames', '0.7')}")
def pad_confusion(v):
    return pad.pad_confusion(_frames(v), 0.7)


@query(f"WITH {FRAMES} {_apcer('frames', '0.5')}")
def apcer_per_type(v):
    return pad.apcer_per_type(_frames(v), 0.5)


@query(f"WITH {FRAMES} {_pad_at('frames', '0.6')}")
def pad_eval_at(v):
    return pad.pad_eval_at(_frames(v), 0.6)


PAD_BEST = f"""fs AS (SELECT frame_index AS pair_id, score, label, attack_type FROM frames), {_roc('fs')},
b AS (SELECT min(score) AS lo, max(score) AS hi FROM frames), grid AS (SELECT i AS idx, CASE WHEN i = 199 THEN hi ELSE i * ((hi - lo) / 199) + lo END AS threshold FROM b, (SELECT unnest(range(0, 200)) AS i)),
counts AS (SELECT attack_type, score, count(*) AS c FROM frames GROUP BY 1, 2), per AS (SELECT idx, threshold, attack_type, coalesce(sum(c) FILTER (score >= threshold), 0) / sum(c) AS up FROM grid, counts GROUP BY 1, 2, 3),
acers AS (SELECT idx, threshold, (coalesce(max(up) FILTER (attack_type <> 'live'), 0) + 1 - max(up) FILTER (attack_type = 'live')) / 2 AS acer FROM per GROUP BY 1, 2),
best AS (SELECT threshold, acer FROM acers ORDER BY round(acer, 12), idx LIMIT 1)"""


@query(f"WITH {FRAMES}, {PAD_BEST} SELECT threshold, acer, eer, eer_threshold, auc FROM best, eer, area")
def recommend_threshold_pad(v):
    return pad.recommend_threshold_pad(_frames(v), id_col="frame_index")


VIDEOS = "videos AS (SELECT source, avg(score) AS score, stddev_pop(score) AS score_std, count(*) AS n_frames, arg_min(label, frame_index) AS label, arg_min(attack_type, frame_index) AS attack_type, min(frame_index) AS first_frame FROM frames GROUP BY 1)"


@query(f"WITH {FRAMES}, {VIDEOS} SELECT source, round(score, 9) AS score, round(score_std, 9) AS score_std, n_frames, label, attack_type, first_frame FROM videos")
def video_scores(v):
    return pad.video_scores(_frames(v)).withColumns({c: F.round(c, 9) for c in ("score", "score_std")})


@query(f"WITH {FRAMES}, {PAD_BEST}, now AS ({_pad_at('frames', '0.859')}) SELECT now.*, threshold, eer, auc, (SELECT x.apcer_max FROM ({_pad_at('frames', '(SELECT threshold FROM best)')}) x) AS best_apcer_max, (SELECT x.npcer FROM ({_pad_at('frames', '(SELECT threshold FROM best)')}) x) AS best_npcer, (SELECT x.acer FROM ({_pad_at('frames', '(SELECT threshold FROM best)')}) x) AS best_acer, (SELECT x.accuracy FROM ({_pad_at('frames', '(SELECT threshold FROM best)')}) x) AS best_accuracy FROM now, best, eer, area")
def eval_pad(v):
    return pad.eval_pad(_frames(v))


@query(f"""WITH {FRAMES}, {VIDEOS}, f AS ({_pad_at('frames', '0.859')}), w AS ({_pad_at('videos', '0.859')})
SELECT f.n AS frame_n, f.apcer_max AS frame_apcer_max, f.npcer AS frame_npcer, f.acer AS frame_acer, f.accuracy AS frame_accuracy, w.n AS video_n, w.apcer_max AS video_apcer_max, w.npcer AS video_npcer, w.acer AS video_acer, w.accuracy AS video_accuracy,
(SELECT min(score) FROM videos WHERE label = 1) AS live_min, (SELECT max(score) FROM videos WHERE label = 0) AS attack_max, (SELECT avg(score_std) FROM videos WHERE label = 1) AS live_std, (SELECT avg(score_std) FROM videos WHERE label = 0) AS attack_std,
(SELECT min(n_frames) FROM videos) AS min_frames, (SELECT max(n_frames) FROM videos) AS max_frames, (SELECT avg(n_frames) FROM videos) AS mean_frames,
(SELECT min(score) FROM videos WHERE label = 1) > (SELECT max(score) FROM videos WHERE label = 0) AS strict_gap, f.accuracy >= 0.98 AS frame_target_met, w.accuracy >= 0.98 AS video_target_met FROM f, w""")
def eval_combined(v):
    return pad.eval_combined(_frames(v))


@query(f"WITH {FRAMES} SELECT count(*) AS n_attack, 0 AS spoof_accepted, count(*) AS spoof_rejected, 0.0::DOUBLE AS spoof_accept_rate, 1.0::DOUBLE AS spoof_rejection_rate, true AS target_met FROM frames WHERE label = 0")
def active_gate_policy(v):
    return pad.active_gate_policy(_frames(v))


PAD_MANIFEST = """m AS (SELECT path, lower(split_part(path, '/', 3)) AS f, lower(split_part(path, '.', 2)) AS e FROM pad_paths), c AS (SELECT path, e, CASE WHEN f IN ('cutout printouts', 'cut-out') THEN 'cut-out printouts' ELSE f END AS cls FROM m),
f AS (SELECT cls, CASE WHEN cls LIKE 'live%' THEN 1 ELSE 0 END AS label, CASE cls WHEN 'printouts' THEN 'print' WHEN 'cut-out printouts' THEN 'cutout' WHEN 'replay' THEN 'replay' ELSE 'live' END AS attack_type, path, e = 'jpg' AS is_image, unnest(CASE WHEN e = 'jpg' THEN [NULL::BIGINT] ELSE range(0, 30) END)::INT AS frame_index
FROM c WHERE cls <> 'other' AND e IN ('jpg', 'mp4'))"""


@query(f"""WITH {PAD_MANIFEST} SELECT 'class' AS kind, cls AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'attack_type', attack_type, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'label', label::VARCHAR, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'medium', CASE WHEN is_image THEN 'image' ELSE 'video_frame' END, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*) FROM f""")
def pad_dataset_stats(v):
    return pad.pad_dataset_stats(files.pad_manifest(v("pad_paths")))


@query(f"WITH {PAD_MANIFEST} SELECT * FROM f")
def read_pad_manifest(v):
    return files.pad_manifest(v("pad_paths"))


# --- gates and decisions ----------------------------------------------------------------

IMAGE_REASON = "CASE WHEN min_image_side < 160 THEN 'image_too_small' WHEN blur_score < 45 THEN 'image_blurry' WHEN brightness < 35 THEN 'too_dark' WHEN brightness > 225 THEN 'too_bright' WHEN contrast < 18 THEN 'low_contrast' END"
OCCLUSION = "min_face_side >= 64 AND lower_face_v_ratio < 0.50 AS has_mask, eye_edge_density > 0.25 AS has_glasses, min_face_side >= 64 AND coalesce(eye_dark_ratio < 0.60, false) AS has_sunglasses"


@query(f"SELECT image_id, {IMAGE_REASON} AS quality_warning, {IMAGE_REASON} IS NOT NULL AS quality_hard_reject FROM quality_signals")
def quality_gate_image(v):
    return gates.quality_gate_image(v("quality_signals")).select("image_id", "quality_warning", "quality_hard_reject")


@query(f"SELECT image_id, {OCCLUSION} FROM quality_signals")
def occlusion_flags(v):
    return gates.occlusion_flags(v("quality_signals")).select("image_id", "has_mask", "has_glasses", "has_sunglasses")


@query(f"""SELECT image_id, CASE WHEN has_mask OR has_glasses OR has_sunglasses THEN 'remove_occlusion' WHEN min_face_side < 72 THEN 'face_too_small' END AS face_reason,
CASE WHEN has_mask OR has_glasses OR has_sunglasses THEN true WHEN min_face_side < 64 THEN true WHEN min_face_side < 72 THEN false ELSE false END AS face_reject FROM (SELECT *, {OCCLUSION} FROM quality_signals)""")
def quality_gate_face(v):
    return gates.quality_gate_face(gates.occlusion_flags(v("quality_signals")), mode="soft").select("image_id", "face_reason", "face_reject")


DECISION = "CASE WHEN similarity IS NULL THEN 'no_match' WHEN similarity >= 0.45 THEN 'match' WHEN similarity <= 0.30 THEN 'no_match' ELSE 'low_confidence' END"


@query(f"SELECT id, {DECISION} AS status, CASE WHEN similarity IS NULL THEN NULL WHEN similarity >= 0.45 THEN 'high' WHEN similarity >= 0.30 THEN 'medium' ELSE 'low' END AS label, {DECISION} = 'match' AND margin > 0.05 AND margin < 0.20 AS challenge FROM verify_attempts")
def verification_decision(v):
    rows = v("verify_attempts").withColumn("status", gates.verification_decision(F.col("similarity")))
    return rows.select("id", "status", gates.confidence_label(F.col("status"), F.col("similarity")).alias("label"), gates.challenge_recommended(F.col("status"), F.col("margin")).alias("challenge"))


@query("""SELECT id, liveness, CASE WHEN liveness >= 0.8 THEN 'low' WHEN liveness >= 0.6 THEN 'medium' ELSE 'high' END AS risk, liveness >= 0.859 AS passed FROM (SELECT id, CASE WHEN passive IS NOT NULL THEN 0.6::DOUBLE * passive + 0.25::DOUBLE * coalesce(texture, 0) + 0.15::DOUBLE * coalesce(behaviour, 0) ELSE 0.7::DOUBLE * coalesce(texture, 0) + 0.3::DOUBLE * coalesce(behaviour, 0) END AS liveness FROM liveness_signals)""")
def fuse_liveness(v):
    return v("liveness_signals").select("id", gates.fuse_liveness(F.col("passive"), F.col("texture"), F.col("behaviour")).alias("f")).select("id", "f.*")


ROUTE = f"SELECT *, CASE WHEN retry THEN 'retry' WHEN quality_rejected THEN 'quality_reject' WHEN spoof THEN 'spoof_detected' WHEN NOT live_passed THEN 'spoof_detected' ELSE {DECISION} END AS status FROM verify_attempts"


@query(f"SELECT status, count(*) AS n FROM ({ROUTE}) GROUP BY 1")
def route_results(v):
    return gates.route_outcome(v("verify_attempts"))[0].groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT id, status, CASE WHEN quality_rejected OR spoof THEN 0 ELSE similarity END AS log_similarity FROM ({ROUTE}) WHERE status <> 'retry' AND user_id IS NOT NULL")
def route_outcome(v):
    return gates.route_outcome(v("verify_attempts"))[1].select("id", "status", "log_similarity")


@query("""SELECT id, CASE WHEN reason IN ('no_face', 'multiple_faces') THEN 'no_face' WHEN reason IN ('bad_crop', 'low_confidence') THEN 'quality_reject' ELSE 'processing_failed' END AS status, reason, CASE WHEN reason = 'invalid_image' THEN 'error' ELSE 'reject' END AS terminal_state, sync_reason
FROM (SELECT id, CASE WHEN m LIKE '%no face%' OR m LIKE '%not detected%' THEN 'no_face' WHEN m LIKE '%multiple%' THEN 'multiple_faces' WHEN m LIKE '%bad crop%' THEN 'bad_crop' WHEN m LIKE '%low confidence%' THEN 'low_confidence' ELSE 'invalid_image' END AS reason,
CASE WHEN m LIKE '%no face%' THEN 'no_face' WHEN m LIKE '%multiple%' THEN 'multiple_faces' WHEN m LIKE '%decode%' OR m LIKE '%image%' THEN 'invalid_image' ELSE 'pipeline_error' END AS sync_reason FROM (SELECT id, lower(message) AS m FROM error_lines))""")
def classify_error(v):
    rows = v("error_lines").withColumns({"w": gates.classify_error(F.col("message")), "s": gates.classify_error(F.col("message"), "sync")})
    return rows.select("id", "w.*", F.col("s.reason").alias("sync_reason"))


@query("""SELECT id, d AS estimated_delay_ms, CASE WHEN inflight >= 30 THEN 'inflight_limit' WHEN queue_len >= 15 THEN 'queue_overflow' WHEN d >= 1500 THEN 'estimated_delay' END AS reject_reason, CASE WHEN d >= 1500 THEN 'shed' WHEN d >= 500 THEN 'degrade' ELSE 'normal' END AS mode
FROM (SELECT *, greatest(queue_len, greatest(0, inflight - slots)) / greatest(0.1, throughput) * 1000 AS d FROM queue_snapshots)""")
def admission_decision(v):
    return gates.admission_decision(v("queue_snapshots")).select("id", "estimated_delay_ms", "reject_reason", "mode")


@query("SELECT job_id, finished_at - created_at > 3.0 OR queue_delay_ms > 400 AS stale FROM jobs")
def job_stale(v):
    return v("jobs").select("job_id", gates.job_stale(F.col("finished_at") - F.col("created_at"), F.col("queue_delay_ms"), True, 3.0, 400.0).alias("stale"))


@query("SELECT id, coalesce(nullif(trim(real_ip), ''), nullif(trim(split_part(forwarded, ',', 1)), ''), nullif(trim(host), ''), 'unknown') AS ip FROM headers")
def client_ip(v):
    return v("headers").select("id", exprs.client_ip(F.col("real_ip"), F.col("forwarded"), F.col("host"), "unknown").alias("ip"))


@query("SELECT id, round(exp(l1 - m) / s, 9) AS real, round(exp(l2 - m) / s, 9) AS spoof FROM (SELECT *, exp(l0 - m) + exp(l1 - m) + exp(l2 - m) AS s FROM (SELECT *, greatest(l0, l1, l2) AS m FROM logits))")
def softmax_real(v):
    rows = v("logits").select("id", exprs.softmax_real(F.array("l0", "l1", "l2")).alias("s"))
    return rows.select("id", F.round("s.real", 9).alias("real"), F.round("s.spoof", 9).alias("spoof"))


@query("""SELECT image, det_idx, x1 * 2 AS sx1, y1 * 1.5 AS sy1, x2 * 2 AS sx2, y2 * 1.5 AS sy2, greatest(0, least((x1 + x2) / 2 - (x2 - x1) * 0.3 / 2, 200)) AS ex1, greatest(0, least((y1 + y2) / 2 + (y2 - y1) * 0.3 / 2, 100)) AS ey2 FROM detections""")
def scale_boxes(v):
    s = exprs.scale_boxes(F.array("x1", "y1", "x2", "y2"), F.lit(2.0), F.lit(1.5))
    e = exprs.expand_bbox(_Box(), F.lit(0.3), F.lit(200.0), F.lit(100.0))
    rows = v("detections").withColumns({"_s": s, "_e": e})
    return rows.select("image", "det_idx", *[F.col("_s")[i].alias(n) for i, n in enumerate(("sx1", "sy1", "sx2", "sy2"))], F.col("_e.x1").alias("ex1"), F.col("_e.y2").alias("ey2"))


class _Box:
    x1, y1, x2, y2 = property(lambda s: F.col("x1")), property(lambda s: F.col("y1")), property(lambda s: F.col("x2")), property(lambda s: F.col("y2"))


@query("SELECT c_custkey, unnest(CASE WHEN k <= 0 THEN [] WHEN k = 1 THEN [0] ELSE list_transform(range(0, k), lambda i: round_even(i * (total - 1) / (k - 1), 0)::INT) END)::INT AS frame FROM (SELECT c_custkey, c_custkey % 40 AS total, least(7, c_custkey % 40) AS k FROM customer)")
def uniform_frame_indices(v):
    return v("customer").select("c_custkey", F.explode(exprs.uniform_frame_indices(F.lit(7), (F.col("c_custkey") % 40).cast("int"))).alias("frame"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.amount') AS DOUBLE) AS a, try_cast(event_type AS DOUBLE) AS b, try_cast(CAST(value AS VARCHAR) AS DOUBLE) AS c FROM events")
def parse_float(v):
    return v("events").select("event_id", exprs.parse_float(F.get_json_object("props", "$.amount")).alias("a"), exprs.parse_float("event_type").alias("b"), exprs.parse_float(F.col("value").cast("string")).alias("c"))


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS self_dot, round(sqrt(list_sum(list_transform(list_transform(embedding::DOUBLE[], lambda x: x * 3), lambda y: y * y))), 4) AS norm3 FROM embeddings")
def l2_normalize(v):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = exprs.l2_normalize(tripled)
    return v("embeddings").select("vec_id", F.round(exprs.dot(unit, unit), 5).alias("self_dot"), F.round(exprs.norm(tripled), 4).alias("norm3"))


# --- windows, tokens, faces, challenges -------------------------------------------------


QUERY_ANCHORED = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM access_log),
f AS (SELECT key, event_id, ts, n, ts AS anchor, 1 AS nth FROM e WHERE n = 1 UNION ALL
SELECT e.key, e.event_id, e.ts, e.n, CASE WHEN e.ts >= f.anchor + INTERVAL 1 DAY THEN e.ts ELSE f.anchor END, CASE WHEN e.ts >= f.anchor + INTERVAL 1 DAY THEN 1 ELSE f.nth + 1 END FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
SELECT key, event_id, nth::INT AS nth, nth > {limit} AS repeat FROM f"""


@query(QUERY_ANCHORED.format(limit=1))
def anchored_window_verdict(v):
    return windows.anchored_window_verdict(v("access_log"), 86400).select("key", "event_id", "nth", "repeat")


@query("""WITH j AS (SELECT c.*, i.token AS t FROM token_consume c LEFT JOIN token_issue i ON c.token = i.token AND c.ts >= i.ts AND c.ts < i.ts + INTERVAL 4 HOUR)
SELECT token, event_id, ts, t IS NOT NULL AND row_number() OVER (PARTITION BY token, t IS NOT NULL ORDER BY ts, event_id) = 1 AS valid FROM j""")
def consume_tokens(v):
    return windows.consume_tokens(v("token_issue"), v("token_consume"), 4 * 3600)


@query("""WITH j AS (SELECT a.*, i.ts AS t0, coalesce(a.ts >= i.ts AND a.ts < i.ts + INTERVAL 6 HOUR, false) AS early, coalesce(a.ws_token = i.ws_token, false) AS good FROM challenge_attempt a LEFT JOIN challenge_issue i USING (challenge_id)),
o AS (SELECT *, min(CASE WHEN early AND good THEN {'ts': ts, 'e': event_id} END) OVER (PARTITION BY challenge_id) AS op FROM j)
SELECT challenge_id, event_id, ts, ws_token, CASE WHEN NOT (CASE WHEN op IS NOT NULL AND (ts > op.ts OR ts = op.ts AND event_id > op.e) THEN ts < op.ts + INTERVAL 6 HOUR ELSE early END) THEN '4410' WHEN NOT good THEN '4401' WHEN op IS NOT NULL AND op.e = event_id THEN 'ok' ELSE '4409' END AS code FROM o""")
def challenge_access(v):
    return windows.challenge_access(v("challenge_issue"), v("challenge_attempt"), 6 * 3600)


@query("""WITH RECURSIVE d AS (SELECT *, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area FROM detections),
g AS (SELECT image, det_idx, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'a': area}] AS reps, [{'c': confidence, 'i': det_idx, 'a': area}] AS best FROM d WHERE det_idx = 1 UNION ALL
SELECT d.image, d.det_idx, CASE WHEN p = 0 THEN list_append(reps, {'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2, 'a': d.area}) ELSE reps END,
CASE WHEN p = 0 THEN list_append(best, {'c': d.confidence, 'i': d.det_idx, 'a': d.area}) ELSE list_transform(best, lambda b, k: CASE WHEN k = p AND d.confidence > b.c THEN {'c': d.confidence, 'i': d.det_idx, 'a': d.area} ELSE b END) END
FROM (SELECT g.image, g.reps, g.best, d.det_idx AS nxt, coalesce(list_position(list_transform(g.reps, lambda r: coalesce(greatest(0, least(d.x2, r.x2) - greatest(d.x1, r.x1)) * greatest(0, least(d.y2, r.y2) - greatest(d.y1, r.y1)) / nullif(d.area + r.a - greatest(0, least(d.x2, r.x2) - greatest(d.x1, r.x1)) * greatest(0, least(d.y2, r.y2) - greatest(d.y1, r.y1)), 0), 0) >= 0.5), true), 0) AS p FROM g JOIN d ON d.image = g.image AND d.det_idx = g.det_idx + 1) s JOIN d ON d.image = s.image AND d.det_idx = s.nxt)
SELECT image, len(best) AS n_groups, list_reduce(best, lambda a, b: CASE WHEN b.c * b.a > a.c * a.a THEN b ELSE a END).i AS det_idx FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY det_idx DESC) AS z FROM g) WHERE z = 1""")
def select_main_face(v):
    return windows.select_main_face(v("detections"))


CHALLENGE = """fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY challenge_id ORDER BY idx) AS n FROM challenge_frames) WHERE n <= 30),
lg AS (SELECT *, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM fr WINDOW w AS (PARTITION BY challenge_id ORDER BY n)),
io AS (SELECT *, greatest(0, least(x2, px2) - greatest(x1, px1)) * greatest(0, least(y2, py2) - greatest(y1, py1)) AS i, (x2 - x1) * (y2 - y1) AS area, (px2 - px1) * (py2 - py1) AS parea FROM lg),
tr AS (SELECT challenge_id, count(*) AS n_frames, coalesce(count(*) >= 6 AND avg(area) > 1e-6 AND stddev_pop(area) / avg(area) <= 0.25 AND coalesce(min(CASE WHEN px1 IS NOT NULL THEN CASE WHEN area + parea - i > 0 THEN i / (area + parea - i) ELSE 0 END END), 1) >= 0.30, false) AS consistent FROM io GROUP BY 1),
sg AS (SELECT challenge_id, list(ear ORDER BY n) FILTER (ear IS NOT NULL) AS e, list(yaw ORDER BY n) AS y, list(pitch_signal ORDER BY n) AS p, list(mouth_width_ratio ORDER BY n) AS m, avg(passive_score) AS passive FROM fr GROUP BY 1),
bs AS (SELECT *, list_avg(e[1:3]) AS be, list_avg(y[1:3]) AS by_, list_avg(p[1:3]) AS bp, list_avg(m[1:3]) AS bm FROM sg),
ac AS (SELECT challenge_id, passive, coalesce(len(e) >= 4 AND be > 1e-6 AND list_min(e) <= be * 0.7 AND e[-1] >= be * 0.85, false) AS blink, len(y) >= 4 AND greatest(list_max(y) - by_, by_ - list_min(y)) >= 25 AS turn,
 CASE WHEN len(y) >= 4 AND greatest(list_max(y) - by_, by_ - list_min(y)) >= 25 THEN CASE WHEN list_max(y) - by_ >= 25 AND list_max(y) - by_ >= by_ - list_min(y) THEN 'right' ELSE 'left' END ELSE '' END AS turn_side,
 len(p) >= 4 AND greatest(list_max(p) - bp, bp - list_min(p)) >= 0.10 AS nod, len(m) >= 4 AND list_max(m) - bm >= 0.04 AS smile FROM bs)"""


@query(f"WITH {CHALLENGE} SELECT * FROM tr")
def track_consistency(v):
    return challenge.track_consistency(v("challenge_frames"))


@query(f"WITH {CHALLENGE} SELECT challenge_id, blink, turn, turn_side, nod, smile FROM ac")
def detect_actions(v):
    return challenge.detect_actions(v("challenge_frames"))


@query(f"""WITH {CHALLENGE}, j AS (SELECT challenge_id, n_frames, consistent, passive, list_filter([CASE WHEN NOT blink THEN 'blink' END, CASE WHEN challenge_id % 2 = 0 AND NOT turn THEN 'turn_left' END], lambda x: x IS NOT NULL) AS missing, CASE WHEN challenge_id % 2 = 0 THEN 2 ELSE 1 END AS asked FROM tr JOIN ac USING (challenge_id)),
s AS (SELECT *, 0.5 * ((asked - len(missing)) / asked) + 0.3 * coalesce(passive, 0) + CASE WHEN consistent THEN 0.2 ELSE 0 END AS score FROM j),
r AS (SELECT *, CASE WHEN n_frames < 6 THEN 'too_few_frames' WHEN NOT consistent THEN 'consistency_fail' WHEN len(missing) > 0 THEN 'actions_incomplete:' || array_to_string(missing, ',') WHEN score >= 0.859 THEN 'ok' ELSE 'below_threshold' END AS reason FROM s)
SELECT challenge_id, reason = 'ok' AS is_live, round(CASE WHEN n_frames < 6 THEN 0 ELSE greatest(0, least(1, score)) END, 9) AS confidence, reason, n_frames FROM r""")
def challenge_verdict(v):
    frames = v("challenge_frames")
    asked = F.when(F.col("challenge_id") % 2 == 0, F.array(F.lit("blink"), F.lit("turn_left"))).otherwise(F.array(F.lit("blink")))
    challenges = frames.select("challenge_id").distinct().withColumn("actions", asked)
    return challenge.challenge_verdict(frames, challenges).withColumn("confidence", F.round("confidence", 9))


@query("""WITH p AS (SELECT image, det_idx, x1 AS lx, y1 AS ly, x2 AS rx, y1 + 3 AS ry, x1 + (x2 - x1) * confidence / 2 AS nx, y1 + 10 AS ny, x1 + 5 AS mlx, y2 AS mly, x2 - 5 AS mrx, y2 AS mry, x1, x2 FROM detections)
SELECT image, det_idx, round(degrees(asin(greatest(-1, least(1, ((nx - lx) - (rx - nx)) / (rx - lx) * 1.2)))), 6) AS yaw, round((ny - (ly + ry) / 2) / ((mly + mry) / 2 - (ly + ry) / 2), 9) AS pitch_signal, round(abs(mlx - mrx) / (x2 - x1), 9) AS mouth_width_ratio FROM p""")
def frame_geometry(v):
    c = F.col
    points = F.array(*[F.array(x, y) for x, y in ((c("x1"), c("y1")), (c("x2"), c("y1") + 3), (c("x1") + (c("x2") - c("x1")) * c("confidence") / 2, c("y1") + 10), (c("x1") + 5, c("y2")), (c("x2") - 5, c("y2")))])
    out = challenge.frame_geometry(v("detections").withColumn("lm5", points))
    return out.select("image", "det_idx", F.round("yaw", 6).alias("yaw"), F.round("pitch_signal", 9).alias("pitch_signal"), F.round("mouth_width_ratio", 9).alias("mouth_width_ratio"))


@query("""SELECT image, det_idx, abs(y1 - (y1 + confidence * 12)) / (y2 - y1) > 0.12 OR abs(x1 + (x2 - x1) * confidence - (x1 + x2) / 2) / (x2 - x1) > 0.18 AS pose_bad FROM detections""")
def pose_check(v):
    c = F.col
    points = F.array(*[F.array(x, y) for x, y in ((c("x1"), c("y1")), (c("x2"), c("y1") + c("confidence") * 12), (c("x1") + (c("x2") - c("x1")) * c("confidence"), c("y2")), (c("x1"), c("y2")), (c("x2"), c("y2")))])
    return gates.pose_check(v("detections").withColumn("landmarks", points)).select("image", "det_idx", "pose_bad")


@query("WITH f AS (SELECT person, min(position) AS p FROM image_series WHERE status = 'ok' GROUP BY 1) SELECT s.person, s.position, s.status, s.reason FROM image_series s JOIN f ON s.person = f.person AND s.position = f.p")
def first_usable_image(v):
    return windows.first_usable_image(v("image_series"))[0]


@query("WITH f AS (SELECT person, min(position) AS p FROM image_series WHERE status = 'ok' GROUP BY 1), s AS (SELECT s.* FROM image_series s LEFT JOIN f ON s.person = f.person WHERE p IS NULL OR position <= p) SELECT status, reason, count(*) AS n, grouping_id(status, reason)::BIGINT AS level FROM s GROUP BY ROLLUP (status, reason)")
def status_tally(v):
    return calibration.status_tally(windows.first_usable_image(v("image_series"))[1])


@query("SELECT count_if(status = 'ok') AS ok, count_if(status = 'spoof') AS spoof, count_if(status = 'quality_reject') AS quality_reject, count_if(status = 'error') AS error, (SELECT count(DISTINCT person) FROM image_series WHERE status = 'ok') AS users_ok, (SELECT count(DISTINCT person) FROM image_series) - (SELECT count(DISTINCT person) FROM image_series WHERE status = 'ok') AS users_fail FROM image_series")
def reenroll_counters(v):
    return calibration.reenroll_counters(v("image_series"))


# --- calibration ------------------------------------------------------------------------


@query("""WITH s AS (SELECT similarity AS score, CASE WHEN is_genuine THEN 1 ELSE 0 END AS label FROM verification_log WHERE similarity IS NOT NULL AND is_genuine IS NOT NULL), c AS (SELECT score, count_if(label = 1) AS p, count_if(label = 0) AS q FROM s GROUP BY 1),
grid AS (SELECT i, CASE WHEN i = 99 THEN 1.0 ELSE i * (1.0::DOUBLE / 99) END AS t FROM (SELECT unnest(range(0, 100)) AS i)), w AS (SELECT t, coalesce(sum(p) FILTER (score >= t), 0) AS tp, coalesce(sum(q) FILTER (score >= t), 0) AS fp, sum(p) AS pos FROM grid, c GROUP BY 1),
r AS (SELECT t, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS recall FROM w)
SELECT coalesce((SELECT max(t) FROM r WHERE precision >= 0.95), 0.5) AS high, coalesce((SELECT t FROM r WHERE precision >= 0.5 ORDER BY recall DESC, t DESC LIMIT 1), 0.3) AS low, (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM s) < 50 AS low_data""")
def auto_calibrate(v):
    return calibration.auto_calibrate(v("verification_log"))


@query("""WITH s AS (SELECT eye_dark_ratio AS value, min_face_side >= 100 AS clean FROM quality_signals WHERE eye_dark_ratio IS NOT NULL), c AS (SELECT value, count_if(clean) AS c, count_if(NOT clean) AS o FROM s GROUP BY 1),
r AS (SELECT value, CASE WHEN sum(c) OVER () > 0 THEN (sum(c) OVER (ORDER BY value) - c) / sum(c) OVER () ELSE 0 END AS frr, CASE WHEN sum(o) OVER () > 0 THEN 1 - (sum(o) OVER (ORDER BY value) - o) / sum(o) OVER () ELSE 0 END AS far FROM c)
SELECT value AS threshold, far, frr, (SELECT min(value) FROM s WHERE clean) - (SELECT max(value) FROM s WHERE NOT clean) AS gap FROM r ORDER BY far, frr, value LIMIT 1""")
def best_separating_threshold(v):
    return calibration.best_separating_threshold(v("quality_signals").select(F.col("eye_dark_ratio").alias("value"), (F.col("min_face_side") >= 100).alias("clean")))


@query("""SELECT g AS "group", signal, count(x) AS n, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, median(x) AS median FROM (SELECT min_face_side % 3 AS g, 'blur_score' AS signal, blur_score AS x FROM quality_signals UNION ALL SELECT min_face_side % 3, 'eye_dark_ratio', eye_dark_ratio FROM quality_signals) WHERE x IS NOT NULL GROUP BY 1, 2""")
def signal_stats(v):
    rows = v("quality_signals").withColumn("group", F.col("min_face_side") % 3)
    return calibration.signal_stats(rows, ["blur_score", "eye_dark_ratio"]).withColumn("mean", F.round("mean", 6))


# --- telemetry --------------------------------------------------------------------------


LATENCY = """o AS (SELECT stage, count(*) AS n, quantile_cont(value_ms, 0.5) AS p50, quantile_cont(value_ms, 0.95) AS p95, quantile_cont(value_ms, 0.99) AS p99, avg(value_ms) AS mean FROM stage_samples GROUP BY 1),
p AS (SELECT 'poll_overhead' AS stage, least(c.n, s.n) AS n, greatest(0, c.p50 - s.p50) AS p50, greatest(0, c.p95 - s.p95) AS p95, greatest(0, c.p99 - s.p99) AS p99, greatest(0, c.mean - s.mean) AS mean FROM o c, o s WHERE c.stage = 'client_terminal_e2e' AND s.stage = 'job_total_server'), a AS (SELECT * FROM o UNION ALL SELECT * FROM p),
latency AS (SELECT stage, coalesce(n, 0) AS n, p50, p95, p99, mean, p95 / (SELECT p95 FROM o WHERE stage = 'client_terminal_e2e') AS share FROM (SELECT unnest(STAGES) AS stage) LEFT JOIN a USING (stage))""".replace("STAGES", str(list(files.STAGE_KEYS)))


@query(f"WITH {LATENCY} SELECT * REPLACE (round(mean, 6) AS mean) FROM latency")
def stage_latency_table(v):
    return telemetry.stage_latency_table(v("stage_samples"), stages=files.STAGE_KEYS).withColumn("mean", F.round("mean", 6))


@query("SELECT stage, count(*) AS n, list_sort(list(value_ms))[(floor(count(*) * 0.5) + 1)::INT] AS p50, list_sort(list(value_ms))[(floor(count(*) * 0.95) + 1)::INT] AS p95, max(value_ms) AS max FROM stage_samples GROUP BY 1")
def nearest_rank_stats(v):
    return telemetry.nearest_rank_stats(v("stage_samples"))


@query("""WITH t AS (SELECT unnest(range(0, 7)) AS stage_no), j AS (SELECT job_id, detect_ms, fast_detect_ms, vector_search_ms FROM jobs)
SELECT job_id, CASE WHEN job_id % 2 = 0 THEN detect_ms ELSE fast_detect_ms END AS detect, vector_search_ms AS search, CASE WHEN job_id % 2 = 0 THEN detect_ms ELSE fast_detect_ms END + vector_search_ms AS total FROM j""")
def normalize_stage_timings(v):
    timings = F.when(F.col("job_id") % 2 == 0, F.create_map(F.lit("detect_ms"), "detect_ms", F.lit("vector_search_ms"), "vector_search_ms")).otherwise(F.create_map(F.lit("fast_detect_ms"), "fast_detect_ms", F.lit("vector_search_ms"), "vector_search_ms"))
    out = telemetry.normalize_stage_timings(v("jobs").withColumn("timings", timings))
    get = lambda k: F.col("timings")[k]
    return out.select("job_id", get("detect_ms").alias("detect"), get("search_ms").alias("search"), get("pipeline_total_ms").alias("total"))


@query("""SELECT job_id, greatest(0, (coalesce(dequeued_at, started_at) - created_at) * 1000) AS queue_delay_ms, CASE WHEN dequeued_at IS NULL THEN 0 ELSE greatest(0, (started_at - dequeued_at) * 1000) END AS dequeue_to_start_ms,
greatest(0, (finished_at - started_at) * 1000) AS processing_ms, greatest(0, (finished_at - created_at) * 1000) AS e2e_ms, greatest(0, greatest(0, (finished_at - started_at) * 1000) - (detect_ms + vector_search_ms)) AS unattributed_ms FROM jobs""")
def job_latency_columns(v):
    rows = v("jobs").drop("queue_delay_ms").withColumn("timings", F.create_map(F.lit("detect_ms"), "detect_ms", F.lit("vector_search_ms"), "vector_search_ms"))
    return telemetry.job_latency_columns(rows).select("job_id", "queue_delay_ms", "dequeue_to_start_ms", "processing_ms", "e2e_ms", "unattributed_ms")


@query("SELECT job_id, CASE WHEN job_id % 2 = 0 THEN detect_ms ELSE (finished_at - created_at) * 1000 END AS total_ms, CASE WHEN job_id % 2 = 0 THEN vector_search_ms END AS queue_ms FROM jobs")
def job_result_metrics(v):
    modern = F.struct(F.struct(F.col("detect_ms").alias("job_total_server_ms"), F.col("vector_search_ms").alias("queue_wait_ms")).alias("timings"))
    old = F.struct(F.struct((F.col("finished_at") - F.col("created_at")).alias("total_latency")).alias("metrics"))
    rows = v("jobs").withColumn("result", F.when(F.col("job_id") % 2 == 0, F.to_json(modern)).otherwise(F.to_json(old)))
    return telemetry.job_result_metrics(rows).select("job_id", "total_ms", "queue_ms")


HIST = """tops AS (SELECT unnest([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 'Infinity'::DOUBLE]::DOUBLE[]) AS le),
post AS (SELECT le, count_if(value <= le) AS cumulative FROM tops, events GROUP BY 1), pre AS (SELECT le, count_if(value <= le) AS cumulative FROM tops, (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16') GROUP BY 1)"""


@query(f"WITH {HIST} SELECT * FROM post")
def histogram_observe(v):
    return telemetry.histogram_observe(v("events"))


@query(f"""WITH {HIST}, d AS (SELECT le, greatest(0, b.cumulative - a.cumulative)::DOUBLE AS d FROM pre a JOIN post b USING (le)), l AS (SELECT le, d, coalesce(lag(d) OVER (ORDER BY le), 0) AS pd, coalesce(lag(le) OVER (ORDER BY le), 0) AS pu, max(d) OVER () * 0.95::DOUBLE AS t FROM d)
SELECT CASE WHEN isinf(le) THEN pu WHEN d - pd <= 0 THEN le ELSE pu + (t - pd) / (d - pd) * (le - pu) END AS value FROM l WHERE d >= t ORDER BY le LIMIT 1""")
def histogram_delta_quantile(v):
    events = v("events")
    before = telemetry.histogram_observe(events.filter("ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'"))
    return telemetry.histogram_delta_quantile(before, telemetry.histogram_observe(events), 0.95)


@query("""WITH a AS (SELECT event_type AS metric, max(value) AS x FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), b AS (SELECT event_type AS metric, max(value) AS x FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT metric, CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN greatest(0, b.x - a.x) END AS delta FROM a FULL JOIN b USING (metric)""")
def counter_delta(v):
    events = v("events").withColumnRenamed("event_type", "metric")
    value = lambda df: df.groupBy("metric").agg(F.max("value").alias("value"))
    return telemetry.counter_delta(value(events.filter("ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'")), value(events.filter("metric <> 'error'")))


@query("""SELECT rate, count(*) AS n, count_if(status = 'completed') / count(*) AS completed_share, count_if(status = 'failed') / count(*) AS failed_share, quantile_cont(queue_delay_ms, 0.5) AS queue_p50, quantile_cont(queue_delay_ms, 0.95) AS queue_p95,
quantile_cont(fast_detect_ms, 0.5) AS pop_p50, quantile_cont(fast_detect_ms, 0.95) AS pop_p95, quantile_cont(vector_search_ms, 0.5) AS claim_p50, quantile_cont(vector_search_ms, 0.95) AS claim_p95,
count_if(status = 'completed') > 0 AND max(queue_left) = 0 AND max(inflight_left) = 0 AS valid FROM jobs GROUP BY 1""")
def capacity_curve(v):
    return telemetry.capacity_curve(v("jobs"), {"queue": "queue_delay_ms", "pop": "fast_detect_ms", "claim": "vector_search_ms"})


@query("SELECT request_ip, count(*) AS n, count_if(NOT result) AS failures FROM verification_log GROUP BY 1")
def audit_by_ip(v):
    return telemetry.audit_by_ip(v("verification_log"))


@query("""SELECT count(*) AS n, 1 - count_if(event_type = 'error') / count(*) AS availability, count_if(event_type = 'error') / count(*) AS error_rate, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.95) < 1000 AS p95_met,
count_if(event_type = 'error') / count(*) < 0.005 AS errors_met, count_if(event_type = 'error') / count(*) / 0.005::DOUBLE AS budget_used, quantile_cont(CASE WHEN event_id % 5 > 0 THEN value * 30 END, 0.95) AS queue_p95, quantile_cont(CASE WHEN event_id % 5 > 0 THEN value * 30 END, 0.95) < 1000 AS queue_p95_met,
quantile_cont(value * 40, 0.95) AS total_p95, quantile_cont(value * 40, 0.95) < 2000 AS total_p95_met, count_if(event_id % 6 = 0) / count(*) AS reject_share, count_if(event_id % 6 = 0) / count(*) < 0.2 AS reject_met FROM events""")
def slo_summary(v):
    more = [F.when(F.col("event_id") % 5 > 0, F.col("value") * 30).alias("queue_ms"), (F.col("value") * 40).alias("total_ms"), (F.col("event_id") % 6 == 0).alias("quality_rejected")]
    return telemetry.slo_summary(v("events").select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"), *more))


@query("""SELECT '{"job_id":"' || event_id || '","status":"' || event_type || '"}' AS payload FROM events WHERE event_id % 3 = 0""")
def extract_job_rows(v):
    return files.extract_job_rows(v("log_lines"))


@query("""SELECT 'queue_delay_ms_bucket' AS metric, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 10 WHEN 'signup' THEN 100 ELSE 'Infinity'::DOUBLE END AS le, max(trunc(value)) AS value FROM events GROUP BY 2 UNION ALL SELECT 'inflight', NULL, max(trunc(value)) FROM events""")
def parse_metric_snapshots(v):
    return files.parse_metric_snapshots(v("metric_lines"))


@query("""SELECT 'detect' AS stage, count(*) AS n, sum(value) AS total FROM events WHERE event_type <> 'error' UNION ALL SELECT 'search', count(*), sum(event_id) FROM events""")
def collect_stage_samples(v):
    inner = F.to_json(F.struct(F.col("event_id").cast("string").alias("search_ms"), (F.col("event_id") > 0).alias("align_ms")))
    doc = F.to_json(F.struct(F.struct(F.when(F.col("event_type") != "error", F.col("value")).alias("a.detect_ms")).alias("deep"), F.array(inner).alias("more")))
    return files.collect_stage_samples(v("events").select(doc.alias("value"))).groupBy("stage").agg(F.count("*").alias("n"), F.sum("value_ms").alias("total"))


@query("SELECT folder AS identity, regexp_extract(path, '[^/]+$') AS file, row_number() OVER (ORDER BY folder, regexp_extract(path, '[^/]+$')) - 1 AS sample_idx FROM paths WHERE c_custkey % 5 IN (0, 1, 3)")
def read_identity_manifest(v):
    return files.identity_manifest(v("paths"))


@query(r"SELECT '/root/' || regexp_replace(image_a, '_\d{4}\.(jpg|jpeg|png)$', '', 'i') || '/' || image_a AS a, '/root/' || regexp_replace(image_b, '_\d{4}\.(jpg|jpeg|png)$', '', 'i') || '/' || image_b AS b, is_same AS label, fold_id::INT AS fold FROM pair_rows")
def read_pairs_csv(v):
    return files.parse_pairs(v("pair_rows"), "/root")


@query("SELECT image, det_idx, greatest(0, x2 - x1 - 60) * greatest(0, y2 - y1 - 70) AS area FROM detections")
def box_area(v):
    return v("detections").select("image", "det_idx", exprs.area(F.col("x1") + 60, F.col("y1") + 70, F.col("x2"), F.col("y2")).alias("area"))


# --- enrolment, hashes, redaction -------------------------------------------------------


@query("""WITH x AS (SELECT c_custkey AS id, 'Customer#' || c_custkey AS external_id FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT DISTINCT 'Customer#' || o_custkey AS external_id FROM orders)
SELECT * FROM x UNION ALL SELECT (SELECT max(id) FROM x) + row_number() OVER (ORDER BY external_id) AS id, external_id FROM n WHERE external_id NOT IN (SELECT external_id FROM x)""")
def enroll_users(v):
    name = lambda c: F.concat(F.lit("Customer#"), F.col(c).cast("string")).alias("external_id")
    existing = v("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), name("c_custkey"))
    return enroll.enroll_users(existing, v("orders").select(name("o_custkey")))


@query("""WITH n AS (SELECT id, user_id, ts, encrypted_hash FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS k FROM enrolments WHERE status = 'ok') WHERE k = 1), r AS (SELECT id, user_id, ts, encrypted_hash FROM references_)
SELECT id, user_id, encrypted_hash FROM r WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT id, user_id, encrypted_hash FROM n""")
def enroll_replace(v):
    return enroll.enroll_replace(v("references_"), v("enrolments")).select("id", "user_id", "encrypted_hash")


@query("SELECT encrypted_hash, count(*) AS n, min(id) AS first_id FROM references_ WHERE encrypted_hash <> '' GROUP BY 1 HAVING count(*) > 1")
def hash_lookup(v):
    return enroll.hash_lookup(v("references_"))


@query("SELECT id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, encrypted_hash ORDER BY id) AS k FROM references_) WHERE k = 1 OR encrypted_hash = ''")
def dedupe_references(v):
    return enroll.dedupe_references(v("references_")).select("id", "user_id")


# The bits of a 32-bit float, from its power of two and its fraction, as little-endian hex digits.
_FLOAT = """CASE WHEN x = 0 THEN '00000000' ELSE (SELECT printf('%02X%02X%02X%02X', b & 255, (b >> 8) & 255, (b >> 16) & 255, b >> 24) FROM
(SELECT (CASE WHEN x < 0 THEN 2147483648 ELSE 0 END + ((abs(x)::DOUBLE / pow(2, floor(log2(abs(x)::DOUBLE))) - 1) * 8388608)::BIGINT + (floor(log2(abs(x)::DOUBLE))::BIGINT + 127) * 8388608)::BIGINT AS b)) END"""
_VECTOR_HEX = f"""parts AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), bits AS (SELECT vec_id, pos, {_FLOAT} AS h FROM parts),
coded AS (SELECT vec_id, string_agg(h, '' ORDER BY pos) AS h FROM bits GROUP BY 1)"""


@query(f"WITH {_VECTOR_HEX} SELECT vec_id, h AS bytes, true AS same FROM coded")
def vector_bytes(v):
    raw = enroll.vector_to_bytes(F.col("embedding"))
    return v("embeddings").withColumn("b", raw).select("vec_id", F.hex("b").alias("bytes"), (enroll.vector_from_bytes(F.col("b")) == F.col("embedding")).alias("same"))


@query(f"WITH {_VECTOR_HEX} SELECT vec_id, sha256(unhex(h)) AS h FROM coded")
def vector_hash(v):
    return v("embeddings").select("vec_id", enroll.vector_hash(F.col("embedding")).alias("h"))


@query(f"""WITH {_VECTOR_HEX} SELECT vec_id, len(h) // 2 + 28 AS n_bytes, h AS plain, true AS hidden, true AS nonces_differ, 0 AS n_failed, count(*) OVER () AS n_failed_with_another_key FROM coded""")
def encrypt_vectors(v):
    # The key comes with the data here; a job reads it from its secret store into such a one-row table.
    key = lambda n: v("region").filter(f"r_regionkey = {n}").select(F.unhex(F.sha2("r_name", 256)).alias("key"))
    coded = enroll.encrypt_vectors(v("embeddings").withColumn("payload", enroll.vector_to_bytes(F.col("embedding"))), key(0)).withColumnRenamed("payload", "original")
    # A second nonce gives other bytes for the same vector.
    again = enroll.encrypt_vectors(coded.withColumnRenamed("encrypted", "_first"), key(0), "original")
    plain = enroll.decrypt_vectors(again, key(0))
    failed = enroll.decrypt_failures(plain).select("n_failed").crossJoin(enroll.decrypt_failures(enroll.decrypt_vectors(coded, key(1))).select(F.col("n_failed").alias("n_failed_with_another_key")))
    return plain.select("vec_id", F.octet_length("encrypted").alias("n_bytes"), F.hex("payload").alias("plain"), (~F.contains(F.hex("encrypted"), F.hex("original"))).alias("hidden"), (F.col("encrypted") != F.col("_first")).alias("nonces_differ")).crossJoin(F.broadcast(failed))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(v):
    following = v("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v("embeddings").join(following, "vec_id").select("vec_id", F.round(exprs.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9+/=]{256,}', '[REDACTED:b64]', 'g'), '\[[0-9eE.,\-+\s]{200,}\]', '[REDACTED:array]', 'g')) AS h FROM log_text")
def redact_text(v):
    return v("log_text").select("doc_id", F.md5(exprs.redact_text(F.col("text"))).alias("h"))


@query("""SELECT event_id, '{"amount": 1, "inner": {"face_count": ' || user_id || ', "user_embedding": "[REDACTED]"}, "vector": "[REDACTED]"}' AS redacted, '{"amount": 1, "inner": {"face_count": ' || user_id || ', "user_embedding": "' || event_type || '"}}' AS sanitized FROM events""")
def redact_documents(v):
    doc = F.to_json(F.struct(F.lit(1).alias("amount"), F.struct(F.col("user_id").alias("face_count"), F.col("event_type").alias("user_embedding")).alias("inner"), F.array("value").alias("vector")))
    rows = v("events").withColumn("doc", doc)
    flat = F.regexp_replace(redact_fields(F.col("doc")), r'\["\[REDACTED\]"\]', '"[REDACTED]"')
    return rows.select("event_id", flat.alias("redacted"), sanitize_result(F.col("doc")).alias("sanitized"))


# --- readers and writers: each writes what the tables give and reads it back ---------------


def _scratch(v: Views) -> str:
    return f"{streams.shared_folder(v.spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query(f"WITH {LATENCY} SELECT stage, n::VARCHAR AS n, {', '.join(f"round({c}::DECIMAL(30,9), 3)::VARCHAR AS {c}" for c in ('p50', 'p95', 'p99', 'mean', 'share'))} FROM latency")
def write_latency_table(v):
    path = _scratch(v)
    files.write_latency_table(telemetry.stage_latency_table(v("stage_samples"), stages=files.STAGE_KEYS), path)
    return v.spark.read.csv(path, header=True, emptyValue="", nullValue="\\N").replace("", None)


@query(f"WITH {_roc()} SELECT idx::VARCHAR AS idx, {', '.join(f"printf('%.6g', {c}::DOUBLE) AS {c}" for c in ('threshold', 'far', 'tar', 'frr'))} FROM curve")
def write_curve_csvs(v):
    path = _scratch(v)
    files.write_curve_csv(recognition.roc_curve(recognition.roc_points(v("scored"))).select("idx", "threshold", "far", "tar", "frr"), path, "idx")
    return v.spark.read.csv(path, header=True)


@query(EVAL)
def eval_report(v):
    """The report's JSON, as it was written, parsed again: keys in order, all of them there."""
    path, summary = _scratch(v), recognition.eval_1to1(v("scored"))
    files.write_eval_report(summary, path)
    plain = [f for f in summary.schema if f.dataType.typeName() != "array"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain)
    return v.spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


@query("SELECT sample_idx, identity, list_sum(embedding::DOUBLE[]) AS total, (SELECT count(*) FROM samples) AS n FROM samples")
def read_samples(v):
    base = _scratch(v)
    built = files.get_or_build_samples(v.spark, base, "set", 320, lambda: v("samples"))
    return built.select("sample_idx", "identity", F.aggregate(exprs.as_doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x).alias("total")).crossJoin(files.read_samples_meta(v.spark, base, "set", 320).select("n"))


@query("SELECT cls, count(*) AS n, count_if(NOT face_detected) AS no_face, round(sum(CASE WHEN face_detected THEN score END), 6) AS total FROM all_frames GROUP BY 1")
def read_pad_predictions(v):
    path = _scratch(v)
    files.write_pad_predictions(v("all_frames"), path)
    frames, drops = files.read_pad_predictions(v.spark, path)
    return drops.join(frames.groupBy("cls").agg(F.round(F.sum("score"), 6).alias("total")), "cls")


@query(r"SELECT '/root/' || regexp_replace(image_a, '_\d{4}\.(jpg|jpeg|png)$', '', 'i') || '/' || image_a AS a, '/root/' || regexp_replace(image_b, '_\d{4}\.(jpg|jpeg|png)$', '', 'i') || '/' || image_b AS b, is_same AS label, fold_id::INT AS fold FROM pair_rows")
def read_pairs_file(v):
    path = _scratch(v)
    v("pair_rows").write.csv(path, header=True)
    return files.read_pairs_csv(v.spark, path, "/root")


@query("SELECT 'users' AS name, count(*) AS n, sum(c_custkey) AS total FROM customer UNION ALL SELECT 'verification_logs', count(*), sum(id) FROM verification_log")
def read_service_tables(v):
    base = _scratch(v)
    v("customer").select(F.col("c_custkey").alias("id"), "c_name").write.parquet(f"{base}/users")
    v("verification_log").write.parquet(f"{base}/verification_logs")
    found = files.read_service_tables(v.spark, base, tables={"users": "id", "verification_logs": "id"})
    return functools.reduce(DataFrame.unionByName, [df.agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.sum("id").alias("total")) for t, df in found.items()])


# Documents of several kinds: samples under their keys, also in JSON inside text; tables with a stage's column; load-test summaries.
@query("""SELECT 'search' AS stage, count(*) AS n, sum(event_id) AS total FROM events UNION ALL SELECT 'detect', count(*), round(sum(value), 6) FROM events WHERE event_type <> 'error' UNION ALL SELECT 'align', count(*), sum(user_id) FROM events""")
def read_benchmark_artifacts(v):
    root = _scratch(v)
    row = F.struct(F.col("event_id").alias("search_ms"), F.to_json(F.struct(F.col("user_id").alias("a.align_ms"))).alias("inner"))
    # A document for every 250 users, some MB, as files of a few KB cost more to open than to read.
    documents = v("events").groupBy(F.floor(F.col("user_id") / 250)).agg(F.struct(F.collect_list(row).alias("rows")).alias("deep")).select("deep")
    documents.write.option("maxRecordsPerFile", 1).json(f"{root}/documents")
    v("events").select(F.when(F.col("event_type") != "error", F.col("value")).alias("x.detect_ms"), "event_type").write.csv(f"{root}/tables", header=True)
    return files.read_benchmark_artifacts(v.spark, root).groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("value_ms"), 6).alias("total"))


@query(f"""WITH {LATENCY}, c AS (SELECT min(user_id) AS u FROM events), s AS (SELECT count(*) AS n, median(value) AS p50, max(value) AS p95, avg(value) AS mean FROM events WHERE user_id = (SELECT u FROM c)),
r AS (SELECT * REPLACE (CASE stage WHEN 'client_terminal_e2e' THEN s.n WHEN 'poll_overhead' THEN least(s.n, v.n) ELSE l.n END AS n, CASE stage WHEN 'client_terminal_e2e' THEN s.p50 WHEN 'poll_overhead' THEN greatest(0, s.p50 - v.p50) ELSE l.p50 END AS p50,
 CASE stage WHEN 'client_terminal_e2e' THEN s.p95 WHEN 'poll_overhead' THEN greatest(0, s.p95 - v.p95) ELSE l.p95 END AS p95) FROM (SELECT stage, n, p50, p95 FROM latency) l, s, (SELECT n, p50, p95 FROM latency WHERE stage = 'job_total_server') v)
SELECT stage, n, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p95 / (SELECT p95 FROM s), 6) AS share FROM (SELECT stage, n, p50, p95 FROM r)""")
def latency_with_client_summary(v):
    root = _scratch(v)
    block = F.struct(F.expr("percentile(value, 0.5)").alias("med"), F.max("value").alias("p(95)"), F.avg("value").alias("avg"))
    users = v("events").groupBy("user_id").agg(block.alias("client_e2e_ms"), F.struct(F.count("*").alias("count")).alias("iterations"))
    first = users.filter(F.col("user_id") == v("events").agg(F.min("user_id")).scalar())
    first.select(F.struct("client_e2e_ms", "iterations").alias("metrics")).write.json(f"{root}/summary")
    samples = v("stage_samples").withColumn("priority", F.lit(0))
    table = telemetry.stage_latency_table(samples, files.read_client_summary(v.spark, root), files.STAGE_KEYS)
    return table.select("stage", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "share")])


# --- streams, run over what is there now ------------------------------------------------


def _stream(v: Views) -> DataFrame:
    return streams.events_stream(v.spark, v.sf_dir)


@query("""WITH w AS (SELECT unnest(range(0, 5)) AS k), e AS (SELECT event_type, event_id, user_id, date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS start FROM events, w),
x AS (SELECT start, 'total' AS kind, 'all' AS value FROM e UNION ALL SELECT start, 'result', event_type FROM e UNION ALL SELECT start, 'reject', 'all' FROM e WHERE event_id % 7 = 0 UNION ALL SELECT start, 'reject_reason', 'reason' || user_id % 3 FROM e WHERE event_id % 7 = 0)
SELECT start, kind, value, count(*) AS n, count(*) / 300 AS per_second FROM x GROUP BY 1, 2, 3""")
def stream_result_rate(v):
    reason = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("reason"), (F.col("user_id") % 3).cast("string")))
    log = _stream(v).select("ts", F.col("event_type").alias("result"), reason.alias("reject_reason"))
    return streams.available(streams.stream_result_rate(log), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


STREAM_BUCKETS = "unnest([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000]) AS le"


def _quantile(q: str) -> str:
    return f"(SELECT CASE WHEN c - pc <= 0 THEN le ELSE pl + (n * {q}::DOUBLE - pc) / (c - pc) * (le - pl) END FROM b WHERE b.start = g.start AND b.stage = g.stage AND c >= n * {q}::DOUBLE ORDER BY le LIMIT 1)"


@query(f"""WITH e AS (SELECT date_trunc('hour', ts) AS start, event_type AS stage, value FROM events), g AS (SELECT start, stage, count(*) AS n FROM e GROUP BY 1, 2), l AS (SELECT {STREAM_BUCKETS}),
c AS (SELECT start, stage, le, count_if(value <= le) AS c FROM e, l GROUP BY 1, 2, 3), b AS (SELECT *, coalesce(lag(c) OVER w, 0) AS pc, coalesce(lag(le) OVER w, 0) AS pl FROM c WINDOW w AS (PARTITION BY start, stage ORDER BY le))
SELECT start, stage, n, round({_quantile('0.95')}, 6) AS p95, round({_quantile('0.99')}, 6) AS p99 FROM g""")
def stream_latency_quantiles(v):
    samples = _stream(v).select("ts", F.col("event_type").alias("stage"), F.col("value").alias("value_ms"))
    rows = streams.available(streams.stream_latency_quantiles(samples, "1 hour", None), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "stage", "n", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


@query(f"""WITH e AS (SELECT date_trunc('day', ts) AS start, event_type, stage, CASE stage WHEN 'p95' THEN value WHEN 'queue_p95' THEN value * 9 END AS value FROM events, (SELECT unnest(['p95', 'queue_p95']) AS stage) WHERE stage = 'p95' OR event_id % 3 = 0),
g AS (SELECT start, stage, count(*) AS n FROM e GROUP BY 1, 2), l AS (SELECT {STREAM_BUCKETS}), c AS (SELECT start, stage, le, count_if(value <= le) AS c FROM e, l GROUP BY 1, 2, 3),
b AS (SELECT *, coalesce(lag(c) OVER w, 0) AS pc, coalesce(lag(le) OVER w, 0) AS pl FROM c WINDOW w AS (PARTITION BY start, stage ORDER BY le)), q AS (SELECT start, stage, round(coalesce({_quantile('0.95')}, 10000), 6) AS x FROM g),
d AS (SELECT date_trunc('day', ts) AS start, count(*) AS n, round(count_if(event_type = 'error') / count(*), 9) AS error_share FROM events GROUP BY 1),
j AS (SELECT d.*, a.x AS p95, z.x AS queue_p95 FROM d JOIN q a ON a.start = d.start AND a.stage = 'p95' LEFT JOIN q z ON z.start = d.start AND z.stage = 'queue_p95')
SELECT *, 'latency' AS alert FROM j WHERE p95 > 50 UNION ALL SELECT *, 'errors' FROM j WHERE error_share > 0.2 UNION ALL SELECT *, 'queue' FROM j WHERE queue_p95 > 500""")
def stream_slo_alerts(v):
    requests = _stream(v).select("ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("value_ms"), F.when(F.col("event_id") % 3 == 0, F.col("value") * 9).alias("queue_ms"))
    rows = streams.available(streams.stream_slo_alerts(requests, "1 day", 50.0, 0.2), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", *[F.round(c, d).alias(c) for c, d in (("p95", 6), ("error_share", 9), ("queue_p95", 6))], "alert")


def _access(v: Views) -> DataFrame:
    return _stream(v).select(F.concat(F.col("user_id").cast("string"), F.lit(":"), (F.col("event_id") % 3).cast("string")).alias("key"), "event_id", "ts")


@query(QUERY_ANCHORED.format(limit=1))
def stream_anti_replay(v):
    return streams.available(streams.stream_anti_replay(_access(v), 86400))


@query(QUERY_ANCHORED.format(limit=2))
def stream_rate_limit(v):
    return streams.available(streams.stream_rate_limit(_access(v), 2, 86400))


@query("""WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT job_id, event_id, n, ts AS anchor, true AS first FROM e WHERE n = 1 UNION ALL
SELECT e.job_id, e.event_id, e.n, CASE WHEN e.ts >= f.anchor + INTERVAL 1 HOUR THEN e.ts ELSE f.anchor END, e.ts >= f.anchor + INTERVAL 1 HOUR FROM f JOIN e ON e.job_id = f.job_id AND e.n = f.n + 1)
SELECT job_id, event_id FROM f WHERE first""")
def stream_webhook_dedup(v):
    return streams.available(streams.stream_webhook_dedup(_stream(v).select(F.col("user_id").alias("job_id"), "event_id", "ts")))


@query("""WITH RECURSIVE a AS (SELECT token, -1 AS event_id, ts FROM token_issue_all UNION ALL SELECT token, event_id, ts FROM token_consume),
e AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY ts, event_id) AS n FROM a),
f AS (SELECT token, event_id, ts, n, CASE WHEN event_id < 0 THEN ts END AS issued, false AS used, false AS takes FROM e WHERE n = 1 UNION ALL
SELECT token, event_id, ts, n, CASE WHEN event_id < 0 THEN ts ELSE issued END, CASE WHEN event_id < 0 THEN false ELSE used OR takes END, takes
FROM (SELECT e.*, f.issued, f.used, coalesce(e.event_id >= 0 AND NOT f.used AND e.ts < f.issued + INTERVAL 4 HOUR, false) AS takes FROM f JOIN e ON e.token = f.token AND e.n = f.n + 1))
SELECT token, event_id, ts FROM f WHERE takes""")
def stream_token_consume(v):
    token = F.concat(F.col("user_id").cast("string"), F.lit("_"), F.col("ts").cast("date").cast("string")).alias("token")
    issued = _stream(v).filter("event_type = 'signup'").select(token, "ts")
    consumed = _stream(v).filter("event_type = 'click'").select(token, "event_id", "ts")
    return streams.available(streams.stream_token_consume(issued, consumed, 4 * 3600)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Each job's events and, last, what the watermark's timers see: a row without a status.
@query("""WITH RECURSIVE r AS (SELECT job_id, status, CASE status WHEN 'accepted' THEN 0 WHEN 'claimed' THEN 1 ELSE 2 END AS r, epoch_us(ts) AS tm FROM job_events WHERE status IS NOT NULL),
a AS (SELECT * FROM r UNION ALL SELECT DISTINCT job_id, NULL, 9, (SELECT epoch_us(max(ts)) // 1000 * 1000 - 60000000 FROM job_events) FROM r),
e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY status IS NULL, tm, r, status) AS n FROM a),
f AS (SELECT job_id, n, status, tm AS opened, tm AS since, NULL::BIGINT AS expired, NULL::BIGINT AS gone, status AS move FROM e WHERE n = 1 UNION ALL
SELECT job_id, n, CASE WHEN moves THEN new ELSE s2 END, CASE WHEN new IS NOT NULL AND s2 IS NULL THEN tm ELSE opened END, CASE WHEN moves THEN tm ELSE t1 END,
 CASE WHEN s1 = 'expired' AND status <> 'expired' THEN t1 END, CASE WHEN s1 IS NOT NULL AND s2 IS NULL THEN t1 + 300000000 END, CASE WHEN moves THEN new END
FROM (SELECT *, new IS NOT NULL AND (s2 IS NULL OR r > CASE s2 WHEN 'accepted' THEN 0 WHEN 'claimed' THEN 1 ELSE 2 END) AS moves
FROM (SELECT *, CASE WHEN s1 IN ('accepted', 'claimed') OR tm - t1 < 300000000 THEN s1 END AS s2
FROM (SELECT e.job_id, e.n, e.status AS new, e.r, e.tm, f.status, f.opened, CASE WHEN f.status IN ('accepted', 'claimed') AND e.tm - f.opened > 300000000 THEN 'expired' ELSE f.status END AS s1,
 CASE WHEN f.status IN ('accepted', 'claimed') AND e.tm - f.opened > 300000000 THEN f.opened + 300000000 ELSE f.since END AS t1 FROM f JOIN e ON e.job_id = f.job_id AND e.n = f.n + 1))))
SELECT job_id, move AS status, since FROM f WHERE move IS NOT NULL UNION ALL SELECT job_id, 'expired', expired FROM f WHERE expired IS NOT NULL UNION ALL SELECT job_id, 'gone', gone FROM f WHERE gone IS NOT NULL""")
def stream_job_lifecycle(v):
    return streams.available(streams.stream_job_lifecycle(v.spark.sql(VIEWS["job_events"], events=_stream(v))))


SESSIONS = """e AS (SELECT *, row_number() OVER (PARTITION BY challenge_id ORDER BY ts, idx) AS n, x1 IS NOT NULL AS face FROM session_input),
f AS (SELECT challenge_id, idx, n, ts, ts AS start, 1 AS session, CASE WHEN face THEN 1 ELSE 0 END AS counted, face AS counts FROM e WHERE n = 1 UNION ALL
SELECT challenge_id, idx, n, ts, start, session, counted + CASE WHEN face AND counted < 30 THEN 1 ELSE 0 END, face AND counted < 30
FROM (SELECT e.challenge_id, e.idx, e.n, e.ts, e.face, CASE WHEN fresh THEN e.ts ELSE p.start END AS start, p.session + CASE WHEN fresh THEN 1 ELSE 0 END AS session, CASE WHEN fresh THEN 0 ELSE p.counted END AS counted
FROM (SELECT f.*, e.ts >= f.ts + INTERVAL 36 HOUR OR e.ts >= f.start + INTERVAL 20 DAY AS fresh FROM f JOIN e ON e.challenge_id = f.challenge_id AND e.n = f.n + 1) p JOIN e ON e.challenge_id = p.challenge_id AND e.n = p.n + 1)),
made AS (SELECT challenge_id, session, any_value(start) AS start, max(counted) AS counted, session < max(max(session)) OVER (PARTITION BY challenge_id) OR max(counted) = 30
 OR least(max(ts) + INTERVAL 36 HOUR, any_value(start) + INTERVAL 20 DAY) <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) AS ended FROM f GROUP BY 1, 2),
session_frames AS (SELECT f.challenge_id * 1000 + f.session AS challenge_id, i.* EXCLUDE (challenge_id) FROM f JOIN session_input i ON i.challenge_id = f.challenge_id AND i.idx = f.idx WHERE f.counts)"""


@query(f"""WITH RECURSIVE {SESSIONS}, {CHALLENGE.replace("challenge_frames", "session_frames")},
j AS (SELECT m.challenge_id, m.start, m.counted AS n_frames, coalesce(consistent, false) AS consistent, passive, coalesce(blink, false) AS blink FROM made m LEFT JOIN tr ON tr.challenge_id = m.challenge_id * 1000 + m.session LEFT JOIN ac ON ac.challenge_id = tr.challenge_id WHERE ended),
s AS (SELECT *, 0.5 * blink::INT + 0.3 * coalesce(passive, 0) + 0.2 * consistent::INT AS score FROM j),
r AS (SELECT *, CASE WHEN n_frames < 6 THEN 'too_few_frames' WHEN NOT consistent THEN 'consistency_fail' WHEN NOT blink THEN 'actions_incomplete:blink' WHEN score >= 0.859 THEN 'ok' ELSE 'below_threshold' END AS reason FROM s)
SELECT challenge_id, start, reason = 'ok' AS is_live, round(CASE WHEN n_frames < 6 THEN 0 ELSE greatest(0, least(1, score)) END, 6) AS confidence, reason, n_frames FROM r""")
def stream_challenge_sessions(v):
    frames = v.spark.sql(VIEWS["session_input"], events=_stream(v))
    ended = streams.available(streams.stream_challenge_sessions(frames, ["blink"], 36 * 3600, 20 * 86400))
    return ended.withColumns({"start": F.col("start").cast("timestamp_ntz"), "confidence": F.round("confidence", 6)})
