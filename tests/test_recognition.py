"""Known answers and invariants of the recognition metrics."""

import math

import numpy as np
import pytest

from verilake.operators import pairs, recognition, search
from verilake.operators.prefix import dense_index, ordered_prefix


def scored(spark, scores, labels):
    return spark.createDataFrame([(i, float(s), int(x)) for i, (s, x) in enumerate(zip(scores, labels))], "pair_id long, score double, label int")


def counted(scores, labels, t):
    """tp, fp, tn, fn by a loop."""
    hit = [(s >= t, bool(x)) for s, x in zip(scores, labels)]
    return tuple(sum(h == pair for h in hit) for pair in ((True, True), (True, False), (False, False), (False, True)))


def rates(scores, labels, t):
    tp, fp, tn, fn = counted(scores, labels, t)
    return fp / max(fp + tn, 1), tp / max(tp + fn, 1)


def drawn(seed, n=90):
    """Scores with ties, of which genuine ones tend to be higher."""
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 2, n)
    return np.round(np.clip(rng.normal(0.35 + 0.25 * labels, 0.2), 0, 1), 2).tolist(), labels.tolist()


@pytest.mark.parametrize("seed", [11, 12])
def test_confusion_at_every_threshold(spark, seed):
    scores, labels = drawn(seed)
    df = scored(spark, scores, labels)
    for t in (-0.7, 0.0, 0.33, scores[0], 0.61, 1.0, 1.7):
        r = recognition.confusion(df, t).first()
        tp, fp, tn, fn = counted(scores, labels, t)
        assert (r.tp, r.fp, r.tn, r.fn) == (tp, fp, tn, fn)
        far, tar = rates(scores, labels, t)
        assert (r.far, r.tar, r.frr) == (pytest.approx(far), pytest.approx(tar), pytest.approx(1 - tar))
        assert r.precision == pytest.approx(tp / (tp + fp) if tp + fp else 0) and r.recall == pytest.approx(tar)


@pytest.mark.parametrize("seed", [21, 22])
def test_curve_measures(spark, seed):
    """Area by comparing all pairs, the rates at each distinct score, and the best of these under a bound."""
    scores, labels = drawn(seed)
    good, bad = [s for s, x in zip(scores, labels) if x], [s for s, x in zip(scores, labels) if not x]
    points = recognition.roc_points(scored(spark, scores, labels))
    curve = recognition.roc_curve(points)
    rows = curve.collect()
    last = {r.threshold: (r.far, r.tar) for r in sorted(rows, key=lambda r: r.idx)}  # of rows with one score the last one holds all of them
    for t in set(scores):
        far, tar = rates(scores, labels, t)
        assert last[t] == (pytest.approx(far), pytest.approx(tar))
    low, high = sum(g > b for g in good for b in bad), sum(g >= b for g in good for b in bad)
    assert low / len(good) / len(bad) <= recognition.auc(points).first().auc + 1e-9 and recognition.auc(points).first().auc <= high / len(good) / len(bad) + 1e-9
    for bound in (0.02, 0.1, 0.5):
        best = max((r.tar, r.threshold) for r in rows if r.far <= bound)
        got = recognition.tar_at_far(curve, bound).first()
        assert (got.tar_at_far, got.tar_at_far_threshold) == best
    gap = min(abs(r.far - r.frr) for r in rows)
    r = recognition.eer_point(curve).first()
    assert any(abs(x.far - x.frr) == gap and r.eer == pytest.approx((x.far + x.frr) / 2) for x in rows)


def test_no_threshold_is_strict_enough(spark):
    scores, labels = [0.31, 0.77, 0.64, 0.12], [1, 0, 1, 0]  # an impostor is above all
    r = recognition.tar_at_far(recognition.roc_curve(recognition.roc_points(scored(spark, scores, labels))), 0.4).first()
    assert r.tar_at_far == 0 and r.tar_at_far_threshold > max(scores)


def test_one_class(spark):
    rows = recognition.roc_curve(recognition.roc_points(scored(spark, [0.5, 0.4], [1, 1]))).orderBy("idx").collect()
    assert [(r.far, r.tar) for r in rows] == [(0, 0), (1, 1)] and rows[0].threshold == math.inf and rows[1].threshold == -math.inf


def test_recommended_thresholds(spark):
    scores, labels = drawn(31)
    df = scored(spark, scores, labels)
    r = recognition.recommend_thresholds(df).first()
    grid = np.linspace(min(scores), max(scores), 200)

    def f1(t):
        tp, fp, _, fn = counted(scores, labels, t)
        return 2 * tp / (2 * tp + fp + fn)

    assert f1(r.low) == pytest.approx(max(map(f1, grid)), abs=1e-6)
    assert r.margin == pytest.approx(max(0, min(r.high - r.low, r.high)))


def test_random_scores(spark):
    rng = np.random.default_rng(1)
    df = scored(spark, rng.random(600).round(2), rng.integers(0, 2, 600))
    points = recognition.roc_points(df)
    rows = recognition.roc_curve(points).orderBy("idx").collect()
    assert all(a.far <= b.far and a.tar <= b.tar for a, b in zip(rows, rows[1:]))
    assert 0.3 < recognition.auc(points).first().auc < 0.7
    again = recognition.roc_curve(recognition.roc_points(df.repartition(7))).orderBy("idx").collect()
    assert again == rows


def test_sweep_matches_single_confusions(spark):
    df = scored(spark, [0.1, 0.2, 0.2, 0.7, 0.9, 0.3], [0, 0, 1, 1, 1, 0])
    for r in recognition.sweep_confusion(df, 9).collect():
        one = recognition.confusion(df, r.threshold).first()
        assert (r.tp, r.fp, r.tn, r.fn) == (one.tp, one.fp, one.tn, one.fn)


def test_distribution_of_scores(spark):
    scores, labels = drawn(41)
    scores += [1.0, 1.25, -0.5, 0.0]
    labels += [1, 1, 0, 0]
    rows = {r.bin: (r.genuine, r.impostor) for r in recognition.score_distribution(scored(spark, scores, labels), 20, 0.0, 1.0).collect()}
    edges = [i * 0.05 for i in range(20)] + [1.0]
    for i in range(20):
        inside = [x for s, x in zip(scores, labels) if edges[i] <= s and (s < edges[i + 1] or (i == 19 and s <= 1))]
        assert rows[i] == (sum(inside), len(inside) - sum(inside))


def test_cmc(spark):
    eye = np.eye(5).tolist()
    names = "abcde"
    gallery = spark.createDataFrame([(i, names[i], eye[i]) for i in range(5)], "sample_idx long, identity string, embedding array<double>")
    probes = spark.createDataFrame([(10 + i, names[i], eye[i]) for i in range(5)], gallery.schema)
    rows = recognition.cmc_curve(search.probe_ranks(probes, gallery), 5).orderBy("rank").collect()
    assert [r.accuracy for r in rows] == [1.0] * 5
    lost = spark.createDataFrame([(20, "z", eye[0])], gallery.schema)
    assert search.probe_ranks(lost, gallery).first()["rank"] is None


def test_top_k(spark):
    eye = np.eye(3).tolist()
    gallery = spark.createDataFrame([(i, "u", eye[i]) for i in range(3)], "sample_idx long, identity string, embedding array<double>")
    found = search.top_k_search(gallery, gallery, 2).orderBy("probe_idx", "rank").collect()
    assert [r.sample_idx for r in found if r.rank == 1] == [0, 1, 2] and len(found) == 6
    assert search.top_k_search(gallery, gallery.limit(0), 2).count() == 0
    margins = search.top2_margin(search.top_k_search(gallery, gallery.limit(1), 2)).orderBy("probe_idx").collect()
    assert margins[0].margin == 1.0


def test_pairs(spark):
    same = spark.createDataFrame([(i, "x", [1.0]) for i in range(3)], "sample_idx long, identity string, embedding array<double>")
    assert sorted(map(tuple, pairs.genuine_pairs(same).collect())) == [(0, 1), (0, 2), (1, 2)]
    mixed = spark.createDataFrame([(i, "abcde"[i // 2], [1.0]) for i in range(10)], same.schema)
    some = pairs.impostor_pairs(mixed, 25).collect()
    assert len({(r.a, r.b) for r in some}) == len(some) == 25 and all(r.a // 2 != r.b // 2 and r.a < r.b for r in some)
    assert pairs.impostor_pairs(mixed, 500).count() == 40
    assert pairs.impostor_pairs(same, 5).count() == 0
    roles = [r.role for r in pairs.gallery_probe_split(mixed).collect()]
    assert roles.count("gallery") == 5 and roles.count("probe") == 5


def test_eval_error_without_genuine(spark):
    assert recognition.eval_1to1(scored(spark, [0.2, 0.1], [0, 0])).first().error is not None


def test_ordered_prefix_with_ties_and_skew(spark):
    rows = [(0.5, i, 1) for i in range(9000)] + [(i / 100, 10000 + i, 1) for i in range(100)]
    got = {r.id: r.n for r in ordered_prefix(spark.createDataFrame(rows, "score double, id long, one long"), "score", "id", {"n": "one"}).collect()}
    want = {i: k + 1 for k, (_, i, _) in enumerate(sorted(rows))}
    assert got == want


def test_dense_index(spark):
    rows = [(f"p{i % 3}", f"{i:03}.jpg") for i in range(50)]
    got = [(r.identity, r.file, r.sample_idx) for r in dense_index(spark.createDataFrame(rows, "identity string, file string"), ["identity", "file"]).orderBy("sample_idx").collect()]
    assert got == [(a, b, k) for k, (a, b) in enumerate(sorted(rows))]


@pytest.mark.parametrize("n", [1, 4])
def test_synthetic_identities(spark, n):
    rng = np.random.default_rng(3)
    rows = []
    for who in range(6):
        base = rng.normal(size=32)
        for _ in range(3):
            v = base + 0.1 * rng.normal(size=32)
            rows.append((len(rows), str(who), (v / np.linalg.norm(v)).tolist()))
    samples = spark.createDataFrame(rows, "sample_idx long, identity string, embedding array<double>").repartition(n)
    genuine = pairs.genuine_pairs(samples).selectExpr("a", "b", "1 AS label")
    impostor = pairs.impostor_pairs(samples, 36).selectExpr("a", "b", "0 AS label")
    df = pairs.score_pairs(genuine.unionByName(impostor), samples).selectExpr("a * 100 + b AS pair_id", "score", "label")
    r = recognition.eval_1to1(df).first()
    assert r.auc >= 0.99 and r.eer <= 0.1 and r.tar_at_far_0_01 >= 0.95
