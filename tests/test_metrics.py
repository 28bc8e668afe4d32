"""Metrics against goldens and brute-force implementations on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from nichelab.operators import metrics
from nichelab.schemas import SCORE_WEIGHTS

GOLDEN = [
    # tn, fp, fn, tp, accuracy, f1, sensitivity, specificity
    (11, 89, 0, 263, 0.7548, 0.8553, 1.0000, 0.1100),
    (21, 79, 2, 261, 0.7769, 0.8657, 0.9924, 0.2100),
    (37, 63, 5, 258, 0.8127, 0.8836, 0.9810, 0.3700),
    (54, 46, 64, 199, 0.6970, 0.7835, 0.7567, 0.5400),
]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "key long, risk double, label int")


@pytest.mark.parametrize("tn,fp,fn,tp,acc,f1,sens,spec", GOLDEN)
def test_golden_confusion(spark, tn, fp, fn, tp, acc, f1, sens, spec):
    rows, k = [], 0
    for n, score, label in [(tn, 0.2, 0), (fp, 0.8, 0), (fn, 0.2, 1), (tp, 0.8, 1)]:
        for _ in range(n):
            rows.append((k, score, label))
            k += 1
    m = metrics.standard_metrics(_frame(spark, rows), 0.5).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (tn, fp, fn, tp)
    assert round(m["accuracy"], 4) == acc
    assert round(m["f1_score"], 4) == f1
    assert round(m["sensitivity"], 4) == sens
    assert round(m["specificity"], 4) == spec


def _random_scored(seed, n=400, levels=37):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        label = 1 if rnd.random() < 0.6 else 0
        s = min(max(rnd.gauss(0.6 if label else 0.4, 0.2), 0.0), 1.0)
        rows.append((k, round(s * levels) / levels, label))  # many ties
    return rows


def brute_auc(rows):
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y != 1]
    tot = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(rows):
    P = sum(1 for r in rows if r[2] == 1)
    ap, prev_r = 0.0, 0.0
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        tp = sum(1 for _, s, y in rows if s >= t and y == 1)
        fp = sum(1 for _, s, y in rows if s >= t and y != 1)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auc_ap_match_brute_force(spark, seed):
    rows = _random_scored(seed)
    m = metrics.standard_metrics(_frame(spark, rows)).first()
    assert m["auc"] == pytest.approx(brute_auc(rows), abs=1e-12)
    assert m["average_precision"] == pytest.approx(brute_ap(rows), abs=1e-12)


def test_auc_invariant_under_monotone_change(spark):
    rows = _random_scored(7)
    a = metrics.roc_auc(_frame(spark, rows)).first()["auc"]
    squashed = [(k, s ** 3, y) for k, s, y in rows]
    b = metrics.roc_auc(_frame(spark, squashed)).first()["auc"]
    assert a == pytest.approx(b, abs=1e-12)


def test_single_class_gives_null_auc(spark):
    rows = [(k, k / 10, 1) for k in range(10)]
    m = metrics.standard_metrics(_frame(spark, rows)).first()
    assert m["auc"] is None and m["tp"] + m["fn"] == 10 and m["specificity"] == 0.0


def reference_search(rows):
    """The threshold search written as the plain ordered loop."""
    best_t, best_f1, best_bal = 0.5, 0.0, float("inf")
    for i in range(80):
        t = 0.1 + i * (0.11 - 0.1)
        tp = sum(1 for _, s, y in rows if s >= t and y == 1)
        fp = sum(1 for _, s, y in rows if s >= t and y != 1)
        fn = sum(1 for _, s, y in rows if s < t and y == 1)
        tn = sum(1 for _, s, y in rows if s < t and y != 1)
        sens = tp / (tp + fn) if tp + fn else 0
        spec = tn / (tn + fp) if tn + fp else 0
        f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0
        bal = math.sqrt((1 - sens) ** 2 + (1 - spec) ** 2)
        if f1 > best_f1 and bal < best_bal * 1.1:
            best_t, best_f1, best_bal = t, f1, bal
    return best_t


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_threshold_search_matches_loop(spark, seed):
    rows = _random_scored(seed, levels=100)
    got = metrics.optimal_threshold(_frame(spark, rows)).first()
    assert got["threshold"] == reference_search(rows)


def test_threshold_bin_exact_at_boundaries(spark):
    from nichelab.functions.bins import threshold_bin

    ts = [0.1 + i * (0.11 - 0.1) for i in range(80)]
    probes = sorted({*ts, *[math.nextafter(t, 0) for t in ts], *[math.nextafter(t, 1) for t in ts], 0.0, 0.05, 0.95, 1.0})
    df = spark.createDataFrame([(p,) for p in probes], "p double")
    for r in df.select("p", threshold_bin(F.col("p")).alias("b")).collect():
        assert r["b"] == sum(1 for t in ts if t <= r["p"]), r["p"]


def test_sweep_counts_match_brute_force(spark):
    rows = _random_scored(8, levels=100)
    sweep = {r["i"]: r for r in metrics.threshold_sweep(_frame(spark, rows)).collect()}
    assert len(sweep) == 80
    for i in (0, 17, 54, 79):
        t = 0.1 + i * (0.11 - 0.1)
        assert sweep[i]["tp"] == sum(1 for _, s, y in rows if s >= t and y == 1)
        assert sweep[i]["fp"] == sum(1 for _, s, y in rows if s >= t and y != 1)


def test_classification_report(spark):
    rows = [(0, 0.2, 0)] * 37 + [(0, 0.8, 0)] * 63 + [(0, 0.2, 1)] * 5 + [(0, 0.8, 1)] * 258
    rep = {r["label"]: r for r in metrics.classification_report(_frame(spark, rows), 0.5).collect()}
    assert rep["1"]["support"] == 263 and rep["0"]["support"] == 100
    assert rep["1"]["precision"] == pytest.approx(258 / 321)
    assert rep["0"]["recall"] == pytest.approx(0.37)
    assert rep["accuracy"]["f1_score"] == pytest.approx(295 / 363)
    assert rep["macro avg"]["recall"] == pytest.approx((0.37 + 258 / 263) / 2)


def test_model_score_formula(spark):
    # AUC, F1, accuracy, specificity, sensitivity, AP -> documented composite score
    rows = [
        ("Random Forest", 0.8284, 0.8553, 0.7548, 0.1100, 1.0000, 0.9306, 0.743705),
        ("Boosted trees", 0.7921, 0.8836, 0.8127, 0.3700, 0.9810, 0.8817, 0.782600),
        ("Enhanced", 0.6928, 0.7835, 0.6970, 0.5400, 0.7567, 0.8422, 0.714515),
    ]
    df = spark.createDataFrame(
        [r[:7] for r in rows], "model string, auc double, f1_score double, accuracy double, specificity double, sensitivity double, average_precision double"
    )
    got = {r["model"]: r for r in metrics.model_scores(df).collect()}
    for r in rows:
        assert got[r[0]]["score"] == pytest.approx(r[7], abs=1e-6)
    assert got["Boosted trees"]["is_best"] and got["Boosted trees"]["rank"] == 1
    assert set(SCORE_WEIGHTS) == {"auc", "f1_score", "accuracy", "specificity", "sensitivity", "average_precision"}


def test_transfer_gap_shape(spark):
    from nichelab.sources import tables

    df = metrics.transfer_gap(tables.prediction_log(spark, "/root/testdata/sf0.001"))
    rows = df.collect()
    assert len(rows) == 5
    for r in rows:
        assert r["gap"] == pytest.approx(r["train_accuracy"] - r["validation_accuracy"])


def test_unusable_scores_are_ignored(spark):
    rows = _random_scored(9, n=200)
    clean = metrics.optimal_threshold(_frame(spark, rows)).first()
    dirty = rows + [(1000, None, 1), (1001, float("nan"), 0)]
    got = metrics.optimal_threshold(_frame(spark, dirty)).first()
    assert got["auc"] == clean["auc"] and got["threshold"] == clean["threshold"]
    assert got["average_precision"] == clean["average_precision"]
