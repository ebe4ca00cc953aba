"""Metrics against brute force."""

import pytest

from hookline.operators import metrics as M


def test_auc_matches_pairwise(spark):
    rows = [(i, 1 if (i * 13) % 5 < 2 else 0, float((i * 7) % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    pos = [s for _, l, s in rows if l == 1]
    neg = [s for _, l, s in rows if l == 0]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df).first()["roc_auc"] == pytest.approx(want, abs=1e-12)


def test_binary_metrics_and_zero_division(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "label int, prediction int")
    r = M.binary_metrics(df).first()
    assert (r.accuracy, r.precision, r.recall) == (0.6, 2 / 3, 2 / 3)
    assert r.f1_score == pytest.approx(2 / 3)
    none = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    assert tuple(M.binary_metrics(none).first()) == (1.0, 0.0, 0.0, 0.0)


def test_scaler_uses_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    stats = {r.feature: (r.mean, r.std) for r in M.scaler_stats(df, ["a", "b"]).collect()}
    assert stats == {"a": (2.0, 1.0), "b": (5.0, 1.0)}


def test_best_by_first_wins_ties(spark):
    df = spark.createDataFrame([("a", 0.5, 0), ("b", 0.7, 1), ("c", 0.7, 2)], "m string, f1 double, o int")
    assert tuple(M.best_by(df, "m", "f1", "o").first()) == ("b", 0.7)
