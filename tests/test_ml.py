"""Model properties, as in the reference's model tests.

Forests use the default parameters; boosted trees use 10 rounds here to keep
the suite short (the defaults are 100 rounds, see hookline.fixed).
"""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hookline.operators import ml

FEATS = [f"feature_{i}" for i in range(10)]
FAST = {"random_forest": {}, "xgboost": {"maxIter": 10}}


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.RandomState(42)
    x = rng.randn(100, 10)
    y = rng.randint(0, 2, 100)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(100)]
    return spark.createDataFrame(rows, ["id", "label", *FEATS])


@pytest.fixture(scope="module", params=["random_forest", "xgboost"])
def trained(request, sample):
    model, metrics = ml.train(sample, FEATS, request.param, **FAST[request.param])
    return request.param, model, metrics.first()


def test_invalid_model_type():
    with pytest.raises(ValueError):
        ml.make_classifier("invalid")


def test_training_metrics_in_range(trained):
    _, _, m = trained
    for k in ("accuracy", "precision", "recall", "f1_score", "roc_auc"):
        assert 0.0 <= m[k] <= 1.0


def test_prediction_and_probabilities(trained, sample):
    _, model, _ = trained
    out = model.transform(sample.limit(5)).select("prediction", vector_to_array("probability").alias("p")).collect()
    assert len(out) == 5
    for r in out:
        assert r.prediction in (0.0, 1.0)
        assert len(r.p) == 2 and all(0 <= v <= 1 for v in r.p) and sum(r.p) == pytest.approx(1.0)


def test_importances_sum_to_one(trained, spark):
    _, model, _ = trained
    imp = [r.importance for r in model.importances(spark).collect()]
    assert len(imp) == 10 and all(v >= 0 for v in imp) and sum(imp) == pytest.approx(1.0, abs=1e-6)


def test_cross_validation(sample):
    r = ml.cross_validate(sample, FEATS, "random_forest", k=3, numTrees=20).first()
    assert 0 <= r.cv_mean_accuracy <= 1 and r.cv_std_accuracy >= 0


def test_save_load_same_predictions(trained, sample, spark, tmp_path):
    kind, model, _ = trained
    path = str(tmp_path / kind)
    model.save(path)
    loaded = ml.load_model(spark, path)
    assert loaded.model_type == kind and loaded.feature_names == FEATS
    a = [r.prediction for r in model.transform(sample).orderBy("id").collect()]
    b = [r.prediction for r in loaded.transform(sample).orderBy("id").collect()]
    assert a == b


def test_load_missing_model_raises(spark, tmp_path):
    with pytest.raises(Exception):
        ml.load_model(spark, str(tmp_path / "nothing"))


def test_missing_features_are_reported(spark, trained, sample):
    _, model, _ = trained
    with pytest.raises(ValueError, match="Missing features"):
        model.transform(sample.drop("feature_3"))
    miss = ml.missing_features(spark, ["feature_0"], FEATS)
    assert miss.count() == 9


def test_single_class_is_rejected(sample):
    with pytest.raises(ValueError):
        ml.train(sample.withColumn("label", F.lit(1)), FEATS, "random_forest")


def test_train_flow_writes_model_and_metrics(spark, sample, tmp_path):
    out = ml.train_flow(sample, FEATS, "random_forest", str(tmp_path / "run"), k=3, numTrees=10)
    assert out["top_features"].count() == 10
    assert spark.read.json(str(tmp_path / "run" / "metrics")).count() == 1
    assert ml.load_model(spark, str(tmp_path / "run" / "model")).feature_names == FEATS


def test_synthetic_model_cannot_score_url_features(spark):
    from hookline.fixed import FEATURE_COLUMNS
    model = ml.train_synthetic(spark, 200)
    frame = spark.createDataFrame([tuple(0.0 for _ in FEATURE_COLUMNS)], FEATURE_COLUMNS)
    with pytest.raises(ValueError, match="Missing features"):
        model.transform(frame)


def test_labelled_features_fill_zero(spark):
    df = spark.createDataFrame([(1, None, "bad"), (0, 2.0, None)], "label int, a double, error string")
    rows = ml.labelled_features(df, ["a"]).orderBy("label").collect()
    assert [r.a for r in rows] == [2.0, 0.0]


def test_grid_search_rows(sample):
    out = ml.grid_search(sample, FEATS, "random_forest", {"maxDepth": [2, 4], "numTrees": [5]}, k=3).collect()
    assert len(out) == 2 and all(0 <= r.cv_mean_accuracy <= 1 for r in out)


def test_status_lines(spark):
    from hookline.operators.scoring import report_lines
    df = spark.createDataFrame([("http://a.com", True, 0.9, None), ("http://b.com", None, None, "Invalid IPv6 URL")],
                               "url string, is_phishing boolean, confidence double, error string")
    lines = [r.status for r in report_lines(df).orderBy("url").collect()]
    assert lines[0] == "PHISHING http://a.com... (90%)"
    assert lines[1].startswith("ERROR") and "Invalid IPv6 URL" in lines[1]


def test_compare_models_rows(spark, sample):
    """Both model types, validation metrics and CV accuracy (small models here)."""
    small = {"random_forest": {"numTrees": 10}, "xgboost": {"maxIter": 5}}
    rows = ml.compare_models(sample, FEATS, k=3, params=small).collect()
    assert [r.model for r in rows] == ["random_forest", "xgboost"]
    for r in rows:
        assert 0 <= r.f1_score <= 1 and 0 <= r.cv_mean_accuracy <= 1 and r.cv_std_accuracy >= 0
