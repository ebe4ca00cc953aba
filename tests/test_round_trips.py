"""Files written and read back, the rules as a model, out-of-fold scores."""

import duckdb
import pytest

from conftest import SF_SMALL
from hookline.fixed import FEATURE_COLUMNS, MODEL_TYPES
from hookline.operators import ml
from hookline.operators.scoring import RuleModel, score_urls
from hookline.operators.splits import stratified_folds
from hookline.plans.catalog_ml import training_frame
from hookline.session import scratch_path
from hookline.sources import datasets as D

SMALL = {"random_forest": {"numTrees": 4, "maxDepth": 3}, "xgboost": {"maxIter": 2, "maxDepth": 2}}


def test_labelled_csv_keeps_odd_texts(spark):
    urls = ["http://a.com/\"q\"", "  http://b.com ", "http://c.com/x,y", "http://d.com/\\", "a\tb", None, "", "é\\\"", "'x'"]
    rows = [(u, x) for u, x in zip(urls, ["phishing", " phishing", "1", "1.0", "TRUE", "bad", None, "good", "Malicious"])]
    path = scratch_path(spark, "odd-csv")
    D.write_custom(spark.createDataFrame(rows, "url string, label string"), path)
    got = [tuple(r) for r in D.load_custom(spark, path).collect()]
    want = [("nan" if u is None else u, int((x or "").lower() in ("phishing", "1", "malicious", "bad", "true"))) for u, x in rows]
    assert sorted(got) == sorted(want) or sorted(got) == sorted([("nan" if u == "" else u, y) for u, y in want])


def test_training_expectedfrom_a_file_are_whole_and_zero_filled(spark):
    path = scratch_path(spark, "train-csv")
    D.write_custom(spark.createDataFrame([("http://[bad", "1"), ("https://ok.com/a?b=1", "0"), (None, "bad")], "url string, label string"), path)
    got = {r.url: r for r in D.load_training(spark, path).collect()}
    assert [c for c in got["nan"].asDict() if c not in ("url", "label")] == FEATURE_COLUMNS
    assert all(got["http://[bad"][c] == 0 for c in FEATURE_COLUMNS) and got["http://[bad"].label == 1
    assert got["https://ok.com/a?b=1"].question_count == 1 and got["nan"].url_length == 3
    with pytest.raises(ValueError, match="site"):
        D.load_training(spark, path, url_column="site")


@pytest.mark.parametrize("kind", ["csv", "arff"])
def test_uci_tables_round_trip(spark, kind):
    path = f"{scratch_path(spark, 'uci-test')}/t.{kind}"
    D.write_uci(spark.createDataFrame([(1.5, -1, 1), (0.0, None, -1), (-2.0, 7, 0)], "a double, b int, Result int"), path)
    got = sorted((r.a, r.b, r.label) for r in D.load_uci(spark, path, positive=1).fillna(0).collect())
    assert got == [(-2.0, 7, 0), (0.0, 0, 0), (1.5, -1, 1)]


def test_url_list_round_trip(spark):
    path = scratch_path(spark, "list-test")
    D.write_url_list(spark.createDataFrame([("  http://a.com ",), (None,), ("   ",), ("",), ("b",)], "url string"), path)
    assert sorted(r.url for r in D.read_url_list(spark, path).collect()) == ["b", "http://a.com"]


def test_a_url_file_to_verdicts_with_the_rules(spark):
    urls = spark.createDataFrame([("http://192.168.0.1/a@b",), ("https://www.google.com",), ("http://[x",)], "url string")
    got = {r.url: r for r in score_urls(urls, RuleModel(4)).collect()}
    assert got["http://192.168.0.1/a@b"].is_phishing and not got["https://www.google.com"].is_phishing
    assert got["http://[x"].is_phishing is None and got["http://[x"].error
    r = got["https://www.google.com"]
    assert r.confidence == max(r.phishing_probability, 1 - r.phishing_probability)
    with pytest.raises(ValueError, match="importances"):
        RuleModel().importances(spark)
    with pytest.raises(ValueError, match="Missing features"):
        RuleModel().transform(urls)


def test_out_of_fold_scores_and_their_summary(spark):
    rows = training_frame(spark, SF_SMALL).persist()
    scores = ml.out_of_fold(rows, FEATURE_COLUMNS, SMALL, 3)
    table = scores.toPandas()
    folds = {(r.id, r.fold) for r in stratified_folds(rows.select("id", "label"), 3).collect()}
    for m in SMALL:
        assert {(r.id, r.fold) for r in table[table.model == m].itertuples()} == folds
    # each row's score is that of a model fitted without its fold
    folded = ml._prep(stratified_folds(rows, 3))
    one = ml.make_pipeline(FEATURE_COLUMNS, "random_forest", **SMALL["random_forest"]).fit(folded.where("fold <> 1"))
    again = {r.id: r.prediction for r in ml.TrainedModel(one, "random_forest", FEATURE_COLUMNS).transform(folded.where("fold = 1")).collect()}
    held = table[(table.model == "random_forest") & (table.fold == 1)]
    assert sum(again[i] == p for i, p in zip(held.id, held.prediction)) >= 0.9 * len(held)  # samples of trees depend on the partitions
    con = duckdb.connect()
    con.register("t", table)
    expected = con.execute("""
        WITH f AS (SELECT model, fold, avg((label = prediction)::INT::DOUBLE) AS accuracy FROM t GROUP BY ALL),
        per AS (SELECT model, avg(accuracy) AS m, stddev_pop(accuracy) AS s, count(*) AS n FROM f GROUP BY model),
        auc AS (SELECT a.model, avg(CASE WHEN a.p1 > b.p1 THEN 1.0 WHEN a.p1 = b.p1 THEN 0.5 ELSE 0.0 END::DOUBLE) AS auc FROM t a JOIN t b ON a.model = b.model AND a.label = 1 AND b.label = 0 GROUP BY a.model)
        SELECT model, m, s, n, auc FROM per JOIN auc USING (model)""").fetchall()
    got = {r.model: r for r in ml.out_of_fold_summary(scores).collect()}
    best = max(expected, key=lambda r: (round(r[1], 12), r[0] == MODEL_TYPES[0]))[0]
    for model, mean, std, n, auc in expected:
        r = got[model]
        assert (r.cv_mean_accuracy, r.cv_std_accuracy, r.n_folds, r.roc_auc) == (pytest.approx(mean), pytest.approx(std), n, pytest.approx(auc))
        assert r.is_best == (model == best)
