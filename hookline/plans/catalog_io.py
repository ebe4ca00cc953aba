"""Registered queries, fourth part: files written and read back, the rules as a model, out-of-fold scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hookline.fixed import FEATURE_COLUMNS
from hookline.operators import metrics as M
from hookline.operators import ml
from hookline.operators.features import url_features
from hookline.operators.scoring import RuleModel, batch_summary, evaluation_table, importance_report, report_lines, score_features
from hookline.operators.splits import stratified_folds
from hookline.plans.catalog import corpus_features, corpus_local, query
from hookline.plans.catalog_ml import training_frame
from hookline.plans.catalog_more import FOLDS, RULE_THRESHOLD, scored, uci_frame, zero_filled
from hookline.session import scratch_path
from hookline.sources import corpus as C
from hookline.sources import datasets as D
from hookline.sources.sinks import features_json, write_json

UCI_COLUMNS = ["url_length", "dot_count", "has_https"]
TOP_K = 10
#: Few and shallow trees: the queries show the flow, not the best model.
SMALL_MODELS = {"random_forest": {"numTrees": 10, "maxDepth": 5}, "xgboost": {"maxIter": 5, "maxDepth": 3}}


# --- files (S1-S5, S10-S12) ---------------------------------------------------------------

@query("custom_dataset")
def custom_dataset(spark, sf):
    """The corpus as a labelled CSV, and from the file the training rows."""
    path = scratch_path(spark, "custom-csv")
    D.write_custom(C.url_corpus(spark, sf), path, label_column="label_text")
    return D.load_training(spark, path, label_column="label_text")


@query("uci_datasets")
def uci_datasets(spark, sf):
    """A numeric table as CSV and as ARFF, read back with the target found and mapped."""
    target = uci_frame(spark, sf).select("id", "Result")
    rows = zero_filled(corpus_local(spark, sf)).select("id", *UCI_COLUMNS).join(target, "id").drop("id")
    read = []
    for kind in ("csv", "arff"):
        path = f"{scratch_path(spark, 'uci')}/table.{kind}"
        D.write_uci(rows, path)
        found = D.load_uci(spark, path, positive=1)
        read.append(found.select(F.lit(kind).alias("file"), *[F.col(c).cast("double").alias(c) for c in UCI_COLUMNS], "label"))
    return read[0].unionByName(read[1])


@query("url_list")
def url_list(spark, sf):
    """The urls as a list, one a line, read back without blanks."""
    path = scratch_path(spark, "url-list")
    D.write_url_list(C.url_corpus(spark, sf), path)
    return D.read_url_list(spark, path)


@query("json_results")
def json_results(spark, sf):
    """Batch verdicts as JSON lines, read back."""
    found = score_features(corpus_features(spark, sf), RuleModel(RULE_THRESHOLD), keep=["id", "url"])
    path = scratch_path(spark, "json-results")
    write_json(found, path)
    return spark.read.schema(found.schema).json(path)


@query("feature_records")
def feature_records(spark, sf):
    """Feature records as JSON, read back as columns."""
    feats = corpus_features(spark, sf)
    records = features_json(feats, ["id"])
    path = scratch_path(spark, "feature-records")
    write_json(records, path)
    fields = StructType([f for f in feats.schema.fields if f.name in (*FEATURE_COLUMNS, "closest_brand")])
    back = spark.read.schema(StructType([StructField("id", feats.schema["id"].dataType), records.schema["features"]])).json(path)
    return back.select("id", F.from_json("features", fields).alias("f")).select("id", "f.*")


@query("metrics_json")
def metrics_json(spark, sf):
    """Validation and cross-validation metrics in one JSON record, read back."""
    rows = scored(spark, sf).select("id", "label", "prediction").persist()
    per = stratified_folds(rows, FOLDS).groupBy("fold").agg((F.count_if(F.col("label") == F.col("prediction")) / F.count(F.lit(1))).alias("accuracy"))
    both = M.side_by_side(M.binary_metrics(rows), M.fold_summary(per))
    path = scratch_path(spark, "metrics-json")
    write_json(both, path)
    rows.unpersist()
    return spark.read.schema(both.schema).json(path)


# --- the rules as a model (M4-M6, M9, M10, T1, T2, R1, R2, R4, R5, A4) --------------------------

@query("rule_batch_score")
def rule_batch_score(spark, sf):
    """R2, M4-M6: verdict, confidence and probability of every event url, errors kept."""
    ev = C.url_events(spark, sf).select("event_id", "url")
    feats = url_features(ev, registry=C.registry_snapshot(spark, sf), certificates=C.certificate_snapshot(spark, sf), as_of=C.as_of())
    return score_features(feats, RuleModel(RULE_THRESHOLD), keep=["event_id", "url"])


def rule_scores(spark, sf, *keep, **options):
    return score_features(corpus_features(spark, sf), RuleModel(RULE_THRESHOLD), keep=list(keep), **options)


@query("rule_score_with_features")
def rule_score_with_features(spark, sf):
    """Verdicts with the features they come from."""
    found = rule_scores(spark, sf, "id", with_features=True)
    return found.select("id", "is_phishing", "confidence", "phishing_probability", "features.*", "error")


@query("rule_status_lines")
def rule_status_lines(spark, sf):
    """M9: a line of text per url."""
    return report_lines(rule_scores(spark, sf, "url"))


@query("rule_summary")
def rule_summary(spark, sf):
    """A4 over the verdicts of the corpus."""
    return batch_summary(rule_scores(spark, sf, "id"))


@query("rule_evaluation")
def rule_evaluation(spark, sf):
    """Actual and predicted class, and whether they match."""
    return evaluation_table(rule_scores(spark, sf, "url", "label"))


@query("rule_importance")
def rule_importance(spark, sf):
    """The features by their share of the rules that fire."""
    return importance_report(spark, RuleModel(RULE_THRESHOLD).fit_importances(corpus_features(spark, sf)))


@query("rule_top_features")
def rule_top_features(spark, sf):
    """The first of them."""
    return importance_report(spark, RuleModel(RULE_THRESHOLD).fit_importances(corpus_features(spark, sf)), 5)


# --- models (L8, L9, S8, S9) -------------------------------------------------------------------

@query("saved_model_score")
def saved_model_score(spark, sf):
    """A saved forest, loaded again, gives every corpus row the verdict of the one in memory."""
    rows = training_frame(spark, sf).persist()
    model, _ = ml.train(rows, FEATURE_COLUMNS, "random_forest", **SMALL_MODELS["random_forest"])
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = ml.load_model(spark, path)
    own, other = (m.transform(rows).select("id", "prediction", "p1") for m in (model, loaded))
    both = own.join(other.withColumnsRenamed({"prediction": "other", "p1": "other_p1"}), "id")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if((F.col("prediction") == F.col("other")) & (F.col("p1") == F.col("other_p1"))).alias("n_same"))


@query("out_of_fold_scores")
def out_of_fold_scores(spark, sf):
    """Each corpus row scored by the forest and the boosted trees that did not see it."""
    return ml.out_of_fold(training_frame(spark, sf), FEATURE_COLUMNS, SMALL_MODELS, FOLDS)


@query("out_of_fold_summary")
def out_of_fold_summary(spark, sf):
    """Accuracies, AUC and the winner, from the out-of-fold scores."""
    return ml.out_of_fold_summary(out_of_fold_scores(spark, sf))
