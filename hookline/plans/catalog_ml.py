"""Registered queries, third part: models, scoring and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from hookline.fixed import FEATURE_COLUMNS
from hookline.operators import ml
from hookline.operators.features import url_features
from hookline.operators.scoring import (batch_summary, evaluation_table, importance_report,
                                        score_features)
from hookline.plans.catalog import corpus_features, query
from hookline.plans.catalog_more import RULE_THRESHOLD, scored, zero_filled
from hookline.session import table_path
from hookline.sources import corpus as C
from hookline.streaming import scoring as S
from hookline.streaming.commits import CommittedSink

TOP_K = 10


def training_frame(spark, sf):
    """Every corpus row: id, label and the 32 features (zeros for unreadable urls)."""
    return scored(spark, sf).select("id", "label", *FEATURE_COLUMNS)


def _fit(spark, sf, model_type):
    return ml.train(training_frame(spark, sf), FEATURE_COLUMNS, model_type)


@query("rf_train_score")
def rf_train_score(spark, sf):
    """L2/L4: random forest, validation metrics (one row)."""
    _, metrics = _fit(spark, sf, "random_forest")
    return metrics


@query("gbt_train_score")
def gbt_train_score(spark, sf):
    """L3/L4: boosted trees, validation metrics (one row)."""
    _, metrics = _fit(spark, sf, "xgboost")
    return metrics


def compare_models(spark, sf):
    """Both model types, validation metrics + 5-fold CV accuracy."""
    rows = ml.compare_models(training_frame(spark, sf), FEATURE_COLUMNS)
    best = F.max(F.struct(F.col("f1_score"), (-F.col("model_order")).alias("o"), F.col("model")))
    winner = rows.agg(best.alias("b")).select(F.col("b.model").alias("best_model"))
    return rows.join(winner, rows["model"] == winner["best_model"], "left") \
        .select(*[c for c in rows.columns if c != "model_order"],
                F.col("best_model").isNotNull().alias("is_best"))


@query("feature_importance")
def feature_importance(spark, sf):
    """Forest importances, descending."""
    model, _ = _fit(spark, sf, "random_forest")
    return importance_report(spark, model)


@query("top_features")
def top_features(spark, sf):
    """The ten most important features."""
    model, _ = _fit(spark, sf, "random_forest")
    return importance_report(spark, model, TOP_K)


@query("batch_score")
def batch_score(spark, sf):
    """R2: forest verdicts for every event url, errors kept per row."""
    model, _ = _fit(spark, sf, "random_forest")
    ev = C.url_events(spark, sf).select("event_id", "url")
    feats = url_features(ev, registry=C.registry_snapshot(spark, sf),
                         certificates=C.certificate_snapshot(spark, sf), as_of=C.as_of())
    return score_features(feats, model, keep=["event_id", "url"])


@query("batch_score_summary")
def batch_score_summary(spark, sf):
    """A4 on model verdicts."""
    return batch_summary(batch_score(spark, sf))


@query("score_with_features")
def score_with_features(spark, sf):
    """Verdict plus the feature record for every corpus url."""
    model, _ = _fit(spark, sf, "random_forest")
    feats = corpus_features(spark, sf)
    return score_features(feats, model, with_features=True, keep=["id", "url"])


@query("demo_evaluation")
def demo_evaluation(spark, sf):
    """Actual vs predicted for the labelled corpus."""
    model, _ = _fit(spark, sf, "random_forest")
    feats = corpus_features(spark, sf)
    return evaluation_table(score_features(feats, model, keep=["url", "label"]))


# --- streams (R6, R7) ------------------------------------------------------------------

def event_stream(spark, sf):
    """The given events as a stream, with their corpus urls (a stream-table join)."""
    return C.with_urls(S.read_stream(spark, table_path(sf, "events")).select("event_id", "ts"), spark, sf)


@query("score_stream")
def score_stream(spark, sf):
    """Url events as a stream, full features per micro-batch, rule verdict."""
    stream = event_stream(spark, sf).select("event_id", "url")
    reg, certs = C.registry_snapshot(spark, sf), C.certificate_snapshot(spark, sf)

    def job(batch):
        f = url_features(batch, registry=reg, certificates=certs, as_of=C.as_of())
        return S.rule_verdicts(threshold=RULE_THRESHOLD)(f).select(
            "event_id", "n_indicators", "is_phishing", "error")

    sink, ckpt = S.stream_paths(spark, "score-stream")
    S.run_batches(stream, job, sink, ckpt).awaitTermination()
    return CommittedSink(sink).read(spark, "event_id long, n_indicators int, is_phishing boolean, error string")


@query("stream_verdict_windows")
def stream_verdict_windows(spark, sf):
    """Hourly safe / phishing / error counts of the local rule verdict; events that are an hour behind are counted as late and added."""
    stream = event_stream(spark, sf).select("event_id", "ts", "url")
    sink, ckpt = S.stream_paths(spark, "verdict-windows")
    found = S.VerdictWindows(sink, threshold=RULE_THRESHOLD)
    found.run(stream, ckpt).awaitTermination()
    return found.totals(spark)


@query("quick_train_score")
def quick_train_score(spark, sf):
    """Registry lookups skipped (age and registration = -1), forest,
    validation metrics."""
    f = zero_filled(corpus_features(spark, sf, registry=False))
    _, metrics = ml.train(f.select("id", "label", *FEATURE_COLUMNS), FEATURE_COLUMNS, "random_forest")
    return metrics
