"""Scoring jobs R1-R5: features -> model -> verdict records, errors per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector

from hookline.fixed import FEATURE_COLUMNS, INDICATOR_RULES
from hookline.functions.rules import (confidence, indicator_count, phishing_probability, risk_indicators, status_line, warning_text,
                                      warnings)
from hookline.operators.features import url_features
from hookline.operators.ml import TrainedModel, check_features


class RuleModel:
    """The documented indicators as a model: the share of rules that fire is the probability, ``threshold`` of them make a verdict.

    It needs no training, and everything that takes a model takes it.
    """

    model_type = "indicator_rules"
    feature_names = FEATURE_COLUMNS

    def __init__(self, threshold: int = 4, fitted: DataFrame | None = None) -> None:
        self.threshold, self._importances = threshold, fitted

    def transform(self, df: DataFrame) -> DataFrame:
        check_features(df.columns, self.feature_names)
        share = indicator_count().cast("double") / F.lit(float(len(INDICATOR_RULES)))
        fired = F.when(indicator_count() >= self.threshold, 1.0).otherwise(0.0)
        return df.withColumns({"p1": share, "prediction": fired}).withColumn("probability", array_to_vector(F.array(1.0 - F.col("p1"), F.col("p1"))))

    def fit_importances(self, feats: DataFrame) -> RuleModel:
        """The same model with importances: each feature's share of all rules that fire on ``feats``."""
        rule = F.explode(risk_indicators())
        names = F.create_map(*[F.lit(x) for name, feature, *_ in INDICATOR_RULES for x in (name, feature)])
        fired = feats.select(rule.alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
        by_feature = fired.groupBy(F.try_element_at(names, F.col("rule")).alias("feature")).agg(F.sum("n").alias("n"))
        total = fired.agg(F.sum("n")).scalar()
        return RuleModel(self.threshold, by_feature.select("feature", (F.col("n") / total).alias("importance")))

    def importances(self, spark: SparkSession) -> DataFrame:
        if self._importances is None:
            raise ValueError("the rules have no importances before fit_importances")
        return self._importances


def score_features(feats: DataFrame, model: TrainedModel | RuleModel, with_features: bool = False,
                   keep: list[str] | None = None) -> DataFrame:
    """Model verdicts for a feature frame that has an ``error`` column.

    Error rows go through the model with zero features (one pass, no
    branch-and-union) and get null verdicts afterwards.
    """
    check_features(feats.columns, model.feature_names)
    ok = F.col("error").isNull()
    filled = feats.fillna(0, subset=model.feature_names)
    out = model.transform(filled)
    keep = keep if keep is not None else ["url"]
    cols = [*keep,
            F.when(ok, out["prediction"] == 1.0).alias("is_phishing"),
            F.when(ok, confidence(out["probability"])).alias("confidence"),
            F.when(ok, phishing_probability(out["probability"])).alias("phishing_probability"),
            "error"]
    if with_features:
        cols.insert(-1, F.when(ok, F.struct(*FEATURE_COLUMNS, "closest_brand")).alias("features"))
    return out.select(*cols)


def score_urls(df: DataFrame, model: TrainedModel, *, registry=None, certificates=None,
               as_of: Column | None = None, with_features: bool = False,
               keep: list[str] | None = None) -> DataFrame:
    """Urls -> features -> verdicts (``error`` per row, never a failed batch)."""
    feats = url_features(df, registry=registry, certificates=certificates, as_of=as_of)
    return score_features(feats, model, with_features, keep)


def batch_summary(scored: DataFrame) -> DataFrame:
    """A4: safe / phishing / error counts in one aggregate."""
    err = F.col("error").isNotNull()
    return scored.agg(
        F.count_if(~err & ~F.col("is_phishing")).alias("safe_count"),
        F.count_if(~err & F.col("is_phishing")).alias("phishing_count"),
        F.count_if(err).alias("error_count"))


def report_lines(scored: DataFrame) -> DataFrame:
    """M9: one status line per row (errors say ERROR)."""
    line = F.when(F.col("error").isNotNull(),
                  F.format_string("%-8s %s... (%s)", F.lit("ERROR"), F.substring("url", 1, 50), F.col("error"))) \
        .otherwise(status_line(F.col("is_phishing"), F.col("url"), F.col("confidence")))
    return scored.select("url", line.alias("status"))


def with_warnings(feats: DataFrame) -> DataFrame:
    """M7/M8 on a feature frame."""
    w = warnings()
    return feats.withColumn("warnings", w).withColumn("warning_text", warning_text(w))


def importance_report(spark: SparkSession, model: TrainedModel, k: int | None = None) -> DataFrame:
    """Model type + importances, descending (ties by name), top k."""
    imp = model.importances(spark).select(F.lit(model.model_type).alias("model_type"), "feature", "importance")
    ordered = imp.orderBy(F.desc("importance"), "feature")
    return ordered.limit(k) if k else ordered


def evaluation_table(scored: DataFrame, actual_col: str = "label") -> DataFrame:
    """Url, actual, predicted, confidence, match."""
    # a row that could not be scored has no prediction and no match
    pred = F.when(F.col("is_phishing"), F.lit("phishing")).when(~F.col("is_phishing"), F.lit("legitimate"))
    actual = F.when(F.col(actual_col) == 1, F.lit("phishing")).otherwise(F.lit("legitimate"))
    return scored.select("url", actual.alias("actual"), pred.alias("predicted"), "confidence",
                         (pred == actual).alias("match"), "error")
