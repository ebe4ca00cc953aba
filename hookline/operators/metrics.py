"""Evaluation aggregates: class distribution (A2), binary metrics (A5),
exact ROC-AUC (A6), fold summary (A7), scaler statistics (A8), confusion
matrix (A9), best model (T5). All are one-pass partial aggregations except
the AUC, which needs a global order of the distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookline.operators.ranking import running_sums
from hookline.session import materialize


def _ratio(num: Column, den: Column) -> Column:
    """num/den as DOUBLE, 0.0 when den is 0 (the usual zero-division rule)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A5: accuracy, precision, recall, f1_score for positive class 1 (one row)."""
    y = F.col(label) == 1
    p = F.col(prediction) == 1
    c = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    return c.select(
        _ratio(tp + tn, n).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact rank AUC, ties get half credit (one row ``roc_auc``).

    Per distinct score: positives p_s and negatives n_s (partial aggregation),
    then the negatives strictly below each score by a distributed prefix sum;
    AUC = sum(p_s * (neg_below + n_s / 2)) / (P * N).
    """
    per = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    return _auc_from_counts(per)


def _auc_from_counts(per: DataFrame) -> DataFrame:
    """per = (score, p, q) with unique scores."""
    below = running_sums(per, "score", ["q"])
    num = F.sum(F.col("p").cast("double") * (F.col("q_before").cast("double") + F.col("q").cast("double") / 2.0))
    agg = below.agg(num.alias("u"), F.sum("p").alias("P"), F.sum("q").alias("N"))
    return agg.select(
        F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(None).cast("double"))
        .otherwise(F.col("u") / (F.col("P").cast("double") * F.col("N").cast("double"))).alias("roc_auc"))


def score_table(df: DataFrame, label: str = "label", score: str = "score",
                prediction: str = "prediction") -> DataFrame:
    """(score, prediction, p, q): positives and negatives per distinct
    (score, prediction) -- one partial aggregation over the scored rows."""
    return df.groupBy(F.col(score).alias("score"), F.col(prediction).alias("prediction")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))


def metrics_from_score_table(per: DataFrame) -> DataFrame:
    """A5 + A6 from :func:`score_table` (one row): the big input is read once."""
    per = materialize(per, "score-table")
    pred = F.col("prediction") == 1
    base = per.agg(
        F.sum(F.when(pred, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(pred, F.col("q")).otherwise(0)).alias("fp"),
        F.sum(F.when(~pred, F.col("p")).otherwise(0)).alias("fn"),
        F.sum(F.when(~pred, F.col("q")).otherwise(0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    m = base.select(
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"))
    by_score = per.groupBy("score").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return side_by_side(m, _auc_from_counts(by_score))


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of two one-row frames in one row, by a union and ``max``
    (no join between them)."""
    cols_a, cols_b = a.columns, b.columns
    types = dict(a.dtypes + b.dtypes)
    left = a.select(*cols_a, *[F.lit(None).cast(types[c]).alias(c) for c in cols_b])
    right = b.select(*[F.lit(None).cast(types[c]).alias(c) for c in cols_a], *cols_b)
    return left.unionByName(right).agg(*[F.max(c).alias(c) for c in cols_a + cols_b])


def fold_summary(per_fold: DataFrame, metric: str = "accuracy", digits: int = 9) -> DataFrame:
    """Mean and population std of per-fold scores."""
    return per_fold.agg(F.round(F.avg(metric), digits).alias(f"cv_mean_{metric}"),
                        F.round(F.stddev_pop(metric), digits).alias(f"cv_std_{metric}"))


def scaler_stats(df: DataFrame, cols: list[str], digits: int | None = 9) -> DataFrame:
    """(feature, mean, std) with population std, a zero std read as 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `m_{c}`, `s_{c}`" for c in cols)
    long = one.selectExpr(f"stack({len(cols)}, {stack}) as (feature, mean, std)")
    std = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    mean = F.col("mean")
    if digits is not None:
        mean, std = F.round(mean, digits), F.round(std, digits)
    return long.select("feature", mean.alias("mean"), std.alias("std"))


def best_by(metrics: DataFrame, name_col: str, metric: str, order_col: str) -> DataFrame:
    """T5: the row with the largest metric; the first (smallest order_col) wins ties."""
    best = F.max(F.struct(F.col(metric), (-F.col(order_col)).alias("_o"), F.col(name_col)))
    return metrics.agg(best.alias("b")).select(
        F.col(f"b.{name_col}").alias(name_col), F.col(f"b.{metric}").alias(metric))


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """L1 fit: per column (mean, population std; zero std -> 1).

    One aggregate job; only the 2 x len(cols) statistics (model parameters,
    bounded by the feature count) reach the driver.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = (m if m is not None else 0.0, 1.0 if not s else s)
    return out


def apply_scaler(fitted: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """L1 transform: column -> (x - mean) / std."""
    return {c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()}
