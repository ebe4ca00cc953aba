"""Classification on Spark ML.

A model is a ``PipelineModel`` (assembler -> scaler -> trees) plus a small
metadata record (model type, seed, feature names). ``random_forest`` maps to
``RandomForestClassifier``; the boosted-tree type (named ``xgboost`` in the
reference) maps to Spark's ``GBTClassifier`` -- first-order boosting without
the L2 term, so scores differ from xgboost but the interface and the
evaluation are the same. Metrics use the exact aggregates of
``operators.metrics`` on the validation rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookline.fixed import BOOSTED_PARAMS, CV_FOLDS, FOREST_PARAMS, MODEL_TYPES, RANDOM_SEED, VALIDATION_SPLIT
from hookline.operators import metrics as M
from hookline.operators.splits import stratified_folds, stratified_split
from hookline.session import materialize


def make_classifier(model_type: str, seed: int = RANDOM_SEED, **overrides):
    """Unknown type -> ValueError."""
    if model_type == "random_forest":
        params = {**FOREST_PARAMS, **overrides}
        return RandomForestClassifier(featuresCol="scaled", labelCol="label_d", seed=seed, **params)
    if model_type == "xgboost":
        params = {**BOOSTED_PARAMS, **overrides}
        return GBTClassifier(featuresCol="scaled", labelCol="label_d", seed=seed, **params)
    raise ValueError(f"Unknown model_type: {model_type}")


def make_pipeline(feature_names: list[str], model_type: str, seed: int = RANDOM_SEED,
                  **overrides) -> Pipeline:
    """L1 + L2/L3: assemble -> standardize (mean and std) -> trees."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=feature_names, outputCol="features", handleInvalid="keep"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        make_classifier(model_type, seed, **overrides),
    ])


ROWS_PER_PARTITION = 200_000


def sized(df: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Persist training rows (memory and disk; recomputed from lineage if an
    executor is lost) with about ``rows_per_partition`` rows per partition, and
    a partition per core at least: tree learners run several jobs per tree level,
    and each job pays one task per partition, so tiny partitions cost more than
    they parallelise. Only ever coalesces (no shuffle)."""
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    n = cached.count()
    target = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows_per_partition))
    if target < cached.rdd.getNumPartitions():
        narrowed = cached.coalesce(target).persist(StorageLevel.MEMORY_AND_DISK)
        narrowed.count()
        cached.unpersist()
        return narrowed
    return cached


def _prep(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("label_d", F.col(label).cast("double"))


@dataclass
class TrainedModel:
    pipeline: PipelineModel
    model_type: str
    feature_names: list[str]
    random_state: int = RANDOM_SEED
    extra: dict = field(default_factory=dict)

    # L5 / L6 ---------------------------------------------------------------------
    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction (0/1), probability (vector), p1 (class-1 probability)."""
        check_features(df.columns, self.feature_names)
        out = self.pipeline.transform(df)
        return out.withColumn("p1", vector_to_array("probability")[1])

    # L7 ----------------------------------------------------------------------------
    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance); the vector is bounded by the feature count."""
        imp = self.pipeline.stages[-1].featureImportances.toArray().tolist()
        names = self.feature_names or [f"feature_{i}" for i in range(len(imp))]
        return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)],
                                     "feature string, importance double")

    # S8 -----------------------------------------------------------------------------
    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.pipeline.write().overwrite().save(path)
        meta = {"model_type": self.model_type, "feature_names": self.feature_names,
                "random_state": self.random_state, **self.extra}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(path.rstrip("/") + "/hookline_meta")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    """Pipeline + metadata (raises when either is missing)."""
    pipe = PipelineModel.load(path)
    meta = json.loads(spark.read.text(path.rstrip("/") + "/hookline_meta").first()[0])
    return TrainedModel(pipe, meta.pop("model_type"), meta.pop("feature_names"),
                        meta.pop("random_state", RANDOM_SEED), meta)


def check_features(columns: list[str], feature_names: list[str]) -> None:
    """Every training feature must be present (order is the model's)."""
    missing = sorted(set(feature_names) - set(columns))
    if missing:
        raise ValueError(f"Missing features: {missing}")


def missing_features(spark: SparkSession, columns: list[str], feature_names: list[str]) -> DataFrame:
    """U3 as data: expected names not present, via a left anti join."""
    want = spark.createDataFrame([(n,) for n in feature_names], "feature string")
    have = spark.createDataFrame([(n,) for n in columns], "feature string")
    return want.join(have, "feature", "left_anti")


def evaluate(scored: DataFrame, label: str = "label") -> DataFrame:
    """A5 + A6 on (label, prediction, p1): one row of five metrics."""
    s = scored.select(F.col(label).alias("label"), F.col("prediction").cast("int").alias("prediction"),
                      F.col("p1").alias("score"))
    return M.metrics_from_score_table(M.score_table(s))


def train(df: DataFrame, feature_names: list[str], model_type: str = "random_forest",
          validation_split: float = VALIDATION_SPLIT, seed: int = RANDOM_SEED, label: str = "label",
          id_col: str = "id", **overrides) -> tuple[TrainedModel, DataFrame]:
    """L4: stratified split -> fit on train -> metrics on validation."""
    classes = df.select(label).distinct().limit(3).count()
    if classes < 2:
        raise ValueError("training needs both classes in the label column")
    split = stratified_split(df, label, id_col, validation_split, seed)
    # the scaler pass and the tree passes reread the training rows: persist
    # them (spills to disk; recomputed from lineage if an executor is lost)
    train_rows = sized(_prep(split.where(F.col("split") == "train"), label))
    val_rows = _prep(split.where(F.col("split") == "validation"), label)
    try:
        pipe = make_pipeline(feature_names, model_type, seed, **overrides).fit(train_rows)
    finally:
        train_rows.unpersist()
    model = TrainedModel(pipe, model_type, list(feature_names), seed)
    return model, evaluate(model.transform(val_rows), label)


def cross_validate(df: DataFrame, feature_names: list[str], model_type: str = "random_forest",
                   k: int = CV_FOLDS, seed: int = RANDOM_SEED, label: str = "label", id_col: str = "id",
                   **overrides) -> DataFrame:
    """K-fold accuracy with the whole pipeline refit per fold (no scaler
    leak); folds are the unshuffled stratified folds of D3."""
    spark = df.sparkSession
    folded = sized(_prep(stratified_folds(df, k, label, id_col), label))
    pipe = make_pipeline(feature_names, model_type, seed, **overrides)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(),
                        evaluator=MulticlassClassificationEvaluator(labelCol="label_d", metricName="accuracy"),
                        numFolds=k, foldCol="fold", seed=seed)
    try:
        fitted = cv.fit(folded)
    finally:
        folded.unpersist()
    mean = float(fitted.avgMetrics[0])
    std = float(fitted.stdMetrics[0]) if fitted.stdMetrics else 0.0
    return spark.createDataFrame([(mean, std)], "cv_mean_accuracy double, cv_std_accuracy double")


def out_of_fold(df: DataFrame, feature_names: list[str], params: dict[str, dict], k: int = CV_FOLDS, seed: int = RANDOM_SEED,
                label: str = "label", id_col: str = "id", at_once: int = 4) -> DataFrame:
    """(id, model, fold, label, prediction, p1), each row scored by the models that did not see its fold.

    ``params`` names the model types and their parameters. All types and folds are
    fitted on one persisted table, ``at_once`` of them at a time. The scores are
    written once, so that what is computed from them does not fit again.
    """
    folded = sized(_prep(stratified_folds(df.select(id_col, label, *feature_names), k, label, id_col), label))

    def scored(task: tuple[str, int]) -> DataFrame:
        model_type, fold = task
        fitted = make_pipeline(feature_names, model_type, seed, **params[model_type]).fit(folded.where(F.col("fold") != fold))
        held = TrainedModel(fitted, model_type, list(feature_names), seed).transform(folded.where(F.col("fold") == fold))
        return held.select(F.col(id_col).alias("id"), F.lit(model_type).alias("model"), "fold", F.col(label).alias("label"), F.col("prediction").cast("int").alias("prediction"), "p1")

    try:
        with ThreadPool(at_once) as pool:
            parts = pool.map(inheritable_thread_target(df.sparkSession)(scored), [(m, i) for m in params for i in range(k)])
        return materialize(reduce(DataFrame.unionByName, parts), "out-of-fold")
    finally:
        folded.unpersist()


def out_of_fold_summary(scores: DataFrame) -> DataFrame:
    """Per model: mean and population std of the folds' accuracies, the exact AUC over all rows, and which model has the best mean (the first wins ties)."""
    right = F.count_if(F.col("label") == F.col("prediction")) / F.count(F.lit(1))
    folds = scores.groupBy("model", "fold").agg(right.alias("accuracy"))
    per = folds.groupBy("model").agg(F.avg("accuracy").alias("cv_mean_accuracy"), F.stddev_pop("accuracy").alias("cv_std_accuracy"), F.count(F.lit(1)).alias("n_folds"))
    models = [r["model"] for r in per.select("model").collect()]  # the model types
    aucs = [M.roc_auc(scores.where(F.col("model") == m).select("label", "prediction", F.col("p1").alias("score"))).select(F.lit(m).alias("model"), "roc_auc") for m in models]
    best = per.agg(F.max(F.struct("cv_mean_accuracy", F.when(F.col("model") == MODEL_TYPES[0], 1).otherwise(0), "model")).alias("b")).select(F.col("b.model").alias("best"))
    return per.join(reduce(DataFrame.unionByName, aucs), "model").withColumn("is_best", F.col("model") == best.scalar())


def compare_models(df: DataFrame, feature_names: list[str], validation_split: float = VALIDATION_SPLIT,
                   k: int = CV_FOLDS, model_types: list[str] | None = None,
                   params: dict[str, dict] | None = None) -> DataFrame:
    """Each model type -> validation metrics + CV accuracy, one row per type
    (``params`` = optional parameter overrides per model type)."""
    rows = None
    for i, mt in enumerate(model_types or MODEL_TYPES):
        overrides = (params or {}).get(mt, {})
        _, m = train(df, feature_names, mt, validation_split, **overrides)
        cv = cross_validate(df, feature_names, mt, k, **overrides)
        row = M.side_by_side(m, cv).select(F.lit(mt).alias("model"), F.lit(i).alias("model_order"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def grid_search(df: DataFrame, feature_names: list[str], model_type: str = "random_forest",
                grid: dict | None = None, k: int = 3, seed: int = RANDOM_SEED, label: str = "label",
                id_col: str = "id") -> DataFrame:
    """L13 (documented only in the reference): CV over a parameter grid,
    one row per parameter map with its mean accuracy."""
    spark = df.sparkSession
    folded = _prep(stratified_folds(df, k, label, id_col), label)
    pipe = make_pipeline(feature_names, model_type, seed)
    clf = pipe.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in (grid or {"maxDepth": [4, 8]}).items():
        builder = builder.addGrid(clf.getParam(name), values)
    maps = builder.build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps,
                        evaluator=MulticlassClassificationEvaluator(labelCol="label_d", metricName="accuracy"),
                        numFolds=k, foldCol="fold", seed=seed)
    fitted = cv.fit(folded)
    rows = [(json.dumps({p.name: v for p, v in m.items()}), float(a)) for m, a in zip(maps, fitted.avgMetrics)]
    return spark.createDataFrame(rows, "params string, cv_mean_accuracy double")


def labelled_features(feats: DataFrame, feature_names: list[str], label: str = "label") -> DataFrame:
    """M3: rows whose url could not be parsed keep their label with all
    features 0 (the reference's loader fills the empty record with 0)."""
    return feats.fillna(0, subset=feature_names)


def train_flow(df: DataFrame, feature_names: list[str], model_type: str, output_dir: str,
               k: int = CV_FOLDS, top_k: int = 10, **overrides) -> dict:
    """Train -> cross-validate -> top-k importances -> save model ->
    metrics JSON (S10). Returns the fitted model and the three result frames."""
    spark = df.sparkSession
    model, metrics = train(df, feature_names, model_type, **overrides)
    cv = cross_validate(df, feature_names, model_type, k, **overrides)
    top = model.importances(spark).orderBy(F.desc("importance"), "feature").limit(top_k)
    model.save(f"{output_dir.rstrip('/')}/model")
    all_metrics = M.side_by_side(metrics, cv)
    all_metrics.coalesce(1).write.mode("overwrite").json(f"{output_dir.rstrip('/')}/metrics")
    return {"model": model, "metrics": all_metrics, "top_features": top}


def train_synthetic(spark: SparkSession, n: int = 1000, seed: int = RANDOM_SEED) -> TrainedModel:
    """Forest (100 trees, depth 10) on the synthetic 30-column table
    with the UCI attribute names; such a model cannot score URL features
    (its names differ, see ``check_features``)."""
    from hookline.fixed import UCI_FEATURE_NAMES
    from hookline.sources.datasets import synthetic_numeric
    df = _prep(synthetic_numeric(spark, n, 30, seed, UCI_FEATURE_NAMES))
    clf = RandomForestClassifier(featuresCol="features", labelCol="label_d", numTrees=100, maxDepth=10, seed=seed)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=UCI_FEATURE_NAMES, outputCol="features"), clf]).fit(df)
    return TrainedModel(pipe, "random_forest", list(UCI_FEATURE_NAMES), seed, {"is_synthetic": True})
