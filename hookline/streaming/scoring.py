"""Structured Streaming jobs R6 (score a url stream) and R7 (verdict windows).

R6 runs the batch feature/scoring job on each micro-batch through
``foreachBatch``: the registry and certificate lookups work on the batch's
distinct keys exactly as in batch mode, and each batch is committed to the sink
as a whole (:mod:`commits`). R7 counts verdicts per tumbling window: with a
watermark that sets late rows aside and counts them (:class:`VerdictWindows`), or as
Spark's own stateful aggregation in update mode (:func:`window_counts`), where
readers take the last update per window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hookline.functions.rules import indicator_count
from hookline.operators.features import local_features
from hookline.session import scratch_path
from hookline.streaming.commits import CommittedSink


def read_stream(spark: SparkSession, path: str, like: DataFrame | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table (one file or a folder) as a stream; the schema is that of a batch read."""
    schema = (like if like is not None else spark.read.parquet(path)).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{path}*")  # a pattern, since a plain path must be a folder


def started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_batches(stream: DataFrame, batch_job: Callable[[DataFrame], DataFrame], sink: str,
                checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """R6 driver: ``batch_job`` on every micro-batch, into a :class:`CommittedSink`."""
    return started(stream, lambda batch, batch_id: CommittedSink(sink).write(batch_job(batch), batch_id), checkpoint, available_now)


def rule_verdicts(url_col: str = "url", threshold: int = 4) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("n_indicators", F.when(F.col("error").isNull(), indicator_count())) \
        .withColumn("is_phishing", F.col("n_indicators") >= threshold)


def window_counts(stream: DataFrame, ts_col: str = "ts", window: str = "1 hour",
                  watermark: str | None = None, threshold: int = 4) -> DataFrame:
    """Per tumbling window, safe / phishing / error counts of the local rule verdict.

    Without a ``watermark`` no event is ever late: the state is one row of
    three counts per window, whatever the order of the files. A stated lateness
    lets old windows go; events later than it are dropped by Spark, which
    counts them in the query's progress (numRowsDroppedByWatermark).
    """
    f = local_features(stream)
    f = f.withColumn("has_valid_ssl", F.lit(0.0)).withColumn("domain_age_days", F.lit(-1.0))
    # event time as an instant: unix_timestamp reads a TIMESTAMP_NTZ as UTC,
    # so the windows do not depend on the session time zone
    f = f.withColumn("event_time", F.timestamp_seconds(F.unix_timestamp(F.col(ts_col))))
    ok = F.col("error").isNull()
    n = indicator_count()
    if watermark:
        f = f.withWatermark("event_time", watermark)
    return (f.groupBy(F.window("event_time", window).alias("w"))
            .agg(F.count_if(ok & (n < threshold)).alias("safe_count"),
                 F.count_if(ok & (n >= threshold)).alias("phishing_count"),
                 F.count_if(~ok).alias("error_count")))


def run_windows(counts: DataFrame, sink: str, checkpoint: str,
                available_now: bool = True) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        CommittedSink(sink).write(batch.withColumn("update", F.lit(batch_id)), batch_id)

    w = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest_windows(spark: SparkSession, sink: str) -> DataFrame:
    """Final value per window = the update of the highest batch id."""
    u = CommittedSink(sink).read(spark)
    last = F.max_by(F.struct("safe_count", "phishing_count", "error_count"), F.col("update"))
    return u.groupBy("w").agg(last.alias("c")).select(
        F.unix_seconds(F.col("w.start")).alias("window_start_epoch"),
        F.col("c.safe_count").alias("safe_count"), F.col("c.phishing_count").alias("phishing_count"),
        F.col("c.error_count").alias("error_count"))


COUNTS = ("safe_count", "phishing_count", "error_count")
COUNT_SCHEMA = "window_start_epoch long, late boolean, safe_count long, phishing_count long, error_count long"


@dataclass(frozen=True)
class VerdictWindows:
    """R7 with a watermark that loses no event.

    Every micro-batch adds its counts per window; a window's value is the sum over
    the batches. The watermark of a batch is the latest event time of the batches
    before it less the allowed lateness, and is kept with their commits. Rows
    behind it are late: they are counted apart and also written as rows to a sink
    of their own. A window that ends before the watermark is closed: from then on
    only its late counts grow. All that is kept is a number per batch.
    """

    path: str
    lateness_seconds: int = 3600
    window_seconds: int = 3600
    threshold: int = 4

    @property
    def counts(self) -> CommittedSink:
        return CommittedSink(f"{self.path}/counts")

    @property
    def late(self) -> CommittedSink:
        return CommittedSink(f"{self.path}/late")

    def horizon(self, spark: SparkSession, batch_id: int) -> int | None:
        """The watermark of a batch, the same whenever the batch is run again."""
        before = self.counts.commits(spark, "max_time long").where(F.col("batch_id") < batch_id)
        latest = before.agg(F.max("max_time")).first()[0]
        return None if latest is None else latest - self.lateness_seconds

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        horizon = self.horizon(spark, batch_id)
        seconds = F.unix_timestamp(F.col("ts"))  # a TIMESTAMP_NTZ is read as UTC, whatever the session's time zone
        timed = batch.withColumns({"event_epoch": seconds, "late": F.lit(False) if horizon is None else F.coalesce(seconds < horizon, F.lit(False))})
        feats = local_features(timed).withColumns({"has_valid_ssl": F.lit(0.0), "domain_age_days": F.lit(-1.0)})
        rows = rule_verdicts(threshold=self.threshold)(feats).select(*batch.columns, "event_epoch", "late", "is_phishing", "error").persist()
        try:
            self.late.write(rows.where("late").drop("late"), batch_id)
            start = (F.floor(F.col("event_epoch") / self.window_seconds) * self.window_seconds).cast("long")
            ok = F.col("error").isNull()
            found = rows.groupBy(start.alias("window_start_epoch"), "late").agg(
                F.count_if(ok & ~F.col("is_phishing")).alias("safe_count"), F.count_if(ok & F.col("is_phishing")).alias("phishing_count"), F.count_if(~ok).alias("error_count"))
            self.counts.write(found, batch_id, max_time=rows.agg(F.max("event_epoch")).first()[0])
        finally:
            rows.unpersist()

    def run(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        return started(stream, self.write, checkpoint, available_now)

    def windows(self, spark: SparkSession) -> DataFrame:
        """(window_start_epoch, late, counts): what came in time and what came late, per window."""
        rows = self.counts.read(spark, COUNT_SCHEMA)
        return rows.groupBy("window_start_epoch", "late").agg(*[F.sum(c).alias(c) for c in COUNTS])

    def totals(self, spark: SparkSession) -> DataFrame:
        """Per window, all events, whatever the order in which they came."""
        return self.windows(spark).groupBy("window_start_epoch").agg(*[F.sum(c).alias(c) for c in COUNTS])


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh sink and checkpoint folders under the shared checkpoint dir."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def model_verdicts(model, registry=None, certificates=None, as_of=None,
                   keep: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """R6 with a trained model: features (+ lookups) and model verdicts per
    micro-batch, errors kept per row."""
    from hookline.operators.features import url_features
    from hookline.operators.scoring import score_features

    def job(batch: DataFrame) -> DataFrame:
        f = url_features(batch, registry=registry, certificates=certificates, as_of=as_of)
        return score_features(f, model, keep=keep if keep is not None else ["url"])
    return job
