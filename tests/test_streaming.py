"""Streams give the same result as the batch jobs (availableNow)."""

from conftest import SF_SMALL
from hookline.session import scratch_path
from hookline.streaming import commits, scoring as S
from hookline.streaming.commits import CommittedSink
from hookline.sources.tables import events
from hookline.plans.catalog import all_queries
from hookline.plans.catalog_more import RULE_THRESHOLD
from hookline.functions.rules import indicator_count
from hookline.operators.features import local_features, url_features
from hookline.sources import corpus as C
import pytest
from pyspark.sql import functions as F


def test_score_stream_equals_batch(spark):
    got = {tuple(r) for r in all_queries()["score_stream"](spark, SF_SMALL)
           .select("event_id", "n_indicators", "is_phishing", "error").collect()}
    ev = C.url_events(spark, SF_SMALL).select("event_id", "url")
    f = url_features(ev, registry=C.registry_snapshot(spark, SF_SMALL),
                     certificates=C.certificate_snapshot(spark, SF_SMALL), as_of=C.as_of())
    n = F.when(F.col("error").isNull(), indicator_count())
    want = {tuple(r) for r in f.select("event_id", n.alias("n"), (n >= RULE_THRESHOLD).alias("p"), "error").collect()}
    assert got == want and len(got) == ev.count()


def test_windows_equal_batch(spark):
    got = {tuple(r) for r in all_queries()["stream_verdict_windows"](spark, SF_SMALL).collect()}
    ev = C.url_events(spark, SF_SMALL).select("event_id", "ts", "url")
    f = local_features(ev).withColumn("has_valid_ssl", F.lit(0.0)).withColumn("domain_age_days", F.lit(-1.0))
    ok = F.col("error").isNull()
    n = indicator_count()
    w = F.window(F.timestamp_seconds(F.unix_timestamp("ts")), "1 hour")
    want = {tuple(r) for r in f.groupBy(w.alias("w")).agg(
        F.count_if(ok & (n < RULE_THRESHOLD)), F.count_if(ok & (n >= RULE_THRESHOLD)), F.count_if(~ok))
        .select(F.unix_seconds("w.start"), "*").drop("w").collect()}
    assert got == want


def test_model_stream_equals_batch(spark):
    from hookline.fixed import FEATURE_COLUMNS
    from hookline.operators import ml
    from hookline.operators.scoring import score_features
    from hookline.plans.catalog_ml import training_frame
    from hookline.streaming import scoring as S
    model, _ = ml.train(training_frame(spark, SF_SMALL), FEATURE_COLUMNS, "random_forest", numTrees=20)
    reg, certs = C.registry_snapshot(spark, SF_SMALL), C.certificate_snapshot(spark, SF_SMALL)
    src = f"{scratch_path(spark, 'events-in-files')}/events.parquet"
    events(spark, SF_SMALL).repartition(4).write.parquet(src)
    stream = C.with_urls(S.read_stream(spark, src, max_files_per_trigger=2).select("event_id", "ts"), spark, SF_SMALL).select("event_id", "url")
    job = S.model_verdicts(model, reg, certs, C.as_of(), keep=["event_id", "url"])
    sink, ckpt = S.stream_paths(spark, "model-stream-test")
    S.run_batches(stream, job, sink, ckpt).awaitTermination()
    got = {tuple(r) for r in CommittedSink(sink).read(spark).collect()}
    batch = C.url_events(spark, SF_SMALL).select("event_id", "url")
    want = {tuple(r) for r in job(batch).collect()}
    assert got == want and len(got) == batch.count()


@pytest.mark.parametrize("files", [1, 2, None])
def test_windows_lose_no_event_whatever_the_batches(spark, files):
    """Files in random order over one, two or many micro-batches give the same windows."""
    src = f"{scratch_path(spark, 'events-in-files')}/events.parquet"
    events(spark, SF_SMALL).orderBy(F.md5(F.col("event_id").cast("string"))).repartition(5).write.parquet(src)
    stream = C.with_urls(S.read_stream(spark, src, max_files_per_trigger=files).select("event_id", "ts"), spark, SF_SMALL)
    sink, ckpt = S.stream_paths(spark, "windows-test")
    S.run_windows(S.window_counts(stream.select("event_id", "ts", "url")), sink, ckpt).awaitTermination()
    total = S.latest_windows(spark, sink).agg(F.sum(F.col("safe_count") + F.col("phishing_count") + F.col("error_count")), F.count(F.lit(1))).first()
    assert tuple(total) == (1000, 531)


def shuffled_events(spark, files):
    src = f"{scratch_path(spark, 'events-in-files')}/events.parquet"
    events(spark, SF_SMALL).orderBy(F.md5(F.col("event_id").cast("string"))).repartition(files).write.parquet(src)
    return src


def event_urls(spark, src, files_per_batch):
    return C.with_urls(S.read_stream(spark, src, max_files_per_trigger=files_per_batch).select("event_id", "ts"), spark, SF_SMALL).select("event_id", "ts", "url")


def batch_counts(spark):
    f = local_features(C.url_events(spark, SF_SMALL)).withColumn("has_valid_ssl", F.lit(0.0)).withColumn("domain_age_days", F.lit(-1.0))
    ok, n = F.col("error").isNull(), indicator_count()
    start = (F.floor(F.unix_timestamp("ts") / 3600) * 3600).cast("long")
    rows = f.groupBy(start.alias("w")).agg(F.count_if(ok & (n < RULE_THRESHOLD)), F.count_if(ok & (n >= RULE_THRESHOLD)), F.count_if(~ok)).collect()
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("files", [1, 3, None])
def test_windows_and_late_rows_hold_every_event(spark, files):
    sink, ckpt = S.stream_paths(spark, "late-test")
    found = S.VerdictWindows(sink, lateness_seconds=7200, threshold=RULE_THRESHOLD)
    found.run(event_urls(spark, shuffled_events(spark, 5), files), ckpt).awaitTermination()
    assert {tuple(r) for r in found.totals(spark).collect()} == batch_counts(spark)
    late = found.late.read(spark, "event_id long").select("event_id").collect()
    counted = found.windows(spark).where("late").agg(F.coalesce(F.sum(F.col("safe_count") + F.col("phishing_count") + F.col("error_count")), F.lit(0))).first()[0]
    assert len(late) == len(set(late)) == counted
    assert (counted == 0) == (files is None)  # one batch has no watermark before it
    times = [r.max_time for r in found.counts.commits(spark, "max_time long").orderBy("batch_id").collect()]
    assert [found.horizon(spark, k) for k in range(len(times) + 1)] == [None] + [max(times[:k + 1]) - 7200 for k in range(len(times))]


class Broken(Exception):
    pass


@pytest.mark.parametrize("where", ["data", "commit"])
def test_a_stream_that_breaks_and_restarts_gives_each_event_once(spark, monkeypatch, where):
    """One batch breaks while its files are written, or when they are there and only the commit is missing."""
    src = shuffled_events(spark, 4)
    sink, ckpt = S.stream_paths(spark, "broken-test")
    publish, broken = commits.publish, []

    def job(batch):
        rows = batch.select("event_id")
        if where == "data" and batch.sparkSession.sparkContext and len(broken) == 0 and commits.exists(spark, f"{sink}/commits/0.json"):
            broken.append(1)
            rows = rows.withColumn("event_id", F.when(F.col("event_id") >= 0, F.raise_error(F.lit("broken"))).cast("long"))
        return rows

    def publish_once_broken(session, path, text):
        if where == "commit" and not broken and path.endswith("/1.json"):
            broken.append(1)
            raise Broken
        publish(session, path, text)

    monkeypatch.setattr(commits, "publish", publish_once_broken)
    with pytest.raises(Exception):
        S.run_batches(event_urls(spark, src, 1), job, sink, ckpt).awaitTermination()
    assert broken and CommittedSink(sink).commits(spark).count() == 1
    seen = [r.event_id for r in CommittedSink(sink).read(spark).collect()]
    assert len(seen) == len(set(seen)) < 1000
    S.run_batches(event_urls(spark, src, 1), job, sink, ckpt).awaitTermination()
    ids = [r.event_id for r in CommittedSink(sink).read(spark).collect()]
    assert len(ids) == len(set(ids)) == 1000
    if where == "commit":
        assert spark.read.parquet(f"{sink}/data").count() > 1000  # the attempt that nobody names
    again = CommittedSink(sink)
    again.write(spark.createDataFrame([(5,)], "event_id long"), 0)
    assert again.read(spark).count() == 1000
