"""Hot keys: one key holds a third of the rows; results equal the plain join."""

from pyspark.sql import functions as F

from hookline.operators.joins import lookup_join
from hookline.operators.ranking import rank_within
from hookline.operators.features import url_features
from hookline.sources import corpus as C
from conftest import SF_SMALL


def _skewed(spark, n=3000):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 97}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, key string")


def test_lookup_join_keeps_every_row_of_a_hot_key(spark):
    big = _skewed(spark)
    lookup = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(50)], "key string, v double")
    free = lookup_join(big, lookup, ["key"])
    bound = lookup_join(big, lookup, ["key"], rows_at_most=51)
    assert free.count() == bound.count() == big.count()
    assert sorted(map(str, free.select("id", "v").collect())) == sorted(map(str, bound.select("id", "v").collect()))


def test_rows_without_lookup_key_are_kept(spark):
    """Half the rows on one host, half without a certificate host or without a url."""
    rows = [(i, "https://hot.example.com/a" if i % 2 else ("http://hot.example.com/b" if i % 4 else None)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, url string")
    reg = spark.createDataFrame([("example.com", "2020-01-01", "2030-01-01")], "domain string, creation_date string, expiration_date string")
    certs = C.certificate_snapshot(spark, SF_SMALL)
    out = url_features(df, registry=reg, certificates=certs, as_of=C.as_of()).collect()
    assert len(out) == 400 and sum(r.error is not None for r in out) == 100
    assert {r.domain_age_days for r in out if r.error is None} == {1827.0}


def test_registry_dates_as_text_lists_and_ties(spark):
    from hookline.operators.enrich import registry_features
    keys = spark.createDataFrame([("a.b.example.com",), ("x.org",)], "registry_key string")
    text = spark.createDataFrame([("example.com", ["2024-12-01", "2001-01-01"], ["2026-01-01"]), ("example.com", ["2024-12-02"], ["2027-01-01"]),
                                  ("x.org", ["bad"], None)], "domain string, creation_date array<string>, expiration_date array<string>")
    got = {r.registry_key: (r.domain_age_days, r.domain_registration_length) for r in registry_features(keys, text, C.as_of()).collect()}
    assert got == {"a.b.example.com": (31.0, 396.0), "x.org": (None, None)}


def test_rank_with_dominant_group(spark):
    df = _skewed(spark).withColumn("g", F.when(F.col("key") == "hot", "hot").otherwise("rest"))
    got = {r.id: r.rank for r in rank_within(df, ["g"], ["id"], partitions=5).collect()}
    hot = sorted(i for i in range(3000) if i % 3 == 0)
    rest = sorted(i for i in range(3000) if i % 3 != 0)
    assert [got[i] for i in hot] == list(range(1, len(hot) + 1))
    assert [got[i] for i in rest] == list(range(1, len(rest) + 1))


def test_events_of_one_file_are_dealt_out(spark):
    """One row group is one task; the work on each url is not left to it."""
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "1b")
    try:
        rows = C.url_events(spark, SF_SMALL)
        tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.set(key, before)
    total = sum(r.n for r in tasks)
    assert total == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert len(tasks) > 1 and max(r.n for r in tasks) < 0.6 * total
