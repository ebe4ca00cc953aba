"""Sources: CSV/ARFF/url list loaders, sample dataset, label maps."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from hookline.fixed import SAMPLE_LEGITIMATE_URLS, SAMPLE_PHISHING_URLS
from hookline.functions.labels import custom_label, uci_label
from hookline.sources import datasets as D


def test_custom_label_map(spark):
    vals = ["phishing", "PHISHING", "1", "malicious", "bad", "true", " phishing", "1.0", "legit", None]
    df = spark.createDataFrame([(v,) for v in vals], "label string")
    got = [r[0] for r in df.select(custom_label(F.col("label"))).collect()]
    assert got == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0]


def test_uci_label_map(spark):
    df = spark.createDataFrame([(1,), (-1,), (0,)], "t int")
    assert [r[0] for r in df.select(uci_label(F.col("t"), IntegerType())).collect()] == [1, 1, 0]
    assert [r[0] for r in df.select(uci_label(F.col("t"), IntegerType(), 1)).collect()] == [1, 0, 0]
    s = spark.createDataFrame([("1",), ("-1",), ("phishing",), ("1.0",)], "t string")
    assert [r[0] for r in s.select(uci_label(F.col("t"), StringType())).collect()] == [1, 1, 1, 0]


def test_load_custom_and_missing_column(spark, tmp_path):
    p = tmp_path / "urls.csv"
    p.write_text("url,label\nhttp://a.com,phishing\nhttp://b.com,legitimate\n,bad\n")
    df = D.load_custom(spark, str(p))
    assert [tuple(r) for r in df.collect()] == [("http://a.com", 1), ("http://b.com", 0), ("nan", 1)]
    with pytest.raises(ValueError):
        D.load_custom(spark, str(p), url_column="link")


def test_load_uci_csv_and_arff(spark, tmp_path):
    c = tmp_path / "d.csv"
    c.write_text("a,b,Result\n1,-1,1\n0,1,-1\n1,1,0\n")
    df = D.load_uci(spark, str(c))
    assert df.columns == ["a", "b", "label"]
    assert [r.label for r in df.collect()] == [1, 1, 0]
    a = tmp_path / "d.arff"
    a.write_text("% comment\n@relation x\n@attribute f1 numeric\n@attribute class {-1,1}\n@data\n1,-1\n0,1\n\n")
    df = D.load_uci(spark, str(a))
    assert df.columns == ["f1", "label"] and [r.label for r in df.collect()] == [1, 1]
    assert D.pick_target(["x", "y"]) == "y"


def test_url_list_reader(spark, tmp_path):
    p = tmp_path / "u.txt"
    p.write_text("  http://a.com \n\n\t\nhttp://b.com\n")
    assert [r.url for r in D.read_url_list(spark, str(p)).collect()] == ["http://a.com", "http://b.com"]


def test_sample_dataset_repeats_pools_in_order(spark):
    rows = D.sample_dataset(spark, 100).orderBy("row_idx").collect()
    legit = (SAMPLE_LEGITIMATE_URLS * 3)[:50]
    phish = (SAMPLE_PHISHING_URLS * 4)[:50]
    assert [r.url for r in rows] == legit + phish
    assert [r.label for r in rows] == ["legitimate"] * 50 + ["phishing"] * 50


def test_synthetic_numeric(spark):
    df = D.synthetic_numeric(spark, 200)
    assert len(df.columns) == 32 and df.count() == 200
    assert df.where("label = 1").count() > 0


def test_arff_quoted_names_and_nominal(spark, tmp_path):
    a = tmp_path / "q.arff"
    a.write_text("@RELATION r\n@ATTRIBUTE 'url length' NUMERIC\n@attribute kind {x,y}\n"
                 "@attribute Result {-1,1}\n@DATA\n3,x,1\n5,'y',-1\n")
    df = D.read_arff(spark, str(a))
    assert df.columns == ["url length", "kind", "Result"]
    assert [tuple(r) for r in df.collect()] == [(3.0, "x", "1"), (5.0, "y", "-1")]


def test_py_strip_matches_python(spark):
    from pyspark.sql import functions as F
    from hookline.functions.url import py_strip
    samples = [" a ", "\t\n\x0b\x0c\r\x1c\x1fb\x85\xa0", " c　", "​d", " ", "", "e f"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(py_strip(F.col("s"))).collect()]
    assert got == [s.strip() for s in samples]


def test_queries_read_the_given_table_each_time(spark, tmp_path):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert E.queries()["url_lengths"](spark, str(tmp_path)).count() == 50
    pages.selectExpr("page_id + 50 AS page_id", "url", "html").write.mode("append").parquet(f"{tmp_path}/pages.parquet")
    assert E.queries()["url_lengths"](spark, str(tmp_path)).count() == 100


def test_null_labels_fail_the_split(spark):
    import pytest
    from hookline.operators.splits import stratified_split
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id long, label int")
    with pytest.raises(Exception, match="no label"):
        stratified_split(df).collect()


def test_unscored_rows_have_no_prediction(spark):
    from hookline.operators.scoring import evaluation_table
    df = spark.createDataFrame([("a", 0, None, None, "bad"), ("b", 1, True, 0.9, None)], "url string, label int, is_phishing boolean, confidence double, error string")
    got = {r.url: (r.predicted, r.match, r.error) for r in evaluation_table(df).collect()}
    assert got == {"a": (None, None, "bad"), "b": ("phishing", True, None)}
