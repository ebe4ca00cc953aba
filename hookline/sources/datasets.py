"""Labelled-data sources S1-S7 and the feature-table assembly around them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from hookline.fixed import (FEATURE_COLUMNS, RANDOM_SEED, SAMPLE_LEGITIMATE_URLS, SAMPLE_PHISHING_URLS,
                            UCI_TARGET_NAMES)
from hookline.functions.labels import custom_label, uci_label
from hookline.functions.url import py_strip
from hookline.operators.joins import lookup_join
from hookline.operators.ranking import rank_within


def pick_target(columns: list[str]) -> str:
    """``Result``, else ``class``, else the last column."""
    for name in UCI_TARGET_NAMES:
        if name in columns:
            return name
    return columns[-1]


def load_uci(spark: SparkSession, path: str, positive=None) -> DataFrame:
    """UCI-style CSV (header) or ARFF -> feature columns + ``label``.

    ``positive=None`` keeps the reference label map (1 and -1 both -> 1).
    """
    df = read_arff(spark, path) if path.endswith(".arff") else \
        spark.read.csv(path, header=True, inferSchema=True)
    target = pick_target(df.columns)
    dtype = df.schema[target].dataType
    feats = [c for c in df.columns if c != target]
    return df.select(*feats, uci_label(F.col(target), dtype, positive).alias("label"))


# @attribute <name> <type>; the name may be quoted and contain spaces
_ARFF_ATTRIBUTE = re.compile(r"""(?i)@attribute\s+(?:'([^']*)'|"([^"]*)"|(\S+))\s+(.*)$""")


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF -> DataFrame. Only the ``@attribute`` lines (the schema) reach the driver;
    data lines are parsed by ``from_csv`` on the executors."""
    lines = spark.read.text(path)
    header = (lines.where(F.lower(F.trim("value")).startswith("@attribute"))
              .select("value").collect())
    fields = []
    for row in header:
        m = _ARFF_ATTRIBUTE.match(row.value.strip())
        if not m:
            raise ValueError(f"bad ARFF attribute line: {row.value!r}")
        name = next(g for g in m.group(1, 2, 3) if g is not None)
        kind = m.group(4).strip().lower()
        numeric = kind in ("numeric", "real", "integer")
        fields.append(StructField(name, DoubleType() if numeric else StringType()))
    schema = StructType(fields)
    body = lines.where(~F.trim("value").startswith("@") & ~F.trim("value").startswith("%")
                       & (F.trim("value") != ""))
    ddl = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString())
                    for f in schema.fields)
    parsed = body.select(F.from_csv(F.col("value"), ddl,
                                    {"quote": "'", "ignoreLeadingWhiteSpace": "true"}).alias("r"))
    return parsed.select("r.*")


def load_custom(spark: SparkSession, path: str, url_column: str = "url",
                label_column: str = "label") -> DataFrame:
    """S3: CSV with a url and a label column, read as strings -> (url, label)."""
    df = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    check_columns(df, [url_column, label_column])
    url = F.coalesce(F.col(url_column), F.lit("nan"))
    return df.select(url.alias("url"), custom_label(F.col(label_column)).alias("label"))


def write_custom(df: DataFrame, path: str, url_column: str = "url", label_column: str = "label") -> None:
    """A labelled dataset as CSV with a header, so that :func:`load_custom` reads the same texts."""
    (df.select(F.col(url_column), F.col(label_column)).write.mode("overwrite")
     .csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))


def load_training(spark: SparkSession, path: str, url_column: str = "url", label_column: str = "label", **lookups) -> DataFrame:
    """S3 as one call: labelled CSV -> (url, label, the 32 features), zeros where a url can't be read.

    ``lookups`` are those of :func:`hookline.operators.features.url_features`.
    """
    from hookline.operators.features import url_features
    feats = url_features(load_custom(spark, path, url_column, label_column), **lookups)
    return feats.select("url", "label", *[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in feats.dtypes if c in FEATURE_COLUMNS])


def write_uci(df: DataFrame, path: str) -> None:
    """A numeric table as CSV, or as ARFF if the path ends so (header and data are files of one folder)."""
    if not path.endswith(".arff"):
        df.write.mode("overwrite").csv(path, header=True)
        return
    header = ["% written by Spark", "@relation urls", *[f"@attribute '{c}' numeric" for c in df.columns], "@data"]
    df.sparkSession.createDataFrame([("\n".join(header),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in df.columns]).alias("value")).write.mode("append").text(path)


def write_url_list(df: DataFrame, path: str, url_column: str = "url") -> None:
    """One url per line; rows without a url are left out."""
    df.where(F.col(url_column).isNotNull()).select(F.col(url_column).alias("value")).write.mode("overwrite").text(path)


def check_columns(df: DataFrame, required: list[str]) -> None:
    """Fail before any job when a required column is missing."""
    for name in required:
        if name not in df.columns:
            raise ValueError(f"column '{name}' not found in dataset")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One url per line, stripped, blank lines dropped."""
    url = py_strip(F.col("value"))
    return spark.read.text(path).select(url.alias("url")).where(F.col("url") != "")


def sample_dataset_from_pools(spark: SparkSession, legit: DataFrame, phish: DataFrame,
                              n_samples: int) -> DataFrame:
    """Each pool (id, url) repeated in id order and cut to
    ``n_samples // 2`` rows; legitimate rows first (row_idx), then phishing."""
    half = n_samples // 2
    pools = (legit.select("id", "url", F.lit("legitimate").alias("label"))
             .unionByName(phish.select("id", "url", F.lit("phishing").alias("label"))))
    pools = rank_within(pools, ["label"], ["id"], "_pos")
    sizes = pools.groupBy("label").agg(F.count(F.lit(1)).alias("_size"))  # <= 2 rows
    kinds = F.explode(F.array(F.lit("legitimate"), F.lit("phishing")))
    targets = (spark.range(half).select(F.col("id").alias("i"), kinds.alias("label"))
               .join(F.broadcast(sizes), "label")
               .withColumn("_pos", F.pmod(F.col("i"), F.col("_size")) + 1))
    out = lookup_join(targets, pools.select("label", "_pos", "url"), ["label", "_pos"], "inner")
    row_idx = F.when(F.col("label") == "legitimate", F.col("i")).otherwise(F.col("i") + half)
    return out.select(row_idx.alias("row_idx"), "url", "label")


def sample_dataset(spark: SparkSession, n_samples: int = 100) -> DataFrame:
    """S5 with the fixed seed pools."""
    legit = spark.createDataFrame(list(enumerate(SAMPLE_LEGITIMATE_URLS)), "id long, url string")
    phish = spark.createDataFrame(list(enumerate(SAMPLE_PHISHING_URLS)), "id long, url string")
    return sample_dataset_from_pools(spark, legit, phish, n_samples)


def synthetic_numeric(spark: SparkSession, n: int = 1000, n_features: int = 30,
                      seed: int = RANDOM_SEED, names: list[str] | None = None) -> DataFrame:
    """Standard-normal columns; label 1 if f0>0.5 or f1>1.0 or f7<-0.5 or f23<-0.5."""
    names = names or [f"feature_{i}" for i in range(n_features)]
    base = spark.range(n)
    cols = [F.randn(seed + i).alias(nm) for i, nm in enumerate(names)]
    df = base.select("id", *cols)
    c = [F.col(nm) for nm in names]
    label = F.when((c[0] > 0.5) | (c[1] > 1.0) | (c[7] < -0.5) | (c[23] < -0.5), 1).otherwise(0)
    return df.withColumn("label", label)
