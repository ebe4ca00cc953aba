"""The given tables and files, as the queries and the pipeline read them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from hookline.session import ensure_checkpoint_dir
from hookline.sources.tables import read_table


def vocabulary() -> str:
    """Path of the packing vocabulary (installed beside the tokenizers, never copied)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Python workers find this package where the driver does (elsewhere it is shipped with the job)."""
    ensure_checkpoint_dir(spark)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return read_table(spark, sf_dir, name)
