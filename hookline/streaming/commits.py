"""A sink of micro-batches that readers see whole, once, or not at all.

A batch is written to a folder of its own attempt; then one small file names the
attempt as the batch's result. That file appears by a rename, so it is there or
not. Readers join the data with these files. A batch that broke after its data
were written leaves an attempt nobody names, and its retry names another; a
batch that is run again after its commit does nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears at once; one that is there already stays."""
    draft, fs = _path(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, _path(spark, path)[0]):
        fs.delete(draft, False)


@dataclass(frozen=True)
class CommittedSink:
    path: str

    def committed(self, spark: SparkSession, batch_id: int) -> bool:
        return exists(spark, f"{self.path}/commits/{batch_id}.json")

    def write(self, batch: DataFrame, batch_id: int, **facts) -> None:
        """Write one batch and commit it, with some facts of it (numbers or texts)."""
        spark = batch.sparkSession
        if self.committed(spark, batch_id):
            return
        attempt = f"a-{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.path}/data/batch_id={batch_id}/attempt={attempt}")
        publish(spark, f"{self.path}/commits/{batch_id}.json", json.dumps({"batch_id": batch_id, "attempt": attempt, **facts}))

    def commits(self, spark: SparkSession, facts: str = "") -> DataFrame:
        """(batch_id, attempt, ...facts): a row a committed batch; ``facts`` is their schema."""
        schema = "batch_id long, attempt string" + (f", {facts}" if facts else "")
        if not exists(spark, f"{self.path}/commits"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).json(f"{self.path}/commits")

    def read(self, spark: SparkSession, schema=None) -> DataFrame:
        """The rows of the committed batches; ``schema`` tells the columns of a sink that may be empty."""
        if not exists(spark, f"{self.path}/commits"):
            if schema is None:
                raise FileNotFoundError(f"no batch is committed in {self.path}")
            return spark.createDataFrame([], schema)
        data = spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        return data.join(self.commits(spark), ["batch_id", "attempt"], "left_semi").drop("batch_id", "attempt")
