"""A corpus-cleaning pipeline over ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before
kept, and works on all of it; all but the last return the columns of
``documents``. ``run`` applies them in order, writing each stage's result as
Parquet under the shared scratch folder and reading it again, so that a lost
executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookline.llm import line_dedup, mixing, ngram_join, packing, toxicity
from hookline.llm.catalog_tables import table, vocabulary
from hookline.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What an Arrow batch holds at most; Spark's own limits (10,000 rows, 64 MB) let the text of one batch stand in the JVM and in Python for each core.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Python workers get few megabytes at a time. A stage's plan runs after the stage returned, so this stays set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    small_batches(spark)
    lexicon = toxicity.fit_lexicon(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, lexicon)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; so do documents that have no line left of those they had."""
    done = line_dedup.deduplicate_lines(docs)
    kept = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]") | F.col("text").isNull())
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return kept.select(*[length.alias(c) if c == "n_chars" else c for c in docs.columns])


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    small_batches(spark)
    return ngram_join.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the target source, language and topic weights."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences; one row per piece."""
    small_batches(spark)
    return packing.packed_pieces(docs, vocabulary(), keep_cache=False, slice_bytes=BATCH_BYTES)  # the workers serve the other stages too


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL for the fitted lexicon, the tokenizer and the packing; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
