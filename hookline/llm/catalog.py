"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hookline.llm import ann, chat_format, conversation_repair, fingerprints, html_extract, line_dedup, mixing, ngram_join, packing, pii, prefix_trie, substring_dedup, toxicity
from hookline.llm.catalog_tables import table, vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(documents(spark, sf_dir), vocabulary())


def ngram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def line_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicate_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def ann_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_summary(documents(spark, sf_dir))


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(documents(spark, sf_dir))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit_lexicon(docs, table(spark, sf_dir, "labels")))


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_digests(table(spark, sf_dir, "conversations"))


def repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(table(spark, sf_dir, "conversations"))


def trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def pipeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents(spark, sf_dir)
    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": substring_query,
        "op2_packing": packing_query,
        "op3_ngram_join": ngram_query,
        "op4_fingerprints": fingerprint_query,
        "op5_line_dedup": line_query,
        "op6_nearest_neighbours": ann_query,
        "op7_pii": pii_query,
        "op8_html_extraction": html_query,
        "op9_mixing": mixing_query,
        "op10_toxicity": toxicity_query,
        "op11_chat_formatting": chat_query,
        "op12_conversation_repair": repair_query,
        "op13_prefix_trie": trie_query,
        "pipeline": pipeline_query,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": line_dedup.line_dedup_sql(),
        "op9_mixing": mixing.mixing_sql(),
        "op11_chat_formatting": chat_format.format_sql(),
        "op13_prefix_trie": prefix_trie.trie_sql(),
    }
