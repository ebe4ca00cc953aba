"""The registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or tables Spark derives from them),
so its work grows with the scale factor. Companion DuckDB SQL lives in
``hookline.plans.oracle`` and ``oracle_more``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookline.fixed import FEATURE_COLUMNS
from hookline.functions.url import with_parsed
from hookline.operators.features import LOCAL_COLUMNS, PARSED_FIELDS, local_features, url_features
from hookline.sources import corpus as C

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        _REGISTRY[name] = fn
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    # import modules that register more queries
    from hookline.plans import catalog_io, catalog_ml, catalog_more  # noqa: F401
    return dict(_REGISTRY)


# --- shared building blocks ----------------------------------------------------

def corpus_local(spark: SparkSession, sf: str, keep_parsed: bool = False) -> DataFrame:
    return local_features(C.url_corpus(spark, sf), keep_parsed=keep_parsed)


def corpus_features(spark: SparkSession, sf: str, registry: bool = True,
                    certificates: bool = True) -> DataFrame:
    """url_corpus -> 32 features (+closest_brand, error), with J1/J2 snapshots."""
    base = C.url_corpus(spark, sf).select("id", "url", "label")
    reg = C.registry_snapshot(spark, sf) if registry else None
    certs = C.certificate_snapshot(spark, sf) if certificates else None
    return url_features(base, registry=reg, certificates=certs, as_of=C.as_of())


# --- F0-F27 -----------------------------------------------------------------------

@query("url_parse")
def url_parse(spark, sf):
    parsed = with_parsed(C.url_corpus(spark, sf).select("id", "url"))
    return parsed.select("id", "url", *[F.col(f"p.{f}").alias(f) for f in PARSED_FIELDS],
                         F.col("p.error").alias("error"))


def _local_subset(cols):
    def fn(spark, sf):
        return corpus_local(spark, sf).select("id", *cols)
    return fn


LENGTH_COLS = ["url_length", "domain_length", "path_length"]
CHAR_COLS = ["at_count", "double_slash_count", "dash_count", "dot_count", "underscore_count",
             "question_count", "equal_count", "ampersand_count", "exclamation_count",
             "space_count", "tilde_count", "comma_count", "plus_count", "asterisk_count",
             "hash_count", "dollar_count", "percent_count"]
HTTPS_COLS = ["has_https", "https_in_domain"]
IP_COLS = ["has_ip_address", "ip_in_url"]
SUBDOMAIN_COLS = ["num_subdomains", "has_www"]
TYPO_COLS = ["levenshtein_distance", "normalized_levenshtein", "typosquatting_score", "closest_brand"]

query("url_lengths")(_local_subset(LENGTH_COLS))
query("url_char_counts")(_local_subset(CHAR_COLS))
query("url_https")(_local_subset(HTTPS_COLS))
query("url_ip")(_local_subset(IP_COLS))
query("url_subdomains")(_local_subset(SUBDOMAIN_COLS))


@query("typosquat_nearest_brand")
def typosquat_nearest_brand(spark, sf):
    return corpus_local(spark, sf, keep_parsed=True).select(
        "id", F.col("p.main_label").alias("main_label"), *TYPO_COLS)


# --- F39-F41, J1, J2 ----------------------------------------------------------------

@query("url_features_local")
def url_features_local(spark, sf):
    return corpus_local(spark, sf).select("id", *LOCAL_COLUMNS, "closest_brand", "error")


@query("url_features_full")
def url_features_full(spark, sf):
    return corpus_features(spark, sf).select("id", *FEATURE_COLUMNS, "closest_brand", "error")


@query("url_features_no_registry")
def url_features_no_registry(spark, sf):
    return corpus_features(spark, sf, registry=False).select(
        "id", *FEATURE_COLUMNS, "closest_brand", "error")


@query("domain_registry_join")
def domain_registry_join(spark, sf):
    return corpus_features(spark, sf, certificates=False).select(
        "id", "domain_age_days", "domain_registration_length")


@query("certificate_join")
def certificate_join(spark, sf):
    return corpus_features(spark, sf, registry=False).select("id", "has_https", "has_valid_ssl")
