"""Sinks S10-S12 and request bodies.

Results are written by the executors (``df.write``); nothing is gathered on
the driver. Request bodies are JSON lines like ``{"url": ...}`` or
``{"urls": [...]}``; bodies that lack the field or hold something else
become rows with an ``error`` instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookline.fixed import FEATURE_COLUMNS


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metrics or batch results as JSON lines."""
    df.write.mode(mode).json(path)


def features_json(df: DataFrame, key_cols: list[str], feature_cols: list[str] | None = None) -> DataFrame:
    """One JSON feature record per row (``features`` STRING)."""
    cols = feature_cols or FEATURE_COLUMNS + ["closest_brand"]
    return df.select(*key_cols, F.to_json(F.struct(*cols)).alias("features"))


def whole_json(body: Column) -> Column:
    """The body as a VARIANT; null if it is not one JSON value from end to end (the parser itself overlooks what follows a value)."""
    in_list = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"a":'), body, F.lit("}")))
    return F.when((F.size(in_list) == 1) & in_object.isNotNull(), F.get(in_list, F.lit(0)))


def parse_requests(bodies: DataFrame, body_col: str = "body", id_col: str = "request_id", batch_col: str | None = None) -> DataFrame:
    """JSON bodies -> one row per url (request id, pos, url, error), with ``error`` where the url can't be used.

    A body is read as a VARIANT, so its fields keep their types. ``batch_col``
    tells the requests that send a list; without it a body with ``urls`` but no ``url``
    is one. Text that is not JSON (nor are repeated keys), a missing field and
    ``urls`` of any type but a list make one error row; an item that is no
    text is an error of its own row; an empty list asks for nothing and gives no row.
    """
    v = whole_json(F.col(body_col))
    read = bodies.select(id_col, v.alias("v"), F.try_variant_get(v, "$.url", "variant").alias("one"), F.try_variant_get(v, "$.urls", "variant").alias("many"),
                         (F.lit(None) if batch_col is None else F.col(batch_col)).cast("boolean").alias("batch"))
    batch = F.coalesce("batch", F.col("many").isNotNull() & F.col("one").isNull())
    is_list = F.schema_of_variant("many").startswith("ARRAY<")
    missing = F.concat(F.lit("Missing required field: "), F.when(batch, "urls").otherwise("url"))
    error = (F.when(F.col("v").isNull(), "Invalid JSON").when(F.when(batch, F.col("many").isNull()).otherwise(F.col("one").isNull()), missing)
             .when(batch & ~is_list, "urls must be a list"))
    items = F.when(~batch, F.array("one")).otherwise(F.try_variant_get("many", "$", "array<variant>"))
    found = read.select(id_col, error.alias("error"), F.posexplode(F.when(error.isNull(), items).otherwise(F.array(F.lit(None).cast("variant")))).alias("pos", "item"))
    is_text = F.schema_of_variant("item") == "STRING"
    return found.select(id_col, "pos", F.when(is_text, F.try_variant_get("item", "$", "string")).alias("url"),
                        F.coalesce("error", F.when(~F.coalesce(is_text, F.lit(False)), "url must be a string")).alias("error"))
