"""Content job (F34-F38) over stored pages and its join to URL rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookline.fixed import CONTENT_COLUMNS
from hookline.functions.html import content_columns, wanted_tags
from hookline.functions.url import once, with_parsed


def page_content(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Adds the five content features; external = not under the page's netloc."""
    netloc = F.col("_page.netloc")
    cols = content_columns(F.col(html_col), F.coalesce(netloc, F.lit("")), F.col("_tags"))
    tagged = with_parsed(pages, url_col, "_page").withColumn("_tags", once(wanted_tags(F.col(html_col))))  # five columns read the tags
    return tagged.select(*pages.columns, *[c.alias(n) for n, c in cols])


def content_by_url(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One content record per url (the page with the smallest id wins); only the winners' html is read by the tag patterns."""
    first = pages.where(F.col("url").isNotNull()).groupBy("url").agg(F.min(id_col).alias(id_col))
    winners = pages.join(first, ["url", id_col], "left_semi").dropDuplicates(["url", id_col])
    return page_content(winners).select("url", *CONTENT_COLUMNS)


def with_content(df: DataFrame, pages: DataFrame) -> DataFrame:
    """Left join the per-url content record; no page -> 0.0 (fetch failed)."""
    wanted = df.select("url").where(F.col("url").isNotNull()).distinct()
    lookup = content_by_url(pages.join(wanted, "url", "left_semi"))
    joined = df.join(lookup, "url", "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in CONTENT_COLUMNS])
