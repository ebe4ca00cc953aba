"""Brand-distance columns (typosquatting features F30-F33).

For a bounded brand list the arg-min is computed per row from one array of
distances: no join, no shuffle, and the first brand in list order wins ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hookline.fixed import BRANDS

def nearest_brand(label, brands: list[str] | None = None) -> Column:
    """struct(distance INT, brand_idx INT, brand STRING) of the closest brand.

    The least (distance, number) is the first brand in list order with the least
    distance (the tie rule). Each row meets every
    brand: a brand *table* goes through ``operators.typosquat.nearest_brands``,
    which gives the same answer.
    """
    brands = BRANDS if brands is None else list(brands)
    if not brands:
        raise ValueError("brand list is empty")
    lab = F.col(label) if isinstance(label, str) else label
    # each distance is taken once, in code that does not grow with the list (very long methods are not compiled)
    each = F.transform(F.array(*[F.lit(b) for b in brands]), lambda b, i: F.struct(F.levenshtein(lab, b).alias("distance"), i.alias("brand_idx"), b.alias("brand")))
    return F.when(lab.isNotNull(), F.array_min(each))


def typosquat_columns(label_col: Column, best: Column) -> list[tuple[str, Column]]:
    """F30-F33 as (name, column) from the label and the nearest-brand struct."""
    d = best["distance"]
    n = F.length(label_col)
    return [
        ("levenshtein_distance", d.cast("double")),
        ("normalized_levenshtein", d.cast("double") / F.greatest(n, F.lit(1)).cast("double")),
        ("typosquatting_score", F.when((d <= 2) & (n > 3), F.lit(1.0)).otherwise(F.lit(0.0))),
        ("closest_brand", best["brand"]),
    ]
