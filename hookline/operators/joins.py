"""Join helper: broadcast behind a known bound, else a join that Spark may split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


def lookup_join(big: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left",
                max_broadcast_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS,
                rows_at_most: int | None = None) -> DataFrame:
    """Join a large, possibly skewed table to a lookup with unique keys.

    The lookup is broadcast if the caller knows a bound (``rows_at_most``) that
    is small enough. Otherwise Spark decides from the sizes it measures at run
    time: a small lookup is broadcast, a large one is sort-merge joined and the
    partitions of a key that holds very many rows are split (adaptive skew join).
    Nothing is counted while planning.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup_join supports left and inner joins")
    if rows_at_most is not None and max_broadcast_rows is not None and rows_at_most <= max_broadcast_rows:
        return big.join(F.broadcast(lookup), keys, how)
    return big.join(lookup, keys, how)
