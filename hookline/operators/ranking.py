"""Exact positions and running sums without a single-partition window.

A ``row_number() over (partition by label order by ...)`` sends each label to
one task; with two labels that is two tasks for the whole table. Instead the
rows are range-partitioned on (group, order) into many sorted partitions,
each row's position inside its partition comes from
``monotonically_increasing_id`` (partition index in the upper bits, row
index in the lower 33), and a tiny per-(partition, group) count table gives
the offset of each partition. That table has at most
``partitions x groups`` rows, so broadcasting it is bounded.

The positioned rows are written as a table to the shared checkpoint folder before
they are used twice (for the counts and for the rows themselves): the
upstream plan runs once, and a task retried after an executor loss reads
the same positions instead of recomputing them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hookline.session import materialize

_LOW_BITS = (1 << 33) - 1


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                rank_col: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds the 1-based position of each row inside its group, ordered by
    ``order_cols`` (which must include a unique tiebreak for a total order)."""
    keys = [*group_cols, *order_cols]
    n = _partitions(df, partitions)
    pos = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
           .withColumn("_rk_mid", F.monotonically_increasing_id())
           .withColumn("_rk_pid", F.shiftrightunsigned("_rk_mid", 33))
           .withColumn("_rk_pos", F.col("_rk_mid").bitwiseAND(F.lit(_LOW_BITS))))
    pos = materialize(pos, "rank")
    stats = pos.groupBy("_rk_pid", *group_cols).agg(
        F.count(F.lit(1)).alias("_rk_cnt"), F.min("_rk_pos").alias("_rk_first"))
    before = Window.partitionBy(*group_cols).orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_rk_before", F.coalesce(F.sum("_rk_cnt").over(before), F.lit(0)))
    # at most partitions x groups rows; Spark broadcasts it if it is small
    # groups are compared null-safe, so rows of a null group keep their rank
    joined = _null_safe(pos, stats.select("_rk_pid", *group_cols, "_rk_before", "_rk_first"),
                         ["_rk_pid", *group_cols])
    return (joined.withColumn(rank_col, F.col("_rk_before") + F.col("_rk_pos") - F.col("_rk_first") + 1)
            .drop("_rk_mid", "_rk_pid", "_rk_pos", "_rk_before", "_rk_first"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join where null keys are equal."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"_r_{k}"])
    return left.join(named, on).drop(*[f"_r_{k}" for k in keys])


def running_sums(df: DataFrame, order_col: str, value_cols: list[str], suffix: str = "_before",
                 partitions: int | None = None) -> DataFrame:
    """Adds, per row, the sum of each value column over all rows with a smaller
    ``order_col`` (a global exclusive prefix sum; ``order_col`` unique)."""
    n = _partitions(df, partitions)
    part = materialize(df.repartitionByRange(n, order_col)
                       .withColumn("_rk_pid", F.spark_partition_id()), "prefix")
    totals = part.groupBy("_rk_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    w_tot = Window.orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_rk_pid", *[F.coalesce(F.sum(f"_t_{c}").over(w_tot), F.lit(0)).alias(f"_o_{c}")
                                      for c in value_cols])
    w_in = Window.partitionBy("_rk_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    inner = part.select("*", *[F.coalesce(F.sum(c).over(w_in), F.lit(0)).alias(f"_i_{c}") for c in value_cols])
    out = inner.join(F.broadcast(offsets), "_rk_pid")
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_i_{c}")).alias(c + suffix)
                                     for c in value_cols])
