"""Stratified splits and folds (D1-D3), exact per class and distributed.

Row order inside a class is ``md5(seed:id)`` (splits) or ``id`` (folds). The
class sizes say how many rows come before each cut; the cut itself is found
by distributed selection (:mod:`selection`) on (label, id) alone, and every row
is then placed by comparing its key with its class's cuts: no row is sorted,
moved or written. Rows with equal ids fall on the same side. Class allocation: the training share ``n - ceil(ratio*n)`` is spread
by largest remainder (ties to the smaller label), the rest is held out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hookline.fixed import RANDOM_SEED
from hookline.operators.selection import class_cuts, cuts_passed, integer_key

MD5_DIGITS = 32


def hash_order(id_col: str, seed: int = RANDOM_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def labelled(df: DataFrame, label: str) -> DataFrame:
    """``df``; the job fails on a row without a label instead of losing it."""
    missing = F.raise_error(F.lit(f"a row has no {label}")).cast(df.schema[label].dataType)
    return df.withColumn(label, F.when(F.col(label).isNull(), missing).otherwise(F.col(label)))


def _allocate(counts: DataFrame, label: str, n_col: str, ratio: float, out: str) -> DataFrame:
    """Per class: ``out`` = rows held out so that the kept rows follow the
    largest-remainder share of ``n - ceil(ratio * n)``."""
    whole = Window.partitionBy()
    c = counts.withColumn("_n_all", F.sum(n_col).over(whole))
    keep_total = F.col("_n_all") - F.ceil(F.lit(float(ratio)) * F.col("_n_all"))
    cont = F.col(n_col) / F.col("_n_all") * keep_total
    c = c.withColumn("_cont", cont).withColumn("_floor", F.floor("_cont"))
    c = c.withColumn("_need", keep_total - F.sum("_floor").over(whole))
    order = Window.orderBy(F.desc(F.col("_cont") - F.col("_floor")), F.col(label))
    c = c.withColumn("_r", F.row_number().over(order))
    keep = F.col("_floor") + F.when(F.col("_r") <= F.col("_need"), 1).otherwise(0)
    return c.select(label, n_col, (F.col(n_col) - keep).cast("bigint").alias(out))


def _rows_of(table: DataFrame, label: str) -> dict:
    """The rows of a table with one row a class, by class."""
    return {r[label]: r for r in table.collect()}


def split_cuts(df: DataFrame, label: str = "label", id_col: str = "id", ratio: float = 0.2, seed: int = RANDOM_SEED) -> DataFrame:
    """(label, cuts) of the stratified split of the rows ``df`` (label, id): the held-out rows are those before the cut."""
    df = labelled(df, label)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    alloc = _rows_of(_allocate(counts, label, "_n", ratio, "_hold"), label)
    return class_cuts(df, label, hash_order(id_col, seed), {lab: [r["_hold"]] for lab, r in alloc.items()}, MD5_DIGITS)


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "id",
                     ratio: float = 0.2, seed: int = RANDOM_SEED,
                     names: tuple[str, str] = ("train", "validation"), cuts: DataFrame | None = None) -> DataFrame:
    """Adds ``split`` = train / validation with exact per-class sizes.

    ``cuts`` may hold :func:`split_cuts` of the same rows, found on a narrower table.
    """
    df = labelled(df, label)
    cuts = split_cuts(df.select(label, id_col), label, id_col, ratio, seed) if cuts is None else cuts
    passed = cuts_passed(hash_order(id_col, seed))
    return df.join(cuts, label).withColumn("split", F.when(passed == 0, F.lit(names[1])).otherwise(F.lit(names[0]))).drop("_cuts")


def three_way_split(df: DataFrame, label: str = "label", id_col: str = "id",
                    train: float = 0.8, val: float = 0.1, test: float = 0.1,
                    seed: int = RANDOM_SEED) -> DataFrame:
    """Test first (``test`` of all), then validation = val/(train+val) of the rest."""
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("Ratios must sum to 1")
    df = labelled(df, label)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    a1 = _allocate(counts, label, "_n", test, "_test")
    rest = a1.select(label, (F.col("_n") - F.col("_test")).alias("_rest"), "_test")
    tests, vals = _rows_of(rest, label), _rows_of(_allocate(rest, label, "_rest", val / (train + val), "_val"), label)
    ranks = {lab: [r["_test"], r["_test"] + vals[lab]["_val"]] for lab, r in tests.items()}
    cuts = class_cuts(df.select(label, id_col), label, hash_order(id_col, seed), ranks, MD5_DIGITS)
    name = F.get(F.array(F.lit("test"), F.lit("validation"), F.lit("train")), cuts_passed(hash_order(id_col, seed)))
    return df.join(cuts, label).withColumn("split", name).drop("_cuts")


def stratified_folds(df: DataFrame, k: int = 5, label: str = "label", id_col: str = "id") -> DataFrame:
    """D3: unshuffled stratified k-fold, adds ``fold`` in 0..k-1; ids are whole numbers.

    Classes are taken in order of first appearance (smallest id); class c
    occupies positions [o, o+n) of the label-sorted order and fold i gets the
    positions p = i (mod k) of that block, handed out as contiguous runs in
    id order. ``fold`` = number of folds that end before the row.
    """
    df = labelled(df, label)
    cls = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_first"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    cls = cls.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ends = cls.select(label, F.array(*fold_ends(F.col("_n"), F.col("_o"), k)[:-1]).alias("_ends"))
    ranks = {lab: list(r["_ends"]) for lab, r in _rows_of(ends, label).items()}
    key = integer_key(F.col(id_col))
    cuts = class_cuts(df.select(label, id_col), label, key, ranks, 16)
    return df.join(cuts, label).withColumn("fold", cuts_passed(key)).drop("_cuts")


def fold_ends(n: Column, o: Column, k: int) -> list[Column]:
    """For each fold, how many rows of a class of ``n`` rows (after ``o`` of other classes) are in it or a fold before."""
    q = F.floor(n / k)
    m = n % k
    o2 = o % k

    def clamp(x, hi):
        return F.least(F.greatest(x, F.lit(0)), hi)

    ends = []
    for i in range(k):
        no_wrap = clamp(F.lit(i) - o2 + 1, m)
        wrap = clamp(F.lit(i) - o2 + 1, F.lit(k) - o2) + clamp(F.lit(i + 1), o2 + m - k)
        extra = F.when(o2 + m <= k, no_wrap).otherwise(wrap)
        ends.append((q * (i + 1) + extra).cast("long"))
    return ends
