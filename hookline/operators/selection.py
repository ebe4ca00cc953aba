"""Order statistics per class, by digit histograms: no sort, no window over rows, nothing written.

A key is a text of hex digits whose text order is the wanted order. To find the
k-th smallest key of a class, the keys are counted by their first digits (a
partial aggregation: at most 65,536 numbers a class and task); the digits at
which the running count reaches k start the answer, and the next pass counts
only keys that start so. A pass ends the search where all remaining keys of
that start belong below the cut. n keys take about log(n) / log(65,536) passes
over the key columns.

The driver sees the cuts alone: a few texts a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

DIGITS = 4
ABOVE = "g"  # sorts after every hex digit


def integer_key(c: Column) -> Column:
    """16 hex digits in the order of a whole number, negative ones first."""
    return F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def class_cuts(df: DataFrame, label: str, key: Column, ranks: dict[object, list[int]], width: int) -> DataFrame:
    """(label, cuts): for each rank k of a class the text that exactly its k smallest keys sort before.

    Keys have ``width`` digits. Rows with equal keys fall on the same side of a cut.
    """
    spark = df.sparkSession
    kind = df.schema[label].dataType
    cuts = {lab: ["" if k <= 0 else None for k in ks] for lab, ks in ranks.items()}
    open_ = [(lab, j, "", k) for lab, ks in ranks.items() for j, k in enumerate(ks) if k > 0]
    state = StructType([StructField("_lab", kind), StructField("_cut", IntegerType()), StructField("_start", StringType()), StructField("_need", LongType())])
    rows = df.select(F.col(label).alias("_label"), key.alias("_key"))
    done = 0
    while open_:
        wanted = spark.createDataFrame(open_, state)  # a row for each class and cut
        met = rows.join(F.broadcast(wanted), (F.col("_label") == F.col("_lab")) & F.col("_key").startswith(F.col("_start")))
        counts = met.groupBy("_lab", "_cut", "_need", F.substring("_key", done + 1, DIGITS).alias("_next")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_lab", "_cut").orderBy("_next"))  # over at most 65,536 rows
        here = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
        found = {(r["_lab"], r["_cut"]): r for r in here.collect()}
        done += DIGITS
        left = []
        for lab, j, start, need in open_:
            r = found.get((lab, j))
            if r is None:  # the class has fewer keys
                cuts[lab][j] = start + ABOVE
                continue
            rest = need - (r["_upto"] - r["_n"])
            if rest == r["_n"] or done >= width:
                cuts[lab][j] = start + r["_next"] + ABOVE
            else:
                left.append((lab, j, start + r["_next"], rest))
        open_ = left
    return spark.createDataFrame(list(cuts.items()), StructType([StructField(label, kind), StructField("_cuts", ArrayType(StringType()))]))


def cuts_passed(key: Column) -> Column:
    """How many of a row's ``_cuts`` its key reaches."""
    return F.size(F.filter("_cuts", lambda c: c <= key))
