"""J3 for large brand tables: labels within edit distance 2 of a brand.

Unrolling one ``levenshtein`` per brand per row only suits a short list
(``functions.brands``). For a brand *table*, both sides are expanded into
their deletion neighbourhoods (the string with up to two characters removed;
at most 1 + L + L(L-1)/2 variants). Labels longer than the longest brand by
more than two cannot match and are dropped first, so a label of any length
costs no more than that. Two strings
within distance 2 always share a variant, so an equi-join on the variant
finds every candidate exactly; candidates are then verified with
``levenshtein(a, b, 2)``. Labels and brands are deduplicated first, so a hot
host costs one lookup. :func:`search_nearest` answers the wider question, the
nearest brand at any distance, by an index of brand segments.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookline.session import materialize

MAX_DISTANCE = 2


def deletion_variants(s: Column) -> Column:
    """array_distinct of ``s`` with 0, 1 or 2 characters deleted."""
    n = F.length(s)

    def drop1(x: Column, i: Column) -> Column:
        return F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1))

    one = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: drop1(s, i))) \
        .otherwise(F.array().cast("array<string>"))
    two = F.when(n >= 2, F.flatten(F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.transform(F.sequence(i + 1, n), lambda j: drop1(drop1(s, j), i))))) \
        .otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(s), one, two))


def brand_matches(labels: DataFrame, brands: DataFrame, label_col: str = "main_label",
                  brand_col: str = "brand") -> DataFrame:
    """(label, brand, distance) for every pair with distance <= 2."""
    lab = labels.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
    br = brands.select(F.col(brand_col).alias("brand")).where(F.col("brand").isNotNull()).distinct()
    longest = br.agg(F.max(F.length("brand"))).scalar()
    lab = lab.where(F.length("label") <= longest + MAX_DISTANCE)
    lv = lab.select("label", F.explode(deletion_variants(F.col("label"))).alias("v"))
    bv = br.select("brand", F.explode(deletion_variants(F.col("brand"))).alias("v"))
    cands = (lv.join(bv, "v")
             .where(F.abs(F.length("label") - F.length("brand")) <= MAX_DISTANCE)
             .select("label", "brand").distinct())
    dist = F.levenshtein(F.col("label"), F.col("brand"), MAX_DISTANCE)
    return cands.withColumn("distance", dist).where(F.col("distance") >= 0)


def next_radius(radius: int) -> int:
    return radius + max(1, radius // 2)


#: A text that many brands hold where many labels have it is met in more detail (:func:`refined`); else the pairs number at most
#: FEW_BRANDS a text of a label, or FEW_LABELS a text of a brand, or FEW_PAIRS a label and brand.
FEW_BRANDS, FEW_LABELS, FEW_PAIRS = 256, 32, 8


def place(i: Column, start: Column, shift: Column, more: Column, budget: Column) -> Column:
    """May piece ``i``, at ``start`` in the brand's text, be the first whole one if it stands ``shift`` further in the label's text, longer by ``more``?

    The text before it needs at least ``|shift|`` edits, and one in each piece; the text after it ``|more - shift|``.
    """
    return (F.greatest(i, F.abs(shift)) + F.abs(more - shift) <= budget) & (start + shift >= 0)


def piece_bounds(m: Column, budget: Column, i: Column) -> tuple[Column, Column]:
    """(start, length) of piece ``i`` of a brand's text of ``m`` characters: the pieces are even, and depend on the length and the budget alone."""
    k = piece_count(m, budget)
    start = F.floor(i * m / k).cast("int")
    return start, F.floor((i + 1) * m / k).cast("int") - start


def piece_count(m: Column, budget: Column) -> Column:
    """Pieces of a brand's text of ``m`` characters: one more than there can be edits, none of them empty."""
    return F.least(m, budget + 1)


def with_bounds(df: DataFrame) -> DataFrame:
    """``df`` (m, budget) a row a piece: its number i, its start and length."""
    cut = df.where("m > 0").withColumn("i", F.explode(F.sequence(F.lit(0), piece_count(F.col("m"), F.col("budget")) - 1)))
    start, length = piece_bounds(F.col("m"), F.col("budget"), F.col("i"))
    return cut.withColumns({"start": start, "length": length})


def shifts(text: Column) -> Column:
    """Where a piece could stand in the label's ``text``, counted from its place in the brand's."""
    n, budget, start, length = F.length(text), F.col("budget"), F.col("start"), F.col("length")
    low, high = F.greatest(-budget, -start), F.least(budget, n - start - length)
    every = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda s: place(F.col("i"), start, s, n - F.col("m"), budget))


def brand_pieces(brands: DataFrame) -> DataFrame:
    """The pieces of the brands' texts (key, text, m, budget); the new ``key`` is of the old one, the piece's number and its text."""
    cut = with_bounds(brands)
    piece = F.substr("text", F.col("start") + 1, F.col("length"))
    return cut.withColumn("key", F.xxhash64("key", "i", piece))


def label_pieces(labels: DataFrame) -> DataFrame:
    """What the labels' texts (key, text, m, budget) have where a piece of a brand's text could stand, with the same keys, and the ``piece``."""
    cut = with_bounds(labels)
    found = F.array_distinct(F.transform(shifts(F.col("text")), lambda s: F.substr("text", F.col("start") + s + 1, F.col("length"))))
    return cut.withColumn("piece", F.explode(found)).withColumn("key", F.xxhash64("key", "i", "piece"))


def refined(rows: DataFrame, owner: list[str], start: Column) -> DataFrame:
    """Rows of a met piece (``more``, ``shift``: how it was met) with the text on one side of it, which stands at ``start`` in the row's own text.

    The edits before the piece leave a budget for those after it, and the other way
    round; the side that makes the longer pieces is met next, within its budget.
    ``last`` says that its pieces could all be touched: these rows are compared.
    """
    before, after = F.col("start"), F.col("m") - F.col("start") - F.col("length")
    left, right = F.col("budget") - F.abs(F.col("more") - F.col("shift")), F.col("budget") - F.greatest("i", F.abs(F.col("shift")))
    on_right = after * (left + 1) >= before * (right + 1)
    m, budget = F.when(on_right, after).otherwise(before), F.when(on_right, right).otherwise(left)
    text = F.when(on_right, F.substr("text", start + F.col("length") + 1)).otherwise(F.substr("text", F.lit(1), start))
    return rows.select(F.xxhash64("key", "more", "shift").alias("key"), text.alias("text"), m.alias("m"), budget.alias("budget"), *owner, (m <= budget).alias("last"))


def by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join of pieces on their key, never by a broadcast: Spark knows the size of the compressed files they are made from, and a row there makes many pieces."""
    return left.join(right.hint("merge"), "key")


def counted(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """The rows of ``labels`` that meet some of ``brands`` by their key, with the numbers of rows of both (a, b)."""
    sizes = by_key(labels.groupBy("key").agg(F.count(F.lit(1)).alias("a")), brands.groupBy("key").agg(F.count(F.lit(1)).alias("b")))
    return materialize(by_key(labels, sizes), "brand-met")


def meetings(labels: DataFrame, names: DataFrame, radius: int, few_pairs: int) -> tuple[DataFrame, int]:
    """(label, brand_idx, brand) of all pairs that may be within the radius, some of them more than once, and how many rows these are.

    Pairs meet on a whole piece. A piece that many have in common ("shop") says
    little, so there the texts beside it meet by their own pieces, and so on.
    """
    spark = names.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few small rows make many pairs, so the tasks stay apart
    spread = lambda rows: rows.repartition(tasks, "key")
    pairs, met = [], 0

    def join(some: DataFrame, brands: DataFrame) -> None:
        pairs.append(spread(brands.select("key", "brand_idx", "brand")).join(spread(some.select("key", "label")).hint("shuffle_hash"), "key").select("label", "brand_idx", "brand"))

    n = F.length("label")
    near = F.explode(F.filter("by_length.m", lambda m: F.abs(n - m) <= radius))
    budget, key = F.lit(radius).alias("budget"), F.xxhash64("m").alias("key")
    left = labels.select("label", near.alias("m")).select(key, F.col("label").alias("text"), "m", budget, "label")
    right = names.select(F.length("brand").alias("m"), "brand_idx", "brand").select(key, F.col("brand").alias("text"), "m", budget, "brand_idx", "brand")
    while True:
        right = brand_pieces(right)
        rows = counted(label_pieces(left), right)
        product = F.sum("b")
        crowd = (F.col("b") > FEW_BRANDS) & (F.col("a") > FEW_LABELS)
        seen = rows.agg(F.coalesce(product, F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(crowd, F.col("b"))), F.lit(0)).alias("crowd")).first()
        if seen["crowd"] <= few_pairs:
            join(rows, right)
            return reduce(DataFrame.unionByName, pairs), met + seen["all"]
        join(rows.where(~crowd), right)
        met += seen["all"] - seen["crowd"]
        where = rows.where(crowd).withColumns({"more": F.length("text") - F.col("m"), "shift": F.explode(shifts(F.col("text")))})
        where = where.where(F.substr("text", F.col("start") + F.col("shift") + 1, F.col("length")) == F.col("piece"))
        left = materialize(refined(where, ["label"], F.col("start") + F.col("shift")), "brand-labels-met")
        ways = where.select("key", "more", "shift").distinct()
        right = materialize(refined(by_key(right, ways), ["brand_idx", "brand"], F.col("start")), "brand-names-met")
        ends = counted(left.where("last"), right.where("last"))
        met += ends.agg(F.coalesce(product, F.lit(0))).first()[0]
        join(ends, right.where("last"))
        left, right = left.where("not last"), right.where("not last")


class NearestBrands(NamedTuple):
    """``matches`` (label, distance, brand), and for each round its radius, the labels still open before it, and the pairs verified."""

    matches: DataFrame
    rounds: list[tuple[int, int, int]]


def search_nearest(labels: DataFrame, brands: DataFrame, label_col: str = "main_label") -> NearestBrands:
    """The nearest brand of each distinct label, for a brand table (brand_idx, brand) of any size.

    Within distance r, a brand cut into r + 1 pieces keeps at least one of them
    whole, and not far from its place. So the pieces are an index (keyed by the
    brand's length, the piece's number and its text) that the label's substrings
    look up, and only brands met there are compared. Where many brands and many
    labels share a piece, as names made from one word do, the texts beside it are
    indexed in the same way with the edits that are left. The radius grows; labels
    whose best brand is within it are settled, the others go on. Where a brand
    has no more than r characters its pieces are single ones: a brand that
    shares none of them with the label is exactly max(lengths) away, so the first
    brand of each length stands in for these (which ends the search at the
    latest). Ties go to the smallest brand_idx.

    Each round is written to the shared folder; the driver sees three numbers a round.
    """
    spark = labels.sparkSession
    names = materialize(brands.where(F.col("brand").isNotNull()).groupBy("brand").agg(F.min("brand_idx").alias("brand_idx")), "brand-names")
    first = names.groupBy(F.length("brand").alias("m")).agg(F.min("brand_idx").alias("brand_idx"), F.min_by("brand", "brand_idx").alias("brand"))
    by_length = first.agg(F.sort_array(F.collect_list(F.struct("m", "brand_idx", "brand"))).alias("by_length")).scalar()  # a row per length that occurs
    distinct = labels.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
    open_ = materialize(distinct.select("label", by_length.alias("by_length")).where(F.size("by_length") > 0), "brand-labels")
    n = F.length("label")
    least_gap = F.min(F.array_min(F.transform("by_length.m", lambda m: F.abs(n - m))))
    settled, rounds, radius, n_names = [], [], 1, names.count()
    while (state := open_.agg(F.count(F.lit(1)).alias("labels"), least_gap.alias("gap")).first())["labels"]:
        radius = max(radius, state["gap"])  # nothing is nearer than the lengths allow
        # compared where they meet (a pair once for each piece it shares): only the best of a label moves on
        pairs, met = meetings(open_, names, radius, FEW_PAIRS * (n_names + state["labels"]))
        compared = pairs.select("label", "brand_idx", "brand", F.levenshtein("label", "brand", radius).alias("distance"))
        found = compared.where(F.col("distance") >= 0).groupBy("label").agg(F.min(F.struct("distance", "brand_idx", "brand")).alias("best"))
        # a brand without a common character: the shortest such distance, then the smallest number
        far = F.array_min(F.transform("by_length", lambda x: F.struct(F.greatest(n, x["m"]).alias("distance"), x["brand_idx"].alias("brand_idx"), x["brand"].alias("brand"))))
        both = open_.join(found, "label", "left").select("label", "by_length", F.least("best", F.when(far["distance"] <= radius, far)).alias("best"))
        done = materialize(both, "brand-round")
        rounds.append((radius, state["labels"], met))
        settled.append(done.where(F.col("best").isNotNull()).select("label", "best"))
        open_ = done.where(F.col("best").isNull()).select("label", "by_length")
        radius = next_radius(radius)
    none = spark.createDataFrame([], "label string, best struct<distance: int, brand_idx: bigint, brand: string>")
    every = reduce(DataFrame.unionByName, settled, none)
    return NearestBrands(every.select("label", F.col("best.distance").alias("distance"), F.col("best.brand").alias("brand")), rounds)


def nearest_brands(labels: DataFrame, brands: DataFrame, label_col: str = "main_label") -> DataFrame:
    """(label, distance, brand) of :func:`search_nearest`. Without a brand there are no rows."""
    return search_nearest(labels, brands, label_col).matches
