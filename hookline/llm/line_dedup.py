"""Removal of near-duplicate lines by an exact set-similarity join.

A line's tokens are its distinct words. A line is removed if some earlier line
(by document id, then line number) has Jaccard similarity of at least the
threshold with it. Only built-in functions run here:

1. Lines with the same text meet by a 128-bit hash of the line; all but the
   first go at once (one minimum per text, combined before the shuffle). Only the
   words of the other lines are hashed, once; what is needed of each (the parity
   maps and the prefix of 3.) is written. Two bitmaps tell which lines these are,
   and the few that they leave in doubt are told apart by their places.
2. A token's rarity is read from a small table of hashed counts over all words
   and from its length (a word is taken for rarer by a factor of two per
   byte). A token's key is that rank and 56 bits of its hash, so sorting
   keys orders a line's tokens from rare to common. Any fixed order gives the same result; this one keeps the
   index's groups small.
3. A line of n tokens puts its first n - ceil(t n) + 1 keys (the prefix) in an
   index. Two lines that reach t share a prefix key, differ in length by at
   most t, can still reach the overlap from the key's positions on, and their
   64-bit parity maps (128 bits, if both lines are long) differ in no more bits
   than their sets may differ in tokens. Of the shorter line the first
   n - ceil(2 t n / (1 + t)) + 1 keys do, so the commonest keys of two prefixes
   are not tried on each other. These filters lose nothing.
4. Where more than ``SMALL_GROUP`` rows have a key, the earliest of them is tried
   first: that settles nearly all lines of a large group of near copies with
   one pair per key, so no such group is squared. Such keys are found by one
   bit of each; a key that shares its bit with another is tried too, and loses nothing.
   All other lines then meet all earlier lines with a common prefix key.
   Prefixes are written once; the index made of them moves once, and both sides
   of the pairs read the same exchange.
5. Pairs that pass the filters are verified on the token keys of both lines.
   A bitmap of the pairs' ends keeps all other lines where they are.

Edge cases: blank lines have no tokens and are kept as they are; null text has
no lines and stays null; lines of rows with a null id are compared with none
and kept; rows with one id are documents of their own, in the order of 32 bits of
their texts' hashes, and of equal rows (id and text) one keeps its lines;
an empty table gives no rows. A token is known by its rank and 56 bits of its hash, in the last test by 48.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hookline.session import dropped_shuffles, materialize

THRESHOLD = 0.8
RARITY_CELLS = 1 << 13
RANK_AT = 56  # a key is 7 bits of rank and 56 of the word's hash
INDEX_BITS = 40  # what the index keeps of a key: enough to meet by, and fewer bytes to shuffle
LOW_HALF = (1 << 32) - 1
BITMAP_PART = 1 << 15  # bits of a part that Spark's bitmap functions make
ENDS = ["doc_id", "at", "y_doc_id", "y_at"]
SMALL_GROUP = 256  # rows of a key that need no leader; all lines of larger groups try theirs first
CROWD_BITS = 1 << 20  # bits for the keys of larger groups
LONG = 64  # lines of more tokens than this have a parity map of 128 bits; for the others 64 tell enough
MAPS = ["bits", "odd_bits"]
LENGTHS = 31  # a word's length counts up to this many bytes
SETTLED_AT = 31  # the bit of an index row's ``sz`` that says its line is settled
WORDED = r"[^\x20\x09-\x0D]"


def tokens(line: Column) -> Column:
    """The words of a line. Splitting at one character is much cheaper than at a pattern, and nearly all lines allow it, with no blank to drop."""
    other = line.rlike(r"[\x09-\x0D]")
    blanks = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | (line == "")
    return F.when(other | blanks, F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")).otherwise(F.split(line, " "))


def cell_of(h: Column) -> Column:
    return h.bitwiseAND(RARITY_CELLS - 1).cast("int")


def rarity(docs: DataFrame, text: str) -> list[int]:
    """Per cell, the rarity step of the words that hash into it (two steps an octave of their count).

    RARITY_CELLS numbers whatever the size of the input, so they go into the plan as a literal.
    """
    words = docs.where(F.col(text).isNotNull()).select(F.explode_outer(F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = words.select(cell_of(F.xxhash64("word")).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    step = F.least(F.lit(60), F.floor(F.log2(F.col("n") + 1.0) * 2)).cast("int").alias("step")
    steps = [0] * RARITY_CELLS
    for r in counts.select("cell", step).collect():  # at most RARITY_CELLS small rows
        steps[r["cell"]] = r["step"]
    return steps


def listed(numbers: list[int]) -> Column:
    """The numbers as an array, one literal in the plan."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def keys_of(line: Column, steps: list[int]) -> Column:
    """Distinct token keys of a line, rarest first: the cell's step, less two for each letter, then the word's hash. None is null, which makes sorting cheap.

    Ranks come from tables already shifted: Spark interprets each step in here for each word.
    """
    ranks = listed([(x + 2 * LENGTHS) << RANK_AT for x in steps])
    less = listed([2 * x << RANK_AT for x in range(LENGTHS + 1)])

    def key(word: Column) -> Column:
        h = F.xxhash64(word)
        highest = F.get(ranks, h.bitwiseAND(RARITY_CELLS - 1)).bitwiseOR(F.shiftrightunsigned(h, 64 - RANK_AT))
        return sure(highest - F.get(less, F.least(F.octet_length(word), F.lit(LENGTHS))))

    return F.sort_array(F.array_distinct(F.transform(tokens(line), key)))


def prefix_length(n: Column, threshold: float) -> Column:
    return n - F.ceil(n * threshold - 1e-9) + 1


def index_length(n: Column, threshold: float) -> Column:
    """How many keys of a line must meet the prefixes of lines that are as long or longer: the rarest common key is among them."""
    return n - least_overlap(n, n, threshold) + 1


def parity_map(keys: Column, places: list[int]) -> Column:
    """64 bits, each the parity of how many keys fall on it: sets that differ in d tokens differ in at most d bits. ``places`` has the bits by a key's last ones."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.get(listed(places), k.bitwiseAND(len(places) - 1))))


def parity_maps(keys: Column) -> list[Column]:
    """The map of 64 bits and, of long lines, one half of a map of 128; its other half is the sum (by exclusive or) of both."""
    bits = [1 << k for k in range(63)] + [-1 << 63]
    odd = parity_map(keys, [0] * 64 + bits)
    return [parity_map(keys, bits), F.when(F.size(keys) > LONG, odd).otherwise(F.lit(0).cast("long"))]


def least_overlap(n: Column, m: Column, threshold: float) -> Column:
    """Fewest common tokens of two lines of n and m tokens that reach the threshold."""
    return F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)


def few_flips(x: str, y: str, threshold: float) -> Column:
    """The test of the 64-bit maps for the index rows ``x`` and ``y`` of one key, in its cheapest form: nearly all pairs end here."""
    most = (size_of(f"{x}sz") + size_of(f"{y}sz")) * (1 - 2 * threshold / (1 + threshold)) + 1e-6
    return F.bit_count(F.col(f"{x}bits").bitwiseXOR(F.col(f"{y}bits"))) <= most


def may_match(x: str, y: str, threshold: float) -> Column:
    """Length, position and parity filters for the index rows ``x`` and ``y`` of one key (prefixes of column names)."""
    n, m = size_of(f"{x}sz"), size_of(f"{y}sz")
    common = least_overlap(n, m, threshold)
    rest = F.least(n - pos_of(f"{x}sz"), m - pos_of(f"{y}sz"))
    flips, odd = (F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in MAPS)
    wide = F.bit_count(odd) + F.bit_count(flips.bitwiseXOR(odd))
    near = (F.bit_count(flips) <= n + m - 2 * common) & ((F.least(n, m) <= LONG) | (wide <= n + m - 2 * common))
    return (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9) & (rest + 1 >= common) & near


def packed(high: Column, low: Column) -> Column:
    """Two numbers under 2^32 as one: rows of the index are narrow."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def size_of(sz: str) -> Column:
    return F.shiftrightunsigned(F.col(sz), 32)


def pos_of(sz: str) -> Column:
    return F.col(sz).bitwiseAND((1 << SETTLED_AT) - 1)


def is_settled(sz: str) -> Column:
    return F.getbit(F.col(sz), F.lit(SETTLED_AT)) == 1


def text_mark(text: Column) -> Column:
    """32 bits that part the texts of rows with one id."""
    return F.xxhash64(text).bitwiseAND(LOW_HALF)


def text_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text) of the rows that have both."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")


def worded_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, at, line) of every line with a word; ``at`` is the line's number, then the mark of its row's text.

    The arrays are never empty here and below; of an outer explode Spark knows it
    and puts no filter under it that would cut the texts a second time.
    """
    cut = rows.select("doc_id", text_mark(F.col("text")).alias("mark"), F.split("text", "\n", -1).alias("lines"))
    lines = cut.select("doc_id", "mark", F.posexplode_outer("lines").alias("line_no", "line"))
    return lines.select("doc_id", sure(packed(F.col("line_no"), F.col("mark"))).alias("at"), "line").where(F.col("line").rlike(WORDED))


def sure(c: Column) -> Column:
    """A number that is never null, as one that Spark knows to be none: no reader puts a filter of its own under an exchange that others share."""
    return F.coalesce(c, F.lit(0).cast("long"))


def prefixes(lines: DataFrame, steps: list[int], threshold: float) -> DataFrame:
    """(doc_id, at, n, the parity maps, head): the number of each line's keys, their parity maps, and the prefix; other columns of ``lines`` stay."""
    more = [c for c in lines.columns if c not in ("doc_id", "at", "line")]
    keyed = lines.select("doc_id", "at", *more, keys_of(F.col("line"), steps).alias("keys"))
    n = F.size("keys")
    head = F.transform(F.slice("keys", F.lit(1), prefix_length(n, threshold).cast("int")), lambda k: F.shiftrightunsigned(k, 63 - INDEX_BITS))
    return keyed.select("doc_id", "at", *more, n.alias("n"), *[m.alias(c) for c, m in zip(MAPS, parity_maps(F.col("keys")))], head.alias("head"))


def index_rows(heads: DataFrame) -> DataFrame:
    """(tok, doc_id, at, sz, the parity maps), a row a prefix key; ``sz`` is the number of keys, then a bit for settled lines, then the key's place."""
    rows = heads.select("doc_id", "at", "n", *MAPS, "settled", F.posexplode_outer("head").alias("pos", "tok"))
    place = F.shiftleft(F.col("settled").cast("long"), SETTLED_AT).bitwiseOR((F.col("pos") + 1).cast("long"))
    columns = {"tok": F.col("tok"), "doc_id": F.col("doc_id"), "at": F.col("at"), "sz": packed(F.col("n"), place), **{c: F.col(c) for c in MAPS}}
    return rows.select(*[sure(c).alias(name) for name, c in columns.items()])


def marked(wanted: DataFrame) -> tuple[Column, int]:
    """A bitmap (and its size in bits) of the (doc_id, at) of ``wanted``: a line whose bit is not set is none of them.

    16 bits a line, at least 2^20 and at most 2^27 (16 MB) of them, so with
    very many lines it lets more pass, and no result depends on it.
    """
    bits = 1 << min(27, max(20, (16 * wanted.count()).bit_length()))
    place = bit_of(F.col("doc_id"), F.col("at"), bits)
    parts = wanted.select(place.alias("p")).groupBy((F.bitmap_bucket_number("p") - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("part"))
    every = wanted.sparkSession.range(bits // BITMAP_PART).join(parts, F.col("id") == F.col("bucket"), "left")
    filled = F.coalesce("part", F.unhex(F.lit("00" * (BITMAP_PART // 8))))
    listed = every.agg(F.sort_array(F.collect_list(F.struct("id", filled.alias("part")))).alias("parts"))
    return listed.select(F.aggregate("parts.part", F.unhex(F.lit("")), lambda a, x: F.concat(a, x))).scalar(), bits


def bit_of(doc_id: Column, at: Column, bits: int) -> Column:
    """The place of a line's bit, from 1: ``bitmap_bit_position`` counts so."""
    return F.pmod(F.xxhash64(doc_id, at), F.lit(bits)) + 1


def is_marked(bitmap: Column, bits: int, at: Column | None = None) -> Column:
    place = bit_of(F.col("doc_id"), F.col("at") if at is None else at, bits) - 1
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1


def key_sets(ends: DataFrame, rows: DataFrame, steps: list[int]) -> DataFrame:
    """(doc_id, at, keys) of the lines ``ends``, and of few others, dealt by line; of all lines only these move, and few other texts are cut.

    Here 48 bits of a word's hash stand for it. No line is at -1: that bit tells whether a document has any of ``ends``.
    """
    whole = F.lit(-1).cast("long")
    bitmap, bits = marked(ends.unionByName(ends.select("doc_id", whole.alias("at")).distinct()))
    lines = worded_lines(rows.where(is_marked(bitmap, bits, whole)))
    found = lines.where(is_marked(bitmap, bits)).select("doc_id", "at", F.transform(keys_of(F.col("line"), steps), lambda k: k.bitwiseAND((1 << 48) - 1)).alias("keys"))
    return found.select(sure(F.col("doc_id")).alias("doc_id"), "at", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys")).repartition("doc_id", "at")


def similar_lines(pairs: DataFrame, rows: DataFrame, steps: list[int], threshold: float) -> DataFrame:
    """(doc_id, at) of the later lines of the pairs that reach the threshold, by their keys."""
    ends = pairs.select("doc_id", "at").unionByName(pairs.select(F.col("y_doc_id").alias("doc_id"), F.col("y_at").alias("at"))).distinct().checkpoint()
    keyed = key_sets(ends, rows, steps)
    own = keyed.select("doc_id", "at", F.col("keys").alias("x"))
    other = keyed.select(F.col("doc_id").alias("y_doc_id"), F.col("at").alias("y_at"), F.col("keys").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    reaches = common * (1 + threshold) >= (F.size("x") + F.size("y")) * threshold - 1e-9
    return pairs.join(own, ["doc_id", "at"]).join(other, ["y_doc_id", "y_at"]).where(reaches).select("doc_id", "at").distinct().checkpoint()


def earlier_than(y: str, x: str) -> Column:
    """By id, then the text's mark, then the line's number."""
    doc, other = F.col(f"{x}doc_id"), F.col(f"{y}doc_id")
    at, other_at = (F.struct(F.col(f"{c}at").bitwiseAND(LOW_HALF), F.col(f"{c}at")) for c in (x, y))
    return (other < doc) | ((other == doc) & (other_at < at))


def meet(index: DataFrame, threshold: float) -> DataFrame:
    """The pairs (doc_id, at, y_doc_id, y_at) of lines of ``index`` with earlier ones, the later not settled, that have a common key and pass the filters.

    An open line meets the index keys of lines that are as long or shorter,
    and all keys of settled lines that are earlier; no settled line meets another.
    The rows are asked after they moved: no filter goes under the exchange that both sides read.
    """
    moved = F.spark_partition_id() >= 0
    columns = ["tok", "doc_id", "at", "sz", *MAPS]
    rows = index.where(F.when(moved, ~is_settled("sz")))
    met = index.where(F.when(moved, is_settled("sz") | (pos_of("sz") <= index_length(size_of("sz"), threshold)))).select(*[F.col(c).alias(f"y_{c}") for c in columns])
    n, m, earlier = size_of("sz"), size_of("y_sz"), earlier_than("y_", "")
    once = F.when(is_settled("y_sz"), earlier).otherwise((n > m) | ((n == m) & earlier))
    on = (F.col("tok") == F.col("y_tok")) & few_flips("", "y_", threshold) & once & may_match("", "y_", threshold)
    ends, others = ENDS[:2], ENDS[2:]
    return rows.join(met, on).select(*[F.when(earlier, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in zip(ends + others, others + ends, ENDS)])


def crowded(index: DataFrame) -> DataFrame:
    """The rows of ``index`` whose key more than ``SMALL_GROUP`` rows have, and of few other keys: those whose bit is set."""
    counts = index.groupBy("tok").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL_GROUP)
    place = F.col("tok").bitwiseAND(CROWD_BITS - 1)
    words = counts.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("part")).checkpoint()
    if words.isEmpty():
        return index.limit(0)
    every = index.sparkSession.range(CROWD_BITS // 64).join(words, F.col("id") == F.col("word"), "left")
    listed = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("part", F.lit(0).cast("long")).alias("part")))).alias("parts"))
    bits = listed.select(F.col("parts.part")).scalar()
    return index.where(F.getbit(F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1)


def settled_lines(index: DataFrame, rows: DataFrame, steps: list[int], threshold: float) -> DataFrame:
    """(doc_id, at) of the lines that are similar to the earliest line of a key that very many share."""
    columns = ["doc_id", "at", "sz", *MAPS]
    group = W.partitionBy("tok").orderBy("doc_id", F.col("at").bitwiseAND(LOW_HALF), "at")  # read in order, nothing is held
    led = crowded(index).select(*columns, *[F.first(c).over(group).alias(f"y_{c}") for c in columns])
    pairs = led.where(earlier_than("y_", "") & may_match("", "y_", threshold)).select(*ENDS).distinct().checkpoint()
    return similar_lines(pairs, rows, steps, threshold)


def matched_lines(heads: DataFrame, rows: DataFrame, steps: list[int], threshold: float) -> DataFrame:
    """(doc_id, at) of the lines of ``heads`` that have an earlier similar line there."""
    heads = heads.withColumn("settled", F.lit(False))
    settled = settled_lines(index_rows(heads), rows, steps, threshold)
    if not settled.isEmpty():
        bitmap, bits = marked(settled)
        maybe = heads.drop("settled").where(is_marked(bitmap, bits)).join(settled.withColumn("settled", F.lit(True)), ["doc_id", "at"], "left")
        heads = heads.where(~is_marked(bitmap, bits)).unionByName(maybe.withColumn("settled", F.coalesce("settled", F.lit(False))))
    index = index_rows(heads).repartition("tok")  # moved once: both sides of the pairs read this
    pairs = meet(index, threshold).distinct().checkpoint()
    return settled.unionByName(similar_lines(pairs, rows, steps, threshold))


def line_hashes(lines: DataFrame) -> DataFrame:
    """(doc_id, at, h1, h2): 128 bits for the text of each line."""
    return lines.select("doc_id", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def copied_lines(hashes: DataFrame) -> DataFrame:
    """(doc_id, at) of every line with the text of an earlier one."""
    occurrences = hashes.select("h1", "h2", "doc_id", F.col("at").bitwiseAND(LOW_HALF).alias("mark"), "at")
    several = occurrences.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "mark", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = occurrences.join(several, ["h1", "h2"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
    return later.select("doc_id", "at").distinct().checkpoint()


def open_heads(lines: DataFrame, hashes: DataFrame, copies: DataFrame, steps: list[int], threshold: float) -> DataFrame:
    """``prefixes`` of the ``lines`` that are not ``copies``, written for all who read them.

    A line without the bit of a copy is none. Those that have such a bit by chance get
    a bitmap of their own; the lines in both are few, and only they are joined.
    """
    bitmap, bits = marked(copies)
    spared = hashes.select("doc_id", "at").where(is_marked(bitmap, bits)).join(copies, ["doc_id", "at"], "left_anti").distinct().checkpoint()
    stays, stay_bits = marked(spared)
    flagged = lines.withColumn("doubt", is_marked(bitmap, bits)).where(~F.col("doubt") | is_marked(stays, stay_bits))
    heads = materialize(prefixes(flagged, steps, threshold), "line-heads")  # words are hashed once
    few = heads.where("doubt").join(spared, ["doc_id", "at"]).select(heads.columns)
    return heads.where("not doubt").unionByName(materialize(few, "few-heads")).drop("doubt")


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, at) of every line with an earlier line that is equal or similar."""
    rows = text_rows(docs, doc_id, text)
    lines = worded_lines(rows)
    hashes = materialize(line_hashes(lines), "line-hashes")
    copies = copied_lines(hashes)
    steps = rarity(docs, text)
    heads = open_heads(lines, hashes, copies, steps, threshold)
    return copies.unionByName(matched_lines(heads, rows, steps, threshold)).distinct()


def deduplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the removed lines gone from the text, and two more columns: n_lines, n_removed (in place of such columns of ``docs``).

    Texts that lose no line stay where they are: a bitmap tells all others, and those whose id and text another row has too.
    """
    plain = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    with dropped_shuffles(docs.sparkSession):
        removed = removed_lines(docs, doc_id, text, threshold)
        gone = removed.select("doc_id", F.col("at").bitwiseAND(LOW_HALF).alias("mark"), F.shiftrightunsigned("at", 32).cast("int").alias("no"))
        gone = gone.groupBy("doc_id", "mark").agg(F.collect_set("no").alias("gone")).checkpoint()
        marks = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_mark(F.col(text)).alias("mark"))
        equal = marks.where("doc_id is not null").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").checkpoint()
        bitmap, bits = marked(gone.select("doc_id", "mark").unionByName(equal.select("doc_id", "mark")).withColumnRenamed("mark", "at"))
    one = F.struct(*[F.col(c) for c in plain], F.col(text).alias("_text_"))  # the columns keep their names in here, whatever they are
    rows = docs.select(one.alias("row"), F.col(doc_id).cast("long").alias("doc_id"), text_mark(F.col(text)).alias("at"))
    rows = rows.withColumn("touched", F.coalesce(is_marked(bitmap, bits), F.lit(False)))
    joined = rows.where("touched").withColumnRenamed("at", "mark").join(gone, ["doc_id", "mark"], "left")
    again = F.row_number().over(W.partitionBy("doc_id", "mark").orderBy("mark")) > 1  # an equal row: all its worded lines are copies
    body = F.col("row._text_")
    found = joined.select("row", body.alias("text"), F.split(body, "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), again.alias("again"))
    left = (F.when(F.col("again"), F.filter("lines", lambda x: ~x.rlike(WORDED)))
            .when(F.size("gone") > 0, F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda k: F.get("lines", k))).otherwise(F.col("lines")))
    kept = found.select("row", "text", "lines", left.alias("left"))
    count = lambda c: F.when(F.col("text").isNull(), 0).otherwise(c).cast("long")

    def result(some: DataFrame, new: dict[str, Column]) -> DataFrame:
        return some.select(*[F.col("row").getField(c).alias(c) for c in plain], *[v.alias(c) for c, v in new.items()])

    cut = result(kept, {text: F.when(F.col("text").isNotNull(), F.array_join("left", "\n")), "n_lines": count(F.size("lines")), "n_removed": count(F.size("lines") - F.size("left"))})
    whole = rows.where("not touched").select("row", body.alias("text"))
    return cut.unionByName(result(whole, {text: F.col("text"), "n_lines": count(F.size(F.split("text", "\n", -1))), "n_removed": F.lit(0).cast("long")}))


def line_dedup_sql(threshold: float = THRESHOLD) -> str:
    """Per document its lines, removed lines and the digest of what is left, in DuckDB."""
    words = "list_distinct([x FOR x IN regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+') IF x <> ''])"
    return f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
texts AS (SELECT line, min((doc_id, line_no)) AS f, {words} AS words FROM lines GROUP BY line HAVING len({words}) > 0),
numbered AS (SELECT row_number() OVER (ORDER BY f) AS id, line, f, words, len(words) AS n FROM texts),
tok AS (SELECT id, n, unnest(words) AS w FROM numbered),
df AS (SELECT w, count(*) AS c FROM tok GROUP BY w),
ranked AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS pos FROM tok JOIN df USING (w)),
head AS (SELECT id, n, w FROM ranked WHERE pos <= n - ceil(n * {threshold}::DOUBLE - 1e-9) + 1),
pairs AS (SELECT DISTINCT x.id AS x, y.id AS y FROM head x JOIN head y ON x.w = y.w AND y.id < x.id AND least(x.n, y.n) >= {threshold}::DOUBLE * greatest(x.n, y.n) - 1e-9),
alike AS (SELECT DISTINCT a.id FROM pairs JOIN numbered a ON a.id = pairs.x JOIN numbered b ON b.id = pairs.y
  WHERE len(list_intersect(a.words, b.words)) * (1 + {threshold}::DOUBLE) >= {threshold}::DOUBLE * (a.n + b.n) - 1e-9),
judged AS (SELECT l.doc_id, l.line_no, l.line, t.id IS NOT NULL AND ((l.doc_id, l.line_no) <> t.f OR t.id IN (SELECT id FROM alike)) AS gone
  FROM lines l LEFT JOIN numbered t ON l.line = t.line),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(kept.text) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""
