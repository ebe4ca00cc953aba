"""Near-duplicate documents: Jaccard join on word shingles with Bayesian pruning.

1. Texts with the same words are one class, stood for by its smallest id.
2. A class's MinHash values are cut into bands; classes that agree on a band
   meet in a bucket. Within a bucket pairs are compared value by value in
   steps: after n values with m agreements a pair is dropped once the
   posterior probability (uniform prior) that its similarity reaches the
   threshold is below ``TOLERANCE``. A bucket only reports enough surviving
   pairs to connect its members, so its output is linear in its size.
3. Components of the survivors are the candidate groups. Inside each, pairs
   are pruned the same way and the rest are verified on the exact shingle
   sets; each task adds up links per class and reports a spanning forest.
4. Components of the verified links give the class ids.

With 24 bands of 4 values a pair at similarity 0.8 meets in some bucket with
probability 1 - 3e-6, more similar pairs nearly surely. Large buckets and
groups are dealt into blocks, one task for each pair of blocks, so no group
has to fit one task; pairs are never written out.

Edge cases: null and empty texts have no shingles and no links, each is its own
class; texts shorter than a shingle have their whole word sequence as one
shingle; rows with a null id have no class and no links; repeated rows count
once; an id with several texts has the links of all, while ``keep_first`` judges
each text on its own; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hookline.llm.components import components
from hookline.llm.words import Words, multipliers, window_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 24, 4
VALUES = BANDS * BAND_ROWS
STEP = 16
TOLERANCE = 1e-6
BUCKET_BLOCK = 1024
GROUP_BLOCK = 2048
SLOT_ROWS = 4000
SLICE_BYTES = 4 << 20


@lru_cache(maxsize=8)
def least_agreements(threshold: float, tolerance: float, values: int = VALUES, step: int = STEP) -> tuple[int, ...]:
    """For n = step, 2 step, ...: the fewest agreements that leave the pair a posterior of ``tolerance``.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1);
    its mass above t is the chance of at most m successes in n + 1 draws at t.
    """
    out = []
    for n in range(step, values + 1, step):
        above, m = 0.0, -1
        while above < tolerance:
            m += 1
            above += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two signature tables may belong to pairs that reach the threshold."""
    alive = np.arange(len(left))
    same = np.zeros(len(left), dtype=np.int32)
    for k, least in enumerate(least_agreements(threshold, TOLERANCE)):
        part = slice(k * STEP, (k + 1) * STEP)
        same = same + (left[alive, part] == right[alive, part]).sum(axis=1)
        keep = same >= least
        alive, same = alive[keep], same[keep]
    return alive


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds per text); a text of fewer words than a shingle has one hash of all of them."""
    n = np.diff(words.bounds)
    h = window_hashes(words.low, size, 11)
    text, start = words.texts_of(), words.bounds[:-1]
    at = np.arange(len(h))
    ok = at + size <= words.bounds[1:][text[:len(h)]]
    h, owner = h[ok], text[:len(ok)][ok]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for k, m in enumerate(multipliers(size, 13)):
            has = n[short] > k
            whole[has] += words.low[start[short[has]] + k] * m
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, VALUES) MinHash values; texts without shingles have all ones."""
    out = np.full((len(bounds) - 1, VALUES), 0xFFFFFFFF, dtype=np.uint32)
    has = np.flatnonzero(np.diff(bounds))
    if len(has):
        first = bounds[:-1][has]
        for k, m in enumerate(multipliers(VALUES, 17)):
            out[has, k] = np.minimum.reduceat(((h * m) >> np.uint64(32)).astype(np.uint32), first)
    return out


def sequence_hash(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's words in order."""
    at = (np.arange(len(words.low)) - words.bounds[:-1][words.texts_of()]).astype(np.uint64)
    out = []
    for h, seed in ((words.low, 0x9E3779B97F4A7C15), (words.high, 0xC2B2AE3D27D4EB4F)):
        m = (at + np.uint64(1)) * np.uint64(seed)
        m ^= m >> np.uint64(30)
        m *= np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(27)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * (m | np.uint64(1)), dtype=np.uint64)])
        out.append((sums[words.bounds[1:]] - sums[words.bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def text_slices(batch: pa.RecordBatch, column: int):
    """Runs of rows with a few megabytes of text."""
    sizes = np.array([len(x or "") for x in batch.column(column).to_pylist()], dtype=np.int64)
    cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def sign(size: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                words = words_of(part.column(1))
                h, bounds = shingles(words, size)
                low, high = sequence_hash(words)
                sig = signatures(h, bounds)
                some = np.diff(bounds) > 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(low), pa.array(high), pa.array([s.tobytes() if ok else None for s, ok in zip(sig, some, strict=True)], pa.binary())],
                    names=["doc_id", "mark", "low", "high", "sig"])
    return run


def band_rows(batches):
    """(key, doc) for each band of each signature."""
    mix = multipliers(BAND_ROWS, 19)
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
        key = (sig * mix).sum(axis=2, dtype=np.uint64) + multipliers(BANDS, 23)
        key ^= key >> np.uint64(31)
        key *= np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(29)
        doc = np.repeat(np.asarray(batch.column(0)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(doc)], names=["key", "doc"])


class Forest:
    """Union-find over 0..n-1 with whole-array root look-ups."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return self.up
            self.up = above

    def stars(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each tree as edges from its smallest name to its others, so equal trees of many buckets give equal edges."""
        root = self.roots()
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, root, names)
        a = least[root]
        real = a != names
        return a[real], names[real]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Union the pairs."""
        up = self.up
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = x, y
            while up[rx] != rx:
                rx = up[rx]
            while up[ry] != ry:
                ry = up[ry]
            if rx != ry:
                up[max(rx, ry)] = min(rx, ry)


def blocked(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """Adds (slot, left, right, side): tasks of small groups together, and of large groups by pairs of blocks.

    ``rows`` has ``n``, the group's size. ``side`` is the row's own block.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long")
    dealt = rows.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64(member), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return (dealt.withColumn("left", F.least("side", "other")).withColumn("right", F.greatest("side", "other"))
            .withColumn("task", F.when(F.col("blocks") > 1, F.xxhash64(key, "left", "right")))
            .drop("other", "blocks"))


def with_slots(rows: DataFrame, key: str, slots: int) -> DataFrame:
    return rows.withColumn("slot", F.coalesce("task", F.pmod(F.xxhash64(key, F.lit(5)), F.lit(slots)))).drop("task")


def connect_bucket(threshold: float):
    """Spanning edges of the surviving pairs of the buckets in one slot."""

    def run(table: pa.Table) -> pa.Table:
        key, doc = table["key"].to_numpy(), table["doc"].to_numpy()
        left, right, side = (table[c].to_numpy() for c in ("left", "right", "side"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint32).reshape(-1, VALUES)
        order = np.lexsort((doc, side, right, left, key))
        key, doc, left, right, side, sig = (x[order] for x in (key, doc, left, right, side, sig))
        group = np.concatenate([[0], np.cumsum((np.diff(key) != 0) | (np.diff(left) != 0) | (np.diff(right) != 0))])
        most = np.bincount(group).max()
        forest = Forest(len(doc))
        for d in range(1, most):
            a = np.flatnonzero(group[d:] == group[:-d])
            b = a + d
            root = forest.roots()
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
            if not len(a):
                if d > 1 and len(np.unique(np.stack([group, root]), axis=1).T) == group[-1] + 1:
                    break  # every group is one tree
                continue
            ok = survivors(sig[a], sig[b], threshold)
            forest.join(a[ok], b[ok])
        low, high = forest.stars(doc)
        return pa.table({"a": pa.array(low), "b": pa.array(high)})

    return run


def verify_groups(threshold: float, size: int):
    """Links per class and a spanning forest of verified pairs, for the groups in one slot."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("label", "left", "right", "side", "rep")])
        names = np.stack([table[c].to_numpy() for c in ("label", "left", "right", "side", "rep")])
        table = table.filter(pa.array(np.concatenate([[True], (np.diff(names) != 0).any(axis=0)])))  # equal rows of a document
        label, rep, copies = (table[c].to_numpy() for c in ("label", "rep", "copies"))
        left, right, side = (table[c].to_numpy() for c in ("left", "right", "side"))
        h, bounds = shingles(words_of(table["text"]), size)
        sig = signatures(h, bounds)
        owner = np.repeat(np.arange(len(rep)), np.diff(bounds))
        _, code = np.unique(h, return_inverse=True)
        pairs = np.unique(np.stack([owner, code]), axis=1)  # each text's distinct shingles
        code, bounds = pairs[1], np.searchsorted(pairs[0], np.arange(len(rep) + 1))
        count = np.diff(bounds)
        mark = np.zeros(code.max() + 1 if len(code) else 1, dtype=np.int32)
        links = np.zeros(len(rep), dtype=np.int64)
        forest = Forest(len(rep))
        group = np.concatenate([[0], np.cumsum((np.diff(label) != 0) | (np.diff(left) != 0) | (np.diff(right) != 0))])
        first = np.searchsorted(group, np.arange(group[-1] + 2))
        for a in range(len(rep)):
            g = group[a]
            # inside one block every later member; between two blocks the members of the other one
            low = a + 1 if left[a] == right[a] else first[g] + np.searchsorted(side[first[g]:first[g + 1]], right[a])
            if left[a] != right[a] and side[a] != left[a]:
                continue
            b = np.arange(low, first[g + 1])
            b = b[(rep[b] != rep[a]) & (np.minimum(count[b], count[a]) >= threshold * np.maximum(count[b], count[a]))]
            if not len(b) or not count[a]:
                continue
            b = b[survivors(np.broadcast_to(sig[a], (len(b), VALUES)), sig[b], threshold)]
            if not len(b):
                continue
            mark[code[bounds[a]:bounds[a + 1]]] = 1
            n = count[b]
            at = np.repeat(bounds[b] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.add.reduceat(mark[code[at]], np.cumsum(n) - n)
            mark[code[bounds[a]:bounds[a + 1]]] = 0
            # shared / (all - shared) >= threshold, without a rounding step
            b = b[shared * (1 + threshold) >= threshold * (n + count[a]) - 1e-9]
            links[a] += copies[b].sum()
            links[b] += copies[a]
            forest.join(np.full(len(b), a), b)
        low, high = forest.stars(rep)
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([rep[some], low])),
            "b": pa.array([None] * len(some) + high.tolist(), pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(low), dtype=np.int64)]))})

    return run


def text_classes(docs: DataFrame, doc_id: str, text: str, threshold: float, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, signed, found).

    ``rows`` (doc_id, mark, text) are the documents, ``mark`` 64 bits of the text's
    hash: together they name a text of an id. ``signed`` has (doc_id, mark, sig) of
    each, ``found`` (doc_id, mark, class_id, n_links) of each with shingles.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    known = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "mark")
    signed = known.mapInArrow(sign(size), "doc_id long, mark long, low long, high long, sig binary").checkpoint()
    full = signed.where(F.col("sig").isNotNull())
    # a class of texts with the same words; its node is its smallest id, or a hash where an id is the smallest of several classes
    each = full.groupBy("doc_id", "low", "high").agg(F.min("mark").alias("mark"))
    classes = each.groupBy("low", "high").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("copies"))
    nth = F.row_number().over(W.partitionBy("first.doc_id").orderBy("low", "high"))
    classes = classes.withColumn("nth", nth).select("low", "high", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("rep_mark"), "copies",
                                                    F.when(F.col("nth") == 1, F.col("first.doc_id")).otherwise(F.xxhash64("first.doc_id", "low", "high")).alias("node"))
    classes = classes.checkpoint()
    members = full.select("doc_id", "mark", "low", "high").distinct().join(classes.drop("rep_mark"), ["low", "high"]).select("doc_id", "mark", "node", "copies").checkpoint()
    heads = classes.select("rep", "rep_mark", "node", "copies")
    reps = full.join(heads, (full["doc_id"] == heads["rep"]) & (full["mark"] == heads["rep_mark"])).select(F.col("node").alias("rep"), "sig").dropDuplicates(["rep"]).checkpoint()

    bands = reps.mapInArrow(band_rows, "key long, doc long")
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = bands.join(buckets, "key").checkpoint()
    slots = max(1, -(-met.count() // SLOT_ROWS))
    signed_rows = with_slots(blocked(met.join(reps, met["doc"] == reps["rep"]).select("key", "doc", "n", "sig"), "key", "doc", BUCKET_BLOCK), "key", slots)
    edges = signed_rows.groupBy("slot").applyInArrow(connect_bucket(threshold), "a long, b long")

    groups = components(edges).withColumnRenamed("node", "member")
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    grouped = groups.join(sizes, "label").join(heads, F.col("member") == heads["node"]).select("node", "label", "n", "copies", "rep", "rep_mark").checkpoint()
    slots = max(1, -(-grouped.count() // (SLOT_ROWS // 4)))
    texts = known.join(grouped, (known["doc_id"] == grouped["rep"]) & (known["mark"] == grouped["rep_mark"])).select("label", F.col("node").alias("rep"), "n", "copies", "text")
    tasks = with_slots(blocked(texts, "label", "rep", GROUP_BLOCK), "label", slots)
    verified = tasks.groupBy("slot").applyInArrow(verify_groups(threshold, size), "a long, b long, links long").checkpoint()

    links = verified.where("b is null").groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("links"))
    final = components(verified.where("b is not null").select("a", "b")).withColumnRenamed("node", "member")
    smallest = final.join(heads, F.col("member") == heads["node"]).groupBy("label").agg(F.min("rep").alias("class_id"))
    named = final.join(smallest, "label").select("member", "class_id", "label")
    of_class = (heads.select("node", "rep").join(links, F.col("node") == links["of"], "left").join(named, F.col("node") == named["member"], "left")
                .select("node", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links")))
    found = members.join(of_class, "node").select("doc_id", "mark", "class_id", "label", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return rows, signed, found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, n_links): one row per document.

    ``class_id`` is the smallest id connected with the document by links;
    ``n_links`` counts the other documents whose similarity reaches the threshold.
    """
    rows, signed, of_texts = text_classes(docs, doc_id, text, threshold, size)
    # texts of one id with the same words count once
    found = of_texts.groupBy("doc_id", "label").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    found = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").cast("long").alias("n_links"))
    bare = signed.where(F.col("sig").isNull()).select("doc_id").distinct().join(found.select("doc_id"), "doc_id", "left_anti")
    loose = rows.where(F.col("doc_id").isNull()).select("doc_id")
    return (found.unionByName(bare.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
            .unionByName(loose.select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One document of each class, the one with the smallest id (of several texts of that id, the one with the smallest hash).

    Each text of a repeated id is judged on its own, and of equal rows (id and text) one stays; rows without an id all stay.
    """
    found = text_classes(docs, doc_id, text, threshold, size)[2]
    first = found.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    gone = found.join(first, "label").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("mark") != F.col("first.mark"))).select("doc_id", "mark").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"))
    kept = rows.join(gone, ["doc_id", "mark"], "left_anti")
    nth = F.row_number().over(W.partitionBy("doc_id", "mark").orderBy("mark"))
    return kept.select("row", ((nth == 1) | F.col("doc_id").isNull()).alias("stays")).where("stays").select("row.*")
