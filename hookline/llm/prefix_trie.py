"""Prefix trie of conversations: what they share, by balanced parentheses in sorted shards.

1. A turn becomes 16 bytes (MD5 of role and text) and the length of its text;
   a conversation is one row of these, some 20 bytes a turn.
2. Rows are dealt by range of their paths, so that conversations with a common
   prefix stand together; the first ``KEY_TURNS`` turns, a hash of the whole
   path and the id make the range key, so copies of one conversation can be
   parted as well and no key grows with a conversation.
3. Each shard, sorted by path, is a trie in preorder. It is written as balanced
   parentheses. ``findclose`` (excess minima of blocks, and a tree of minima
   above them) delimits every subtree, the rank of ``()`` pairs counts its
   leaves, and differences of cumulative arrays give its savings.
4. A node can also stand in another shard only if it lies on the shard's first
   or last path (or below the key's end of one). These spine nodes, a path or
   two a shard, are merged by a 128-bit hash of their prefix: counts add up, and
   what each shard counted once more (a node's own share of the savings, a
   leaf, a child) is taken back along the spine. All other nodes are final as
   they are and move no more.

Edge cases: null roles and texts are empty; turns are ordered by (turn, MD5),
nulls first; rows with a null id belong to no conversation and are left out;
the base of a negative id is the next lower multiple of five; an empty table
gives no rows. The ids of the conversations that end at a spine node are hashed
as a stream of sorted runs, one a shard.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookline.session import materialize

BASES = 5  # conversation c starts like conversation c - c % BASES
MOST_SHARED = 9
KEY_TURNS = 64
BLOCK = 64
ROWS = 50_000
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()
FINAL, SPINE, END = range(3)

PART = ("kind int, key binary, parent binary, top binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, size long, ends_sha256 string")
ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (c.split() for c in PART.split(", "))])


class Parentheses:
    """A tree as balanced parentheses, from its nodes' depths in preorder."""

    def __init__(self, depths: np.ndarray) -> None:
        n = len(depths)
        self.opens = 2 * np.arange(n) - depths  # a node's parenthesis follows those of the nodes before it, and the closed ones of these
        self.bits = np.zeros(2 * n, dtype=np.int8)
        self.bits[self.opens] = 1
        self.excess = np.cumsum(2 * self.bits.astype(np.int32) - 1, dtype=np.int32)
        blocks = -(-2 * n // BLOCK)
        self.width = 1 << max(0, int(blocks - 1).bit_length())
        padded = np.full(self.width * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        padded[:2 * n] = self.excess
        self.padded = padded
        self.least = np.full(2 * self.width, np.iinfo(np.int32).max, dtype=np.int32)  # least excess of block b at width + b, of the nodes above at k from 2k and 2k + 1
        self.least[self.width:] = padded.reshape(-1, BLOCK).min(axis=1)
        level = self.width
        while level > 1:
            self.least[level // 2:level] = self.least[level:2 * level].reshape(-1, 2).min(axis=1)
            level //= 2
        pairs = np.zeros(2 * n, dtype=np.int64)
        pairs[:-1] = (self.bits[:-1] == 1) & (self.bits[1:] == 0)
        self.pairs_before = np.concatenate([[0], np.cumsum(pairs)])

    def _scan(self, at: np.ndarray, under: np.ndarray) -> np.ndarray:
        """First place from ``at`` on, within its block, whose excess is below ``under``; -1 if none."""
        found = np.full(len(at), -1, dtype=np.int64)
        open_ = np.arange(len(at))
        for _ in range(BLOCK):
            hit = self.padded[at[open_]] < under[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] % BLOCK != 0]
            if not len(open_):
                break
        return found

    def findclose(self) -> np.ndarray:
        """The place of each node's closing parenthesis: the first excess below its own."""
        under = self.excess[self.opens]
        start = self.opens + 1
        close = np.where(start % BLOCK != 0, self._scan(start.copy(), under), -1)
        far = np.flatnonzero(close < 0)
        limit, node = under[far], self.width + (start[far] + BLOCK - 1) // BLOCK
        while len(on := np.flatnonzero(self.least[node] >= limit)):  # to the right, and up where a left child begins
            node[on] += 1
            node[on] >>= node[on] % 2 == 0
        while len(on := np.flatnonzero(node < self.width)):
            left = 2 * node[on]
            node[on] = left + (self.least[left] >= limit[on])
        close[far] = self._scan((node - self.width) * BLOCK, limit)
        return close

    def leaves(self, close: np.ndarray) -> np.ndarray:
        return self.pairs_before[close] - self.pairs_before[self.opens]


class Shard:
    """The trie of conversations that come sorted by (path, id)."""

    def __init__(self) -> None:
        self.depth, self.size, self.parent, self.from_conv = array("q", [0]), array("q", [0]), array("q", [-1]), array("q", [0])
        self.keys = [ROOT]
        self.convs, self.end = array("q"), array("q")
        self.ids: list[bytes] = []
        self.stack = [0]  # nodes of the last path
        self.first_path = 0

    def add(self, conv_id: int, ids: list[bytes], sizes: list[int]) -> None:
        same = 0
        for x, y in zip(self.ids, ids):
            if x != y:
                break
            same += 1
        del self.stack[same + 1:]
        for k in range(same, len(ids)):
            above = self.stack[-1]
            self.stack.append(len(self.keys))
            self.depth.append(k + 1)
            self.size.append(sizes[k])
            self.parent.append(above)
            self.from_conv.append(len(self.convs))
            self.keys.append(xxhash.xxh3_128_digest(self.keys[above] + ids[k]))
        if not self.convs:
            self.first_path = len(self.stack)
        self.ids = ids
        self.convs.append(conv_id)
        self.end.append(self.stack[-1])

    def smallest(self, parent: np.ndarray, first_end: np.ndarray) -> np.ndarray:
        """The smallest conversation id below each node, from that of those that end there."""
        least = first_end.tolist()
        for k, above in zip(range(len(least) - 1, 0, -1), parent[:0:-1].tolist()):
            if least[k] < least[above]:
                least[above] = least[k]
        return np.array(least, dtype=np.int64)

    def parts(self) -> Iterator[pa.RecordBatch]:
        depth, size, parent, from_conv, convs, end = (np.array(x, dtype=np.int64) for x in (self.depth, self.size, self.parent, self.from_conv, self.convs, self.end))
        n = len(depth)
        tree = Parentheses(depth)
        close = tree.findclose()
        after = np.arange(n) + (close - tree.opens + 1) // 2
        members = np.append(from_conv, len(convs))[after] - from_conv
        saved = np.concatenate([[0], np.cumsum((members - 1) * size)])
        runs = np.flatnonzero(np.diff(end, prepend=-1))  # copies of one conversation stand together
        bounds = np.append(runs, len(end))
        first_end = np.full(n, np.iinfo(np.int64).max, dtype=np.int64)
        first_end[end[runs]] = convs[runs]
        least = self.smallest(parent, first_end)
        spine = np.zeros(n, dtype=bool)
        spine[:self.first_path] = True
        spine[self.stack] = True
        spine &= depth <= KEY_TURNS
        for k in np.flatnonzero(spine & (depth == KEY_TURNS)):
            spine[k:after[k]] = True
        ends = np.full(n, NO_ENDS, dtype=object)
        split: list[tuple[bytes, int, str]] = []  # (key, first id, ids): copies in other shards have all smaller or all larger ids
        for a, b in zip(bounds[:-1], bounds[1:]):
            node, ids = end[a], convs[a:b].tolist()
            if spine[node]:
                split.extend((self.keys[node], ids[k], ",".join(map(str, ids[k:k + ROWS]))) for k in range(0, len(ids), ROWS))
            else:
                ends[node] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        top = self.tops(depth, parent)
        under_spine = np.zeros(n, dtype=bool)
        under_spine[1:] = spine[parent[1:]]
        keyed = np.array(self.keys, dtype=object)
        leaves, children = tree.leaves(close), np.bincount(parent[1:], minlength=n)

        def batch(kind: int, at: np.ndarray) -> pa.RecordBatch:
            own = kind == SPINE
            columns = {
                "kind": np.full(len(at), kind), "key": keyed[at] if own else [None] * len(at),
                "parent": [self.keys[p] if u else None for p, u in zip(parent[at], under_spine[at])], "top": [self.keys[t] if t >= 0 else ROOT for t in top[at]] if own else [None] * len(at),
                "depth": depth[at], "conv_id": least[at], "parent_conv_id": pa.array(least[parent[at]], mask=parent[at] < 0), "n_convs": members[at], "n_children": children[at],
                "n_leaves": leaves[at], "saved_tokens": (saved[after] - saved[:-1])[at], "size": size[at], "ends_sha256": ends[at]}
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in ARROW], schema=ARROW)

        for kind, mask in ((FINAL, ~spine), (SPINE, spine)):
            where = np.flatnonzero(mask)
            for k in range(0, len(where), ROWS):
                yield batch(kind, where[k:k + ROWS])
        for one in split:
            some = dict(zip(("kind", "key", "conv_id", "ends_sha256"), (END, *one)))
            yield pa.RecordBatch.from_pylist([some], schema=ARROW)

    def tops(self, depth: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Each node's ancestor of depth one, -1 for the root: the last such node before it in preorder."""
        firsts = np.where(depth == 1, np.arange(len(depth)), -1)
        out = np.maximum.accumulate(firsts)
        out[0] = -1
        return out


def shard_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = Shard()
    for batch in batches:
        for conv_id, ids, sizes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            shard.add(conv_id, ids, sizes)
    if shard.convs:
        yield from shard.parts()


def paths(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, sizes) of every rebuilt conversation; the ``BASES`` conversations that share a base make one group."""
    empty = F.lit("")
    said, words = F.coalesce(F.col(role), empty), F.coalesce(F.col(text), empty)
    id_ = F.unhex(F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, words)))
    c = F.col(conv_id).cast("long")
    one = F.struct(c.alias("c"), F.col(turn).alias("turn"), id_.alias("id"), F.octet_length(words).alias("size"))
    families = rows.where(c.isNotNull()).select((c - F.pmod(c, F.lit(BASES))).alias("base"), one.alias("one")).groupBy("base").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    each = families.select("base", "turns", F.filter("turns", lambda t: t["c"] == F.col("base")).alias("head"), F.explode(F.array_distinct("turns.c")).alias("conv_id"))
    own = each.select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).cast("int").alias("h"), "head", F.filter("turns", lambda t: t["c"] == F.col("conv_id")).alias("own"))
    whole = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return own.select("conv_id", whole.alias("whole")).select("conv_id", F.col("whole.id").alias("ids"), F.col("whole.size").alias("sizes"))


def merged_group(group: pd.DataFrame) -> pd.DataFrame:
    """Spine nodes below one first turn: what shards counted once more is taken back, from the deepest up."""
    group = group.sort_values("depth", ascending=False, kind="stable").reset_index(drop=True)
    place = {bytes(k): i for i, k in enumerate(group["key"])}
    saved, leaves, children = (group[c].tolist() for c in ("saved_tokens", "n_leaves", "n_children"))
    more_saved = ((group["shards"] - 1) * group["size"]).tolist()
    more_leaves = ((group["n_children"] == 0).astype(int) - group["local_leaves"]).tolist()
    for k, (above, shards) in enumerate(zip(group["parent"], group["shards"])):
        p = place.get(bytes(above)) if above is not None else None
        if p is not None:
            more_saved[p] += more_saved[k]
            more_leaves[p] += more_leaves[k]
            children[p] -= shards - 1
    group["more_saved"], group["more_leaves"], group["n_children"] = more_saved, more_leaves, children
    group["saved_tokens"] = [x + y for x, y in zip(saved, more_saved)]
    group["n_leaves"] = [x + y for x, y in zip(leaves, more_leaves)]
    return group


def end_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, ends_sha256), from rows (key, ids) in order, where ids are joined already."""
    at, digest = None, None
    for batch in batches:
        done = []
        for key, ids in zip(map(bytes, batch["key"]), batch["ids"]):
            if key != at:
                if digest:
                    done.append((at, digest.hexdigest()))
                at, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if digest:
        yield pd.DataFrame([(at, digest.hexdigest())], columns=["key", "ends_sha256"])


def merged_spines(parts: DataFrame) -> DataFrame:
    """One row a spine node, with its totals over all shards."""
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spine = parts.where(F.col("kind") == SPINE).groupBy("key").agg(
        *[F.max(c).alias(c) for c in ("parent", "top", "depth", "size")], F.min("conv_id").alias("conv_id"), *total, F.count(F.lit(1)).alias("shards"), F.count_if(F.col("n_children") == 0).alias("local_leaves"))
    schema = ", ".join(f"{n} {t}" for n, t in [*spine.dtypes, ("more_saved", "bigint"), ("more_leaves", "bigint")])
    below = materialize(spine.where("depth > 0").groupBy("top").applyInPandas(lambda group: merged_group(group), schema), "trie-spine")
    taken = lambda c: below.where("depth = 1").agg(F.coalesce(F.sum(c), F.lit(0))).scalar()
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0) - F.col("local_leaves")
    root = spine.where("depth = 0").select("key", "parent", "depth", "conv_id", "n_convs", (F.col("n_children") - taken(F.col("shards") - 1)).alias("n_children"),
                                           (F.col("n_leaves") + taken("more_leaves") + leaf).alias("n_leaves"), (F.col("saved_tokens") + taken("more_saved")).alias("saved_tokens"))
    return below.select(*root.columns).unionByName(root)


def trie_nodes(rebuilt: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, ids, sizes)."""
    key = [F.slice("ids", 1, KEY_TURNS), F.xxhash64("ids"), F.col("conv_id")]
    shards = materialize(rebuilt, "trie-paths").repartitionByRange(*key).sortWithinPartitions("ids", "conv_id")
    parts = materialize(shards.select("conv_id", "ids", "sizes").mapInArrow(shard_parts, PART), "trie-parts")
    spine = merged_spines(parts)
    runs = parts.where(F.col("kind") == END).select("key", "conv_id", F.col("ends_sha256").alias("ids")).repartition("key").sortWithinPartitions("key", "conv_id")
    ended = runs.select("key", "ids").mapInPandas(end_digests, "key binary, ends_sha256 string")
    spine = materialize(spine.join(ended, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "trie-merged")
    final = parts.where(F.col("kind") == FINAL)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = spine.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hung = final.where("parent is not null").select("parent", *[c for c in columns if c != "parent_conv_id"]).unionByName(spine.select("parent", *[c for c in columns if c != "parent_conv_id"]))
    return final.where("parent is null").select(*columns).unionByName(hung.join(above, "parent", "left").select(*columns))


def conversation_trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a node: its smallest conversation and depth (its key), its parent's, and the counts of its subtree."""
    return trie_nodes(paths(rows, conv_id, turn, role, text))


def trie_sql() -> str:
    """The same nodes from prefix strings and all (node, ancestor) pairs, in DuckDB."""
    shift = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {shift}), 4294967295)"
    return f"""
WITH filled AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS k FROM filled),
cuts AS (SELECT DISTINCT conv_id, conv_id - ((conv_id % {BASES}) + {BASES}) % {BASES} AS base, {crc} % {MOST_SHARED} AS h FROM filled),
joined AS (SELECT c.conv_id, 0 AS own, t.k, t.id, t.size FROM cuts c JOIN turns t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL SELECT c.conv_id, 1, t.k, t.id, t.size FROM cuts c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h),
steps AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(id, '') OVER w AS path, size FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY own, k)),
seen AS (SELECT conv_id, depth, path, size FROM steps UNION ALL SELECT conv_id, 0, '', 0 FROM cuts),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM seen),
nodes AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM ended GROUP BY path),
children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
below AS (SELECT left(path, 32 * unnest(range(depth + 1))::INTEGER) AS path, n_children, saved FROM counted),
sums AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s USING (path) LEFT JOIN counted p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)"""
