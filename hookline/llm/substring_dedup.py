"""Removal of repeated passages by difference-cover anchors.

A passage of ``window`` words that also starts in a document with a smaller id
is removed, word by word covered. To find such passages without moving every
window, only anchors are exchanged: runs of ``window - period + 1`` words that
start at positions whose remainder modulo ``period`` is in a difference cover.
For any two equal windows some shift below the period puts both on cover
positions, so they share an aligned anchor. Anchors found in more than one
document are then extended to the windows around them, and these are compared
by 128 bits of their words' hashes.

Documents are dealt into blocks by a hash of their id. Each block sends the
distinct hashes of its anchors to hash buckets (a passage that a third of all
documents share is one entry a block), the bucket answers with one bit per
entry, and likewise for windows, which carry the smallest id of the block.
Answers are bits, so what is shuffled is the texts once, 8 bytes per anchor
and 24 per window around a shared anchor. Block and bucket counts follow from
the total text size; nothing is collected.

Edge cases: null text has no words; a row with a null id is compared with
nothing and kept whole; rows with equal ids do not remove each other's words;
texts shorter than a window are kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookline.llm.words import PATTERN, Words, window_hashes, words_of

WINDOW = 13
# Smallest difference covers, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
BLOCK_BYTES = 8 << 20


def anchor_plan(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor width): the largest period that leaves anchors of over half a window."""
    period = max(p for p in COVERS if p <= (window + 1) // 2)
    return period, COVERS[period], window - period + 1


class Block:
    """Documents of one block with their word hashes, anchors and windows."""

    def __init__(self, ids: np.ndarray, words: Words, window: int) -> None:
        self.ids, self.words, self.window = ids, words, window
        self.period, self.cover, self.width = anchor_plan(window)
        self.text = words.texts_of()
        self.start = words.bounds[:-1][self.text]
        self.end = words.bounds[1:][self.text]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, positions) of the anchors at cover positions of texts that hold a window."""
        h = window_hashes(self.words.low, self.width, 1)
        at = np.arange(len(h))
        ok = np.isin((at - self.start[:len(h)]) % self.period, self.cover)
        ok &= (at + self.width <= self.end[:len(h)]) & (self.end[:len(h)] - self.start[:len(h)] >= self.window)
        return h[ok], at[ok]

    def distinct_anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, place of each anchor among them, positions, whether several documents of the block have it)."""
        h, at = self.anchors()
        own, place = np.unique(h, return_inverse=True)
        doc = self.ids[self.text[at]]
        low = np.full(len(own), np.iinfo(np.int64).max)
        high = np.full(len(own), np.iinfo(np.int64).min)
        np.minimum.at(low, place, doc)
        np.maximum.at(high, place, doc)
        return own, place, at, low < high

    def windows(self, shared: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows around shared anchors: (positions, place of each among the distinct ones, their hashes (n, 2), smallest ids)."""
        hit = at[shared[place]]
        mark = np.zeros(len(self.text) + 1, dtype=bool)
        for shift in range(self.period):
            p = hit - shift
            ok = p >= 0
            p, a = p[ok], hit[ok]
            mark[p[(p >= self.start[a]) & (p + self.window <= self.end[a])]] = True
        at = np.flatnonzero(mark)
        if not len(at):
            return at, at, np.zeros((0, 2), dtype=np.uint64), np.zeros(0, dtype=np.int64)
        low = window_hashes(self.words.low, self.window, 2)[at]
        high = window_hashes(self.words.high, self.window, 3)[at]
        order = np.lexsort((high, low))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        number = np.cumsum(new) - 1
        place = np.empty(len(order), dtype=np.int64)
        place[order] = number
        least = np.full(number[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, place, self.ids[self.text[at]])
        first = order[new]
        return at, place, np.column_stack([low[first], high[first]]), least


def block_of(table: pa.Table, window: int) -> Block:
    # the same order in every pass, whatever order the shuffle delivers
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return Block(table["doc_id"].to_numpy().astype(np.int64), words_of(table["text"]), window)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def sent(block: int, hashes: np.ndarray, buckets: int, extra: np.ndarray) -> pa.Table:
    """One row per bucket with the hashes (sorted by their first column) that belong to it."""
    lead = hashes if hashes.ndim == 1 else hashes[:, 0]
    bucket = (lead % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(order, edges) if len(order) else []
    return pa.table({
        "bucket": pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), "block": pa.array([block] * len(parts), pa.int64()),
        "hashes": pa.array([hashes[p].tobytes() for p in parts], pa.binary()),
        "extra": pa.array([extra[p].tobytes() for p in parts], pa.binary())})


def answers(table: pa.Table, kind: int, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    """One row per row of ``table``: a bit for each hash that the block sent."""
    cuts = np.cumsum(sizes)[:-1]
    return pa.table({"block": table["block"], "kind": pa.array([kind] * table.num_rows, pa.int32()), "bucket": table["bucket"],
                     "flags": pa.array([bits(f) for f in np.split(flags, cuts)], pa.binary())})


def received(replies: pa.Table, kind: int, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The answer for each hash, in the order of ``hashes``."""
    out = np.zeros(len(hashes), dtype=bool)
    if not len(hashes):
        return out
    lead = hashes if hashes.ndim == 1 else hashes[:, 0]
    bucket = (lead % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(buckets + 1))
    mine = replies.filter(pc.equal(replies["kind"], kind))
    for b, data in zip(mine["bucket"].to_pylist(), mine["flags"].to_pylist(), strict=True):
        part = order[first[b]:first[b + 1]]
        out[part] = unbits(data, len(part))
    return out


SENT = "bucket long, block long, hashes binary, extra binary"
REPLY = "block long, kind int, bucket long, flags binary"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = blocks
    dealt = rows.where(F.col("doc_id").isNotNull()).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    def send_anchors(key, table):
        own, _, _, many = block_of(table, window).distinct_anchors()
        return sent(key[0].as_py(), own, buckets, many.astype(np.uint8))

    def judge_anchors(key, table):
        parts = [np.frombuffer(x, dtype=np.uint64) for x in table["hashes"].to_pylist()]
        every = np.concatenate(parts)
        many = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in table["extra"].to_pylist()])
        _, place, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = count > 1
        np.logical_or.at(shared, place, many.astype(bool))
        return answers(table, 1, shared[place], [len(p) for p in parts])

    def around(block, replies):
        own, place, at, many = block.distinct_anchors()
        return block.windows(received(replies, 1, own, buckets), place, at)

    def send_windows(key, table, replies):
        _, _, hashes, least = around(block_of(table, window), replies)
        return sent(key[0].as_py(), hashes, buckets, least)

    def judge_windows(key, table):
        parts = [np.frombuffer(x, dtype=np.uint64).reshape(-1, 2) for x in table["hashes"].to_pylist()]
        every = np.concatenate(parts)
        least = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table["extra"].to_pylist()])
        order = np.lexsort((least, every[:, 1], every[:, 0]))
        ordered = every[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        first = least[order][new][np.cumsum(new) - 1]  # the smallest id that has the window
        earlier = np.empty(len(order), dtype=bool)
        earlier[order] = first < least[order]
        return answers(table, 2, earlier, [len(p) for p in parts])

    def remove(key, table, replies):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        block = block_of(table, window)
        at, place, hashes, least = around(block, replies)
        gone = np.zeros(len(block.text) + 1, dtype=np.int32)
        if len(at):
            earlier = received(replies, 2, hashes, buckets)
            hit = at[earlier[place] | (least[place] < block.ids[block.text[at]])]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
        keep = np.cumsum(gone)[:-1] == 0
        bounds = block.words.bounds
        kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
        words = block.words.dictionary.cast(pa.string()).take(pa.array(block.words.codes[keep]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words), " ")
        n = np.diff(bounds)
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.diff(kept), pa.int64()),
                         "kept_text": joined})

    by_block = dealt.groupBy("block")
    anchor_replies = by_block.applyInArrow(send_anchors, SENT).groupBy("bucket").applyInArrow(judge_anchors, REPLY)
    window_replies = (by_block.cogroup(anchor_replies.groupBy("block")).applyInArrow(send_windows, SENT)
                      .groupBy("bucket").applyInArrow(judge_windows, REPLY))
    replies = anchor_replies.unionByName(window_replies)
    done = by_block.cogroup(replies.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")
    words = F.regexp_extract_all("text", F.lit(PATTERN), 0)
    loose = rows.where(F.col("doc_id").isNull()).select("doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
                                                        F.array_join(words, " ").alias("kept_text"))
    return done.unionByName(loose)
