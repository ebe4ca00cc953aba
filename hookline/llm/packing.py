"""Packing token ids into sequences by the sum-of-squares rule.

Each task packs the documents of its partition as a stream, so nothing is
shuffled. A document's ids fill whole sequences first; what is left (fewer
than ``size`` ids) goes on one partially filled window or an empty one: the
one for which the sum over all levels h of N(h)**2 is smallest afterwards,
where N(h) counts the open windows filled up to level h (the level array).
Full windows leave the task at once. At its end the windows still open are
emptied into each other: their pieces, longest window first, are poured into
whole sequences, and the last rest is cut into sequences whose lengths are
powers of two, so that no sequence needs padding.

Sequence ids are (partition number << 40) + a counter, so they are unique and
the same when a lost task runs again on the same input.

Edge cases: a null or empty text has the end id only; repeated rows are packed
each; a null id is kept as it is; an empty table gives no rows; very long texts
are cut; the open windows are what a task holds besides one batch.
"""

from __future__ import annotations

import os
from collections import defaultdict
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 2048
END_ID = 1
CACHE_WORDS = 1_000_000
SLICE_BYTES = 16 << 20  # of text at a time; arrays of its words take several times as much


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One cache for all tasks of a Python worker."""
    return WordTokens(path)


class WordTokens:
    """Ids of texts, by a cache of words.

    The vocabulary's pre-tokenizer drops white space, so no id spans two words
    and a text's ids are those of its words in order. Words are cut at ASCII
    white space by Arrow, encoded once, and looked up by number after that.
    """

    def __init__(self, path: str) -> None:
        self.encode = tokenizer(path).encode_batch_fast
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.first = np.zeros(1 << 14, dtype=np.int32)  # where a word's ids begin in flat; the next word's beginning is their end
        self.used = 0

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        for at in range(0, len(words), 2000):
            some = words[at:at + 2000]
            ids = [e.ids for e in self.encode(some, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
            new = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum()))
            n = len(self.known)
            if self.used + len(new) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * (self.used + len(new)))
            if n + len(some) + 1 > len(self.first):
                self.first = np.resize(self.first, 2 * (n + len(some) + 1))
            self.flat[self.used:self.used + len(new)] = new
            self.first[n + 1:n + 1 + len(some)] = self.used + np.cumsum(sizes)
            self.known.update(zip(some, range(n, n + len(some)), strict=True))
            self.used += len(new)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, offsets per text), without end ids."""
        lists = pc.ascii_split_whitespace(column.cast(pa.large_string()))
        words = lists.flatten().dictionary_encode()
        bounds = lists.offsets.to_numpy()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > CACHE_WORDS:
            self.forget()
        self.learn([w for w in distinct if w not in self.known])
        number = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int32, count=len(distinct))
        code = number[words.indices.to_numpy()]
        begin = self.first[code]
        n = self.first[code + 1] - begin
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        take = np.repeat(begin - ends[:-1].astype(np.int32), n)
        take += np.arange(ends[-1], dtype=np.int32)
        return self.flat[take], ends[bounds - bounds[0]]


class Packer:
    """Windows of one task: level counts and the open windows of each level."""

    def __init__(self, size: int, first: int) -> None:
        self.size, self.next = size, first
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def level_for(self, n: int) -> int:
        """The fill level (0: a new window) whose choice leaves the least sum of squares."""
        top = self.size - n
        counts = self.levels[:top + 1]
        after = self.levels[n:self.size + 1]
        # taking a window from h to h+n changes the sum by -2N(h)+1 and +2N(h+n)+1; level 0 and a full window do not count
        change = 2 * after + 1 - 2 * counts + 1
        change[0] = 2 * after[0] + 1
        change[top] = (1 - 2 * counts[top]) if top else 0
        change[1:][counts[1:] == 0] = np.iinfo(np.int64).max
        best = change.min()
        return int(np.flatnonzero(change == best)[-1])  # ties: the fullest window

    def place(self, piece: tuple) -> list[tuple]:
        """Put (doc, start, ids, doc_tokens) away; the rows of a window that it fills."""
        n = len(piece[2])
        h = self.level_for(n)
        if h:
            window = self.open[h].pop()
            self.levels[h] -= 1
        else:
            window = []
        window.append(piece)
        if h + n == self.size:
            return self.rows(window)
        self.open[h + n].append(window)
        self.levels[h + n] += 1
        return []

    def rows(self, window: list[tuple]) -> list[tuple]:
        number, offset, out = self.sequence(), 0, []
        for doc, start, ids, total in window:
            out.append((doc, start, ids, total, number, offset))
            offset += len(ids)
        return out

    def rest(self):
        """Rows of the windows still open, poured together."""
        window, filled = [], 0
        for h in sorted(self.open, reverse=True):
            for pieces in self.open[h]:
                for doc, start, ids, total in pieces:
                    while len(ids):
                        some = ids[:self.size - filled]
                        window.append((doc, start, some, total))
                        filled += len(some)
                        start, ids = start + len(some), ids[len(some):]
                        if filled == self.size:
                            yield from self.rows(window)
                            window, filled = [], 0
        self.open.clear()
        while filled:
            part = 1 << (filled.bit_length() - 1)
            now, later, got = [], [], 0
            for doc, start, ids, total in window:
                here = ids[:part - got]
                if len(here):
                    now.append((doc, start, here, total))
                    got += len(here)
                if len(here) < len(ids):
                    later.append((doc, start + len(here), ids[len(here):], total))
            yield from self.rows(now)
            window, filled = later, filled - part


def slices(batch: pa.RecordBatch, text_bytes: int = SLICE_BYTES):
    """The batch in runs of rows with about ``text_bytes`` of text each."""
    sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // text_bytes)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID, checksums: bool = False,
                   keep_cache: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers; with
    ``checksums`` their CRC-32 stands there instead (``ids_crc32``), and no ids leave the task.
    Without ``keep_cache`` a Python worker forgets its words after each task: slower,
    but it leaves the memory to the other jobs of the application. So do fewer
    ``slice_bytes``: that much text is cut into words at a time. Pieces are the same.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = "ids_crc32 long" if checksums else "ids binary"
    schema = f"doc_id {kind}, start long, length long, {held}, doc_tokens long, sequence_id long, offset long"

    def pack(batches):
        words = word_tokens(vocabulary)
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        id_type = None

        def table(out):
            doc, start, ids, total, number, offset = zip(*out, strict=True)
            little = [np.ascontiguousarray(x, dtype="<u4") for x in ids]
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, id_type), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([crc32(x) for x in little], pa.int64()) if checksums else pa.array([x.tobytes() for x in little], pa.binary()), pa.array(total, pa.int64()),
                 pa.array(number, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "start", "length", held.split()[0], "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.column(0).type
            for some in slices(batch, slice_bytes):
                ids, bounds = words.texts(some.column(1))
                out = []
                for k, doc in enumerate(some.column(0).to_pylist()):
                    own = np.append(ids[bounds[k]:bounds[k + 1]], np.uint32(end_id))
                    total = len(own)
                    whole = total - total % size
                    for start in range(0, whole, size):
                        out += packer.rows([(doc, start, own[start:start + size], total)])
                    if whole < total:
                        out += packer.place((doc, whole, own[whole:], total))
                if out:
                    yield table(out)
        out = []
        for row in packer.rest():
            out.append(row)
            if len(out) >= 2000:
                yield table(out)
                out = []
        if out:
            yield table(out)
        if not keep_cache:
            words.forget()
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(pack, schema)


def packed_pieces(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """``pack_documents`` with the checksum of each piece's ids in place of the ids."""
    return pack_documents(docs, vocabulary, checksums=True, **options)
