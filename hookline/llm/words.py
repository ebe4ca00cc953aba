"""Words of whole texts as numbers: Arrow splits, each distinct word of a block is hashed once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PATTERN = r"[^\x20\x09-\x0D]+"


@dataclass
class Words:
    """Words of some texts: ``codes`` into ``dictionary``, text k owning ``bounds[k]:bounds[k + 1]``."""

    codes: np.ndarray
    bounds: np.ndarray
    dictionary: pa.Array
    low: np.ndarray  # 64-bit hashes of the words
    high: np.ndarray  # another 64 bits

    def texts_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words_of(texts: pa.Array | pa.ChunkedArray) -> Words:
    """Split at ASCII white space (\\x20, \\x09-\\x0D); null texts have no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets)
    flat = lists.flatten().dictionary_encode()
    codes = np.asarray(flat.indices)
    dictionary = flat.dictionary
    real = np.asarray(pc.greater(pc.binary_length(dictionary), 0))  # an empty piece stands before or after white space
    keep = real[codes] if len(codes) else np.zeros(0, dtype=bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    both = [xxhash.xxh3_128_intdigest(w) for w in dictionary.cast(pa.large_binary()).to_pylist()]
    mask = (1 << 64) - 1
    low = np.fromiter((x & mask for x in both), dtype=np.uint64, count=len(both))
    high = np.fromiter((x >> 64 for x in both), dtype=np.uint64, count=len(both))
    codes = codes[keep]
    return Words(codes, before[offsets - offsets[0]], dictionary, low[codes], high[codes])


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same everywhere."""
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k}") | 1 for k in range(n)], dtype=np.uint64)


def window_hashes(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the ``width`` words from each position (no regard to text ends)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k, m in enumerate(multipliers(width, seed)):
        out += hashes[k:k + n] * m
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out
