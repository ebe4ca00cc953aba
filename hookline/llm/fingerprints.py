"""Document fingerprints: a digest of hashed byte-triplet counts.

The bytes of a text (two zero bytes before and after it) are read through a
window of five; six triplets of each window are hashed into 256 buckets. The
digest holds the length on a logarithmic scale and, for each bucket, which
quartile its count lies in. Two digests are compared by a bounded difference:
a step of one or two quartiles counts as much, a step of three counts 6, a
length step counts 2 up to 24; the sum is cut at the mean of two unrelated
digests. Likeness is 1 less the share of that bound.

``edited_fingerprints`` also builds each document's edited text, whose last
quarter comes from the start of the next document in the order of ids. Ids are
cut into buckets by approximate quantiles, each bucket gets the first document
of the next one as a look-ahead row, and sorted buckets stream through an Arrow
function that holds two documents at a time: one shuffle of the texts.

Edge cases: null text is empty; rows with a null id come first; equal ids are
ordered by text; the last row's next is the first row (a single row is its
own); an empty table gives no rows; equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))  # with the window's first byte
PAD = b"\0\0"
BOUND = 1.6 * BUCKETS  # what two digests with unrelated quartiles differ by, on average
LENGTH_STEP, LENGTH_MOST = 2.0, 24.0
STEP_COST = np.array([0, 1, 2, 6], dtype=np.int64)
BUCKET_CHARS = 16 << 20
MOST_BUCKETS = 10_000


def byte_table(salt: int) -> np.ndarray:
    """A 32-bit value for each byte, from a multiplicative hash."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt) * np.uint64(0xBF58476D1CE4E5B9))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


with np.errstate(over="ignore"):
    FIRST, SECOND, THIRD = (byte_table(k) for k in (1, 2, 3))
    SALTS = byte_table(4)[:len(TRIPLETS)]


def triplet_counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket."""
    if not data:
        return np.zeros(BUCKETS, dtype=np.int64)
    b = np.frombuffer(PAD + data + PAD, dtype=np.uint8)
    n = len(b) - 4
    one, two, three = FIRST[b[:n]], SECOND[b], THIRD[b]
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for salt, (x, y) in zip(SALTS, TRIPLETS, strict=True):
        h = one + two[x:x + n]
        h += three[y:y + n]
        h += salt
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(24)
        counts += np.bincount(h, minlength=BUCKETS)
    return counts


def fingerprint(text: str | None) -> str:
    """Digest as lowercase hex: length step (4 digits), then two bits a bucket."""
    data = (text or "").encode()
    counts = triplet_counts(data)
    ordered = np.sort(counts)
    quartiles = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = np.searchsorted(quartiles, counts, side="left").astype(np.uint8)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    step = int(round(np.log1p(len(data)) / np.log(1.1)))
    return f"{step:04x}{packed.tobytes().hex()}"


def quartile_codes(digest: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(digest[4:]), dtype=np.uint8)
    return np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for unrelated ones."""
    if a == b:
        return 1.0
    steps = np.abs(quartile_codes(a).astype(np.int64) - quartile_codes(b))
    length = min(LENGTH_MOST, LENGTH_STEP * abs(int(a[:4], 16) - int(b[:4], 16)))
    return float(1 - min(BOUND, STEP_COST[steps].sum() + length) / BOUND)


def fingerprint_column(text: Column) -> Column:
    make = F.pandas_udf(fingerprint_series, "string")
    return make(F.coalesce(text, F.lit("")))


def fingerprint_series(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype=object)


def edited_text(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def id_bounds(rows: DataFrame) -> list[int]:
    """At most MOST_BUCKETS ids that cut the documents into runs of about BUCKET_CHARS characters."""
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, min(MOST_BUCKETS, -(-total // BUCKET_CHARS)))
    if n == 1:
        return []
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    cuts = rows.agg(F.percentile_approx("doc_id", shares, F.lit(20 * n))).first()[0]
    return sorted(set(cuts or []))


def in_order(rows: DataFrame) -> DataFrame:
    """(bucket, ahead, doc_id, text): each bucket in order, its look-ahead row (ahead = 1) last."""
    bounds = np.array(id_bounds(rows), dtype=np.int64)
    lowest = F.lit(-(1 << 63))

    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="left").astype(np.int32))

    spot = F.pandas_udf(place, "int")
    own = rows.withColumn("bucket", spot(F.coalesce("doc_id", lowest)) if len(bounds) else F.lit(0))
    heads = {r["bucket"]: r["head"] for r in own.groupBy("bucket").agg(F.min(F.coalesce("doc_id", lowest)).alias("head")).collect()}
    order = sorted(heads)
    ahead = [(b, heads[order[(k + 1) % len(order)]]) for k, b in enumerate(order)]  # one row a bucket
    spark = rows.sparkSession
    wanted = spark.createDataFrame(ahead, "bucket int, head long")
    first = (rows.withColumn("head", F.coalesce("doc_id", lowest))
             .join(F.broadcast(wanted.select("head").distinct()), "head")
             .groupBy("head").agg(F.min("text").alias("text")))
    extra = wanted.join(first, "head").select("bucket", F.lit(1).alias("ahead"), F.col("head").alias("doc_id"), "text")
    every = own.select("bucket", F.lit(0).alias("ahead"), "doc_id", "text").unionByName(extra)
    return every.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.asc_nulls_first("doc_id"), "text")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pairs(batches):
        held = None  # (bucket, id, text, fingerprint) of the row before
        for batch in batches:
            out = []
            for part in range(0, batch.num_rows, 200):  # few texts as Python strings at a time
                some = batch.slice(part, 200)
                for bucket, ahead, doc, body in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    mark = fingerprint(body)
                    if held and held[0] == bucket:
                        edited = edited_text(held[2], body)
                        other = held[3] if edited == held[2] else fingerprint(edited)
                        out.append((held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), held[3], other,
                                    likeness(held[3], other), likeness(held[3], mark)))
                    held = None if ahead else (bucket, doc, body, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)

    return in_order(rows).mapInArrow(pairs, RESULT)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
