"""Enrichment joins J1 (domain registry), J2 (certificates), J4 (page content).

Each lookup runs on the *distinct* keys of the input first (pre-aggregated,
so a host that holds a third of the rows is looked up once); the caller joins
the small per-key result back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from hookline.functions.url import once



def day_floor(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, floored (as ``timedelta.days``)."""
    secs = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(secs / F.lit(86_400_000_000)).cast("bigint")


def parent_suffixes(key: Column, min_labels: int = 2, max_labels: Column | None = None) -> Column:
    """'a.b.c.d' -> ['a.b.c.d', 'b.c.d', 'c.d'] (the host and each parent with
    at least ``min_labels`` labels). A registry of registered domains never
    holds a bare top-level label, and leaving it out keeps ``com`` from
    becoming one join key shared by nearly every host. ``max_labels`` is the
    label count of the longest registry domain: longer suffixes match nothing,
    so a host of very many labels does not expand into all of its parents."""
    parts = F.split(key, r"[.]", -1)
    n = F.size(parts)
    last = F.greatest(n - min_labels + 1, F.lit(1))
    first = F.lit(1) if max_labels is None else F.least(F.greatest(n - max_labels + 1, F.lit(1)), last)
    return F.transform(F.sequence(first, last),
                       lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def as_time(registry: DataFrame, name: str) -> Column:
    """A registry date as a timestamp: a timestamp, ``YYYY-MM-DD`` text, or a list of either (the first counts)."""
    c, kind = F.col(name), registry.schema[name].dataType
    if isinstance(kind, ArrayType):
        c, kind = F.get(c, F.lit(0)), kind.elementType
    if isinstance(kind, StringType):
        return F.when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_timestamp(c, F.lit("yyyy-M-d")))
    return c.cast("timestamp")


def registry_features(keys: DataFrame, registry: DataFrame, as_of: Column,
                      key: str = "registry_key", min_labels: int = 2) -> DataFrame:
    """Per distinct key: domain_age_days, domain_registration_length.

    Longest registry domain that equals the key or one of its parents (with
    at least ``min_labels`` labels) wins.
    ``registry`` = (domain, creation_date, expiration_date); dates as in
    :func:`as_time`. Of several rows for one domain the earliest creation, then
    the latest expiry counts.
    """
    distinct_keys = keys.select(key).where(F.col(key).isNotNull() & (F.col(key) != "")).distinct()
    reg = registry.select(F.lower("domain").alias("domain"), as_time(registry, "creation_date").alias("creation_date"),
                          as_time(registry, "expiration_date").alias("expiration_date"))
    longest = registry.agg(F.max(F.size(F.split("domain", r"[.]", -1)))).scalar()
    cands = (distinct_keys.select(once(F.col(key)).alias(key), F.coalesce(longest, F.lit(1)).alias("_most"))
             .select(key, F.explode(parent_suffixes(F.col(key), min_labels, F.col("_most"))).alias("domain")))
    matched = cands.join(reg, "domain", "inner")
    order = F.struct(F.length("domain"), -F.coalesce(F.unix_micros("creation_date"), F.lit(1 << 62)),
                     F.coalesce(F.unix_micros("expiration_date"), F.lit(-(1 << 62))))
    best = matched.groupBy(key).agg(F.max_by(F.struct("creation_date", "expiration_date"), order).alias("r"))
    created = F.col("r.creation_date")
    expires = F.col("r.expiration_date")
    age = F.when(created.isNotNull(), day_floor(as_of, created).cast("double"))
    reg_len = F.when(created.isNotNull() & expires.isNotNull(),
                     day_floor(expires, created).cast("double"))
    return best.select(key, age.alias("domain_age_days"), reg_len.alias("domain_registration_length"))


def certificate_features(keys: DataFrame, certificates: DataFrame, as_of: Column,
                         key: str = "cert_host") -> DataFrame:
    """Per distinct host: cert_valid = a certificate covers ``as_of``."""
    distinct_keys = keys.select(key).where(F.col(key).isNotNull()).distinct()
    certs = certificates.select(F.lower("host").alias(key), "not_before", "not_after")
    valid = (certs.where((F.col("not_before") <= as_of) & (F.col("not_after") >= as_of))
             .select(key).distinct().withColumn("cert_valid", F.lit(True)))
    return distinct_keys.join(valid, key, "inner")
