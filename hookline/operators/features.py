"""The URL feature job (F0-F33, F39-F42) over a table of URLs.

One narrow projection computes the parse struct and every local feature
inside whole-stage codegen; registry and certificate lookups are optional
joins on distinct keys (J1, J2). Rows whose url cannot be parsed keep their
place with null features and an ``error`` text instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from hookline.fixed import FEATURE_COLUMNS
from hookline.functions.brands import nearest_brand, typosquat_columns
from hookline.functions.url import lexical_columns, once, with_parsed
from hookline.operators.enrich import certificate_features, registry_features
from hookline.session import materialize

LOCAL_COLUMNS = [c for c in FEATURE_COLUMNS
                 if c not in ("has_valid_ssl", "domain_age_days", "domain_registration_length")]
SPREAD_KEYS = 4096  # keys over which rows without a lookup key are spread
PARSED_FIELDS = ["scheme", "netloc", "path", "host", "host_no_www", "main_label"]


def parsed(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds struct column ``p``."""
    return with_parsed(df, url_col, "p")


def local_features(df: DataFrame, url_col: str = "url", brands: list[str] | None = None,
                   keep_parsed: bool = False) -> DataFrame:
    """Input columns + 29 local features + closest_brand + error (+ ``p``)."""
    return parsed_features(parsed(df, url_col), df.columns, url_col, brands, keep_parsed)


def parsed_features(base: DataFrame, columns: list[str], url_col: str = "url", brands: list[str] | None = None,
                    keep_parsed: bool = False) -> DataFrame:
    """:func:`local_features` of rows that have their ``p`` already: ``columns`` + the features."""
    p = F.col("p")
    # own projection: four columns read the arg-min struct, and inside the
    # CASE guards below Catalyst would otherwise evaluate it once per use
    base = base.withColumn("_best", nearest_brand(p.main_label, brands))
    feats = lexical_columns(url_col, "p") + typosquat_columns(p.main_label, F.col("_best"))
    # one guard around the whole record (a CASE per column would repeat the
    # guard 30 times in the generated code)
    record = F.when(p.error.isNull(), F.struct(*[c.alias(name) for name, c in feats]))
    out = (base.select(*columns, record.alias("_f"), p.error.alias("error"), "p")
           .select(*columns, *[F.col("_f")[name].alias(name) for name, _ in feats], "error", "p"))
    return out if keep_parsed else out.drop("p")


def url_features(df: DataFrame, url_col: str = "url", *, registry: DataFrame | None = None,
                 certificates: DataFrame | None = None, as_of: Column | None = None,
                 brands: list[str] | None = None) -> DataFrame:
    """input columns + the 32 features in vector order + closest_brand + error.

    ``registry`` None -> domain_age_days/registration_length = -1 (F41);
    ``certificates`` None -> has_valid_ssl = 0 (no check possible).

    With lookups, both are resolved on the distinct (registry key, certificate
    host) pairs of the input, so a host that holds a third of the rows is looked
    up once, and one join brings the result back. The pairs are written once for
    all who read them. Only the input columns, the parsed url and
    the pair pass through that join; the features are computed after it. Spark
    picks the join and splits skewed pairs; rows without a pair are spread over
    keys that match nothing.
    """
    if registry is None and certificates is None:
        found = parsed(df, url_col).withColumns({"domain_age_days": F.lit(None).cast("double"), "domain_registration_length": F.lit(None).cast("double"),
                                "cert_valid": F.lit(None).cast("boolean")})
    else:
        if as_of is None:
            raise ValueError("as_of is required with registry or certificate snapshots")
        p = F.col("p")
        keyed = parsed(df, url_col).withColumns({
            "registry_key": once(F.when(p.error.isNull(), F.lower(p.host_no_www))),
            "cert_host": once(F.when(p.error.isNull() & (p.scheme == "https"), F.lower(p.host))),
        })
        pairs = materialize(keyed.select("registry_key", "cert_host").where("registry_key is not null").distinct(), "lookup-pairs")
        lookups = resolve_lookups(pairs, registry, certificates, as_of)
        nobody = F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD_KEYS)).cast("string"))
        found = (keyed.withColumns({"registry_key": F.coalesce("registry_key", nobody), "cert_host": F.coalesce("cert_host", F.lit(""))})
                 .join(lookups, ["registry_key", "cert_host"], "left").drop("registry_key", "cert_host"))
    feats = parsed_features(found, [c for c in found.columns if c != "p"], url_col, brands, keep_parsed=True)
    ok = F.col("error").isNull()
    ssl = F.when((F.col("p.scheme") == "https") & F.col("cert_valid"), F.lit(1.0)).otherwise(F.lit(0.0))
    feats = feats.withColumns({
        "domain_age_days": F.when(ok, F.coalesce("domain_age_days", F.lit(-1.0))),
        "domain_registration_length": F.when(ok, F.coalesce("domain_registration_length", F.lit(-1.0))),
        "has_valid_ssl": F.when(ok, ssl),
    })
    return feats.select(*df.columns, *FEATURE_COLUMNS, "closest_brand", "error")


def resolve_lookups(pairs: DataFrame, registry: DataFrame | None, certificates: DataFrame | None, as_of: Column) -> DataFrame:
    """(registry_key, cert_host, domain_age_days, domain_registration_length, cert_valid) for distinct pairs; '' stands for no certificate host."""
    out = pairs
    if registry is not None:
        out = out.join(registry_features(pairs, registry, as_of), "registry_key", "left")
    else:
        out = out.withColumns({"domain_age_days": F.lit(None).cast("double"), "domain_registration_length": F.lit(None).cast("double")})
    if certificates is not None:
        out = out.join(certificate_features(pairs, certificates, as_of), "cert_host", "left")
    else:
        out = out.withColumn("cert_valid", F.lit(None).cast("boolean"))
    return out.withColumn("cert_host", F.coalesce("cert_host", F.lit("")))


def numeric_feature_columns(df: DataFrame, exclude: tuple[str, ...] = ("id", "label")) -> list[str]:
    """int/float fields only, in frame order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]
