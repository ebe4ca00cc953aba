"""DuckDB SQL for every SQL-checkable query in the catalog.

Each statement rebuilds the derived corpus from the raw views (``pages``,
``events``) with the same arithmetic as ``hookline.sources.corpus`` and then
computes the query independently with DuckDB functions. The SQL is the
correctness oracle; it shares only fixed values (brand list, thresholds,
tag patterns) with the Spark jobs, no execution code.
Notes: DuckDB ``levenshtein`` counts bytes, so the corpus keeps hosts ASCII.
"""

from __future__ import annotations

import unicodedata

from hookline.fixed import BRANDS, FEATURE_COLUMNS, PARAM_SCHEMES
from hookline.sources import corpus as C

LOCAL = [c for c in FEATURE_COLUMNS
         if c not in ("has_valid_ssl", "domain_age_days", "domain_registration_length")]
INT_FEATURES = {"url_length", "domain_length", "path_length", "num_subdomains",
                "at_count", "double_slash_count", "dash_count", "dot_count",
                "underscore_count", "question_count", "equal_count", "ampersand_count",
                "exclamation_count", "space_count", "tilde_count", "comma_count",
                "plus_count", "asterisk_count", "hash_count", "dollar_count", "percent_count"}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(values) -> str:
    return ", ".join(_q(v) for v in values)


def _case_pick(values, idx_expr: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"CASE {idx_expr} {whens} END"


def md5int(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"


BRAND_VALUES = ", ".join(f"({i}, {_q(b)})" for i, b in enumerate(BRANDS))
N = C.N_TEMPLATES


def corpus_ctes() -> str:
    """brands, url_corpus(id, url, label, label_text)."""
    spam = _q(C.SPAM_HOST_PATTERN)
    phishy = ", ".join(str(k) for k in C.PHISHY_TEMPLATES)
    nb = len(BRANDS)
    return f"""
brands AS (SELECT * FROM (VALUES {BRAND_VALUES}) t(brand_idx, brand)),
pg0 AS (
  SELECT page_id, url,
         regexp_extract(url, '^([A-Za-z]+)://', 1) AS s,
         regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS h,
         regexp_replace(url, '^[A-Za-z]+://[^/?#]*', '') AS r,
         page_id % {N} AS k, page_id // {N} AS g
  FROM pages),
pg1 AS (
  SELECT pg0.*, brands.brand AS b, {_case_pick(C.BRAND_WORDS, f'g % {len(C.BRAND_WORDS)}')} AS w
  FROM pg0 JOIN brands ON brands.brand_idx = pg0.g % {nb}),
pg2 AS (
  SELECT *, CASE g % 4 WHEN 0 THEN replace(b, 'o', '0') WHEN 1 THEN replace(b, 'l', '1')
                       WHEN 2 THEN b || 's' ELSE substr(b, 2) END AS look
  FROM pg1),
url_corpus AS (
  SELECT CAST(page_id AS BIGINT) AS id,
    CASE k WHEN 0 THEN url
      WHEN 1 THEN 'http://' || look || '.com' || r
      WHEN 2 THEN 'https://www.' || b || '.com' || r
      WHEN 3 THEN 'http://' || CAST(page_id % 223 + 1 AS VARCHAR) || '.' || CAST(page_id * 7 % 256 AS VARCHAR)
                  || '.' || CAST(page_id * 13 % 256 AS VARCHAR) || '.' || CAST(page_id * 31 % 256 AS VARCHAR) || r
      WHEN 4 THEN 'http://' || b || '.com@' || h || r
      WHEN 5 THEN s || '://' || h || ':8443' || r
      WHEN 6 THEN 'http://' || b || '.login.secure.account.' || h || r
      WHEN 7 THEN h || r
      WHEN 8 THEN ' ' || s || '://' || h || chr(9) || r || ' a%20b'
      WHEN 9 THEN 'http://' || replace({_case_pick(C.REFUSED_HOSTS, f'(g % {len(C.REFUSED_HOSTS)})')}, '{{h}}', h) || r
      WHEN 10 THEN '   '
      WHEN 11 THEN NULL
      WHEN 12 THEN upper(s) || '://WWW.' || upper(h) || r
      WHEN 13 THEN 'https://' || look || '-' || w || '.com' || r
      WHEN 14 THEN 'http://https-' || b || '.co.uk' || r
      ELSE s || '://' || h || '//http://' || look || '.com' || r END AS url,
    CAST(CASE WHEN k IN ({phishy}) OR regexp_matches(h, {spam}) THEN 1 ELSE 0 END AS INTEGER) AS label,
    CASE WHEN k IN ({phishy}) OR regexp_matches(h, {spam})
         THEN {_case_pick(C.POSITIVE_LABEL_TEXT, f'g % {len(C.POSITIVE_LABEL_TEXT)}')}
         ELSE {_case_pick(C.NEGATIVE_LABEL_TEXT, f'g % {len(C.NEGATIVE_LABEL_TEXT)}')} END AS label_text
  FROM pg2)"""


def ipv6_pattern() -> str:
    """Every shape of an IPv6 address spelled out: with n groups before ``::``, at most 7 - n after it."""
    h, v4 = "[0-9A-Fa-f]{1,4}", r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    shapes = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{v4}"]
    for n in range(8):
        before = f"{h}(?::{h}){{{n - 1}}}" if n else ""
        after = [""] + [f"{h}(?::{h}){{0,{6 - n}}}"] * (n < 7) + [f"(?:{h}:){{0,{5 - n}}}{v4}"] * (n < 6)
        shapes.append(f"{before}::(?:{'|'.join(after)})")
    return f"^(?:{'|'.join(shapes)})(?:%[^%]+)?$"


def unsafe_in_hosts() -> str:
    """Characters that NFKC turns into text with a delimiter, found in the Unicode tables."""
    return "".join(c for c in map(chr, range(128, 0x110000)) if set("/?#@:") & set(unicodedata.normalize("NFKC", c)))


IPV6, UNSAFE = ipv6_pattern(), unsafe_in_hosts()


def parse_ctes(src: str, out: str = "parsed") -> str:
    """{out}(..src columns.., scheme, netloc, path, host, host_no_www, main_label, error)."""
    schemes = _in_list(PARAM_SCHEMES)
    inner = "split_part(substr(netloc, strpos(netloc, '[') + 1), ']', 1)"
    return rf"""
{out}_a AS (
  SELECT *, regexp_replace(regexp_replace(url, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g') AS c_
  FROM {src}),
{out}_b AS (
  SELECT *, lower(regexp_replace(regexp_extract(c_, '^([A-Za-z][A-Za-z0-9+.\-]*:)', 1), ':$', '')) AS scheme,
         regexp_replace(c_, '^[A-Za-z][A-Za-z0-9+.\-]*:', '') AS rest_
  FROM {out}_a),
{out}_c AS (
  SELECT *, regexp_extract(rest_, '^//([^/?#]*)', 1) AS netloc,
         regexp_extract(regexp_replace(rest_, '^//[^/?#]*', ''), '^([^?#]*)', 1) AS path_q_
  FROM {out}_b),
{out}_d AS (
  SELECT *, CASE WHEN scheme IN ({schemes}) THEN regexp_replace(path_q_, ';[^/]*\z', '') ELSE path_q_ END AS path,
         split_part(netloc, ':', 1) AS host,
         CASE WHEN starts_with(split_part(lower(netloc), ':', 1), 'www.')
              THEN substr(split_part(lower(netloc), ':', 1), 5) ELSE split_part(lower(netloc), ':', 1) END AS lhost_
  FROM {out}_c),
{out} AS (
  SELECT *, CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE host END AS host_no_www,
         CASE WHEN len(string_split(lhost_, '.')) > 2 THEN string_split(lhost_, '.')[len(string_split(lhost_, '.')) - 1]
              WHEN len(string_split(lhost_, '.')) = 2 THEN string_split(lhost_, '.')[1]
              ELSE lhost_ END AS main_label,
         CASE WHEN url IS NULL THEN 'missing url'
              WHEN contains(netloc, '[') <> contains(netloc, ']') THEN 'Invalid IPv6 URL'
              WHEN contains(netloc, '[') AND starts_with({inner}, 'v') AND NOT regexp_matches({inner}, '(?i)^v[a-f0-9]+[.].') THEN 'IPvFuture address is invalid'
              WHEN contains(netloc, '[') AND len(string_split({inner}, '.')) = 4 AND list_bool_and(list_transform(string_split({inner}, '.'),
                lambda x: coalesce(TRY_CAST(x AS INTEGER)::VARCHAR = x AND TRY_CAST(x AS INTEGER) BETWEEN 0 AND 255, false))) THEN 'An IPv4 address cannot be in brackets'
              WHEN contains(netloc, '[') AND NOT starts_with({inner}, 'v') AND NOT regexp_matches({inner}, '{IPV6}')
                THEN '''' || {inner} || ''' does not appear to be an IPv4 or IPv6 address'
              WHEN regexp_matches(netloc, '[{UNSAFE}]') THEN 'netloc ''' || netloc || ''' contains invalid characters under NFKC normalization' END AS error
  FROM {out}_d)"""


def _count(ch: str) -> str:
    n = len(ch)
    body = f"(length(url) - length(replace(url, {_q(ch)}, '')))"
    return body if n == 1 else f"({body} // {n})"


CHAR_SQL = {
    "at_count": _count("@"), "double_slash_count": _count("//"), "dash_count": _count("-"),
    "dot_count": _count("."), "underscore_count": _count("_"), "question_count": _count("?"),
    "equal_count": _count("="), "ampersand_count": _count("&"), "exclamation_count": _count("!"),
    "space_count": f"({_count(' ')} + {_count('%20')})", "tilde_count": _count("~"),
    "comma_count": _count(","), "plus_count": _count("+"), "asterisk_count": _count("*"),
    "hash_count": _count("#"), "dollar_count": _count("$"), "percent_count": _count("%"),
}
IP_HOST = r"^(\p{Nd}{1,3}\.){3}\p{Nd}{1,3}\z"
IP_ANY = r"(\p{Nd}{1,3}\.){3}\p{Nd}{1,3}"


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


LEXICAL_SQL = {
    "url_length": "length(url)",
    "domain_length": "length(netloc)",
    "path_length": "length(path)",
    **CHAR_SQL,
    "has_https": _flag("scheme = 'https'"),
    "https_in_domain": _flag("contains(lower(netloc), 'https')"),
    "has_ip_address": _flag(f"regexp_matches(host, '{IP_HOST}')"),
    "ip_in_url": _flag(f"regexp_matches(url, '{IP_ANY}')"),
    "num_subdomains": "greatest(len(string_split(host_no_www, '.')) - 2, 0)",
    "has_www": _flag("starts_with(netloc, 'www.')"),
}


def _typed(name: str, expr: str) -> str:
    t = "INTEGER" if name in INT_FEATURES else "DOUBLE"
    return f"CAST(CASE WHEN error IS NULL THEN {expr} END AS {t}) AS {name}"


def local_ctes(src: str) -> str:
    """{src} -> parsed -> local(id.., 29 local features, closest_brand, error)."""
    lex = ",\n    ".join(_typed(n, LEXICAL_SQL[n]) for n in LEXICAL_SQL)
    return parse_ctes(src) + f""",
nearest AS (
  SELECT x.id, min(levenshtein(x.main_label, brands.brand)) AS dist,
         arg_min(brands.brand, levenshtein(x.main_label, brands.brand) * 1000 + brands.brand_idx) AS brand
  FROM parsed x CROSS JOIN brands WHERE x.main_label IS NOT NULL GROUP BY x.id),
local AS (
  SELECT parsed.*,
    {lex},
    CAST(CASE WHEN error IS NULL THEN nearest.dist END AS DOUBLE) AS levenshtein_distance,
    CAST(CASE WHEN error IS NULL THEN nearest.dist / greatest(length(main_label), 1) END AS DOUBLE) AS normalized_levenshtein,
    CAST(CASE WHEN error IS NULL THEN (CASE WHEN nearest.dist <= 2 AND length(main_label) > 3 THEN 1.0 ELSE 0.0 END) END AS DOUBLE) AS typosquatting_score,
    CASE WHEN error IS NULL THEN nearest.brand END AS closest_brand
  FROM parsed LEFT JOIN nearest ON parsed.id = nearest.id)"""


def snapshot_ctes() -> str:
    """registry(domain, created_sec, expires_sec), certs(host, valid) from url_corpus."""
    as_of_day = C.AS_OF_EPOCH // 86400
    return parse_ctes("url_corpus", "pc") + f""",
reg_keys AS (
  SELECT DISTINCT lower(host_no_www) AS key FROM pc
  WHERE lower(host_no_www) <> '' AND contains(lower(host_no_www), '.')),
reg_cands AS (
  SELECT DISTINCT domain FROM (
    SELECT array_to_string(list_slice(string_split(key, '.'), len(string_split(key, '.')) - 1,
                                      len(string_split(key, '.'))), '.') AS domain FROM reg_keys
    UNION ALL
    SELECT key FROM reg_keys WHERE {md5int('key')} % 3 = 0)),
reg_h AS (SELECT domain, {md5int('domain')} AS hv FROM reg_cands),
reg_d AS (
  SELECT domain, hv, (CASE WHEN hv % 5 = 0 THEN {as_of_day} - hv % 60 ELSE {C.EPOCH_DAY_2000} + hv % 9000 END) * 86400
                     + hv % 86400 AS created_sec
  FROM reg_h WHERE hv % 10 <> 0),
registry AS (
  SELECT domain, created_sec,
         CASE WHEN hv % 7 = 0 THEN NULL ELSE created_sec + (hv % 10 + 1) * 365 * 86400 END AS expires_sec
  FROM reg_d),
cert_hosts AS (SELECT DISTINCT lower(host) AS host FROM pc WHERE scheme = 'https' AND lower(host) <> ''),
cert_h AS (SELECT host, {md5int("'cert:' || host")} AS hv FROM cert_hosts),
certs AS (
  SELECT host, ({C.AS_OF_EPOCH} - (hv % 400) * 86400 <= {C.AS_OF_EPOCH}
            AND {C.AS_OF_EPOCH} - (hv % 400) * 86400 + (hv % 4 + 1) * 90 * 86400 >= {C.AS_OF_EPOCH}) AS valid
  FROM cert_h WHERE hv % 6 <> 0)"""


def full_ctes(src: str, registry: bool = True, certificates: bool = True) -> str:
    """local features of {src} + J1/J2 -> full(id.., 32 features, closest_brand, error)."""
    reg_sel = "CAST(-1.0 AS DOUBLE)"
    reg_len_sel = "CAST(-1.0 AS DOUBLE)"
    joins = ""
    if registry:
        reg_sel = f"CAST(coalesce(floor(({C.AS_OF_EPOCH} - rm.created_sec) / 86400.0), -1.0) AS DOUBLE)"
        reg_len_sel = ("CAST(coalesce(floor((rm.expires_sec - rm.created_sec) / 86400.0), -1.0) AS DOUBLE)")
        joins += " LEFT JOIN reg_match rm ON rm.key = lower(local.host_no_www)"
    ssl_sel = "0.0"
    if certificates:
        ssl_sel = "CASE WHEN local.scheme = 'https' AND coalesce(ct.valid, false) THEN 1.0 ELSE 0.0 END"
        joins += " LEFT JOIN certs ct ON ct.host = lower(local.host) AND local.scheme = 'https'"
    return local_ctes(src) + "," + snapshot_ctes() + f""",
reg_q AS (SELECT DISTINCT lower(host_no_www) AS key FROM local WHERE lower(host_no_www) <> ''),
reg_sfx AS (
  SELECT key, array_to_string(list_slice(string_split(key, '.'), i, len(string_split(key, '.'))), '.') AS domain
  FROM (SELECT key, unnest(generate_series(1, len(string_split(key, '.')))) AS i FROM reg_q)),
reg_best AS (
  SELECT reg_sfx.key,
         arg_max(struct_pack(c := registry.created_sec, e := registry.expires_sec), length(registry.domain)) AS r
  FROM reg_sfx JOIN registry ON registry.domain = reg_sfx.domain GROUP BY reg_sfx.key),
reg_match AS (SELECT key, r.c AS created_sec, r.e AS expires_sec FROM reg_best),
full_ AS (
  SELECT local.*,
    CAST(CASE WHEN local.error IS NULL THEN {ssl_sel} END AS DOUBLE) AS has_valid_ssl,
    CASE WHEN local.error IS NULL THEN {reg_sel} END AS domain_age_days,
    CASE WHEN local.error IS NULL THEN {reg_len_sel} END AS domain_registration_length
  FROM local{joins})"""


# --- statements -------------------------------------------------------------------

def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


def _cols(cols) -> str:
    return ", ".join(cols)


LENGTH_COLS = ["url_length", "domain_length", "path_length"]
CHAR_COLS = ["at_count", "double_slash_count", "dash_count", "dot_count", "underscore_count",
             "question_count", "equal_count", "ampersand_count", "exclamation_count",
             "space_count", "tilde_count", "comma_count", "plus_count", "asterisk_count",
             "hash_count", "dollar_count", "percent_count"]
TYPO_COLS = ["levenshtein_distance", "normalized_levenshtein", "typosquatting_score", "closest_brand"]


def _local_select(cols) -> str:
    return _with(corpus_ctes(), local_ctes("url_corpus")) + f"\nSELECT id, {_cols(cols)} FROM local"


def _full_select(cols, registry=True, certificates=True) -> str:
    return (_with(corpus_ctes(), full_ctes("url_corpus", registry, certificates))
            + f"\nSELECT id, {_cols(cols)} FROM full_")


def statements() -> dict[str, str]:
    out = {
        "url_parse": _with(corpus_ctes(), parse_ctes("url_corpus"))
        + "\nSELECT id, url, scheme, netloc, path, host, host_no_www, main_label, error FROM parsed",
        "url_lengths": _local_select(LENGTH_COLS),
        "url_char_counts": _local_select(CHAR_COLS),
        "url_https": _local_select(["has_https", "https_in_domain"]),
        "url_ip": _local_select(["has_ip_address", "ip_in_url"]),
        "url_subdomains": _local_select(["num_subdomains", "has_www"]),
        "typosquat_nearest_brand": _local_select(["main_label"] + TYPO_COLS),
        "url_features_local": _local_select(LOCAL + ["closest_brand", "error"]),
        "url_features_full": _full_select(FEATURE_COLUMNS + ["closest_brand", "error"]),
        "url_features_no_registry": _full_select(FEATURE_COLUMNS + ["closest_brand", "error"],
                                                 registry=False),
        "domain_registry_join": _full_select(["domain_age_days", "domain_registration_length"],
                                             certificates=False),
        "certificate_join": _full_select(["has_https", "has_valid_ssl"], registry=False),
    }
    from hookline.plans import oracle_io, oracle_more
    out.update(oracle_more.statements())
    out.update(oracle_io.statements())
    return out
