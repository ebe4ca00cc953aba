"""URL parsing and lexical features as native Spark column expressions.

Parsing follows Python's ``urlparse`` (not a strict URI grammar): the scheme
is the text before the first ``:`` when it is made of scheme characters, the
netloc keeps user-info and port, ``;params`` are cut from the last path
segment for the usual schemes, and a host that the parser refuses (brackets
around no address, characters that NFKC turns into delimiters) is an error. Lengths and character counts use the *raw* url.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hookline.fixed import (CHAR_COUNTS, ERROR_BRACKETS, ERROR_FUTURE_ADDRESS, ERROR_HOST_CHARACTERS, ERROR_IPV4_IN_BRACKETS,
                            ERROR_NO_ADDRESS, HOST_UNSAFE_CHARACTERS, PARAM_SCHEMES)

# Digits as Python's ``\d`` sees them (any Unicode decimal digit).
_D = r"\p{Nd}"
IP_HOST_PATTERN = rf"^({_D}{{1,3}}\.){{3}}{_D}{{1,3}}\z"
IP_ANYWHERE_PATTERN = rf"({_D}{{1,3}}\.){{3}}{_D}{{1,3}}"

# Python's str.strip() whitespace (str.isspace), in syntax both Java regex
# and RE2 read
PY_SPACE = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
PY_STRIP = rf"^{PY_SPACE}+|{PY_SPACE}+$"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_NETLOC = r"^//[^/?#]*"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_url(url) -> Column:
    """Leading C0 controls/spaces stripped, then tab/CR/LF removed."""
    u = _col(url)
    return F.regexp_replace(F.regexp_replace(u, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def with_parsed(df, url_col: str = "url", out: str = "p"):
    """Adds struct column ``out`` (scheme, netloc, path, host, host_no_www,
    main_label, error), computed in stages so every regex runs once per row.

    ``host`` is the netloc before its first ``:`` (so user-info stays when
    there is no password), ``main_label`` is the label used for the brand
    distance: lower-cased host without ``www.``, second-last label when there
    are more than two, first when two, else the whole host.

    Each intermediate is its own projection; Catalyst keeps a projection
    apart when its non-trivial result is used more than once downstream, so
    ``netloc``/``host`` are not re-inlined into every consumer (inside CASE
    branches common-subexpression elimination cannot share them).
    """
    t = f"_{out}_"
    u = F.col(url_col)
    df = df.withColumn(t + "c", clean_url(u))
    c = F.col(t + "c")
    df = df.withColumn(t + "sr", F.regexp_extract(c, rf"({_SCHEME})", 1))
    df = df.withColumns({
        t + "scheme": F.lower(F.regexp_replace(F.col(t + "sr"), ":$", "")),
        t + "rest": F.when(F.col(t + "sr") == "", c).otherwise(
            F.substring(c, F.length(F.col(t + "sr")) + 1, F.length(c))),
    })
    rest = F.col(t + "rest")
    df = df.withColumns({
        t + "netloc": F.regexp_extract(rest, r"^//([^/?#]*)", 1),
        t + "pq": F.regexp_extract(F.regexp_replace(rest, _NETLOC, ""), r"^([^?#]*)", 1),
    })
    netloc, scheme, pq = F.col(t + "netloc"), F.col(t + "scheme"), F.col(t + "pq")
    df = df.withColumns({
        t + "path": F.when(scheme.isin(PARAM_SCHEMES), F.regexp_replace(pq, r";[^/]*\z", "")).otherwise(pq),
        t + "host": F.substring_index(netloc, ":", 1),
        t + "lhost": strip_www(F.substring_index(F.lower(netloc), ":", 1)),
        t + "bad": host_error(u, netloc),
    })
    host, lhost = F.col(t + "host"), F.col(t + "lhost")
    df = df.withColumns({t + "hnw": strip_www(host), t + "parts": F.split(lhost, r"[.]", -1)})
    parts = F.col(t + "parts")
    n = F.size(parts)
    main_label = (F.when(n > 2, F.element_at(parts, -2)).when(n == 2, F.element_at(parts, 1))
                  .otherwise(lhost))
    df = df.withColumn(out, once(F.struct(
        scheme.alias("scheme"), netloc.alias("netloc"), F.col(t + "path").alias("path"),
        host.alias("host"), F.col(t + "hnw").alias("host_no_www"), main_label.alias("main_label"),
        F.col(t + "bad").alias("error"))))
    return df.drop(*[t + x for x in ("c", "sr", "scheme", "rest", "netloc", "pq", "path", "host",
                                     "lhost", "bad", "hnw", "parts")])


def once(c: Column) -> Column:
    """``c``, kept apart from its users by the optimizer.

    Filters pushed below a projection, and projections merged into one, repeat
    the expressions of the columns they read; a long chain of patterns then
    grows past what can be compiled. A condition on random numbers (always
    true) makes the column one that Spark evaluates once per row, in its place.
    """
    return F.when(F.rand(0) + F.rand(1) >= 0, c)


def is_ipv6(address: Column) -> Column:
    """The whole IPv6 grammar: groups are counted, one ``::`` stands for at least one of eight, an IPv4 tail for two; a zone may follow."""
    zone_ok = ~address.contains("%") | address.rlike(r"^[^%]*%[^%]+\z")
    a = F.regexp_replace(F.substring_index(address, "%", 1), rf":{_IPV4}\z", ":0:0")
    groups = F.size(F.filter(F.split(a, ":", -1), lambda x: x != ""))
    colons = F.length(a) - F.length(F.replace(a, F.lit(":"), F.lit("")))
    plain = a.rlike(r"^[0-9A-Fa-f:]+\z") & ~a.rlike(r"[0-9A-Fa-f]{5}|:::|::.*::|^:(?!:)|(?<!:):\z")
    return zone_ok & plain & F.when(a.contains("::"), groups <= 7).otherwise((groups == 8) & (colons == 7))


def host_error(url, netloc: Column) -> Column:
    """Why the parser refuses the host, as its message; null for a good one.

    Brackets have to come in both kinds and to hold an IPv6 address (or one of a
    future version), and no character may turn into one of ``/?#@:`` under NFKC.
    """
    opens, closes = netloc.contains("["), netloc.contains("]")
    bracketed = F.regexp_extract(netloc, r"\[([^\]]*)", 1)
    future = bracketed.startswith("v")
    head, _, tail = ERROR_NO_ADDRESS.partition("{host}")
    start, _, end = ERROR_HOST_CHARACTERS.partition("{netloc}")
    return (F.when(_col(url).isNull(), F.lit("missing url"))
            .when(opens != closes, F.lit(ERROR_BRACKETS))
            .when(opens & future & ~bracketed.rlike(r"(?s)^v[a-fA-F0-9]+\..+\z"), F.lit(ERROR_FUTURE_ADDRESS))
            .when(opens & bracketed.rlike(rf"^{_IPV4}\z"), F.lit(ERROR_IPV4_IN_BRACKETS))
            .when(opens & ~future & ~is_ipv6(bracketed), F.concat(F.lit(head), bracketed, F.lit(tail)))
            .when(netloc.rlike(f"[{HOST_UNSAFE_CHARACTERS}]"), F.concat(F.lit(start), netloc, F.lit(end))))


def py_strip(c: Column) -> Column:
    """``str.strip()`` of a string column."""
    return F.regexp_replace(c, PY_STRIP, "")


def strip_www(host: Column) -> Column:
    return F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(host)


def count_substring(u: Column, s: str) -> Column:
    """Non-overlapping occurrences of ``s`` (as ``str.count``)."""
    removed = F.length(u) - F.length(F.replace(u, F.lit(s), F.lit("")))
    return (removed / F.lit(len(s))).cast("int") if len(s) > 1 else removed


def lexical_columns(url_col: str = "url", parsed_col: str = "p") -> list[tuple[str, Column]]:
    """F1-F22, F24-F27 as (name, column) over raw ``url`` and parsed struct ``p``."""
    u = F.col(url_col)
    p = F.col(parsed_col)
    cols = [
        ("url_length", F.length(u)),
        ("domain_length", F.length(p.netloc)),
        ("path_length", F.length(p.path)),
    ]
    counts = {name: count_substring(u, ch) for name, ch in CHAR_COUNTS}
    counts["double_slash_count"] = count_substring(u, "//")
    counts["space_count"] = count_substring(u, " ") + count_substring(u, "%20")
    order = ["at_count", "double_slash_count", "dash_count", "dot_count",
             "underscore_count", "question_count", "equal_count",
             "ampersand_count", "exclamation_count", "space_count",
             "tilde_count", "comma_count", "plus_count", "asterisk_count",
             "hash_count", "dollar_count", "percent_count"]
    cols += [(k, counts[k].cast("int")) for k in order]
    cols += [
        ("has_https", flag(p.scheme == "https")),
        ("https_in_domain", flag(F.lower(p.netloc).contains("https"))),
        ("has_ip_address", flag(p.host.rlike(IP_HOST_PATTERN))),
        ("ip_in_url", flag(u.rlike(IP_ANYWHERE_PATTERN))),
        ("num_subdomains", F.greatest(F.size(F.split(p.host_no_www, r"[.]", -1)) - 2, F.lit(0))),
        ("has_www", flag(p.netloc.startswith("www."))),
    ]
    return cols


def flag(cond: Column) -> Column:
    """Boolean -> 1.0 / 0.0 (null counts as false)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))
