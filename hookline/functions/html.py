"""Page-content features (F34-F38) from a stored HTML column, natively.

Markup is read the way Python's ``html.parser`` reads it, in one left-to-right
scan. A token is a comment, a marked section, a start tag (with the whole raw
text after it for ``<script>`` and ``<style>``), or a piece that looks like
markup but counts as text: an unclosed comment or a start tag that is cut off,
both up to the next ``>``. So ``<abbr>`` is not ``<a>``, ``action='x>y'`` does not
end a tag, nothing inside a comment, a script or a value is a tag, an unclosed
script hides the rest of the page, and ``<b <script>`` is one tag.

Tag and attribute names are case-insensitive, attribute *values* are compared
case-sensitively, after their character references are decoded. Of attributes
of one name the last counts. A page with a marked section of an unknown kind
is one that the parser refuses: it has no tags. The patterns repeat only
possessively, so long tags cost no stack.
"""

from __future__ import annotations

import html as stdlib_html
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from hookline.functions.url import PY_SPACE

_W = PY_SPACE[1:-1]  # Python's white space, for use in classes
_S = PY_SPACE
_NAME = r"[a-zA-Z][^\t\n\r\f />\x00]*+"
_VALUE = rf"'[^']*+'|\"[^\"]*+\"|(?!['\"])[^>{_W}]*+"
_ATTRIBUTE = rf"(?<=['\"{_W}/])[^{_W}/>][^{_W}/=>]*+(?>{_S}*=+{_S}*(?:{_VALUE}))?+"
_GAP = rf"(?:{_S}++|/(?!>))*+"
_REST = rf"{_GAP}(?:{_ATTRIBUTE}{_GAP})*+"
_NAME_END = r"(?![^\t\n\r\f />\x00])"
_KNOWN_SECTION = r"(?i:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-zA-Z0-9])"

START_TAG = rf"<{_NAME}{_REST}/?>"
#: One token of markup, at the first place where one begins.
TOKEN = "(?s)" + "|".join([
    rf"<!--.*?--{_S}*+>",
    rf"<!\[(?i:temp|cdata|ignore|include|rcdata)(?![-_.a-zA-Z0-9]).*?\]{_S}*+\]{_S}*+>",
    rf"<!\[(?i:if|else|endif)(?![-_.a-zA-Z0-9]).*?\]{_S}*+>",
    rf"<(?i:(script|style)){_NAME_END}{_REST}(?:/>|>(?:.*?</{_S}*+(?i:\1){_S}*+>|.*+))",
    START_TAG,
    rf"(?=<{_NAME}{_REST}(?:[a-zA-Z=/]|\z))<[^>]*+>",
    rf"<{_NAME}{_REST}",
    r"<[!?/][^>]*+>",
])
REFUSED = rf"^<!\[(?!{_KNOWN_SECTION})"
WANTED = rf"^<(?i:form|input|a|img|link){_NAME_END}"

# FIXED: names of character references may end without a semicolon only where the table has them so
_LEGACY = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_LEGACY_START = "^(" + "|".join(_LEGACY) + ")"
_REFERENCE = r"(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]++|&"


def _literal_map(pairs: dict[str, str]) -> Column:
    """The pairs as a map that the optimizer folds into one value."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x01"))


def _in_ranges(n: Column, *ranges: tuple[int, int]) -> Column:
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | n.between(low, high)
    return inside


def numeric_reference(body: Column) -> Column:
    """The character of ``#58;`` or ``#x3a``: what it names, with the replacements that HTML asks for."""
    is_hex = F.lower(F.substring(body, 2, 1)) == "x"
    digits = F.regexp_replace(F.regexp_replace(body, "^#[xX]?0*", ""), ";$", "")
    n = F.when(F.length(digits) > 8, 1 << 33).when(digits == "", 0).when(is_hex, F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
    windows = F.array(*[F.lit(stdlib_html.unescape(f"&#{k};")) for k in range(0x80, 0xA0)])  # read as Windows-1252
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when(n.between(0x80, 0x9F), F.get(windows, (n - 0x80).cast("int")))
            .when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(_in_ranges(n, (1, 8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x7F), (0xFDD0, 0xFDEF)) | (n.bitwiseAND(0xFFFE) == 0xFFFE), "")
            .otherwise(plain))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is evaluated (and stands in the plan) once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decode_references(value: Column) -> Column:
    """Character references, numeric and named, as their characters; the names are those of the standard library's table."""
    named = _literal_map({n: v for n, v in html5.items() if n.endswith(";")})
    legacy = _literal_map({n: html5[n] for n in _LEGACY})

    def named_reference(body: Column) -> Column:
        by_start = let(F.regexp_extract(body, _LEGACY_START, 1), lambda start: F.when(start != "", F.concat(F.try_element_at(legacy, start), F.substr(body, F.length(start) + 1))))
        return F.coalesce(F.when(body.endswith(";"), F.try_element_at(named, body)), by_start, F.concat(F.lit("&"), body))

    def one(piece: Column) -> Column:
        reference = let(F.substr(piece, F.lit(2)), lambda body: F.when(body == "amp;", "&").when(body.startswith("#"), numeric_reference(body)).otherwise(named_reference(body)))
        return F.when(piece.startswith("&") & (piece != "&"), reference).otherwise(piece)

    pieces = F.regexp_extract_all(value, F.lit(_REFERENCE), F.lit(0))
    return F.when(value.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(value)


def attr(tag: Column, name: Column) -> Column:
    """Attribute value, without its quotes and with its references decoded; '' when absent. Of several the last counts."""
    after_name = F.regexp_replace(tag, rf"^<{_NAME}", "")
    found = F.filter(F.regexp_extract_all(after_name, F.lit(f"(?s){_ATTRIBUTE}"), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, rf"^[^{_W}/>][^{_W}/=>]*+", 0)) == name)
    last = let(found, lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit("")))
    raw = F.regexp_extract(last, rf"(?s)^[^{_W}/>][^{_W}/=>]*+{_S}*=+{_S}*({_VALUE})$", 1)
    bare = let(raw, lambda r: F.when(r.startswith('"') | r.startswith("'"), F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(r))
    return let(bare, decode_references)


def wanted_tags(html: Column) -> Column:
    """The forms, inputs, anchors, images and links, in order: structs of the kind, its href, and what it is (an input's type, a link's rel)."""
    tokens = F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))
    refused = html.contains("<![") & F.exists(tokens, lambda t: t.rlike(REFUSED))
    read = F.when(refused, F.array().cast("array<string>")).otherwise(tokens)
    tags = F.filter(read, lambda t: t.rlike(WANTED) & t.rlike(rf"^{START_TAG}\z"))

    def described(tag: Column) -> Column:
        kind = F.lower(F.regexp_extract(tag, rf"^<({_NAME})", 1))
        other = F.when(kind == "input", "type").when(kind == "link", "rel")
        names = F.array(F.when(kind.isin("a", "link"), "href"), other)
        return let(F.transform(names, lambda n: F.when(n.isNotNull(), attr(tag, n))), lambda v: F.struct(kind.alias("kind"), F.get(v, F.lit(0)).alias("href"), F.get(v, F.lit(1)).alias("other")))

    return F.transform(tags, described)


def _external(href: Column, netloc: Column) -> Column:
    """Starts with ``http`` and does not contain the page's netloc."""
    return href.startswith("http") & (netloc != "") & ~href.contains(netloc)


def content_columns(html: Column, netloc: Column, tags: Column | None = None) -> list[tuple[str, Column]]:
    """(name, column) for the five content features; null html -> all 0.0. ``tags`` may hold :func:`wanted_tags` already."""
    found = wanted_tags(html) if tags is None else tags
    of = lambda kind, also=lambda t: F.lit(True): F.filter(found, lambda t: (t["kind"] == kind) & also(t))
    icons = of("link", lambda t: t["other"].rlike(rf"(^|{_S})icon({_S}|\z)"))
    cols = [
        ("has_form", F.when(F.size(of("form")) > 0, 1.0).otherwise(0.0)),
        ("has_password_field", F.when(F.size(of("input", lambda t: t["other"] == "password")) > 0, 1.0).otherwise(0.0)),
        ("num_external_links", F.size(of("a", lambda t: _external(t["href"], netloc))).cast("double")),
        ("num_images", F.size(of("img")).cast("double")),
        ("favicon_from_other_domain", F.when(_external(F.get(icons, F.lit(0))["href"], netloc), 1.0).otherwise(0.0)),
    ]
    return [(n, F.when(html.isNull(), F.lit(0.0)).otherwise(c)) for n, c in cols]
