"""Personal data in text: offset-preserving deobfuscation.

Four kinds of identifier are found: email, ip, card and phone. *Base* spans
are what the plain patterns find in the text as it is. The *added* spans come
from a chain of small transducers that rewrite disguises (homoglyphs, spelled
digits, "at"/"dot" spellings, bracketed separators, invisible characters) into
plain characters while every output character keeps the source range it came
from. The same detectors run over the rewritten text and their hits are mapped
back to source offsets. A hit that touches a base span is dropped, so base
spans always stay as they are.

Offsets count code points, ends are exclusive. Everything is one narrow Arrow
pass over the documents: no shuffle, one text in memory at a time.

Edge cases: a null or empty text has no spans; a null id is kept as it is;
repeated rows are scanned one by one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind keeps a long digit run from being retried at each of its
# digits; a start inside a run can only fail where the start of the run failed.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping emails; linear, because it starts from each @."""
    out, done, last = [], 0, -1
    at = text.find("@")
    while at >= 0:
        low = max(done, last + 1)
        start = low + len(text[low:at].rstrip(LOCAL_CHARS))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        last = at
        at = text.find("@", max(at + 1, done))
    return out


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in the text as it is."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in (x.lstrip("0")[:4] or "0" for x in m[0].split("."))):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out["phone"].append(m.span())
    return out


# --- transducers -----------------------------------------------------------

# Characters that look like ASCII ones.
CYRILLIC = dict(zip("АВЕКМНОРСТХаеорсухіјѕһԁԛԝ", "ABEKMHOPCTXaeopcyxijshdqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρ", "ABEZHIKMNOPTYXoavp", strict=True))
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "·": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-",
         "–": "-", "—": "-", "−": "-", "﹣": "-", "－": "-", "＋": "+", "（": "(", "）": ")", "＿": "_", "％": "%"}
SPACES = (0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
INVISIBLE = (0x00AD, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
DIGIT_ZEROS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)


def fold_table() -> dict[int, str]:
    """Code point to the plain character it stands for ('' if invisible)."""
    table = {ord(k): v for part in (CYRILLIC, GREEK, SIGNS) for k, v in part.items()}
    table |= dict.fromkeys(SPACES, " ") | dict.fromkeys(INVISIBLE, "")
    for zero in DIGIT_ZEROS:
        table |= {zero + d: str(d) for d in range(10)}
    for code in (*range(0x41, 0x5B), *range(0x61, 0x7B)):
        table[code + 0xFEE0] = chr(code)
    return table


FOLD = fold_table()
FOLDABLE = re.compile("[" + "".join(map(re.escape, map(chr, FOLD))) + "]")

# Digit words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
               "seven": "7", "eight": "8", "nine": "9"}
ONE_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
SPELLED = re.compile(rf"(?i)(?<![A-Za-z]){ONE_DIGIT}(?:(?:[\x20,]|-)+(?:{ONE_DIGIT}|[0-9]|dot|point))*(?:(?:[\x20,]|-)+{ONE_DIGIT})(?![A-Za-z])")
SPELLED_PART = re.compile(rf"(?i){ONE_DIGIT}|dot|point|[0-9]|[^A-Za-z0-9]+")
PLUS_WORD = re.compile(r"(?i)(?<![A-Za-z])plus[\x20-]+(?=[0-9])")
OPEN, CLOSE = r"[(\[{<]", r"[)\]}>]"
SPACES = r"(?:(?<!\x20)\x20+)?"  # a whole run or nothing: a long run of spaces is read once
AT_BRACKET = re.compile(rf"(?i){SPACES}{OPEN}\x20*(?:at|@)\x20*{CLOSE}\x20*")
DOT_BRACKET = re.compile(rf"(?i){SPACES}{OPEN}\x20*(?:dot|punkt|punto|point|\.)\x20*{CLOSE}\x20*")
LABEL = r"[A-Za-z0-9-]+"
AT_DOT_WORDS = re.compile(
    rf"(?i)(?<=[A-Za-z0-9_%+-])(\x20+at\x20+{LABEL}(?:(?:\x20+dot\x20+|\.){LABEL})*\x20+dot\x20+[A-Za-z]{{2,}})(?![A-Za-z0-9-])")
DOT_AFTER_AT = re.compile(rf"(?i)(?<=@)({LABEL}(?:(?:\x20+dot\x20+|\.){LABEL})*\x20+dot\x20+[A-Za-z]{{2,}})(?![A-Za-z0-9-])")
DOT_WORD = re.compile(r"(?i)\x20+dot\x20+")
AT_OR_DOT = re.compile(r"(?i)\x20+(?:(at)|dot)\x20+")
DOT_BEFORE_AT = re.compile(r"(?i)(?<=[A-Za-z0-9_%+-])\x20+dot\x20+(?=[A-Za-z0-9._%+-]+@)")
DOT_DIGITS = re.compile(r"(?i)(?<=[0-9])\x20+(?:dot|point)\x20+(?=[0-9])")
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])\x20+@\x20*(?=[A-Za-z0-9-]+\.)|(?<=[A-Za-z0-9_%+-])\x20*@\x20+(?=[A-Za-z0-9-]+\.)")
LETTER_DIGIT = re.compile(r"(?<=[0-9])[OoIlSB](?=[\x20-]?[0-9])")
LETTER_VALUE = {"O": "0", "o": "0", "I": "1", "l": "1", "S": "5", "B": "8"}
BRACKETED = re.compile(rf"(?i){OPEN}\x20*(?:at|@|dot|punkt|punto|point|\.)\x20*{CLOSE}")
SPELLED_START = re.compile(rf"(?i)(?<![A-Za-z]){ONE_DIGIT}[\x20,-]+(?:{ONE_DIGIT}|[0-9]|dot|point)")


def disguised(text: str) -> bool:
    """Whether any transducer can find something: each has its necessary condition here, plain substring tests first."""
    return (" dot " in text.lower() or "@ " in text or " @" in text or any(c in text for c in "([{<") and bool(BRACKETED.search(text))
            or bool(SPELLED_START.search(text))
            or bool(DIGIT.search(text)) and any(p.search(text) for p in (PLUS_WORD, LETTER_DIGIT, DOT_DIGITS)))


def foldable(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(FOLDABLE.search(text))
    return any(c in text for c in "\xa0\xad\xb7")


class Tape:
    """A text whose every character knows its source range."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, put) -> None:
        """Replace each match by ``put(match)``; the new characters share the match's source range."""
        self.replace(pattern.finditer(self.text), put)

    def rewrite_inside(self, outer: re.Pattern, inner: re.Pattern, put) -> None:
        """Like ``rewrite`` with ``inner``, but only inside group 1 of ``outer``."""
        self.replace((m for o in outer.finditer(self.text) for m in inner.finditer(self.text, *o.span(1))), put)

    def replace(self, matches: Iterable[re.Match], put) -> None:
        text, start, end, at = [], [], [], 0
        for m in matches:
            a, b = m.span()
            new = put(m)
            if a == b or new == m[0]:
                continue
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        if at:
            self.text = "".join([*text, self.text[at:]])
            self.start = start + self.start[at:]
            self.end = end + self.end[at:]


def spelled(m: re.Match) -> str:
    """Digits of a run of digit words, if it has four at least."""
    parts = [p[0].lower() for p in SPELLED_PART.finditer(m[0])]
    out = "".join(DIGIT_WORDS.get(p, p if p.isdigit() else "." if p in ("dot", "point") else "") for p in parts)
    return out if sum(c.isdigit() for c in out) >= 4 else m[0]


def normalised(text: str) -> Tape | None:
    """The text with its disguises rewritten; None if it has none."""
    fold = foldable(text)
    if not fold and not disguised(text):
        return None
    tape = Tape(text)
    if fold:
        tape.rewrite(FOLDABLE, lambda m: FOLD[ord(m[0])])
    tape.rewrite(SPELLED, spelled)
    tape.rewrite(PLUS_WORD, lambda m: "+")
    tape.rewrite(LETTER_DIGIT, lambda m: LETTER_VALUE[m[0]])
    tape.rewrite(AT_BRACKET, lambda m: "@")
    tape.rewrite(DOT_BRACKET, lambda m: ".")
    # the words "at" and "dot" only count together: "at example.com" alone is prose
    tape.rewrite_inside(AT_DOT_WORDS, AT_OR_DOT, lambda m: "@" if m[1] else ".")
    tape.rewrite_inside(DOT_AFTER_AT, DOT_WORD, lambda m: ".")
    tape.rewrite(SPACED_AT, lambda m: "@")
    tape.rewrite(DOT_BEFORE_AT, lambda m: ".")
    tape.rewrite(DOT_DIGITS, lambda m: ".")
    return tape if tape.text != text else None


def joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover together, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each (kind, start, end) by start, then kind."""
    text = text or ""
    base = [(k, a, b) for k, spans in detect(text).items() for a, b in spans]
    every = list(base)
    if tape := normalised(text):
        starts, ends = joined([(a, b) for _, a, b in base])
        for kind, spans in detect(tape.text).items():
            for a, b in spans:
                span = kind, tape.start[a], tape.end[b - 1]
                at = bisect_left(starts, span[2]) - 1  # the last base text that begins before the span's end
                if at < 0 or ends[at] <= span[1]:
                    every.append(span)
    order = {k: n for n, k in enumerate(KINDS)}
    key = lambda x: (x[1], order[x[0]], x[2])
    return sorted(base, key=key), sorted(every, key=key)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "all_email long, all_ip long, all_card long, all_phone long")


def pii_report(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        base, every = find(t)
        rows.append((*(sum(k == x[0] for x in base) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(),
                     written(every), *(sum(k == x[0] for x in every) for k in KINDS)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])


SPAN_LIST = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def pii_span_list(text: pd.Series) -> pd.Series:
    out = []
    for t in text:
        base, every = find(t)
        known = set(base)
        out.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in known} for k, a, b in every])
    return pd.Series(out)


def pii_spans(docs: DataFrame, text: str | Column = "text", out: str = "pii") -> DataFrame:
    """``docs`` with an array of (kind, start, end, base) in column ``out``."""
    spans = F.pandas_udf(pii_span_list, SPAN_LIST)
    return docs.withColumn(out, spans(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def pii_summary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: base counts, digest of the base spans, and all spans as text.

    ``n_*`` count base spans, ``all_*`` count all spans.
    """
    report = F.pandas_udf(pii_report, RESULT)
    row = docs.select(F.col(doc_id).alias("doc_id"), report(F.coalesce(F.col(text), F.lit(""))).alias("r"))
    return row.select("doc_id", "r.*")
