"""Main text of web pages by consensus container paths per host.

1. Every page is cut into text blocks, each with the path of its open
   elements as generalised "tag.class" steps (digits become #). Blocks inside
   menus, headers, footers, sidebars, notices, adverts, forms, comments and
   the like are boilerplate. A class or id that says so is judged by the text
   under it: a wrapper that holds the page's text ("layout has-sidebar") is
   none. Each container is scored by the plain text it holds, less its link
   text, and votes with its share of the page's best score.
2. Spark adds up the containers' votes per (host, path) and keeps the winning
   path of each host (partial sums first, so a host with a third of all pages
   is no hot group).
3. Pages are read again: the blocks under the host's winning path are the
   text; a page without that path uses its own best container.

Character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by one line feed. Unclosed and stray
tags are tolerated: closing a tag closes what is open inside it, and a stray
end tag is ignored.

Edge cases: null or empty html gives an empty text; a null url has the host ''
like any url without one; repeated rows each get a row; a page cut off in the
middle keeps what it has.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Winners are broadcast up to this many hosts (about 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_HOSTS = 50_000

# HTML element classes by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
                  "tfoot th thead tr ul".split())
BOILER_TAGS = frozenset("nav header footer aside form button menu dialog label fieldset".split())
CONTAINERS = frozenset("article main section div td body html blockquote center table".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios commentaires "
                         "cookie cookies consent disclaimer discussion disqus foot footer form gdpr head header login masthead menu nav navbar navigation "
                         "newsletter notice notices notification pager pagination popup modal promo promoted related replies reply respond share sharing "
                         "sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets overlay alert".split())
COMMENT_WORDS = frozenset("comments comment respond disqus".split())
ARTICLE_WORDS = frozenset("article content post entry story main body text".split())
# An element named like boilerplate is a wrapper if it holds this many times the text outside of such elements.
WRAPPER_TIMES = 4
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Which open elements a start tag closes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
          "th": {"td", "th", "p"}, "option": {"option"}}
P_CLOSERS = BLOCK - {"br", "body", "html", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup", "summary"}
SCOPES = frozenset("article section div table ul ol dl main aside nav header footer form blockquote body html td th button".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
WORDS = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "step", "boiler", "path", "marks", "comments")

    def __init__(self, tag: str, attributes: str, above: Element | None) -> None:
        name, own, marked = "", above.boiler if above else False, False
        self.comments = False
        if attributes and "=" in attributes:
            got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            name = re.sub(r"[0-9]+", "#", (got.get("class", "").split() or [""])[0].lower())
            said = {w.lower() for w in WORDS.findall(CAMEL.sub(" ", f"{got.get('class', '')} {got.get('id', '')}"))}
            hidden = "display:none" in got.get("style", "").replace(" ", "").lower() or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) is not None
            own = own or hidden or got.get("role", "").lower() in BOILER_ROLES
            post = bool(said & ARTICLE_WORDS - {"text", "body"})
            self.comments = bool(said & COMMENT_WORDS) and tag not in ("body", "html", "main") and not (tag == "article" and post)
            marked = self.comments or bool(said & BOILER_WORDS) and tag not in ("body", "html", "article", "main") and not post
        # the open elements named like boilerplate, this one included
        self.marks: tuple[Element, ...] = (*(above.marks if above else ()), *([self] if marked else []))
        self.tag, self.step = tag, f"{tag}.{name}" if name else tag
        self.boiler = own or tag in BOILER_TAGS
        self.path = f"{above.path}>{self.step}" if above else self.step


class Block(NamedTuple):
    text: str
    paths: tuple[str, ...]
    boiler: bool
    links: int
    marks: tuple[Element, ...]
    articles: tuple[Element, ...]
    title: bool


def wrappers(found: list[Block]) -> set[Element]:
    """Elements that are named like boilerplate but hold the page's text.

    They are those around the page's main or largest article; else those around
    the largest text under one innermost name, if it outweighs the text under
    no name; and all of them if the names would leave no text at all.
    """
    wrong: set[Element] = set()
    rows = [(b, max(0, len(b.text) - 2 * b.links)) for b in found if not b.boiler]
    if not any(b.marks for b, _ in rows):
        return wrong

    def innermost(b: Block) -> Element | None:
        return next((e for e in reversed(b.marks) if e not in wrong), None)

    def outside() -> int:
        return sum(w for b, w in rows if innermost(b) is None)

    inside: dict[Element, int] = defaultdict(int)
    titled: set[Element] = set()
    for b, w in rows:
        for e in b.articles:
            # not what has a name inside the article, and no article that is a comment
            if b.marks == e.marks and e not in e.marks:
                inside[e] += w
                if b.title:
                    titled.add(e)
    if best := max((e for e in inside if e.tag == "main" or e in titled or not any(x.comments for x in e.marks)),
                   key=lambda e: (e.tag == "main", inside[e]), default=None):
        if inside[best] > (0 if best.tag == "main" else outside()):
            wrong |= set(best.marks)
            if best.tag == "main" or best.marks:
                return wrong
    own: dict[Element, int] = defaultdict(int)
    titled = set()
    for b, w in rows:
        if e := innermost(b):
            own[e] += w
            if b.title:
                titled.add(e)
    rest = outside()
    if best := max((e for e in own if e in titled or not any(x.comments for x in e.marks)), key=own.__getitem__, default=None):
        if own[best] > rest * (1 if best in titled else WRAPPER_TIMES):
            wrong |= set(best.marks)
    return wrong if outside() else {e for b, _ in rows for e in b.marks}


def blocks(page: str) -> list[tuple[str, tuple[str, ...], bool, int]]:
    """(text, paths of the open containers, boilerplate?, length of link text) of each block."""
    open_: list[Element] = []
    out: list[Block] = []
    parts: list[str] = []
    links, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(e.path for e in open_ if e.tag in CONTAINERS), bool(open_) and open_[-1].boiler, links,
                                 open_[-1].marks if open_ else (), tuple(e for e in open_ if e.tag in ("article", "main")), any(e.tag == "h1" for e in open_)))
            parts.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal links
        if text:
            parts.append(text)
            if in_link:
                links += len(text)

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            break
        say(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if any(e.tag == tag for e in open_):
                while open_:
                    e = open_.pop()
                    in_link -= e.tag == "a"
                    if e.tag == tag:
                        break
            continue
        if tag in BLOCK:
            flush()
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag in P_CLOSERS else None)
        if closes:
            depth = next((k for k in range(len(open_) - 1, -1, -1) if open_[k].tag in SCOPES and open_[k].tag not in closes), -1)
            first = next((k for k in range(depth + 1, len(open_)) if open_[k].tag in closes), None)
            if first is not None:
                in_link -= sum(e.tag == "a" for e in open_[first:])
                del open_[first:]
        if tag == "a":
            in_link += 1
        if not m[3].endswith("/") or tag in BLOCK:
            open_.append(Element(tag, m[3], open_[-1] if open_ else None))
    say(page[at:] if at < n else "")
    flush()
    wrong = wrappers(out)
    return [(b.text, b.paths, b.boiler or any(e not in wrong for e in b.marks), b.links) for b in out]


def container_scores(found: list[tuple[str, tuple[str, ...], bool, int]]) -> dict[str, float]:
    """Score of each container path: its text less links, boilerplate counted against it, deep containers before outer ones."""
    good: dict[str, float] = defaultdict(float)
    bad: dict[str, float] = defaultdict(float)
    for text, paths, boiler, links in found:
        for p in set(paths):
            if boiler:
                bad[p] += len(text)
            else:
                good[p] += max(0, len(text) - 2 * links)
    out = {}
    for p, g in good.items():
        if g <= 0:
            continue
        last = p.rpartition(">")[2]
        bonus = 1.5 if last.split(".")[0] in ("article", "main") else 1.25 if set(WORDS.findall(last)) & ARTICLE_WORDS - {"body"} else 1.0
        # one part in a thousand for each step of depth breaks ties for the inner container
        out[p] = g * bonus / (1 + bad[p] / (g + 1)) ** 0.5 * (1 + 0.001 * p.count(">"))
    return out


def candidates(page: str) -> list[tuple[str, float]]:
    """The page's container paths with their share of its best score."""
    scores = container_scores(blocks(page))
    best = max(scores.values(), default=0)
    return [(p, s / best) for p, s in scores.items()]


def main_text(page: str | None, path: str | None) -> str:
    """Text of the page under ``path``, or under its own best container."""
    found = blocks(page or "")
    if path is None or not any(path in b[1] and not b[2] for b in found):
        scores = container_scores(found)
        if not scores:
            return ""
        path = min(scores, key=lambda p: (-scores[p], p))
    return "\n".join(text for text, paths, boiler, _ in found if not boiler and path in paths)


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the container path with most votes on each host."""

    def vote(batches):
        for part in batches:
            votes: dict[tuple[str, str], list[float]] = {}
            for host, page in zip(part["host"], part["page"], strict=True):
                for path, share in candidates(page):
                    v = votes.setdefault((host, path), [0.0, 0])
                    v[0] += round(share, 3)
                    v[1] += 1
            yield pd.DataFrame([(h, p, round(v[0] * 1000), v[1]) for (h, p), v in votes.items()], columns=["host", "path", "votes", "pages"])

    rows = pages.select(host_of(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("page"))
    votes = (rows.mapInPandas(vote, "host string, path string, votes long, pages long")
             .groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages")))
    # most votes win; ties go to the deeper, then to the larger path text
    best = F.max(F.struct("votes", F.length(F.regexp_replace("path", "[^>]", "")).alias("depth"), "path")).alias("best")
    return votes.groupBy("host").agg(best).select("host", F.col("best.path").alias("path"))


def read_again(page: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([main_text(a, b) for a, b in zip(page, path, strict=True)], dtype=object)


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), HOST, 1)), F.lit(""))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    winners = winning_paths(pages, url, html).checkpoint()  # a small table, written once: it is counted, then joined
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    read = F.pandas_udf(read_again, "string")
    joined = rows.join(winners, "host", "left")
    text = joined.select("page_id", "url", read(F.coalesce("html", F.lit("")), "path").alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
