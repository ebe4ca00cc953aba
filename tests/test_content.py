"""Page-content features against stdlib html.parser."""

import html
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from brute import page_features
from conftest import SF_SMALL
from hookline.fixed import CONTENT_COLUMNS
from hookline.functions.html import content_columns, decode_references
from hookline.operators.content import page_content, with_content
from hookline.sources import corpus as C

CASES = [
    ("http://a.com/", '<form action="x>y"><input type="password"></form>'),
    ("http://a.com/", "<abbr title='x'>t</abbr><a href='http://b.com'>b</a><A HREF=http://a.com/x>s</A>"),
    ("http://a.com/", "<input type=PASSWORD><img src=x><IMG/><img\nsrc='y'>"),
    ("http://a.com/", '<link rel="shortcut icon" href="http://cdn.b.com/f.ico"><link rel=icon href=/x>'),
    ("http://a.com/", "<!-- <form> --><script>x='<img>'</script><style>a{}</style><p>ok</p>"),
    ("", '<a href="http://x.com">x</a><link rel="icon" href="http://y.com/i">'),
    ("http://a.com/", None),
]


def test_cases_match_html_parser(spark):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(CASES)], "page_id long, url string, html string")
    got = page_content(df).orderBy("page_id").collect()
    for (u, h), r in zip(CASES, got):
        assert {c: r[c] for c in CONTENT_COLUMNS} == page_features(u, h), (u, h)


def test_decorated_pages_match_html_parser(spark):
    pages = C.pages_decorated(spark, SF_SMALL)
    got = page_content(pages).orderBy("page_id").collect()
    assert len(got) == pages.count() > 0
    for r in got:
        assert {c: r[c] for c in CONTENT_COLUMNS} == page_features(r["url"], r["html"]), r["page_id"]


def test_content_join_defaults_to_zero(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "<form></form>")], "page_id long, url string, html string")
    urls = spark.createDataFrame([(1, "http://a.com/"), (2, "http://missing.com/")], "id long, url string")
    out = {r["id"]: r for r in with_content(urls, pages).collect()}
    assert out[1]["has_form"] == 1.0 and out[2]["has_form"] == 0.0


PIECES = ['<a href="http://x.com">', '<a href=http://a.com/y>', "<a href='http://z.org'>", '</a>', '<form>',
          '<FORM method=post>', '<input type="password">', '<input type=password/>', "<input type='text'>",
          '<img src=1>', '<IMG>', '<img/>', '<link rel="icon" href="http://cdn.x.com/i">', '<link rel=icon href=/f>',
          '<link rel="shortcut icon" href="http://q.com">', '<!-- <img> -->', '<script>"<form>"</script>',
          '<style>.a{}</style>', 'text', '<p>', '</p>', '<abbr>', '<area>', '<a title="x>y" href="http://w.com">',
          '<div class="<img>">', '<a href="">', '<a href = "http://s.com" >', '<br/>', '<img\nsrc="n">',
          '<a\thref="http://t.com">', '<input type="PASSWORD">', '<link href="http://h.com" rel="icon">',
          "<span data-x='<form>'>", '<a HREF="http://caps.com">', '<Link REL="icon" HREF="http://c.com">', '1 < 2']


BROKEN = ['<!-- open <form> ', '<!--', '-->', '<!-- x --  >', '<!-->', '<script>', '</script>', '</ SCRIPT >', '<script src=a/>', '<script/>', '<style x', '<style>', '</style', '</style\n>',
          '<', '< ', '<<', '<b <script>', '<b ', '<a href="http&#58;//r.test"', '<a href=">', "<img src='", '"', "'", '>', '/>', '=', '<a =x href=http://e.test>', '<img/ >', '<img //>',
          '<a href=="http://f.test">', '<a href= "http://g.test>', '</>', '</ a>', '<?php <img> ?>', '<!doctype html>', '<!x <img>', '<![CDATA[ <img> ]]>', '<![if IE]><img><![endif]>', '<![CDATA[ <form>',
          '<input type=text type=password>', '<input type=password type=text>', '<a HREF="/l" href="http&colon;//dup.test/">', '<link rel="&#105;con" href="&#x68;ttps://c.test">',
          '<a href="http&#x3A;&sol;&sol;a.com/x">', '<link rel="x\x0bicon" href=http://v.test>', '<a\x0bhref="http://vt.test">', '<a\xa0href="http://nb.test">', '<a data-href="http://no.test">', '<i><a/href=http://sl.test>',
          "<a href='http://q.test'title=x>", '<a title="x"href="http://g2.test">', '\x00', '<a \x00 href=http://nul.test>', '<img src=a\x00b>', '<aé href="http://u.test">', '<fo\x00rm>', '<FORM/>', '\n', '\t']


@pytest.mark.parametrize("seed, pieces, n", [(3, PIECES, 300), (4, PIECES + BROKEN, 1500), (5, BROKEN, 1500)])
def test_random_tag_soup_matches_html_parser(spark, seed, pieces, n):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["http://a.com/p", "https://x.com", ""]), "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in page_content(df).collect()}
    for i, u, h in rows:
        assert {c: got[i][c] for c in CONTENT_COLUMNS} == page_features(u, h), (u, h)


def test_references_decode_as_in_the_standard_library(spark):
    rnd = random.Random(6)
    names = [*html5, *"amp; lt gt; notit; nosuch; colon; sol; AMP".split()]
    pieces = ["&", ";", "x", "#", " ", "&#", "&#x", "é", "=", "&amp;amp;"]
    odd = [f"&#{k};" for k in [*range(0, 300), 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 99999999, 123456789012345678901234567890]] + ["&#x0003A", "&#X3a;", "&#0;", "&#x80", "&#00000000058;"]
    values = odd + [f"&{n}" for n in names] + ["".join(rnd.choice([f"&{rnd.choice(names)}", rnd.choice(odd), *pieces]) for _ in range(rnd.randrange(1, 8))) for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", decode_references(F.col("v")).alias("d")).collect()
    assert [(r.v, r.d) for r in got if r.d != html.unescape(r.v)] == []


def test_long_tags_and_many_attributes_need_no_stack(spark):
    pages = ["<a " + "x " * 200_000 + "href=http://o.test>", "<img " + "a='b' " * 50_000 + ">", "<a" + "/" * 200_000 + " href=http://o.test>", "<!--" + "<img>" * 100_000 + "-->", "<a href=http://o.test/" + "é" * 300_000 + ">"]
    df = spark.createDataFrame([(i, "http://a.com/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = page_content(df).orderBy("page_id").collect()
    assert [(r.num_external_links, r.num_images) for r in got] == [(1, 0), (0, 1), (1, 0), (0, 0), (1, 0)]


def test_attributes_inside_other_values_and_duplicates(spark):
    page = ('<a title="x href=http://evil.test/" href="/local">q</a><input name="a type=password" type="text">'
            '<a href="/a" href="http://dup.test/">d</a>')
    df = spark.createDataFrame([(page,)], "html string")
    row = df.select(*[c.alias(n) for n, c in content_columns(F.col("html"), F.lit("own.test"))]).first()
    assert (row.has_password_field, row.num_external_links) == (0.0, 1.0)
