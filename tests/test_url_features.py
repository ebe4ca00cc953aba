"""URL parsing and local features: golden rows, edge cases, brute force."""

import random
import unicodedata
from urllib.parse import urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import url_features as py_features
from conftest import SF_SMALL
from hookline.fixed import FEATURE_COLUMNS, HOST_UNSAFE_CHARACTERS
from hookline.operators.features import LOCAL_COLUMNS, local_features, numeric_feature_columns

# url, len, dom, path, dot, dash, //, https, ip, sub, www, dist, brand, typo
GOLDEN = [
    ("https://www.google.com/search?q=test", 36, 14, 7, 2, 0, 1, 1, 0, 0, 1, 0, "google", 1),
    ("http://test-site.com//path?a=1&b=2@test", 39, 13, 6, 1, 1, 2, 0, 0, 0, 0, 6, "netflix", 0),
    ("https://secure.example.com", 26, 18, 0, 2, 0, 1, 1, 0, 1, 0, 3, "apple", 0),
    ("http://192.168.1.1/login", 24, 11, 6, 3, 0, 1, 0, 1, 2, 0, 4, "amex", 0),
    ("https://google.com", 18, 10, 0, 1, 0, 1, 1, 0, 0, 0, 0, "google", 1),
    ("https://a.b.c.google.com", 24, 16, 0, 4, 0, 1, 1, 0, 3, 0, 0, "google", 1),
    ("https://g00gle-security.com", 27, 19, 0, 1, 1, 1, 1, 0, 0, 0, 11, "google", 0),
    ("http://g00gle.com/x", 19, 10, 2, 1, 0, 1, 0, 0, 0, 0, 2, "google", 1),
    ("http://paypa1-security.com/login.php", 36, 19, 10, 2, 1, 1, 0, 0, 0, 0, 10, "paypal", 0),
    ("google.com/path", 15, 0, 15, 1, 0, 0, 0, 0, 0, 0, 4, "amex", 0),
    ("http://u:p@h.com:81/a", 21, 12, 2, 1, 0, 1, 0, 0, 0, 0, 3, "uber", 0),
    ("http://https-pay.co.uk/a%20b c", 30, 15, 8, 2, 1, 1, 0, 0, 1, 0, 4, "yahoo", 0),
    ("http://amazn.co/!~$*+,#_=", 25, 8, 7, 1, 0, 1, 0, 0, 0, 0, 1, "amazon", 1),
    ("http://münchen.de/é", 19, 10, 2, 1, 0, 1, 0, 0, 0, 0, 6, "google", 0),
    ("https://twiter.com", 18, 10, 0, 1, 0, 1, 1, 0, 0, 0, 1, "twitter", 1),
]
COLS = ["url_length", "domain_length", "path_length", "dot_count", "dash_count",
        "double_slash_count", "has_https", "has_ip_address", "num_subdomains", "has_www",
        "levenshtein_distance", "closest_brand", "typosquatting_score"]

PARSE_CASES = [
    ("HTTP://A.B.c.com:80/x;y=1?z#f", "http", "A.B.c.com:80", "/x"),
    ("//h.com/a", "", "h.com", "/a"),
    ("http:/x.com", "http", "", "/x.com"),
    ("mailto:a@b.com", "mailto", "", "a@b.com"),
    ("ht_tp://x.com/y", "", "", "ht_tp://x.com/y"),
    ("foo://h.com/a;b", "foo", "h.com", "/a;b"),
    ("http://h.com/a;p/b;q", "http", "h.com", "/a;p/b"),
    (" \thttp://h.com/a\nb", "http", "h.com", "/ab"),
]


def _frame(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string")


def test_golden_rows(spark):
    out = local_features(_frame(spark, [g[0] for g in GOLDEN])).orderBy("id").collect()
    for g, r in zip(GOLDEN, out):
        got = tuple(r[c] for c in COLS)
        want = tuple(float(x) if isinstance(x, int) and c.startswith(("has_", "lev", "typo")) else x
                     for c, x in zip(COLS, g[1:]))
        assert got == want, g[0]


def test_parse_edge_cases(spark):
    out = local_features(_frame(spark, [c[0] for c in PARSE_CASES]), keep_parsed=True) \
        .orderBy("id").select("p.scheme", "p.netloc", "p.path").collect()
    assert [tuple(r) for r in out] == [c[1:] for c in PARSE_CASES]


def test_errors_are_rows_not_failures(spark):
    out = local_features(_frame(spark, ["http://[bad/x", None, "", "http://ok.com"])).orderBy("id").collect()
    assert out[0]["error"] == "Invalid IPv6 URL" and out[0]["url_length"] is None
    assert out[1]["error"] == "missing url"
    assert out[2]["error"] is None and out[2]["url_length"] == 0
    assert out[3]["error"] is None


def _python_error(url):
    try:
        urlparse(url)
    except ValueError as e:
        return str(e)
    return None


def _random_address(rnd):
    group = lambda: rnd.choice(["0", "1", "ab", "FFFF", "db8", "12345", "g", ""] if rnd.random() < 0.15 else ["0", "1", "ab", "FFFF", "db8"])
    tail = rnd.choice(["", "", "", ":1.2.3.4", ":1.2.3.256", ":01.2.3.4", ":1.2.3", ":0.0.0.0"])
    groups = [group() for _ in range(rnd.choice([1, 2, 5, 6, 7, 8, 9]))]
    if rnd.random() < 0.6:
        k = rnd.randrange(len(groups) + 1)
        groups[k:k] = [""] if 0 < k < len(groups) else ["", ""]
    return rnd.choice(["", "", "", "", "v", "v1.", ":"]) + ":".join(groups) + tail + rnd.choice(["", "", "", "%eth0", "%", "%a%b", ":", "::", ".x"])


def test_bracketed_hosts_match_python(spark):
    rnd = random.Random(12)
    parts = ["[1:2]", "[::1::2]", "[12345::]", "[::]", "[:]", "[]", "[1.2.3.4]", "[v1]", "[v1.]", "[v1.x:y]", "[vg.x]", "[1:2:3:4:5:6:7::]", "[::2:3:4:5:6:7:8]", "[1:2:3:4:5:6:7:8]", "[1:2:3:4::5:6:7:8]"]
    hosts = [*parts, *[rnd.choice(["", "", "u@", "x", "]"]) + f"[{_random_address(rnd)}" + rnd.choice(["]", "]", "]:80", "]x", "", "]]", "][::1]"]) for _ in range(3000)]]
    urls = [f"http://{h}/p" for h in hosts]
    got = local_features(_frame(spark, urls)).orderBy("id").collect()
    wrong = [(u, r["error"], _python_error(u)) for u, r in zip(urls, got) if r["error"] != _python_error(u)]
    assert wrong == []
    assert 500 < sum(r["error"] is None for r in got) < 2500


def test_hosts_that_change_under_normalization_match_python(spark):
    unsafe = [c for c in map(chr, range(128, 0x110000)) if set("/?#@:") & set(unicodedata.normalize("NFKC", c))]
    assert "".join(unsafe) == HOST_UNSAFE_CHARACTERS
    urls = [f"http://a{c}b.com/" for c in unsafe] + [f"http://a.com/{c}" for c in unsafe] + ["http://u:p@\u00fcber.com:80/", "http://\ufb01x.com/", "http://a@b\u2100"]
    got = local_features(_frame(spark, urls)).orderBy("id").collect()
    assert [r["error"] for r in got] == [_python_error(u) for u in urls]


def _compare(spark, urls):
    got = local_features(_frame(spark, urls)).orderBy("id").collect()
    for u, r in zip(urls, got):
        want = py_features(u)
        for c in LOCAL_COLUMNS + ["closest_brand"]:
            w, g = want[c], r[c]
            if isinstance(w, float):
                assert g == pytest.approx(w), (u, c)
            else:
                assert g == w, (u, c)


def test_corpus_matches_python(spark):
    from hookline.sources import corpus as C
    urls = [r.url for r in C.url_corpus(spark, SF_SMALL).where("url is not null").collect()]
    _compare(spark, [u for u in urls if _python_error(u) is None])


URL_CHARS = "abcgoleGO019.-_/:?=&@!~,+*#$% "


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=URL_CHARS, min_size=0, max_size=30), min_size=1, max_size=20),
       st.sampled_from(["http://", "https://", "", "//", "ftp://", "HTTPS://www."]))
def test_random_urls_match_python(spark, tails, prefix):
    urls = [prefix + t for t in tails if "[" not in t]
    _compare(spark, urls)


def test_numeric_filter(spark):
    from hookline.sources import corpus as C
    from hookline.operators.features import url_features
    f = url_features(C.url_corpus(spark, SF_SMALL).select("id", "url"))
    assert numeric_feature_columns(f) == FEATURE_COLUMNS


def test_exotic_urls_match_python(spark):
    """Brackets, control characters, Unicode digits: features equal urlparse,
    and urlparse's ValueError is our error column."""
    rnd = random.Random(5)
    alpha = list("abgoGO01.-_/:?=&@!~,+*#$% ;[]") + ["\t", "\n", "\x01", "\u0663", "é", "//", "www.",
                                                    "http", "s://", "::", "[::1]", "%20"]
    prefixes = ["http://", "https://", "", "//", "HTTP://", " \x02http://", "ftp://", "foo:", "1http://"]
    urls = [rnd.choice(prefixes) + "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 25)))
            for _ in range(400)]
    got = local_features(_frame(spark, urls)).orderBy("id").collect()
    for u, r in zip(urls, got):
        try:
            want = py_features(u)
        except ValueError:
            assert r["error"] is not None, u
            continue
        assert r["error"] is None, u
        for c in LOCAL_COLUMNS + ["closest_brand"]:
            assert (r[c] == pytest.approx(want[c])) if isinstance(want[c], float) else r[c] == want[c], (u, c)


def test_lookups_read_the_urls_once_more_and_distances_are_taken_once(spark):
    from hookline.fixed import BRANDS
    from hookline.operators.features import url_features
    urls = spark.range(50).select("id", F.concat(F.lit("https://h"), F.col("id") % 5, F.lit(".paypal.com/")).alias("url"))
    registry = spark.createDataFrame([("paypal.com", "2020-01-01", "2030-01-01")], "domain string, creation_date string, expiration_date string")
    certificates = spark.sql("SELECT 'h1.paypal.com' AS host, timestamp '2024-01-01' AS not_before, timestamp '2026-01-01' AS not_after")
    out = url_features(urls, registry=registry, certificates=certificates, as_of=F.lit("2025-01-01").cast("timestamp"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 50") == 1
    assert 1 <= plan.count("levenshtein(") <= len(BRANDS)
    got = {r.id: (r.levenshtein_distance, r.closest_brand, r.domain_age_days, r.has_valid_ssl) for r in out.collect()}
    assert got == {i: (0.0, "paypal", 1827.0, float(i % 5 == 1)) for i in range(50)}
