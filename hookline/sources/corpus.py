"""Tables derived from the given ``pages`` and ``events`` tables.

The driver's ``pages`` only hold ``*.example.*`` hosts, so the feature jobs
are exercised on a URL corpus derived from it row by row: each page's host
is swapped for one of 16 templates picked by ``page_id % 16`` (lookalike,
exact brand, IPv4, user-info, port, deep subdomain, no scheme, controls and
spaces, bracketed and refused hosts, blank, null, upper case, brand-word host,
``https-`` host, ``//`` redirect). A registry and a certificate snapshot are
derived from the distinct hosts with dates taken from an md5 prefix, and the
pages' HTML is decorated with form/input/img/link fragments. Every rule is
plain SQL arithmetic so that the DuckDB oracle can rebuild the same rows.
The derivations are projections (and small aggregates) inside each query's
plan: every query scans the given tables, and nothing is kept between queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hookline.fixed import BRANDS
from hookline.functions.url import once, with_parsed
from hookline.sources.tables import events, pages, read_table

# --- FIXED VALUES of the derived corpus (the oracle SQL repeats them) --------
N_TEMPLATES = 16
BRAND_WORDS = ["secure", "login", "verify", "update"]
PHISHY_TEMPLATES = [1, 3, 4, 6, 9, 13, 14, 15]
SPAM_HOST_PATTERN = "cheap-pills|spam-farm|casino-win|free-bets"
REFUSED_HOSTS = ["[{h}", "[1:2]", "h℀.com", "[::1::2]", "[2001:db8::7]:8080", "[12345::]", "x／y.com", "u@[fe80::1%25eth0]", "[::ffff:1.2.3.4]", "a℆b", "[v1.x]",
                 "[v1]", "[1.2.3.4]", "x]y[::1", "[1:2:3:4:5:6:7:8:9]", "{h}：80", "[1:2:3:4:5:6:7::]", "[::1.2.3.256]"]  # a few of them are good
POSITIVE_LABEL_TEXT = ["phishing", "1", "Malicious", "BAD", "true", " phishing"]
NEGATIVE_LABEL_TEXT = ["legitimate", "0", "benign", "good", "false", "1.0"]
AS_OF_EPOCH = 1735689600          # 2025-01-01 00:00:00 UTC, instead of "now"
AS_OF = "2025-01-01 00:00:00"
EPOCH_DAY_2000 = 10957            # 2000-01-01
PART_BRANDS_FROM = 1_000          # brand numbers of the names made from parts
CUSTOMER_BRANDS_FROM = 1_000_000_000_000
# --- end of fixed values -------------------------------------------------------


def md5_int(c: Column) -> Column:
    """First 32 bits of md5 as a non-negative BIGINT (same in DuckDB)."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def _pick(values: list[str], idx: Column) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (idx + 1).cast("int"))


def _url_parts(url: Column):
    s = F.regexp_extract(url, r"^([A-Za-z]+)://", 1)
    h = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)
    r = F.regexp_replace(url, r"^[A-Za-z]+://[^/?#]*", "")
    return s, h, r


def _build_url_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id BIGINT, url STRING, label INT, label_text STRING), one row per page."""
    pg = pages(spark, sf_dir).select("page_id", "url")
    s, h, r = _url_parts(F.col("url"))
    pid = F.col("page_id")
    k = pid % N_TEMPLATES
    g = F.floor(pid / N_TEMPLATES)
    b = _pick(BRANDS, g % len(BRANDS))
    w = _pick(BRAND_WORDS, g % len(BRAND_WORDS))
    look = (F.when(g % 4 == 0, F.replace(b, F.lit("o"), F.lit("0")))
            .when(g % 4 == 1, F.replace(b, F.lit("l"), F.lit("1")))
            .when(g % 4 == 2, F.concat(b, F.lit("s")))
            .otherwise(F.substr(b, F.lit(2))))
    ip = F.concat_ws(".", (pid % 223 + 1).cast("string"), (pid * 7 % 256).cast("string"),
                     (pid * 13 % 256).cast("string"), (pid * 31 % 256).cast("string"))
    lit = F.lit
    url = (F.when(k == 0, F.col("url"))
           .when(k == 1, F.concat(lit("http://"), look, lit(".com"), r))
           .when(k == 2, F.concat(lit("https://www."), b, lit(".com"), r))
           .when(k == 3, F.concat(lit("http://"), ip, r))
           .when(k == 4, F.concat(lit("http://"), b, lit(".com@"), h, r))
           .when(k == 5, F.concat(s, lit("://"), h, lit(":8443"), r))
           .when(k == 6, F.concat(lit("http://"), b, lit(".login.secure.account."), h, r))
           .when(k == 7, F.concat(h, r))
           .when(k == 8, F.concat(lit(" "), s, lit("://"), h, lit("\t"), r, lit(" a%20b")))
           .when(k == 9, F.concat(lit("http://"), F.replace(_pick(REFUSED_HOSTS, g % len(REFUSED_HOSTS)), lit("{h}"), h), r))
           .when(k == 10, lit("   "))
           .when(k == 11, lit(None).cast("string"))
           .when(k == 12, F.concat(F.upper(s), lit("://WWW."), F.upper(h), r))
           .when(k == 13, F.concat(lit("https://"), look, lit("-"), w, lit(".com"), r))
           .when(k == 14, F.concat(lit("http://https-"), b, lit(".co.uk"), r))
           .otherwise(F.concat(s, lit("://"), h, lit("//http://"), look, lit(".com"), r)))
    label = F.when(k.isin(PHISHY_TEMPLATES) | h.rlike(SPAM_HOST_PATTERN), 1).otherwise(0)
    t = F.floor(pid / N_TEMPLATES) % len(POSITIVE_LABEL_TEXT)
    label_text = F.when(label == 1, _pick(POSITIVE_LABEL_TEXT, t)).otherwise(_pick(NEGATIVE_LABEL_TEXT, t))
    return pg.select(pid.cast("bigint").alias("id"), once(url).alias("url"),
                     label.cast("int").alias("label"), label_text.alias("label_text"))


def _build_registry_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, creation_date TIMESTAMP, expiration_date TIMESTAMP).

    Registered domains (last two labels) of the corpus hosts, plus every third
    full host (by md5) so that longest-suffix matching matters; one in ten
    keys is absent and one in seven has no expiry.
    """
    keys = (with_parsed(url_corpus(spark, sf_dir).select("url"))
            .select(once(F.lower(F.col("p.host_no_www"))).alias("key"))
            .where((F.col("key") != "") & F.col("key").contains(".")))
    parts = F.split(F.col("key"), r"[.]", -1)
    two = F.array_join(F.slice(parts, -2, 2), ".")
    cands = keys.select(F.explode(F.array(
        two, F.when(md5_int(F.col("key")) % 3 == 0, F.col("key")))).alias("domain"))
    doms = cands.where(F.col("domain").isNotNull()).distinct()
    hv = md5_int(F.col("domain"))
    as_of_day = AS_OF_EPOCH // 86400
    created_day = F.when(hv % 5 == 0, F.lit(as_of_day) - hv % 60).otherwise(F.lit(EPOCH_DAY_2000) + hv % 9000)
    created = created_day * 86400 + hv % 86400
    expires = F.when(hv % 7 == 0, F.lit(None)).otherwise(created + (hv % 10 + 1) * 365 * 86400)
    return (doms.where(hv % 10 != 0)
            .select("domain",
                    F.timestamp_seconds(created).alias("creation_date"),
                    F.timestamp_seconds(expires).alias("expiration_date")))


def _build_certificate_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, not_before TIMESTAMP, not_after TIMESTAMP) of the https hosts."""
    hosts = (with_parsed(url_corpus(spark, sf_dir).select("url"))
             .select(F.col("p.scheme").alias("scheme"), F.lower(F.col("p.host")).alias("host"))
             .where((F.col("scheme") == "https") & (F.col("host") != ""))
             .select("host").distinct())
    hv = md5_int(F.concat(F.lit("cert:"), F.col("host")))
    not_before = F.lit(AS_OF_EPOCH) - (hv % 400) * 86400
    not_after = not_before + (hv % 4 + 1) * 90 * 86400
    return (hosts.where(hv % 6 != 0)
            .select("host", F.timestamp_seconds(not_before).alias("not_before"),
                    F.timestamp_seconds(not_after).alias("not_after")))


def as_of() -> Column:
    return F.timestamp_seconds(F.lit(AS_OF_EPOCH))


# --- FIXED VALUES: HTML fragments appended by page_id modulo their number ----------------------
HTML_FRAGMENTS = [
    "",
    '<form action="/login"><input type="password" name="pw"></form>',
    "<img src=\"a.png\"><img src='b.png'/><IMG SRC=c.png>",
    "<a href=\"http://other.test/x\">x</a><a href=\"https://{netloc}/y\">y</a>"
    "<a href='http://third.test'>z</a><abbr title=\"http://no\">n</abbr><a name=\"n\">m</a>",
    '<link rel="icon" href="http://cdn.other.test/f.ico">',
    '<link rel="shortcut icon" href="/favicon.ico"><input type=PASSWORD>',
    "<!-- <form><img src=x> --><script>var s=\"<form>\"; document.write(\"<img>\");</script>",
    '<link rel="stylesheet" href="http://x.test/s.css"><link rel="icon" href="https://{netloc}/f.ico">'
    "<form method=post><img src=\"x\"></form>",
    "<a title=\"x href=http://evil.test/\" href=\"/local\">q</a><input name=\"a type=password\" type=\"text\">"
    "<a href=\"/a\" href=\"http://dup.test/\">d</a><link title='rel=icon' rel=next href='http://no.test/'>",
    "<a href=\"http&#58;//ref.test/a\">r</a><a href='&#x68;ttp://hex.test/?a=1&amp;b=2'>h</a><a href=\"/x?c&amp;d\">n</a>"
    "<link rel=\"&#105;con\" href=\"https&colon;//cdn.test/i.ico\">",
    "<b <script><img src=x></b><form><img src=y>",
    "a < b <img src=1><!-- open <form> <img src=2>",
    "<img src=1><script>if (a < b) '<form>'; <img src=2>",
    "<input type=text type=password><a href=\"/l\" href=\"http&colon;//dup.test/\">d</a><![CDATA[ <img src=1> ]]><img src='>'>",
]
NULL_HTML_EVERY = 50
# --- end of fixed values -------------------------------------------------------


def _build_pages_decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): pages with fragments; every 50th html is null."""
    pg = pages(spark, sf_dir).select("page_id", "url", "html")
    _, h, _ = _url_parts(F.col("url"))
    k = F.col("page_id") % len(HTML_FRAGMENTS)
    frag = F.lit("")
    for i, text in enumerate(HTML_FRAGMENTS):
        head, _, tail = text.partition("{netloc}")
        piece = F.concat(F.lit(head), h, F.lit(tail)) if "{netloc}" in text else F.lit(text)
        frag = F.when(k == i, piece).otherwise(frag)
    html = F.when(F.col("page_id") % NULL_HTML_EVERY == NULL_HTML_EVERY - 1, F.lit(None).cast("string")) \
        .otherwise(F.concat(F.col("html"), frag))
    return pg.select("page_id", "url", html.alias("html"))


def with_urls(ev: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events (a table or a stream) with the corpus url ``event_id % n``.

    A left join keeps events whose number meets no page; they carry a null url.
    """
    corpus = url_corpus(spark, sf_dir).select("id", "url", "label")
    n = max(1, pages(spark, sf_dir).count())  # a footer count
    return (ev.withColumn("id", F.col("event_id") % n).join(corpus, "id", "left")
            .select("event_id", "ts", "url", "label"))


def brand_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(brand_idx, brand): the fixed brands, the nations, four names a part and two a customer."""
    own = spark.createDataFrame(list(enumerate(BRANDS)), "brand_idx long, brand string")
    nation = read_table(spark, sf_dir, "nation").select((F.col("n_nationkey") + len(BRANDS)).cast("long").alias("brand_idx"), F.lower("n_name").alias("brand"))
    key = F.col("p_partkey")
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    text = key.cast("string")
    names = F.array(F.concat(first, second, (key % 1000).cast("string")), F.concat(second, F.substring(F.md5(text), 1, 4)),
                    F.concat(F.lower("p_type"), first, (key % 97).cast("string")), F.substr(F.md5(F.concat(F.lit("n"), text)), F.lit(1), (key % 6 + 5).cast("int")))
    part = read_table(spark, sf_dir, "part").select(key, F.posexplode(names).alias("k", "brand"))
    of_parts = part.select((F.col("p_partkey") * 4 + F.col("k") + PART_BRANDS_FROM).alias("brand_idx"), "brand")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(customer_names()).alias("k", "brand"))
    of_customers = customer.select((F.col("c_custkey") * 2 + F.col("k") + CUSTOMER_BRANDS_FROM).alias("brand_idx"), "brand")
    return own.unionByName(nation).unionByName(of_parts).unionByName(of_customers)


def customer_names() -> Column:
    text = F.col("c_custkey").cast("string")
    return F.array(F.concat(F.lower("c_mktsegment"), text), F.concat(F.lit("shop"), F.substring(F.md5(text), 1, 6)))


def squatted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(main_label): the labels of the corpus, and a lookalike of a name of every customer."""
    corpus = with_parsed(url_corpus(spark, sf_dir).select("url")).where("p.error is null").select(F.col("p.main_label").alias("main_label"))
    key = F.col("c_custkey")
    name = F.get(customer_names(), (key % 2).cast("int"))
    look = (F.when(key % 4 == 0, F.replace(name, F.lit("e"), F.lit("3"))).when(key % 4 == 1, F.concat(F.substr(name, F.lit(2)), F.lit("s")))
            .when(key % 4 == 2, F.concat(F.lit("my-"), name)).otherwise(F.concat(F.substring(name, 1, 5), F.substring(F.md5(name), 1, 4))))
    return corpus.unionByName(read_table(spark, sf_dir, "customer").select(look.alias("main_label")))


def url_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build_url_corpus(spark, sf_dir)


def registry_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build_registry_snapshot(spark, sf_dir)


def certificate_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build_certificate_snapshot(spark, sf_dir)


def pages_decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build_pages_decorated(spark, sf_dir)


def url_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, url, label). The narrow event rows are dealt out first: the files may have few row groups,
    and each row costs far more work than bytes, so no later shuffle would part them further."""
    return with_urls(events(spark, sf_dir).select("event_id", "ts").repartition("event_id"), spark, sf_dir)
