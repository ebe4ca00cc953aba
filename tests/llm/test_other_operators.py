"""PII, HTML, toxicity, mixing, nearest neighbours and the pipeline."""

import random
import re
import time
from bisect import bisect_left

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from odd_rows import empty, odd  # noqa: F401  (fixtures)
from hookline.llm import ann, catalog, html_extract, mixing, pii, toxicity

SF_SMALL = "/root/testdata/sf0.001"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and pii.luhn(d)
                  or kind == "phone" and 10 <= len(d) <= 15)
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], list(BASE).index(x[0])))


def test_base_spans_equal_plain_patterns():
    rnd = random.Random(3)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (980) 555-6268", "+", "12", " ",
             ".", "-", "a@b.c@d.e", "é", "00000000000000", "+49 30 123456", "\n", "user%x@host-1.example.org."]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12)))
        assert pii.find(t)[0] == plain_base(t), t


@pytest.mark.parametrize("text,kind,part", [
    ("mail jo.do at mail dot com now", "email", "jo.do at mail dot com"), ("x jo(at)ex[dot]org y", "email", "jo(at)ex[dot]org"),
    ("рaypal@exаmple.com!", "email", "рaypal@exаmple.com"), ("ip 1 dot 2 dot 3 dot 4.", "ip", "1 dot 2 dot 3 dot 4"), ("at 192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"),
    ("no ４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
    ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ("call plus one nine eight zero five five five six two six eight", "phone", "plus one nine eight zero five five five six two six eight")])
def test_disguises_map_back_to_the_source(text, kind, part):
    base, every = pii.find(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in every] == [(kind, part)]


@pytest.mark.parametrize("text,parts", [
    ("jo at mail dot com or al at site dot org", ["jo at mail dot com", "al at site dot org"]),
    ("x dot y at a dot b dot com, jo AT  mail DOT com; u at v dot w.org dot uk.", ["x dot y at a dot b dot com", "jo AT  mail DOT com", "u at v dot w.org dot uk"]),
    ("dot at mail dot com then q at at dot com", ["dot at mail dot com", "q at at dot com"]),
    ("a(at)b[dot]org c@d dot com e @ f.org", ["a(at)b[dot]org", "c@d dot com", "e @ f.org"])])
def test_several_disguises_in_a_text(text, parts):
    assert [text[a:b] for _, a, b in pii.find(text)[1]] == parts


@pytest.mark.parametrize("text,kind", [
    ("plus 44 7911 123456", "phone"), ("plus-44 7911 123456", "phone"), ("four 1 one 1 one 1 one 1 one 1 one 1 one 1 one 1", "card"),
    ("one point two point three point four", "ip"), ("one-dot-two-dot-three-dot-four", "ip"), ("41l1 1111 1111 1111", "card"), ("4111 1111 1111 1I11", "card"),
    ("1 point 2 point 3 point 4", "ip"), ("jo(at)ex.org", "email"), ("jo@ex[dot]org", "email"), ("jo at ex dot org", "email"), ("jo@ex dot org", "email"),
    ("jo @ ex.org", "email"), ("jo@ ex.org", "email"), ("jo＠ex.org", "email"), ("192·168·1·1", "ip")])
def test_each_transducer_alone(text, kind):
    base, every = pii.find(f"call {text}, ok")
    assert base == [] and [(k, f"call {text}, ok"[a:b]) for k, a, b in every] == [(kind, text)]


def test_the_shortcut_loses_nothing(monkeypatch):
    rnd = random.Random(5)
    parts = ["plus", "one", "Two", "ſix", "nine", "oh", "dot", "point", "poınt", "at", "AT", "@", "[", "]", "(", ")", ".", ",", "-", " ", " ", "  ", "1", "44", "7911", "123456",
             "O", "l", "4111", "jo", "mail", "com", "punkt"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 24))) for _ in range(20000)]
    got = [getattr(pii.normalised(t), "text", t) for t in texts]
    monkeypatch.setattr(pii, "disguised", lambda t: True)
    assert got == [getattr(pii.normalised(t), "text", t) for t in texts] and sum(a != b for a, b in zip(got, texts, strict=True)) > 500
    assert {chr(c) for c in pii.FOLD if c < 256} == set("\xa0\xad\xb7")


def test_prose_has_no_spans():
    for t in ("meet me at example.com", "one two three", "dot at the dot", "she was at home. dot", "on one, two (at) most", None, ""):
        assert pii.find(t)[1] == []


def test_pii_odd_rows(odd, empty):
    got = pii.pii_summary(odd).collect()
    assert len(got) == 8 and all(r.spans == "" for r in got) and pii.pii_summary(empty).count() == 0
    assert pii.pii_spans(odd).columns == [*odd.columns, "pii"]


PAGE = """<html><body><header class="top">Site</header><nav><a href=/a>Menu</a></nav><div class="cookie-notice">We use cookies</div>
<div class="main-content"><h1>Title &amp; more</h1><p>First   para<b>graph</b><p>Second&nbsp;one<br>next<script>var x="<p>no</p>"</script>
<ul><li>item 1<li>item 2</ul><form><input name=q>Search</form><div class="ad">Buy</div></div>
<section id="comments"><p>Reader says hi and goes on for quite a long while to be longer than the text itself</p></section><aside>Side</aside>
<footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    rows = [(k, f"http://h.example/{k}", PAGE) for k in range(5)] + [(9, None, None), (10, "http://h.example/x", ""), (11, "http://h.example/y", PAGE[:250])]
    rows.append((12, "http://h.example/z", "<html><body><div class='other'><p>Only this</p></div></body></html>"))
    got = {r.page_id: r for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Title & more\nFirst paragraph\nSecond one\nnext\nitem 1\nitem 2"
    assert got[0].text == got[4].text == want and got[0].n_chars == len(want)
    assert got[9].text == got[10].text == "" and got[11].text.startswith("Title") and got[12].text == "Only this"
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


STORY = "<h1>Title</h1><p>" + "word " * 60 + "</p><p>" + "more " * 40 + "</p>"
SIDE = '<div class="sidebar"><div class="widget"><p>' + "side " * 20 + "</p></div></div>"


@pytest.mark.parametrize("page", [
    f'<div class="layout has-sidebar"><article>{STORY}</article>{SIDE}</div>', f'<div id="wrapper" class="nav-open"><main>{STORY}</main>{SIDE}</div>',
    f'<div class="page header-fixed"><div>{STORY}</div>{SIDE}</div><p>stray line</p>', f'<article class="post comments-open">{STORY}</article>{SIDE}<p>stray line</p>',
    f'<div class="layout has-sidebar"><div class="nav-open"><div>{STORY}</div></div>{SIDE}</div>', f'<div class="site comments-open">{STORY}</div>{SIDE}',
    f'<div class="has-sidebar"><article>{STORY}</article>{SIDE}<div id="comments"><article class="reply">{"said " * 200}</article></div></div>'])
def test_wrappers_named_like_boilerplate(page):
    want = f"Title\n{('word ' * 60).strip()}\n{('more ' * 40).strip()}"
    got = html_extract.main_text(f"<html><body>{page}</body></html>", None)
    assert want in got and "side" not in got and "said" not in got


def test_boilerplate_stays_boilerplate():
    short = "<p>" + "word " * 30 + "</p>"
    for mark in ('id="comments"', 'class="cookie-consent"', 'class="disclaimer"', 'class="related"'):
        page = f"<body><div>{short}</div><div {mark}><article>{'other ' * 24}</article><p>{'other ' * 24}</p></div></body>"
        assert html_extract.main_text(page, None) == ("word " * 30).strip(), mark
    assert html_extract.main_text('<body><nav>Menu</nav><div class="notice"><a href="/">Only</a> a notice</div></body>', None) == "Only a notice"


def test_host_path_votes(spark):
    """A path that wins on most pages of a host is used on a page where another container is larger."""
    good = "<body><div class=post><p>" + "text " * 50 + "</p></div><div class=box><p>small</p></div></body>"
    odd_one = "<body><div class=post><p>short text</p></div><div class=box><p>" + "other " * 80 + "</p></div></body>"
    rows = [(k, "http://a.example/", good) for k in range(6)] + [(7, "http://a.example/", odd_one)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "short text"


def test_every_container_votes(spark):
    """A path that is fourth on most pages of a host wins the full vote."""
    nest = "<div class=k{0}a><div class=k{0}b><div class=k{0}c><p>" + "text " * 50 + "</p></div></div></div>"
    pages = ["<section class=top><div class=wrap>" + nest.format(c * 2) + "</div></section><section class=box><p>small</p></section>" for c in "abcdefg"]
    pages += ["<section class=box><p>" + "other " * 20 + "</p></section>"] * 2
    rows = [(k, "http://a.example/", f"<p>stray {'line ' * 30}</p>{p}") for k, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.path for r in html_extract.winning_paths(df).collect()] == ["section.top>div.wrap"]


def test_toxicity_folding_and_exceptions(spark):
    assert toxicity.folded_words("You L0$3R, m.o.r.o.n! сlown ｉｄｉｏｔ s c u m") == ["you", "loser", "moron", "clown", "idiot", "scum"]
    key = toxicity.Lexicon({" scum ": 3.0, " pond": 1.0}, (" pond scum ",)).key()
    assert [h[2] for h in toxicity.hits(["you", "scum"], key)] == [3.0] and toxicity.hits(["pond", "scum"], key) == []


def test_toxicity_on_held_out_rows(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lexicon = toxicity.fit_lexicon(docs, labels, exceptions=("pond scum",))
    s = toxicity.score_documents(docs, lexicon).join(labels, "doc_id").where("held_out").toPandas()
    bad, good = s[s.toxic == 1], s[s.toxic == 0]
    assert bad.predicted.mean() > 0.6 and good.predicted.mean() < 0.03
    assert toxicity.score_documents(odd, lexicon).count() == 8 and toxicity.score_documents(empty, lexicon).count() == 0
    assert toxicity.fit_lexicon(docs, labels.where("false")).weights == {}


def test_sample_is_bounded_in_rows(spark):
    ids = [k for k in range(60) if not spark.range(1).select(toxicity.held_out(F.lit(k))).first()[0]][:20]
    docs = spark.createDataFrame([(ids[0], t) for t in ["c", "b", None] * 100] + [(k, f"text {k}") for k in ids[1:]] + [(ids[1], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int")
    got = sorted(r.body for r in toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 1000).collect())
    assert got == sorted(["b", *(f"text {k}" for k in ids[1:])])
    assert toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 5).count() == 5


def test_mixing_equals_sql_and_margins(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mixing_plan(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(mixing.mixing_sql()).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns].astype(str) == want.astype(str)).all().all()
    own = got.groupby("source").n_tokens.sum() ** mixing.TEMPER["source"]
    raked = (got.n_tokens * got.factor).groupby(got.source).sum()
    assert np.abs(raked / raked.sum() - own / own.sum()).max() < 0.01
    assert mixing.mixing_plan(odd).count() == 8 and mixing.mixing_plan(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_one_rare_document_barely_moves_the_kept_share(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source", "lang")
    rare = spark.createDataFrame([(-1, "rare " * 20, "rare source", "en")], docs.schema)
    words = F.sum(mixing.word_count(F.col("text")))
    total = docs.agg(words).first()[0]
    shares = [mixing.mixed_documents(d).agg(words).first()[0] / total for d in (docs, docs.union(rare))]
    assert all(abs(s - mixing.KEPT_SHARE) < 0.03 for s in shares) and abs(shares[0] - shares[1]) < 0.01


def test_capped_cells_are_made_up_for_by_the_others(spark):
    cells = spark.createDataFrame([(10, 100.0), (100, 30.0), (1000, 1.0), (9000, 0.2)], "tokens long, factor double")
    for share in (0.01, 0.3, 0.9, 1.0):
        scale = mixing.scale_for(cells, share)
        drawn = sum(n * min(1, f * scale) for n, f in ((10, 100.0), (100, 30.0), (1000, 1.0), (9000, 0.2)))
        assert abs(drawn - share * 10110) < 1e-6
    assert mixing.scale_for(cells.where("false"), 0.5) == 0


def test_nearest_neighbours_recall_and_odd_vectors(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(900, 16)).astype("f4") * rnd.uniform(0.5, 2, size=(900, 1)).astype("f4")
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900 + k, x[0].tolist()) for k in range(60)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] * 16), (2080, [None] * 16), (None, x[1].tolist()), (20, x[20].tolist()), (3000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=300).toPandas()
    ids = np.array([k for k, v in rows[:960]])
    full = np.array([v for _, v in rows[:960]], dtype="f8")
    hit = total = 0
    for q, g in out.groupby("query_id"):
        assert q < 960 and g.sort_values("rank")["rank"].tolist() == list(range(1, 21))
        s = full @ full[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        hit, total = hit + len(set(best) & set(g.vec_id)), total + 20
        assert np.allclose(g.score, s[g.vec_id.to_numpy()], rtol=0, atol=1e-9)
    assert hit / total >= 0.95 and set(out.query_id) == {k for k in range(0, 960, 20)}
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    known, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, known, SF_SMALL).cache()
        kept[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            known = out
    ids = [{r.doc_id for r in kept[n].select("doc_id").collect()} for n, _ in corpus_pipeline.STAGES]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[-1] == ids[-2]
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].collect())
    assert len(ids[0]) >= 0.8 * docs.count()


def test_queries_are_registered():
    names = catalog.llm_queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
    assert set(catalog.llm_oracle_sql()) <= set(names)


def test_copies_with_blank_lines_go(spark):
    """A copy that keeps only its blank lines is gone; a document that was blank before stays."""
    text = "\n\n".join(f"paragraph {w} with its own words {w}{w} and more of {w}" for w in ("alpha", "beta", "gamma")) + "\n \t\n"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "\n\n"), (4, None)], "doc_id long, text string")
    got = corpus_pipeline.line_dedup_stage(spark, docs, SF_SMALL).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 4]


def vectors(kind, n, d=64):
    rng = np.random.default_rng(1)
    if kind == "clusters":
        return rng.normal(size=(200, d))[rng.integers(0, 200, n)] + 0.05 * rng.normal(size=(n, d))
    return rng.normal(size=(n, d)) * np.exp(rng.uniform(0, np.log(4), size=(n, 1)))


@pytest.mark.parametrize("kind,n", [("unequal norms", 12_800), ("clusters", 4_000), ("unequal norms", 300)])
def test_graph_search_finds_nine_tenths_of_the_nearest(kind, n):
    x, k = vectors(kind, n), 20
    space = ann.unit_norm(x)
    edges, starts = ann.build_graph(space)
    assert ann.reached(edges, starts).all()
    beam = ann.fitting_beam(x, space, edges, starts, k)
    asked = np.random.default_rng(3).choice(n, 100, replace=False)
    true = np.argsort(-(x[asked] @ x.T), axis=1)[:, :k]
    found, _ = ann.beam_search(space, edges, ann.asked_points(x[asked]), starts, min(n, beam))
    assert np.mean([len(set(a) & set(b)) / k for a, b in zip(true, found)]) >= 0.9
    assert kind != "clusters" or beam == ann.SEARCH_BEAM


def test_nodes_out_of_reach_get_an_edge():
    x = np.random.default_rng(2).normal(size=(60, 4)).astype(np.float32)
    edges = np.full((60, 3), 60, dtype=np.int32)
    edges[:30, 0] = np.roll(np.arange(30), -1)  # two rings, and full rows in the first
    edges[:30, 1:] = 0
    edges[30:, 0] = np.roll(np.arange(30, 60), -1)
    start = np.array([0], dtype=np.int32)
    assert ann.reached(edges, start).sum() == 30
    assert ann.reached(ann.all_reachable(x, edges, start), start).all()


def test_huge_and_tiny_finite_components(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).normal(size=3)]) for i in range(1, 60)] + [(100, [1e20, -1e20, 3.0]), (20, [1e-30, 1e-30, 0.0]), (40, [3e38, 0.0, 0.0]), (60, [float("inf"), 0.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    points = {i: np.array(v) for i, v in rows if np.isfinite(v).all()}
    for q in (20, 40, 100):
        best = sorted((-(points[q] @ v), i) for i, v in points.items() if i != q)[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)][0] == best[0][1]
    assert {r.query_id for r in got} == {20, 40, 100}


def test_a_rare_cell_hardly_moves_the_share_that_the_query_keeps(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rare = spark.createDataFrame([(10**9, "a few rare words here", "xx", "a new source", 21)], docs.schema)

    def share(rows):
        total = mixing.mixing_plan(rows).agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability"))).first()
        return total[1] / total[0]

    assert abs(share(docs) - mixing.KEPT_SHARE) < 0.001 and abs(share(docs.unionByName(rare)) - share(docs)) < 0.001


@pytest.mark.parametrize("part", ["@ " + " " * 20_000, "x " * 10_000 + "@ ", "a@b.co, " * 300 + "jo at mail dot com. " * 300, "( " * 10_000 + "@ ", " (at) " * 3000, "+1 " * 7000 + "@ "])
def test_pii_takes_time_in_proportion(part):
    def took(text):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            pii.find(text)
            best = min(best, time.perf_counter() - began)
        return best

    pii.find(part)
    assert took(part * 8) < 25 * took(part) + 0.05  # eight times the text; squares would take 64 times


def test_pii_overlaps_equal_a_plain_look_at_all_pairs():
    rnd = random.Random(9)
    for _ in range(2000):
        spans = [(a, a + rnd.randrange(1, 9)) for a in (rnd.randrange(60) for _ in range(rnd.randrange(8)))]
        starts, ends = pii.joined(spans)
        for s in range(70):
            for e in (s + 1, s + 4):
                at = bisect_left(starts, e) - 1
                assert (at >= 0 and ends[at] > s) == any(s < b and a < e for a, b in spans)


def test_pipeline_stages_read_small_batches(spark):
    """With Spark's own limits one batch holds all of these texts."""
    import pyarrow as pa

    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {k: spark.conf.get(k) for k in keys}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    try:
        pieces = corpus_pipeline.packing_stage(spark, docs, SF_SMALL)
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert max(r.bytes for r in got) < 6 << 20 and sum(r.n for r in got) == 3000
        assert pieces.selectExpr("sum(length)", "3000 * max(doc_tokens)", "count(distinct doc_id)").collect() == [(3000 * 2001, 3000 * 2001, 3000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
