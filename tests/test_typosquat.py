"""Blocked brand join against all pairs."""

import random
from unittest import mock

from hypothesis import given, settings
from hypothesis import strategies as st

from brute import edit_distance
from hookline.operators.typosquat import brand_matches, nearest_brands, search_nearest
from hookline.session import materialize


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abgloe0", min_size=0, max_size=8), min_size=1, max_size=30),
       st.lists(st.text(alphabet="abgloe", min_size=1, max_size=8), min_size=1, max_size=10))
def test_blocked_join_finds_every_pair(spark, labels, brands):
    ldf = spark.createDataFrame([(x,) for x in labels], "main_label string")
    bdf = spark.createDataFrame([(x,) for x in brands], "brand string")
    got = {(r.label, r.brand, r.distance) for r in brand_matches(ldf, bdf).collect()}
    want = {(a, b, edit_distance(a, b)) for a in set(labels) for b in set(brands) if edit_distance(a, b) <= 2}
    assert got == want


def test_long_labels_and_brand_tables(spark):
    labels = spark.createDataFrame([("googel",), ("x" * 5000,), (None,)], "main_label string")
    brands = spark.createDataFrame([(i, b) for i, b in enumerate(["paypal", "google", "goggle"] + [f"brand{i}" for i in range(600)])], "brand_idx long, brand string")
    got = {(r.label, r.brand): r.distance for r in brand_matches(labels, brands).collect()}
    assert got == {("googel", "google"): 2}
    near = {r.label: (r.distance, r.brand) for r in nearest_brands(labels, brands).collect()}
    assert near["googel"] == (2, "google") and near["x" * 5000][0] == 5000


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="abgloe0", min_size=0, max_size=12), min_size=1, max_size=25), st.lists(st.text(alphabet="abglz", min_size=0, max_size=9), min_size=1, max_size=25))
def test_segment_search_finds_the_first_nearest_brand(spark, labels, brands):
    ldf = spark.createDataFrame([(x,) for x in labels], "main_label string")
    bdf = spark.createDataFrame([*enumerate(brands), (99, None)], "brand_idx long, brand string")
    got = {r.label: (r.distance, r.brand) for r in search_nearest(ldf, bdf).matches.collect()}
    want = {x: min((edit_distance(x, b), i, b) for i, b in enumerate(brands)) for x in set(labels)}
    assert got == {x: (d, b) for x, (d, _, b) in want.items()}


def test_segment_search_compares_few_pairs(spark):
    """Twice the brands and twice the labels make about twice the pairs, a small part of all."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(8, 15)))
    every = [word() for _ in range(8000)]
    pairs = {}
    for n in (4000, 8000):
        labels = [b[:3] + rnd.choice("xyz") + b[4:] for b in every[:n // 4]] + [b[1:] for b in every[:n // 4]]
        ldf = spark.createDataFrame([(x,) for x in labels], "main_label string")
        found = search_nearest(ldf, spark.createDataFrame(list(enumerate(every[:n])), "brand_idx long, brand string"))
        assert {r.distance for r in found.matches.collect()} <= {0, 1} and [r[0] for r in found.rounds] == [1]
        pairs[n] = sum(r[2] for r in found.rounds)
        assert pairs[n] < len(labels) * n / 100
    assert pairs[8000] < 3 * pairs[4000]


def test_segment_search_without_brands_or_labels(spark):
    some = spark.createDataFrame([("a",)], "main_label string")
    none = spark.createDataFrame([], "brand_idx long, brand string")
    assert nearest_brands(some, none).count() == 0
    assert nearest_brands(some.where("false"), spark.createDataFrame([(0, "b")], "brand_idx long, brand string")).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="abg0", min_size=0, max_size=6), min_size=1, max_size=20), st.lists(st.text(alphabet="abg", min_size=0, max_size=6), min_size=1, max_size=20),
       st.sampled_from(["", "shop", "automobile"]), st.sampled_from(["", "shop", "my-automobile", "x"]), st.sampled_from(["", "s"]))
def test_refined_meetings_lose_nothing(spark, labels, brands, word, start, end):
    """Every text met by two rows or more is refined, down to the last character."""
    names = [word + b for b in brands]
    ldf = spark.createDataFrame([(start + x + end,) for x in labels], "main_label string")
    bdf = spark.createDataFrame([*enumerate(names)], "brand_idx long, brand string")
    with mock.patch.multiple("hookline.operators.typosquat", FEW_BRANDS=1, FEW_LABELS=0, FEW_PAIRS=0):
        got = {r.label: (r.distance, r.brand) for r in search_nearest(ldf, bdf).matches.collect()}
    want = {start + x + end: min((edit_distance(start + x + end, b), i, b) for i, b in enumerate(names)) for x in set(labels)}
    assert got == {x: (d, b) for x, (d, _, b) in want.items()}


def test_names_made_from_one_word_make_few_pairs(spark):
    rnd = random.Random(9)
    every = list({"automobile" + "".join(rnd.choice("0123456789") for _ in range(6)) for _ in range(9000)})[:8000]
    for n in (4000, 8000):
        ldf = spark.createDataFrame([("my-" + b,) for b in every[:n // 4]], "main_label string")
        found = search_nearest(ldf, spark.createDataFrame(list(enumerate(every[:n])), "brand_idx long, brand string"))
        near = {r.label: (r.distance, r.brand) for r in found.matches.collect()}
        assert near == {"my-" + b: (3, b) for b in every[:n // 4]}
        assert sum(r[2] for r in found.rounds) < 40 * n  # not n / 4 for each name


def test_pieces_are_not_broadcast(spark):
    """The files under them look small to Spark, whatever number of pieces their rows make."""
    plans = {}

    def seen(df, name):
        df.collect()
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    names = [f"automobile{i}" for i in range(30)]
    ldf = spark.createDataFrame([("my-" + b,) for b in names], "main_label string")
    bdf = spark.createDataFrame(list(enumerate(names)), "brand_idx long, brand string")
    with mock.patch.multiple("hookline.operators.typosquat", FEW_BRANDS=1, FEW_LABELS=0, FEW_PAIRS=0, materialize=seen):
        got = {r.label: (r.distance, r.brand) for r in search_nearest(ldf, bdf).matches.collect()}
    assert got == {"my-" + b: (3, b) for b in names}
    assert plans["brand-met"] and plans["brand-names-met"]
    assert not [p for name in ("brand-met", "brand-names-met") for p in plans[name] if "BroadcastExchange" in p]
