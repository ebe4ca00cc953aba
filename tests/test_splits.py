"""Exact ranks, stratified splits and folds against plain-Python arithmetic."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from hookline.operators.ranking import rank_within, running_sums
from hookline.operators.selection import class_cuts, cuts_passed, integer_key
from hookline.operators.splits import stratified_folds, stratified_split, three_way_split


def _frame(spark, labels):
    return spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "id long, label int")


def _labels(n, every=3):
    return [1 if (i * 7) % every == 0 else 0 for i in range(n)]


def _approx_mode(counts, draws):
    """Largest-remainder allocation, ties to the smaller label."""
    total = sum(counts.values())
    cont = {k: v / total * draws for k, v in counts.items()}
    fl = {k: math.floor(c) for k, c in cont.items()}
    need = draws - sum(fl.values())
    for k in sorted(cont, key=lambda k: (-(cont[k] - fl[k]), k))[:need]:
        fl[k] += 1
    return fl


def test_rank_within_matches_sort(spark):
    df = spark.createDataFrame([(i, i % 3, (i * 37) % 101) for i in range(500)], "id long, g int, v int")
    got = {r.id: r.rank for r in rank_within(df, ["g"], ["v", "id"], partitions=7).collect()}
    for g in range(3):
        rows = sorted((v, i) for i, gg, v in [(i, i % 3, (i * 37) % 101) for i in range(500)] if gg == g)
        for pos, (_, i) in enumerate(rows, 1):
            assert got[i] == pos


def test_running_sums(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(200)], "k long, q long")
    got = {r.k: r.q_before for r in running_sums(df, "k", ["q"], partitions=6).collect()}
    acc = 0
    for k in range(200):
        assert got[k] == acc
        acc += k % 5


def test_stratified_split_sizes_and_order(spark):
    labels = _labels(103)
    out = {r.id: r.split for r in stratified_split(_frame(spark, labels), ratio=0.2).collect()}
    counts = {0: labels.count(0), 1: labels.count(1)}
    n = len(labels)
    keep = _approx_mode(counts, n - math.ceil(0.2 * n))
    for lab in (0, 1):
        ids = [i for i, l in enumerate(labels) if l == lab]
        ids.sort(key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
        hold = counts[lab] - keep[lab]
        assert [out[i] for i in ids] == ["validation"] * hold + ["train"] * (counts[lab] - hold)


def test_cuts_are_exact_order_statistics(spark):
    rnd = random.Random(2)
    for n, spread in [(1, 10), (40, 3), (700, 10**18), (3000, 5000), (2000, 70_000)]:
        ids = rnd.sample(range(-spread, spread + n), n)
        rows = [(i, rnd.choice("ab")) for i in ids]
        df = spark.createDataFrame(rows, "id long, label string")
        ranks = {lab: [0, 1, len(own) // 3, len(own), len(own) + 5] for lab in {x for _, x in rows} for own in [[i for i, x in rows if x == lab]]}
        cuts = class_cuts(df, "label", integer_key(F.col("id")), ranks, 16)
        got = df.join(cuts, "label").withColumn("passed", cuts_passed(integer_key(F.col("id")))).collect()
        for lab, ks in ranks.items():
            own = sorted((r.id, r.passed) for r in got if r.label == lab)
            assert [p for _, p in own] == [sum(k <= place for k in ks) for place in range(len(own))]


def test_splits_keep_rows_of_one_id_together_and_move_no_feature_rows(spark):
    df = _frame(spark, _labels(300)).withColumn("x", F.rand(1))
    twice = df.unionByName(df)
    sides = twice.select("id", "label").transform(lambda d: stratified_split(d)).groupBy("id").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
    assert sides == 0
    plan = stratified_split(df)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan.split("== Optimized Logical Plan ==")[0].replace("WindowGroup", "")


def test_three_way_split(spark):
    labels = _labels(250)
    out = [r.split for r in three_way_split(_frame(spark, labels)).collect()]
    assert out.count("test") == math.ceil(0.1 * 250)
    assert len(out) == 250 and set(out) == {"train", "validation", "test"}


def _sk_folds(labels, k):
    """Unshuffled stratified k-fold assignment, written out directly."""
    order = []
    for l in labels:
        if l not in order:
            order.append(l)
    enc = [order.index(l) for l in labels]
    y_sorted = sorted(enc)
    alloc = [[y_sorted[i::k].count(c) for c in range(len(order))] for i in range(k)]
    fold = [None] * len(labels)
    for c in range(len(order)):
        seq = [f for f in range(k) for _ in range(alloc[f][c])]
        idx = [i for i, e in enumerate(enc) if e == c]
        for i, f in zip(idx, seq):
            fold[i] = f
    return fold


def test_stratified_folds_match_direct_allocation(spark):
    for n, k, every in [(103, 5, 3), (57, 3, 4), (12, 5, 2), (250, 5, 7)]:
        labels = _labels(n, every)
        got = {r.id: r.fold for r in stratified_folds(_frame(spark, labels), k).collect()}
        assert [got[i] for i in range(n)] == _sk_folds(labels, k), (n, k)


def test_rank_within_random_layouts(spark):
    rnd = random.Random(9)
    for _ in range(3):
        n, groups, parts = rnd.randint(1, 400), rnd.randint(1, 6), rnd.randint(1, 9)
        rows = [(i, rnd.randrange(groups), rnd.randrange(50)) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, g int, v int")
        got = {r.id: r.rank for r in rank_within(df, ["g"], ["v", "id"], partitions=parts).collect()}
        for g in range(groups):
            ordered = sorted((v, i) for i, gg, v in rows if gg == g)
            assert [got[i] for _, i in ordered] == list(range(1, len(ordered) + 1))
