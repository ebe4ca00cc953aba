"""Nearest neighbours by largest inner product on robust-pruned graphs.

Equal vectors are one node. Nodes are dealt into shards of about ``SHARD_ROWS``
by a hash; each shard builds a directed graph: nodes are inserted in batches,
a greedy beam search from the shard's middle proposes neighbours, and relaxed
distance pruning (a candidate is dropped if a chosen neighbour is ``ALPHA``
times nearer to it than the node is) keeps diverse edges, both ways. Inner
product becomes Euclidean distance by one more coordinate that gives all nodes
of a shard the same norm. Nodes that no walk reaches get an edge from the nearest
that one does. Each shard is tried against brute force on some of its nodes and
doubles its beam until the search finds ``RECALL`` of their nearest: clustered
vectors need a narrow beam, Gaussian ones a wide one. The index is written once;
a beam search of every shard answers each query, and the exact double-precision
products of the vectors found decide the order.

A query set is cut into blocks so that a task holds one shard and one block.
A node carries its ``keep`` smallest ids only: the others of equal vectors can
never be among the nearest ``k``.

Edge cases: null, empty, zero vectors and those with null or non-finite
components take no part; vectors of different lengths never meet; repeated
rows count once; fewer than ``k`` candidates are all returned; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD_ROWS = 12_800
QUERY_BLOCK = 20_000
DEGREE = 48
BUILD_BEAM = 96
STARTS = 64
SEARCH_BEAM = 160
ALPHA = 1.2
RECALL, TRIALS = 0.95, 64  # a shard's beam grows until a search finds this share of the nearest of so many of its nodes
FAR = np.float32(np.inf)


def unit_norm(x: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate, all of the same norm: near is then large product.

    They are scaled by the largest component first, so no finite vector overflows.
    """
    x = x / np.abs(x).max()
    square = np.einsum("ij,ij->i", x, x)
    rest = np.sqrt(np.maximum(square.max() - square, 0))
    return np.column_stack([x, rest]).astype(np.float32)


def asked_points(queries: np.ndarray) -> np.ndarray:
    """Queries in the same space; their own lengths do not change who is near."""
    scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
    return np.column_stack([scaled, np.zeros(len(queries))]).astype(np.float32)


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(node ids, squared distances less the query's square) of the ``beam`` nearest nodes that a greedy search meets; -1 where there are fewer."""
    n, many = len(x), len(queries)
    square = np.einsum("ij,ij->i", x, x)
    rows = np.arange(many)
    seen = np.zeros((many, n + 1), dtype=bool)
    ids = np.full((many, beam), -1, dtype=np.int32)
    near = np.full((many, beam), FAR, dtype=np.float32)
    done = np.ones((many, beam), dtype=bool)
    first = starts[:beam]
    ids[:, :len(first)] = first
    near[:, :len(first)] = square[first] - 2 * queries @ x[first].T
    done[:, :len(first)] = False
    seen[:, first] = True
    seen[:, n] = True  # the place of missing edges
    order = np.argsort(near, axis=1, kind="stable")
    ids, near, done = (np.take_along_axis(a, order, 1) for a in (ids, near, done))
    live = rows
    while len(live):
        pick = np.argmin(done[live], axis=1)  # the nearest node not yet opened
        open_ = ~done[live, pick]
        live, pick = live[open_], pick[open_]
        if not len(live):
            break
        done[live, pick] = True
        next_ = edges[ids[live, pick]]
        fresh = ~seen[live[:, None], next_]
        seen[live[:, None], next_] = True
        some = np.where(fresh, next_, 0)
        far = square[some] - 2 * np.einsum("bd,bed->be", queries[live], x[some])
        far[~fresh] = FAR
        all_ids = np.concatenate([ids[live], np.where(fresh, next_, -1)], axis=1)
        all_near = np.concatenate([near[live], far], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argpartition(all_near, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_near, best, 1), axis=1, kind="stable"), 1)
        ids[live], near[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_near, all_done))
        done[live] |= ids[live] < 0
    return ids, near


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most ``degree`` of its candidates (-1: none): the nearest first, without those that a chosen one covers.

    Places that are left go to the nearest of the covered ones: with unequal norms
    pruning alone leaves few edges, and parts of the graph out of reach.
    """
    own = x[nodes]
    valid = (candidates >= 0) & (candidates != nodes[:, None])
    points = x[np.where(valid, candidates, 0)]
    to_node = np.einsum("bcd,bcd->bc", points - own[:, None], points - own[:, None])
    order = np.lexsort((candidates, np.where(valid, to_node, FAR)), axis=1)
    candidates, valid, to_node = (np.take_along_axis(a, order, 1) for a in (candidates, valid, to_node))
    valid[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    points = np.take_along_axis(points, order[:, :, None], 1)
    square = np.einsum("bcd,bcd->bc", points, points)
    out = np.full((len(nodes), degree), -1, dtype=np.int32)
    live, covered, rows = valid.copy(), valid.copy(), np.arange(len(nodes))
    chosen_of = np.zeros(len(nodes), dtype=np.int64)
    for k in range(degree):
        has = live.any(axis=1)
        if not has.any():
            break
        at = np.argmax(live, axis=1)
        chosen = points[rows, at]
        out[:, k] = np.where(has, candidates[rows, at], -1)
        chosen_of += has
        covered[rows[has], at[has]] = False
        between = square + square[rows, at][:, None] - 2 * np.einsum("bcd,bd->bc", points, chosen)
        live &= alpha * alpha * between > to_node
        live[rows, at] = False
    place = np.cumsum(covered, axis=1) - 1 + chosen_of[:, None]
    row, at = np.nonzero(covered & (place < degree))
    out[row, place[row, at]] = candidates[row, at]
    return out


def reached(edges: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which nodes a walk along the edges can reach."""
    n = len(edges)
    seen = np.zeros(n + 1, dtype=bool)
    seen[starts] = True
    front = starts
    while len(front):
        front = np.unique(edges[front])
        front = front[~seen[front] & (front < n)]
        seen[front] = True
    return seen[:n]


def all_reachable(x: np.ndarray, edges: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The edges, and one to each node (or to one of its group) that no walk reaches, from the nearest node that one does."""
    n = len(x)
    while not (seen := reached(edges, starts)).all():
        lost, known = np.flatnonzero(~seen), np.flatnonzero(seen)
        nearest = np.concatenate([known[np.argmin(np.einsum("ij,ij->i", x[known], x[known]) - 2 * x[some] @ x[known].T, axis=1)] for some in np.array_split(lost, -(-len(lost) // 256))])
        from_, first = np.unique(nearest, return_index=True)  # one a node and round
        to = lost[first]
        if (edges[from_] < n).all(axis=1).any():
            edges = np.column_stack([edges, np.full(n, n, dtype=np.int32)])
        edges[from_, np.argmax(edges[from_] == n, axis=1)] = to
    return edges


def fitting_beam(x: np.ndarray, space: np.ndarray, edges: np.ndarray, starts: np.ndarray, k: int, least: int = 0) -> int:
    """The smallest beam, doubled from ``SEARCH_BEAM`` on, that finds ``RECALL`` of the k nearest of some nodes; brute force tells which they are."""
    n = len(x)
    some = np.random.default_rng(11).permutation(n)[:TRIALS]
    asked = asked_points(x[some])
    product = asked[:, :-1].astype(np.float64) @ (x / np.abs(x).max()).T
    best = np.sort(product, axis=1)[:, -min(k, n):][:, :1]  # the score of the last of the k
    beam = max(SEARCH_BEAM, least)
    while beam < n:
        found, _ = beam_search(space, edges, asked, starts, beam)
        right = np.take_along_axis(product, np.maximum(found, 0), 1) >= best
        if (right & (found >= 0)).sum() >= RECALL * min(k, n) * len(some):
            return beam
        beam *= 2
    return n


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(edges (n, degree) with n for none, start nodes) of a shard."""
    n = len(x)
    edges = np.full((n, degree), n, dtype=np.int32)
    middle = int(np.argmin(np.einsum("ij,ij->i", x - x.mean(axis=0), x - x.mean(axis=0))))
    if n <= 1:
        return edges, np.array([middle], dtype=np.int32)
    shuffled = np.random.default_rng(7).permutation(n)
    # answers to large products are often the longest vectors: they are starts too, and the first to be inserted
    longest = np.argsort(x[:, -1], kind="stable")[:STARTS]
    starts = np.unique(np.concatenate([[middle], longest])).astype(np.int32)
    inserted = np.concatenate([starts, shuffled[~np.isin(shuffled, starts)]])
    at = 1
    while at < n:
        batch = inserted[at:at + max(1, min(400, at))]
        found, _ = beam_search(x, edges, x[batch], inserted[:min(at, len(starts))].astype(np.int32), beam)
        if len(batch) > 1:  # nodes of one batch do not see each other in the graph yet
            peers = np.argpartition(-(x[batch] @ x[batch].T), min(8, len(batch) - 1), axis=1)[:, :9]
            found = np.concatenate([found, np.where(batch[peers] == batch[:, None], -1, batch[peers])], axis=1).astype(np.int32)
        chosen = robust_prune(x, batch, found, degree, alpha)
        edges[batch] = np.where(chosen < 0, n, chosen)
        to = chosen.ravel()
        from_ = np.repeat(batch, degree)[to >= 0]
        add_back(x, edges, to[to >= 0], from_, degree, alpha)
        at += len(batch)
    return all_reachable(x, edges, starts), starts


def add_back(x: np.ndarray, edges: np.ndarray, to: np.ndarray, from_: np.ndarray, degree: int, alpha: float) -> None:
    """Add the edges to -> from_; nodes with too many are pruned again."""
    n = len(x)
    order = np.argsort(to, kind="stable")
    to, from_ = to[order], from_[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    new = np.full((len(nodes), count.max()), -1, dtype=np.int32)
    new[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = from_
    old = np.where(edges[nodes] == n, -1, edges[nodes])
    every = np.concatenate([old, new], axis=1)
    every[:, degree:][(every[:, degree:, None] == old[:, None, :]).any(axis=2)] = -1
    full = (every >= 0).sum(axis=1) > degree
    room = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)[:, :degree]
    edges[nodes[~full]] = np.where(room[~full] < 0, n, room[~full])
    for at in range(0, int(full.sum()), 256):
        some = np.flatnonzero(full)[at:at + 256]
        kept = robust_prune(x, nodes[some], every[some], degree, alpha)
        edges[nodes[some]] = np.where(kept < 0, n, kept)


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite numbers, not all zero."""
    return (vector.isNotNull() & (F.size(vector) > 0)
            & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists(vector, lambda v: v != 0))


def vectors_of(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False)))


def nodes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """(vector, dim, ids): distinct vectors with their ``keep`` smallest ids."""
    rank = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    first = vectors.distinct().withColumn("place", rank).where(F.col("place") <= keep)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("vector"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


INDEX = "dim int, shard long, n long, beam long, vectors binary, ids binary, counts binary, edges binary, starts binary"


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """One row per shard: its vectors, ids, graph and beam, as bytes. Written once."""
    per_dim = nodes.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / shard_rows)).alias("shards"))
    dealt = nodes.join(per_dim, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")))

    def build(key, table):
        ids = table["ids"].combine_chunks()
        x = matrix(table["vector"])
        order = np.argsort([v[0] for v in ids.to_pylist()], kind="stable")  # the same graph, whatever order the shuffle delivers
        ids = ids.take(pa.array(order))
        x = x[order]
        space = unit_norm(x)
        edges, starts = build_graph(space)
        flat, counts = np.asarray(ids.flatten(), dtype=np.int64), np.diff(np.asarray(ids.offsets))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([len(x)], pa.int64()),
                         "beam": pa.array([fitting_beam(x, space, edges, starts, k, beam)], pa.int64()),
                         **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (
                             ("vectors", x), ("ids", flat), ("counts", counts.astype(np.int64)), ("edges", edges), ("starts", starts))}})

    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: shards are small in bytes and long in work
    return dealt.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, INDEX).checkpoint()


FOUND = "query_id long, vec_id long, score double"


def search_shard(queries: np.ndarray, query_ids: np.ndarray, row: dict, k: int) -> pa.Table:
    """The k best of one shard for each query."""
    n, dim = row["n"], row["dim"]
    x = np.frombuffer(row["vectors"], dtype=np.float64).reshape(n, dim)
    ids, counts = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["counts"], dtype=np.int64)
    edges = np.frombuffer(row["edges"], dtype=np.int32).reshape(n, -1)
    starts = np.frombuffer(row["starts"], dtype=np.int32)
    first = np.concatenate([[0], np.cumsum(counts)])
    space = unit_norm(x)
    beam = min(n, row["beam"])
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(queries), 256):
        q, own = queries[at:at + 256], query_ids[at:at + 256]
        found, _ = beam_search(space, edges, asked_points(q), starts, beam)
        points = x[np.maximum(found, 0)]
        score = np.einsum("bd,bcd->bc", q, points)
        score[found < 0] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")[:, :k + 1]
        found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
        query, node = np.repeat(np.arange(len(q)), found.shape[1]), found.ravel()
        ok = node >= 0
        query, node, score = query[ok], node[ok], score.ravel()[ok]
        c = counts[node]
        member = ids[np.repeat(first[node], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
        query, score = np.repeat(query, c), np.repeat(score, c)
        ok = member != own[query]
        query, member, score = query[ok], member[ok], score[ok]
        order = np.lexsort((member, -score, query))
        query, member, score = query[order], member[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        ok = place < k
        out.append((own[query[ok]], member[ok], score[ok]))
    a, b, c = (np.concatenate(v) for v in zip(*out, strict=True))
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})


def nearest(table: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``queries`` (a condition on vec_id) holds."""
    vectors = vectors_of(table, vec_id, embedding)
    index = build_index(nodes_of(vectors, k + 1), shard_rows, k, beam)
    asked = vectors.where(queries).distinct().withColumn("dim", F.size("vector"))
    blocks = max(1, -(-asked.count() // query_block))
    shards = index.select(F.col("dim").alias("to_dim"), F.col("shard").alias("to_shard"))
    # each query meets each shard of its dimension once; a block of queries and one shard make a task
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = asked.join(shards, F.col("dim") == F.col("to_dim")).select("vec_id", "vector", "part", "to_dim", "to_shard")
    spread = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return search_shard(matrix(left["vector"]), left["vec_id"].to_numpy(), right.to_pylist()[0], k)

    found = asked.groupBy("to_dim", "to_shard", "part").cogroup(spread.groupBy("dim", "shard", "part")).applyInArrow(search, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
