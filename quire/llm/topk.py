"""Exact top-k by inner product: dual-tree search over cover trees, in blocks.

The upper nodes of a cover tree over a bounded sample are regions: every vector belongs to the nearest
centre, and Spark counts each region's vectors and its covering radius. A query is first searched in the
region of its best centre. Its kth score from there then rules out every region whose centre and radius
allow no such inner product; only what is left is sent to meet it, in blocks of bounded size. Within
a pair of blocks both sides are indexed by a cover tree: the points of a node are covered by balls of half its radius around points
that are further apart than that; small balls share a leaf. Node pairs are searched from the roots
down and pruned when the largest inner product that their balls allow is below the worst kth score
of the query node.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of
different lengths are not compared; rows that share an id and a vector count once; a query never
meets rows with its own id; equal scores go to the smaller id; fewer candidates than k give fewer rows;
inner products that could leave 64 bits raise an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.store import keep, table

DATA_BLOCK, QUERY_BLOCK, LEAF = 4096, 2048, 64
#: Most regions, and vectors of the sample for each.
REGIONS, SAMPLED = 1024, 16


class Tree(NamedTuple):
    center: np.ndarray  # nodes x dimensions
    norm: np.ndarray
    radius: np.ndarray
    children: list[list[int]]
    points: list[np.ndarray]  # below each node


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)))


def _net(x: np.ndarray, points: np.ndarray, reach: float) -> list[np.ndarray]:
    """Groups of points within ``reach`` of their first one; the first ones lie further apart than that."""
    groups, chunk, all_ = [], 256, points
    x = x[points] - x[points[0]]  # distances among near points keep their digits
    points = np.arange(len(points))
    while len(points):
        front = points[:chunk]
        near = _distance(x[front], x[front]) <= reach
        free, heads = np.ones(len(front), bool), []
        for i in range(len(front)):
            if free[i]:
                heads.append(i)
                free &= ~near[i]
        close = _distance(x[front[heads]], x[points]) <= reach
        close[np.arange(len(heads)), heads] = True
        owner = np.where(close.any(axis=0), close.argmax(axis=0), -1)
        owner[heads] = np.arange(len(heads))
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(len(heads) + 1))
        for h in range(len(heads)):
            members = points[order[cut[h] : cut[h + 1]]]
            head = front[heads[h]]
            groups.append(all_[np.concatenate(([head], members[members != head]))])
        points = points[np.sort(order[: cut[0]])]
    return groups


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """Tree over the rows of ``x``; node 0 is the root."""
    center, radius, children, points = [], [], [], []
    todo = [(np.arange(len(x)), -1)]
    while todo:
        own, parent = todo.pop()
        away = np.sqrt(((x[own] - x[own[0]]) ** 2).sum(axis=1)).max()
        at = len(center)
        center.append(own[0])
        radius.append(away * (1 + 1e-9) + 1e-9)
        children.append([])
        points.append(own)
        if parent >= 0:
            children[parent].append(at)
        if len(own) <= leaf or away == 0:
            continue
        groups = _net(x, own, away / 2)
        if len(groups) == 1:  # closer than these numbers can tell
            continue
        pack: list[np.ndarray] = []
        for group in sorted(groups, key=len):
            if len(group) > leaf:
                todo.append((group, at))
            elif sum(map(len, pack)) + len(group) > leaf:
                todo.append((np.concatenate(pack), at))
                pack = [group]
            else:
                pack.append(group)
        if pack:
            todo.append((np.concatenate(pack), at))
    c = x[np.array(center)]
    return Tree(c, np.sqrt((c * c).sum(axis=1)), np.array(radius), children, points)


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of each query's k best in one block; integers in, exact integers out."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, data.shape[1])
    if largest >= 2**62:
        raise OverflowError("inner products of these vectors can leave 64 bits")
    small = largest < 2**52
    q, r = queries.astype(np.float64), data.astype(np.float64)
    qt, rt = cover_tree(q), cover_tree(r)
    lowest = np.iinfo(np.int64).min
    score = np.full((len(q), k), lowest, np.int64)
    ids = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)

    def upper(node: int, others: np.ndarray) -> np.ndarray:
        """Largest inner products that a query node allows with data nodes, rounded up."""
        top = rt.center[others] @ qt.center[node] + qt.norm[node] * rt.radius[others] + rt.norm[others] * qt.radius[node] + qt.radius[node] * rt.radius[others]
        return top + np.abs(top) * 1e-9 + 1e-6

    def meet(own: np.ndarray, theirs: np.ndarray) -> None:
        s = (q[own] @ r[theirs].T).astype(np.int64) if small else queries[own] @ data[theirs].T
        allowed = query_ids[own][:, None] != data_ids[theirs][None, :]
        better = allowed & (s >= score[own, -1][:, None])
        rows = np.flatnonzero(better.any(axis=1))
        if not len(rows):
            return
        new_s = np.concatenate((score[own[rows]], np.where(better[rows], s[rows], lowest)), axis=1)
        new_i = np.concatenate((ids[own[rows]], np.where(better[rows], data_ids[theirs][None, :], np.iinfo(np.int64).max)), axis=1)
        by_id = np.argsort(new_i, axis=1, kind="stable")
        new_s, new_i = np.take_along_axis(new_s, by_id, 1), np.take_along_axis(new_i, by_id, 1)
        best = np.argsort(~new_s, axis=1, kind="stable")[:, :k]  # from high to low
        score[own[rows]], ids[own[rows]] = np.take_along_axis(new_s, best, 1), np.take_along_axis(new_i, best, 1)

    todo = [(0, np.array([0]))]
    while todo:
        node, others = todo.pop()
        own = qt.points[node]
        others = others[upper(node, others) >= score[own, -1].min()]
        if qt.children[node]:
            opened = np.array([c for o in others for c in (rt.children[o] or [o])], np.int64)
            todo += [(c, opened) for c in qt.children[node]]
            continue
        bounds = upper(node, others)
        queue = others[np.argsort(-bounds, kind="stable")]
        while len(queue):
            front, queue = queue[:8], queue[8:]
            leaves = [o for o in front if not rt.children[o]]
            if leaves:
                meet(own, np.concatenate([rt.points[o] for o in leaves]))
            inner = [c for o in front for c in rt.children[o]]
            queue = np.concatenate((np.array(inner, np.int64), queue))
            if len(queue):
                bounds = upper(node, queue)
                keep = bounds >= score[own, -1].min()
                queue = queue[keep][np.argsort(-bounds[keep], kind="stable")]
    row, place = np.nonzero(ids != np.iinfo(np.int64).max)
    return row, ids[row, place], score[row, place]


def _matrix(t: pa.Table, vector: str) -> np.ndarray:
    c = t.column(vector).combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(c), -1) if len(c) else np.zeros((0, 0), np.int64)


class Regions(NamedTuple):
    """The regions of the vectors of one length."""

    center: np.ndarray
    count: np.ndarray
    radius: np.ndarray


def centers(sample: np.ndarray, most: int) -> np.ndarray:
    """Centres of upper nodes of a cover tree: the widest node is opened until there are ``most``, or only leaves."""
    tree = cover_tree(sample, leaf=1)
    front = [(-tree.radius[0], 0)]
    while len(front) < most and tree.children[front[0][1]]:
        _, node = heapq.heappop(front)
        for c in tree.children[node]:
            heapq.heappush(front, (-tree.radius[c] if tree.children[c] else 0.0, c))
    return np.unique(tree.center[[node for _, node in front]], axis=0)


def _vectors(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64)


def _by_length(v: pa.Array, kind: pa.DataType, judge: Callable[[int, np.ndarray], list]) -> pa.Array:
    """What ``judge`` says of the rows of each length."""
    lengths = pc.list_value_length(v).to_numpy()
    out = np.empty(len(v), object)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        out[at] = np.fromiter(judge(int(d), _vectors(v.take(pa.array(at)))), object, len(at))
    return pa.array(out.tolist(), kind)


def nearest(v: Column, found: Broadcast) -> Column:
    """``struct<region, away>``: the region with the nearest centre, and how far that is."""

    @F.arrow_udf("region int, away double")
    def placed(batch: pa.Array) -> pa.Array:
        def judge(d: int, x: np.ndarray) -> list:
            c = found.value.get(d, np.zeros((1, d)))
            at = _distance(x, c).argmin(axis=1)
            return [{"region": int(r), "away": float(a)} for r, a in zip(at, np.sqrt(((x - c[at]) ** 2).sum(axis=1)), strict=True)]

        return _by_length(batch, pa.struct([("region", pa.int32()), ("away", pa.float64())]), judge)

    return placed(v)


def best_region(v: Column, regions: Broadcast) -> Column:
    """The region whose centre has the largest inner product."""

    @F.arrow_udf("int")
    def best(batch: pa.Array) -> pa.Array:
        def judge(d: int, x: np.ndarray) -> list:
            r = regions.value.get(d)
            return (x @ r.center.T - np.where(r.count > 0, 0, np.inf)).argmax(axis=1).tolist() if r else [None] * len(x)

        return _by_length(batch, pa.int32(), judge)

    return best(v)


def reachable(v: Column, least: Column, done: Column, regions: Broadcast) -> Column:
    """The regions, but ``done``, that can hold an inner product of ``least``; all if that is null."""

    @F.arrow_udf("array<int>")
    def reached(batch: pa.Array, scores: pa.Array, first: pa.Array) -> pa.Array:
        lengths, out = pc.list_value_length(batch).to_numpy(), []
        for d, vector, score, own in zip(lengths.tolist(), batch.to_pylist(), scores.to_pylist(), first.to_pylist(), strict=True):
            r = regions.value.get(d)
            if r is None:
                out.append([])
                continue
            x = np.array(vector, np.float64)
            top = r.center @ x + np.sqrt(x @ x) * r.radius
            allowed = (r.count > 0) & (top + np.abs(top) * 1e-9 + 1e-6 >= (-np.inf if score is None else score))
            out.append([i for i in np.flatnonzero(allowed).tolist() if i != own])
        return pa.array(out, pa.list_(pa.int32()))

    return reached(v, least, done)


def in_regions(data: DataFrame, asked: DataFrame, k: int, data_block: int, query_block: int) -> DataFrame:
    """``query_id, query, vec_id, score``: each asked query's k best of each block of its ``region``, from ``d, region, id, h, v`` on both sides."""
    key = ["d", "region"]
    many = lambda df, block, name: df.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(float(block))).alias(name))
    plan = F.broadcast(many(data, data_block, "n").join(many(asked, query_block, "m"), key))  # a row for each region at most
    side = lambda df, own, n, other, m: df.join(plan, key).select(*key, F.pmod(F.xxhash64("id", "h"), F.col(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)).alias(other), "id", "h", "v")
    left = side(data, "r", "n", "q", "m").groupBy(*key, "r", "q")
    right = side(asked, "q", "m", "r", "n").groupBy(*key, "r", "q")

    def block(own: pa.Table, asked: pa.Table) -> pa.Table:
        empty = not own.num_rows or not asked.num_rows
        x, y = (np.zeros((0, 0), np.int64),) * 2 if empty else (_matrix(own, "v"), _matrix(asked, "v"))
        if empty:
            return pa.table({"query_id": pa.array([], pa.int64()), "query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        digests = asked.column("h").to_numpy()
        ids, query_ids = (t.column("id").to_numpy() for t in (own, asked))
        # Of equal vectors only the k + 1 smallest ids can be among the k best of a query that is not one of them.
        order = np.lexsort((ids, *x.T[::-1]))
        x, ids = x[order], ids[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1)))
        fresh = new | np.concatenate(([True], ids[1:] != ids[:-1]))
        x, ids, new = x[fresh], ids[fresh], new[fresh]
        place = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        x, ids = x[place <= k], ids[place <= k]
        _, once = np.unique(np.column_stack((query_ids, y)), axis=0, return_index=True)
        y, query_ids = y[once], query_ids[once]
        row, found, score = search(y, query_ids, x, ids, k)
        return pa.table({"query_id": query_ids[row], "query": digests[once][row], "vec_id": found, "score": score})

    return left.cogroup(right).applyInArrow(block, "query_id long, query long, vec_id long, score long")


def regions_of(data: DataFrame, data_block: int) -> tuple[DataFrame, Broadcast]:
    """``data`` (d, id, h, v) with its ``region``, and the regions by length."""
    sc = data.sparkSession.sparkContext
    total = data.count()
    most = min(REGIONS, max(1, -(-total // data_block)))
    share = min(1.0, 2.0 * SAMPLED * most / max(1, total))
    sample = data.filter(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).orderBy("h").limit(SAMPLED * most).select("v").toArrow().column("v").combine_chunks()
    by_length = {}
    lengths = pc.list_value_length(sample).to_numpy()
    for d in np.unique(lengths):
        by_length[int(d)] = centers(_vectors(sample.take(pa.array(np.flatnonzero(lengths == d)))), most)
    found = sc.broadcast(by_length)
    placed = data.select("*", nearest(F.col("v"), found).alias("at")).select("d", "id", "h", "v", "at.region", "at.away")
    placed = keep(placed, "vectors")
    regions = {}
    for r in placed.groupBy("d", "region").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():
        c = by_length.get(r.d, np.zeros((1, r.d)))
        own = regions.setdefault(r.d, Regions(c, np.zeros(len(c), np.int64), np.zeros(len(c))))
        own.count[r.region], own.radius[r.region] = r.n, r.radius * (1 + 1e-9) + 1e-9
    return placed.drop("away"), sc.broadcast(regions)


def top_k(data: DataFrame, queries: DataFrame, k: int, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``id, v`` (integer arrays) against ``id, v``."""
    digested = lambda df: df.select(F.size("v").alias("d"), "id", F.xxhash64("v").alias("h"), "v")
    data, regions = regions_of(digested(data), data_block)
    queries = keep(digested(queries).select("*", best_region(F.col("v"), regions).alias("first")).distinct(), "queries")
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    best = lambda df: df.withColumn("rank", rank).filter(F.col("rank") <= k)
    near = keep(best(in_regions(data, queries.withColumn("region", F.col("first")), k, data_block, query_block)).drop("rank"), "near")
    least = near.groupBy(F.col("query_id").alias("id"), F.col("query").alias("h")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    asked = queries.join(least, ["id", "h"], "left").select("d", "id", "h", "v", F.explode(reachable(F.col("v"), F.col("least"), F.col("first"), regions)).alias("region"))
    far = in_regions(data, keep(asked, "asked"), k, data_block, query_block)
    return best(near.unionByName(far)).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """``id, v``: floor(scale * component) of every vector that is whole and finite."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    whole = F.coalesce(F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    return vectors.filter(whole & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), x.alias("v"))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("id % 50 = 0"), 5)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
