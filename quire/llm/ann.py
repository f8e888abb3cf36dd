"""Approximate nearest neighbours: inverted lists, scanned by column blocks with early abandoning.

Largest inner products become smallest distances: with one more component every vector gets the norm of the longest,
every query a zero. Vectors belong to the list of their nearest centre; centres come from k-means over a bounded sample,
but every row is indexed. How many lists a query probes is measured: a bounded sample of the queries is answered
exactly by a scan of all rows, and as many lists are probed as hold ``TARGET`` of these neighbours.

A list is scanned in blocks of bounded size. The vectors of a block are rotated at random and held by column blocks. The
partial distance over the first d of D columns is a sample of the whole distance; under a random rotation its share has a
mean of d/D and a deviation of sqrt(2 (D - d) / (d (D + 2))) times that. Once it lies more than ``DOUBT`` deviations
above what the query's kth distance would lead to, the candidate is abandoned. What is left is scored on the original vectors in double precision. The nearest list of a query is scanned first, and its kth
distance there is the bound for all others.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
different lengths are not compared; rows that share an id and a vector count once; a query never meets rows
with its own id; equal scores go to the smaller id; inner products beyond the range of doubles are infinite, and those
without a value come last; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.store import keep, table

#: Rows of a list that meet a block of queries in one task, and pairs that are looked at together.
DATA_BLOCK, QUERY_BLOCK, PAIRS = 4096, 1024, 1 << 16
#: Most lists (there are as many as the root of the rows), vectors of the sample for each, rounds of k-means.
LISTS, SAMPLED, ROUNDS = 16384, 16, 10
#: Queries that are answered exactly, and the share of their neighbours that the probed lists must hold.
MEASURED, TARGET = 256, 0.97
#: Deviations of the test that abandons a candidate, and columns of a block.
DOUBT, COLUMNS = 3.0, 8
_FOUND = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Lists(NamedTuple):
    """The lists of the vectors of one length."""

    scale: float  # largest component: vectors are divided by it, so that squares stay finite
    top: float  # largest squared norm after that
    center: np.ndarray  # with the added component
    probes: int


def matrix(v: pa.Array | pa.ChunkedArray) -> np.ndarray:
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def lengthened(x: np.ndarray, lists: Lists) -> np.ndarray:
    """Scaled vectors with the component that gives all the same norm."""
    x = x / lists.scale
    return np.column_stack((x, np.sqrt(np.maximum(0.0, lists.top - (x * x).sum(axis=1)))))


def directed(q: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Queries with a zero added and the norm of all vectors, which changes no order, and what a score of these is of the original."""
    largest = np.abs(q).max(axis=1, keepdims=True)
    q = q / largest
    norm = np.sqrt((q * q).sum(axis=1, keepdims=True) / lists.top)
    return np.column_stack((q / norm, np.zeros(len(q)))), (largest * norm)[:, 0] * lists.scale


def rotation(d: int) -> np.ndarray:
    """An orthogonal matrix at random, the same in every task."""
    return np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]


def column_blocks(d: int) -> list[slice]:
    return [slice(a, min(a + COLUMNS, d)) for a in range(0, d, COLUMNS)]


def slack(d: int, whole: int, doubt: float) -> float:
    """Largest share of a distance that ``d`` of ``whole`` columns have if it is not abandoned."""
    return d / whole * (1 + doubt * np.sqrt(2 * (whole - d) / (d * (whole + 2))))


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` centres of the distinct rows of ``x``."""
    x = np.unique(x, axis=0)
    center = x[np.random.default_rng(0).permutation(len(x))[:k]]
    for _ in range(ROUNDS if len(x) > k else 0):
        own = closest(x, center)
        total = np.zeros_like(center)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=len(center))
        center = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], center)
    return center


def closest(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    half = (center * center).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ center.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def best(owner: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of every owner's k highest scores, smaller ids first among equals."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < k]


def scan(q: np.ndarray, query_ids: np.ndarray, least: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, lists: Lists, doubt: float = DOUBT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row of the query, id and score of what each query finds in one block, and how many components were read.

    ``least`` is the score that a query has k better ones of, or minus infinity.
    """
    turn = rotation(x.shape[1] + 1)
    asked, unit = directed(q, lists)
    long, asked = lengthened(x, lists) @ turn, asked @ turn
    blocks = column_blocks(long.shape[1])
    columns = [np.ascontiguousarray(long[:, b]) for b in blocks]
    parts = [np.ascontiguousarray(asked[:, b]) for b in blocks]
    norm = (asked * asked).sum(axis=1)
    bound = least.copy()
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    rows, read = max(1, PAIRS // max(1, len(q))), 0
    for at in range(0, len(x), rows):
        with np.errstate(all="ignore"):
            reach = norm + lists.top - 2 * bound / unit
        reach = np.where(np.isnan(reach), np.inf, np.maximum(reach, 0) * (1 + 1e-9) + 1e-9)
        some = columns[0][at : at + rows]
        near = (parts[0] ** 2).sum(axis=1)[:, None] + (some * some).sum(axis=1)[None, :] - 2 * parts[0] @ some.T
        d, whole = blocks[0].stop, long.shape[1]
        allowed = query_ids[:, None] != ids[at : at + rows][None, :]
        qi, xi = np.nonzero(allowed & (near <= reach[:, None] * slack(d, whole, doubt)))
        read += near.size * d
        near, xi = near[qi, xi], xi + at
        for b, part, column in zip(blocks[1:], parts[1:], columns[1:], strict=True):
            near = near + ((column[xi] - part[qi]) ** 2).sum(axis=1)
            read += len(xi) * part.shape[1]
            d = b.stop
            stays = near <= reach[qi] * slack(d, whole, doubt)
            qi, xi, near = qi[stays], xi[stays], near[stays]
        with np.errstate(over="ignore", invalid="ignore"):
            score = (x[xi] * q[qi]).sum(axis=1)
        score = np.where(np.isnan(score), -np.inf, score)
        owner, got, score = (np.concatenate(p) for p in zip(found, (qi, ids[xi], score), strict=True))
        top = best(owner, got, score, k)
        found = owner[top], got[top], score[top]
        full = np.bincount(found[0], minlength=len(q)) >= k
        kth = np.full(len(q), np.inf)
        np.minimum.at(kth, found[0], found[2])
        bound = np.where(full, np.maximum(bound, kth), bound)
    return *found, read


def vectors_of(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``d, id, h, v``: the vectors that take part, as doubles, with their length and a hash."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))) & F.exists(F.col(vector), lambda c: c != 0)
    return df.filter(F.coalesce(fine, F.lit(False)) & F.col(key).isNotNull()).select(F.size(vector).alias("d"), F.col(key).cast("long").alias("id"), v.alias("v")).select("d", "id", F.xxhash64("v").alias("h"), "v")


def _some(df: DataFrame, rows: int, total: int) -> DataFrame:
    """About ``rows`` rows at random, the same each time, never more."""
    dealt = F.pmod(F.xxhash64("id", "h"), F.lit(1 << 30))
    share = min(1.0, 2.0 * rows / max(1, total))
    return df.filter(dealt < F.lit(int(share * (1 << 30)))).orderBy(dealt, "id", "h").limit(rows)


def centers_of(data: DataFrame) -> dict[int, Lists]:
    shape = {r.d: r for r in data.groupBy("d").agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("scale")).collect()}
    scaled = F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / F.col("scale")) ** 2)
    scales = F.broadcast(data.sparkSession.createDataFrame([(d, r.scale) for d, r in shape.items()], "d int, scale double"))  # a row for each length
    top = {r.d: r.top for r in data.join(scales, "d").groupBy("d").agg(F.max(scaled).alias("top")).collect()}
    out = {}
    for d, r in shape.items():
        k = min(LISTS, int(np.ceil(np.sqrt(r.n))))
        empty = Lists(r.scale, top[d] * (1 + 1e-12), np.zeros((0, d + 1)), k)
        sample = matrix(_some(data.filter(F.col("d") == d), SAMPLED * k, r.n).select("v").toArrow().column("v"))
        out[d] = empty._replace(center=k_means(lengthened(sample, empty), k))
    return out


def _per_length(t: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    lengths = t.column("d").to_numpy()
    for d in np.unique(lengths):
        yield int(d), t.take(pa.array(np.flatnonzero(lengths == d)))


def in_lists(data: DataFrame, lists: Broadcast) -> DataFrame:
    """``data`` with the ``list`` of every row."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t in _per_length(pa.Table.from_batches([b])):
                own = closest(lengthened(matrix(t.column("v")), lists.value[d]), lists.value[d].center)
                yield from t.append_column("list", pa.array(own.astype(np.int32))).to_batches()

    return data.mapInArrow(placed, "d int, id long, h long, v array<double>, list int")


def probed(queries: DataFrame, lists: Broadcast) -> DataFrame:
    """``queries`` with ``lists``: those that each probes, the nearest first."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t in _per_length(pa.Table.from_batches([b])):
                if d in lists.value:
                    c = lists.value[d]
                    away = (c.center * c.center).sum(axis=1) - 2 * directed(matrix(t.column("v")), c)[0] @ c.center.T
                    near = np.argsort(away, axis=1, kind="stable")[:, : c.probes].astype(np.int32)
                    yield from t.append_column("lists", pa.array(list(near), pa.list_(pa.int32()))).to_batches()

    return queries.mapInArrow(ordered, "d int, id long, h long, v array<double>, lists array<int>")


def measured_probes(placed: DataFrame, queries: DataFrame, lists: dict[int, Lists], k: int) -> dict[int, Lists]:
    """The lists with as many ``probes`` as hold ``TARGET`` of the true neighbours of a sample of the queries."""
    out = {}
    for d, own in lists.items():
        asked = queries.filter(F.col("d") == d)
        t = _some(asked, MEASURED, asked.count()).select("id", "v").toArrow()
        if not t.num_rows:
            continue
        ids, q = t.column("id").to_numpy(), matrix(t.column("v"))

        def exact(batches: Iterator[pa.RecordBatch], q=q, ids=ids) -> Iterator[pa.RecordBatch]:
            for b in batches:
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.nan_to_num(q @ matrix(b.column("v")).T, nan=-np.inf)
                found = b.column("id").to_numpy()
                score[ids[:, None] == found[None, :]] = -np.inf
                some = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
                row = np.repeat(np.arange(len(q)), some.shape[1])
                yield pa.RecordBatch.from_pydict({"row": row, "id": found[some.ravel()], "list": b.column("list").to_numpy()[some.ravel()], "score": score[row, some.ravel()]})

        rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "id"))
        near = placed.filter(F.col("d") == d).mapInArrow(exact, "row long, id long, list int, score double").withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("score") > float("-inf"))).select("row", "list").toPandas()
        away = (own.center * own.center).sum(axis=1) - 2 * directed(q, own)[0] @ own.center.T
        place = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1)
        needed = np.sort(place[near["row"].to_numpy(), near["list"].to_numpy()])
        out[d] = own._replace(probes=int(needed[int(np.ceil(TARGET * len(needed))) - 1]) + 1 if len(needed) else 1)
    return out


def meet(data: DataFrame, asked: DataFrame, k: int, lists: Broadcast, data_block: int, query_block: int) -> DataFrame:
    """``query_id, query, vec_id, score``: each asked query's k best of each block of its ``list``; both sides are ``d, list, id, h, v``, and ``least`` of the queries."""
    key = ["d", "list"]
    many = lambda df, block, name: df.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(float(block))).alias(name))
    plan = F.broadcast(many(data, data_block, "n").join(many(asked, query_block, "m"), key))  # a row for each list at most
    side = lambda df, own, n, other, m, *more: df.join(plan, key).select(*key, F.pmod(F.xxhash64("id", "h"), F.col(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)).alias(other), "id", "h", "v", *more)
    left = side(data, "r", "n", "q", "m").groupBy(*key, "r", "q")
    right = side(asked, "q", "m", "r", "n", "least").groupBy(*key, "r", "q")

    def block(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        x, ids = matrix(own.column("v")), own.column("id").to_numpy()
        # Of equal vectors only the k + 1 smallest ids can be among the k best of a query that is not one of them.
        order = np.lexsort((ids, own.column("h").to_numpy()))
        x, ids = x[order], ids[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1)))
        fresh = new | np.concatenate(([True], ids[1:] != ids[:-1]))
        x, ids, new = x[fresh], ids[fresh], new[fresh]
        place = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        x, ids = x[place <= k], ids[place <= k]
        q, query_ids, digests = matrix(asked.column("v")), asked.column("id").to_numpy(), asked.column("h").to_numpy()
        least = asked.column("least").to_numpy()
        row, found, score, _ = scan(q, query_ids, least, x, ids, k, lists.value[x.shape[1]])
        return pa.table([query_ids[row], digests[row], found, score], schema=_FOUND)

    return left.cogroup(right).applyInArrow(block, "query_id long, query long, vec_id long, score double")


def nearest(data: DataFrame, queries: DataFrame, k: int, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries among all of ``data``, both as ``vectors_of`` gives them."""
    sc = data.sparkSession.sparkContext
    data, queries = keep(data, "vectors"), keep(queries.distinct(), "queries")
    lists = centers_of(data)
    placed = keep(in_lists(data, sc.broadcast(lists)), "lists")
    known = sc.broadcast(measured_probes(placed, queries, lists, k))
    queries = keep(probed(queries, known), "probed")
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    top = lambda df: df.withColumn("rank", rank).filter(F.col("rank") <= k)
    none = F.lit(float("-inf")).alias("least")
    first = queries.select("d", F.get("lists", F.lit(0)).alias("list"), "id", "h", "v", none)
    near = keep(top(meet(placed, first, k, known, data_block, query_block)).drop("rank"), "near")
    bound = near.groupBy(F.col("query_id").alias("id"), F.col("query").alias("h")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    others = queries.join(bound, ["id", "h"], "left").select("d", F.explode(F.slice("lists", 2, LISTS)).alias("list"), "id", "h", "v", F.coalesce("least", none).alias("least"))
    far = meet(placed, keep(others, "asked"), k, known, data_block, query_block)
    return top(near.unionByName(far)).select("query_id", "rank", "vec_id", "score")


def op11_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vectors_of(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.filter("id % 20 = 0"), 20)
