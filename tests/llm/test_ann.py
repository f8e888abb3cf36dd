"""Neighbours by early abandoning, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann


def brute(rows, k, every=20):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for q, v in ok:
        if q % every == 0:
            x = np.array([w for i, w in ok if i != q and len(w) == len(v)]).reshape(-1, len(v))
            ids = [i for i, w in ok if i != q and len(w) == len(v)]
            out[q, v] = sorted(zip(-(x * np.array(v)).sum(axis=1), ids, strict=True))[:k]
    return out


def check(got, want, k, least):
    hits = total = 0
    answers = {}
    for r in got:
        answers.setdefault(r.query_id, []).append(r)
    for (q, _), near in want.items():
        own = sorted(answers.get(q, []), key=lambda r: r["rank"])
        assert len(own) == len(near) and [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id)) and q not in {r.vec_id for r in own}
        hits += len({r.vec_id for r in own} & {i for _, i in near})
        total += len(near)
    assert hits >= least * total
    return hits / total


@pytest.mark.parametrize("blocks", [(4096, 1024), (61, 7)])
def test_odd_vectors_ties_and_norms(spark, blocks):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(12)]) for i in range(700)]
    rows += [(1000 + i, rows[40][1]) for i in range(300)]  # one vector of many rows
    rows += [(40, rows[40][1])] * 3
    rows += [(2000, None), (2001, []), (2002, [None] * 12), (2003, [math.nan] + [0.0] * 11), (2020, [0.0] * 12), (2040, [1.0, 2.0]), (2041, [3.0, 1.0]), (2060, [5.0]), (None, [1.0] * 12), (3000, [1e200] * 3), (3001, [1e-200, 0.0, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("x")).withColumn("id", F.lit("y")).withColumn("score", F.lit(1))
    v = ann.vectors_of(df)
    got = ann.nearest(v, v.filter("id % 20 = 0"), 20, *blocks).collect()
    want = brute(rows, 20)
    check([r for r in got if r.query_id not in (3000,)], {q: n for q, n in want.items() if q[0] != 3000}, 20, 0.9)
    near = {(q, i): -s for (q, _), found in want.items() for s, i in found}
    assert all(math.isclose(near[r.query_id, r.vec_id], r.score, rel_tol=1e-12) for r in got if (r.query_id, r.vec_id) in near)
    assert [(r.query_id, r.vec_id, r.score) for r in got if r.query_id in (2040, 2060, 3000)] in ([(2040, 2041, 5.0), (3000, 3001, math.inf)], [(3000, 3001, math.inf), (2040, 2041, 5.0)])
    assert ann.nearest(v.limit(0), v.limit(0), 20).count() == 0
    assert ann.nearest(v, v.limit(0), 20).count() == 0


def test_recall_on_the_embeddings(spark):
    v = ann.vectors_of(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    rows = [(r.id, list(r.v)) for r in v.collect()]
    got = ann.op11_adaptive_scan(spark, "/root/testdata/sf0.1").collect()
    assert check(got, brute(rows, 20), 20, 0.93) <= 1


def test_scan_abandons_early_and_loses_little():
    """All lists in one block: with a bound only some of the components are read, and what the test loses is rare."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((160, 96)), 25, axis=0) + 0.4 * rng.standard_normal((4000, 96))
    q, ids = x[:64], np.arange(4000)
    lists = ann.Lists(float(np.abs(x).max()), float(((x / np.abs(x).max()) ** 2).sum(axis=1).max()), np.zeros((0, 97)), 1)
    exact = q @ x.T
    exact[np.arange(64), np.arange(64)] = -np.inf
    least = -np.sort(-exact, axis=1)[:, 19]
    row, found, score, read = ann.scan(q, ids[:64], least, x, ids, 20, lists)
    want = {(r, int(i)) for r in range(64) for i in np.argsort(-exact[r], kind="stable")[:20]}
    assert len(want & set(zip(row.tolist(), found.tolist(), strict=True))) >= 0.97 * len(want)
    assert read < 0.4 * 64 * 4000 * 97
    assert np.allclose(score, exact[row, found], rtol=1e-12)
    everything = ann.scan(q, ids[:64], np.full(64, -np.inf), x, ids, 20, lists, doubt=1e9)
    assert set(zip(everything[0].tolist(), everything[1].tolist(), strict=True)) == want
