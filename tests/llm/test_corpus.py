"""Operators that look at the whole corpus, against brute force on small tables."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, language, lm, neardup, quality, topk

SMALL = "/root/testdata/sf0.001"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# Top-k


def _brute(rows, k):
    out = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in {(i, tuple(w)) for i, w in rows if len(w) == len(v)} if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 2048), (37, 5)])
def test_top_k_with_ties_copies_and_odd_vectors(spark, blocks):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) if i % 3 else 0.5 for _ in range(6)]) for i in range(400)]
    rows += [(7, rows[7][1]), (50, rows[50][1]), (1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, [0.5] * 3), (None, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    v = topk.quantised(df)
    got = sorted(map(tuple, topk.top_k(v, v.filter("id % 50 = 0"), 5, *blocks).select("query_id", "rank", "vec_id", "score").collect()))
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    assert got == _brute(whole, 5)
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_top_k_of_large_integers(spark):
    """Products beyond 2^53, ties one apart, and products that no long holds."""
    frame = lambda rows: spark.createDataFrame(rows, "id long, v array<long>")
    data = frame([(1, [6, 0]), (2, [7, 0]), (3, [-5, 1])])
    assert [tuple(r) for r in topk.top_k(data, frame([(50, [1, 1 << 40])]), 1).select("vec_id", "score").collect()] == [(3, (1 << 40) - 5)]
    assert [tuple(r) for r in topk.top_k(data.filter("id < 3"), frame([(50, [1, 1 << 40])]), 1).select("vec_id", "score").collect()] == [(2, 7)]
    rng = random.Random(8)
    rows = [(i, [rng.randrange(-(1 << 29), 1 << 29) for _ in range(5)]) for i in range(300)]
    rows += [(i + 300, [x + (j == 0) for j, x in enumerate(v)]) for i, v in rows]
    got = topk.top_k(frame(rows), frame(rows).filter("id % 50 = 0"), 5, 50, 7).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == _brute(rows, 5)
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(frame([(1, [1 << 40])]), frame([(2, [1 << 40])]), 1).collect()


def test_far_regions_are_not_sent(spark, monkeypatch):
    """Clusters around ten corners: a query meets its own, and vectors of a third length meet none of another."""
    rng = random.Random(2)
    rows = [(i, [1000 * (j == i % 10) + rng.randrange(20) for j in range(10)]) for i in range(2000)] + [(5000, [3, 4]), (5050, [1, 2]), (5100, [9])]
    seen, inner = [], topk.in_regions

    def counting(data, asked, *a):
        seen.append(asked.count())
        return inner(data, asked, *a)

    monkeypatch.setattr(topk, "in_regions", counting)
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = topk.top_k(df, df.filter("id % 50 = 0"), 5, 100, 16).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == _brute(rows, 5)
    assert seen[0] == 43 and seen[1] <= 4 * 43  # of 20 regions


def test_cover_tree_covers():
    x = np.random.default_rng(1).normal(size=(500, 4)).round(1)
    t = topk.cover_tree(x, leaf=8)
    for c, r, p, kids in zip(t.center, t.radius, t.points, t.children, strict=True):
        assert np.sqrt(((x[p] - c) ** 2).sum(1)).max() <= r
        assert not kids or sorted(np.concatenate([t.points[k] for k in kids])) == sorted(p)


# Near duplicates


def _shingles(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def _components(rows, size):
    """Documents are ids: links between any of their texts, and all texts of one id, join them."""
    sets = [(i, _shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations([x for x in sets if x[0] is not None], 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return Counter((i, len(s), find(i) if i is not None and s else i) for i, s in sets)


def _near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 20, 60, 200]))]
        for _ in range(rng.choice([1, 3, 12])):
            t = list(base)
            for _ in range(rng.randrange(1 + len(t) // 12)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(t)))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(1000 + i, passage + " " + " ".join(rng.choice(words) for _ in range(60))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "One TWO"), (2004, "one two"), (2005, "x " * 3000), (1, rows[0][1]), (None, "no key here at all"), (None, "no key here at all")]
    return rows


def test_components_equal_brute_force(spark, size=5):
    rows = _near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1)).withColumn("label", F.lit("l"))
    got = neardup.with_components(df, size=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component) for r in got) == _components(rows, size)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component) for r in got)
    assert neardup.with_components(df.limit(0)).count() == 0


def test_chains_in_large_buckets(spark, monkeypatch):
    """A cloud whose members link in chains only, in buckets that are dealt again at once."""
    monkeypatch.setattr(neardup, "FEW", 2)
    rng = random.Random(9)
    base = [f"a{i}" for i in range(120)]
    rows = []
    for i in range(40):
        base = list(base)
        base[3 * i] = f"b{rng.random()}"
        rows.append((i, " ".join(base)))
    got = neardup.with_components(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component) for r in got) == _components(rows, 4)


def test_repeated_and_missing_ids_near_copies(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (7, a), (3, b), (5, b), (9, c), (None, c), (None, a), (8, ""), (8, c)]
    got = neardup.with_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component, r.kept) for r in got) == Counter(
        [(5, 3, False), (7, 3, False), (3, 3, True), (5, 3, False), (9, 8, False), (None, None, True), (None, None, True), (8, 8, True), (8, 8, True)]
    )


def test_unlinked_clouds_are_not_compared_in_full(spark, monkeypatch):
    """Hundreds of texts that share two thirds of their words: few pairs, and the links among them are found."""
    monkeypatch.setattr(neardup, "FEW", 30)
    seen, inner = [], neardup.verified

    def counting(near, *a):
        seen.append(near.count())
        return inner(near, *a)

    monkeypatch.setattr(neardup, "verified", counting)
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(160)]
    rows = []
    for g in range(150):
        own = [f"o{g}_{i}" for i in range(60)]
        for _ in range(1 + (g % 5 == 0) + 2 * (g % 25 == 0)):
            t = shared + own
            t[rng.randrange(160, 220)] = f"r{rng.random()}"
            rows.append((len(rows), " ".join(t)))
    got = neardup.with_components(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    want = _components(rows, 4)
    assert Counter((r.doc_id, r.n_shingles, r.component) for r in got) == want
    assert len({c for _, _, c in want}) == 150 and sum(seen) < 10 * len(rows)


def _folded(hashes):
    s = np.unique(hashes)
    return neardup.folded(s, neardup.registers(s))


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    for n, share in ((40, 0.9), (300, 0.8), (3000, 0.5)):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate((a[: int(n * share)], rng.integers(0, 1 << 62, n - int(n * share)).astype(np.uint64)))
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(neardup.estimate(*(_folded(x)[None] for x in (a, b)), [n], [n])[0] - truth) < 0.12


@pytest.mark.parametrize("n", [5, 9, 18, 45, 130, 500, 2000])
def test_spread_of_the_estimate(n):
    """Pairs at a similarity of 0.8 (two thirds for five shingles) stay within the slack, by more than a deviation."""
    rng = np.random.default_rng(n)
    common = math.ceil(2 * n * 0.8 / 1.8) if n > 5 else 4
    rows = []
    for _ in range(100):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate((a[:common], rng.integers(0, 1 << 62, n - common).astype(np.uint64)))
        rows.append([_folded(x) for x in (a, b)])
    left, right = (np.array(x) for x in zip(*rows, strict=True))
    percent = 100 * common // (2 * n - common)
    assert neardup.possible(left, right, np.full(100, float(n)), np.full(100, float(n)), percent).all()
    spread = neardup.estimate(left, right, np.full(100, n), np.full(100, n)).std()
    assert spread < np.sqrt(0.16 / (2 * neardup.REGISTERS)) * (1 + 1.5 / np.sqrt(n)) * 1.2


def test_component_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 150), (150, 300), (7, 7)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(1, 61)) and got[200] == got[300] == 150


# Decontamination


def _windows(t, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    return w, [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(4)
    words = ["the", "a", "of", *(f"w{i}" for i in range(40)), "É", "é", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 4, 9, 10, 11, 40]))) for i in range(12)] + [(3, "Same id, other text, twelve words are what it takes to be one"), (None, "an item without id"), (90, None), (91, "..")]
    docs = [(i, text(20) + ", " + rng.choice(items)[1].upper() if i % 3 == 0 and i < 30 else text(60)) for i in range(60)]
    docs = [(i, t) for i, t in docs if t] + [(100, items[5][1]), (101, None), (102, ""), (103, "the"), (None, items[4][1]), (5, items[6][1]), (5, items[6][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).withColumn("pos", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r.ids)) for r in decontaminate.judge(decontaminate.build(df, bench)).collect())
    want = Counter()
    for i, t in docs:
        w, _ = _windows(t)
        hit, ids = set(), set()
        for k, it in items:
            for win in _windows(it)[1]:
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        ids.add("" if k is None else str(k))
        want[(i, len(w), len(hit), ",".join(sorted(ids)))] += 1
    assert got == want
    assert decontaminate.judge(decontaminate.build(df.limit(0), bench)).count() == 0
    assert decontaminate.judge(decontaminate.build(df, bench.limit(0))).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one x two three four"), (3, "one x y z two three four"), (4, "four two")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "One two THREE four")], "item_id long, text string")
    index = decontaminate.build(docs, bench)
    assert {r.doc for r in decontaminate.phrase_matches(index).collect()} == {1}
    assert {r.doc for r in decontaminate.proximity_matches(index, 1).collect()} == {1, 2}


# Language model


def _tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), "</end>"]


def _tree(texts, depth=3):
    """A suffix tree of token tuples, by counting: total, word counts, and per level next-word probabilities and the retained contexts' weights."""
    lists = [_tokens(t) for t in texts]
    c = Counter(w for x in lists for w in x)
    n = sum(c.values())
    shorter = {(w,): (k, (k + 1) / (n + len(c) + 1)) for w, k in c.items()}
    levels, own = [], []
    for length in range(1, depth + 1):
        grams = Counter(tuple(x[i : i + length + 1]) for x in lists for i in range(len(x) - length))
        grams = {g: k for g, k in grams.items() if k >= lm.LEAST_NEXT and shorter.get(g[:-1], (0,))[0] >= lm.LEAST_CONTEXT and shorter.get(g[1:], (0,))[0] >= lm.LEAST_NEXT}
        behind = {}
        for g, k in grams.items():
            behind.setdefault(g[:-1], []).append((g, k))
        probability, weight, keep = {}, {}, set()
        for ctx, found in behind.items():
            m = shorter[ctx][0]
            weight[ctx] = max(1 - sum((k - lm.DISCOUNT) / m for _, k in found), 1e-9)
            for g, k in found:
                probability[g] = (k - lm.DISCOUNT) / m + weight[ctx] * shorter[g[1:]][1]
            gain = sum(k * math.log(probability[g] / shorter[g[1:]][1]) for g, k in found)
            rest = max(1 - sum(k for _, k in found) / m, 0)
            gain += m * rest * math.log(max(rest, 1e-9) / max(1 - sum(shorter[g[1:]][1] for g, _ in found), 1e-9))
            if gain >= lm.LEAST_DIVERGENCE:
                keep.add(ctx)
        levels.append((probability, weight))
        own.append(keep)
        shorter = {g: (grams[g], p) for g, p in probability.items()}
    for i in range(depth - 2, -1, -1):
        own[i] |= {ctx[1:] for ctx in own[i + 1] if ctx[1:] in levels[i][1]}
    return n, c, [(p, {x: w[x] for x in keep}) for (p, w), keep in zip(levels, own, strict=True)]


def _tree_score(t, n, c, levels):
    x, total = _tokens(t), 0.0
    for i, w in enumerate(x):
        for length in range(min(i, len(levels)), 0, -1):
            p, weight = levels[length - 1]
            if (ctx := tuple(x[i - length : i])) in weight:
                if (*ctx, w) in p:
                    total += math.log10(p[(*ctx, w)])
                    break
                total += math.log10(weight[ctx])
        else:
            total += math.log10((c[w] + 1) / (n + len(c) + 1))
    return total


@pytest.mark.parametrize("slots", [20, 4])
def test_suffix_tree_equals_counting(spark, monkeypatch, slots):
    monkeypatch.setattr(lm, "HEAD_BITS", slots)
    monkeypatch.setattr(lm, "CHUNK_CHARS", 100_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    held_id = next(-i for i in range(100, 200) if zlib.crc32(str(-i).encode()) % 7 == 2)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "the of and the of and"), (held_id, "the of and " * 30_000), (-4, "the of and"), (-4, "the of and")], "doc_id long, text string")
    docs = docs.union(extra).withColumn("key", F.lit(0)).withColumn("c", F.lit(0))
    held = language.in_fold("doc_id", 7, 2)
    got = lm.with_scores(docs, ~held).collect()
    rows = docs.collect()
    train = [r.text for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    n, c, levels = _tree(train)
    assert all(weight for _, weight in levels)
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, r.text)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    for g in got:
        w = _tokens(texts[g.doc_id])
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w))
        assert g.score == pytest.approx(_tree_score(texts[g.doc_id], n, c, levels), rel=1e-5)
    test = [g for g in got if (g.doc_id or 0) > 0 and zlib.crc32(str(g.doc_id).encode()) % 7 == 2]
    assert sum(g.score for g in test) > sum(g.base_score for g in test)


def test_empty_training(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.with_scores(docs, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert lm.with_scores(docs.limit(0), F.lit(True)).count() == 0


# Language and quality


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "123 !!", "en"), (-3, "", None)], "doc_id long, text string, lang string")
    held = language.in_fold("doc_id", 4, 2)
    judged = language.with_language(docs.union(extra).withColumn("score", F.lit(1)), ~held).cache()
    assert judged.filter(held & (F.col("lang") == F.col("language.lang"))).count() >= 0.98 * judged.filter(held & F.col("lang").isNotNull()).count()
    assert {tuple(r) for r in judged.filter("doc_id < 0").select("language.lang", "language.score").collect()} == {("und", 0.0)}
    none = language.with_language(docs.limit(3), F.lit(False)).select("language.*").collect()
    assert {tuple(r) for r in none} == {("und", 0.0)}


def test_language_model_equals_counting(spark):
    """Words, the longest known n-grams of others, and no score for the rest: sums by hand over a small sample."""
    rows = [(1, "alpha beta beta", "aa"), (2, "gamma beta", "bb"), (3, "delta", "bb"), (4, "delta", "bb"), (5, None, "aa"), (6, "x y", None)]
    asked = ["alpha", "beta BETA gamma", "alphx", "l'beta", "", "qqq", "ALPHA " * 5000, "zz delta"]
    docs = spark.createDataFrame(rows + [(10 + i, t, None) for i, t in enumerate(asked)], "doc_id long, text string, lang string")
    model = language.fit(docs, F.col("doc_id") < 10)
    assert model.langs == ["aa", "bb"]
    words = {"aa": Counter({"alpha": 1, "beta": 2}), "bb": Counter({"gamma": 1, "beta": 1, "delta": 2})}
    names = {x: Counter() for x in words}
    for x, found in words.items():
        for w, k in found.items():
            names[x]["0" + w] += k
            for n in range(1, 6):
                for i in range(len(w) + 3 - n):
                    names[x][f"{n}" + f" {w} "[i : i + n]] += k
    total = {(x, o): sum(k for name, k in found.items() if name[0] == o) for x, found in names.items() for o in "012345"}
    value = lambda x, name: math.log10((names[x][name] or 0.5) / (total[x, name[0]] + 1))

    def word_sum(x, w):
        if any(names[y]["0" + w] for y in names):
            return value(x, "0" + w)
        for n in range(5, 0, -1):
            found = [g for g in (f"{n}" + f" {w} "[i : i + n] for i in range(len(w) + 3 - n)) if any(names[y][g] for y in names)]
            if found:
                return sum(value(x, g) for g in found) / len(found)
        return 0.0

    scorer = language.Scorer(model)
    sums, n = scorer.sums(asked)
    for i, t in enumerate(asked):
        split = re.findall(r"[^\W\d_]+", t.lower())
        assert n[i] == len(split)
        for j, x in enumerate(model.langs):
            assert sums[i, j] == pytest.approx(sum(word_sum(x, w) for w in split), rel=1e-5, abs=1e-6)
    assert scorer.sums(asked)[0] == pytest.approx(sums)


def test_language_sample_is_bounded_and_keeps_all_languages(spark, monkeypatch):
    rows = [(None, f"w{i}", "aa") for i in range(3000)] + [(i, "q".join("abcdefghij"[int(d)] for d in f"{i % 300:03}") + " word", f"l{i % 300:03}") for i in range(900)] + [(7, "same text", "zz")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.lit(1)).withColumn("n", F.lit(1))
    sample = language.sample_rows(docs, F.lit(True), "text", "lang", "doc_id", 10, 100_000).groupBy("l").count().collect()
    counts = {r.l: r["count"] for r in sample}
    assert len(counts) == 302 and counts["aa"] <= 10 and counts["zz"] == 1 and counts["l000"] == 3
    model = language.fit(docs, F.lit(True))
    assert len(model.langs) == 302
    assert [x for x, _ in language.Scorer(model).judge(["aqaqf", "cqjqj word", "12"])] == ["l005", "l299", "und"]


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")).withColumn("label", F.lit("x")).withColumn("bins", F.lit("x"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("text", F.lit("x"))
    held = language.in_fold("doc_id", 3, 1)
    judged = quality.with_quality(docs, labels, ~held)
    rows = judged.join(labels.select("doc_id", "quality"), "doc_id").filter(held).select("quality", "quality_score").collect()
    assert sum((r.quality_score >= 0.5) == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.quality_score <= 1 for r in judged.filter("doc_id < 0").collect())
    assert {r.quality_score for r in quality.with_quality(docs.limit(5), labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.with_quality(docs.limit(0), labels, F.lit(True)).count() == 0


def test_labels_of_unknown_documents_take_no_room(spark):
    """Thousands of labels without documents, repeated rows, a very long text, and a bound of 60 rows."""
    good, bad = "the quiet river flows past old stone houses", "WIN $$$ now!!! click >>> free ###"
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(200)] + [(1, f"{good} 1"), (300, f"{bad} " * 20_000), (None, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("h", F.lit(0))
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(1000 + i, i % 2) for i in range(20_000)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    judged = {r.doc_id: r.quality_score for r in quality.with_quality(docs, labels, F.lit(True), sample_rows=60).collect()}
    assert all((judged[i] >= 0.5) == (i % 2 == 1) for i in range(100, 200)) and judged[300] < 0.5 and judged[None] > 0.5
    sampled = quality.sample(docs, labels, F.lit(True), "text", "doc_id", "quality", 60)
    assert sampled.count() == 60
    sizes = [len(r.bins) for r in sampled.collect()]
    assert quality.sample(docs, labels, F.lit(True), "text", "doc_id", "quality", 60, sum(sizes[:20])).count() == 20


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = np.sign(x[:, 0] + 0.3 * x[:, 1] + 0.1)
    w = quality.descend([np.arange(3)] * 60, list(x), y, np.full(60, 1.0), 3, epochs=500)
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w[:3] + w[3])).sum()
    assert all(loss(w) <= loss(w + d) + 0.05 for d in rng.normal(scale=0.05, size=(200, 4)))


def test_suffix_tree_grows_with_the_corpus(spark):
    """A context that occurs a few times among 200,000 tokens, of three words, predicts its next word."""
    rare = "red fox ran north"
    rows = [(i, " ".join(f"w{(i * 7919 + j * j) % 5000}" for j in range(200))) for i in range(1000)]
    rows += [(5000 + i, f"q{i} {rare} {w}") for i, w in enumerate(["home", "home", "away", "home", "home", "home"])]
    docs = spark.createDataFrame([*rows, (9000, f"new {rare} home"), (9001, "north home")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.with_scores(docs, F.col("doc_id") < 9000).collect()}
    assert len(got) == len(rows) + 2
    n, c = got[9000].train_tokens, Counter(w for _, t in rows for w in [*t.split(), "</end>"])
    root = lambda w: (c[w] + 1) / (n + len(c) + 1)
    # By hand: discounted counts behind one word, interpolated with the root; contexts of one distribution add nothing.
    want = (5 - lm.DISCOUNT) / 6 + (1 - (5 - lm.DISCOUNT) / 6) * root("home")
    assert got[9001].score == pytest.approx(math.log10(root("north")) + math.log10(want) + _behind_home(root))
    assert got[9000].score > got[9000].base_score + 8


def _behind_home(root):
    return math.log10((5 - lm.DISCOUNT) / 5 + lm.DISCOUNT / 5 * root("</end>"))


def test_what_leaves_a_bucket_does_not_grow_with_its_pairs(spark, monkeypatch):
    """A cloud whose pairs are all close to the threshold; one run with buckets in parts."""
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(240)]
    rows = []
    for g in range(90):
        t = shared + [f"o{g}_{i}" for i in range(36)]
        rows.append((2 * g, " ".join(t)))
        t[rng.randrange(240, 276)] = f"r{g}"
        rows.append((2 * g + 1, " ".join(t)))
    docs = spark.createDataFrame(rows, "id long, text string")
    sets = docs.select("id", neardup.shingle_set(F.col("text"), 4).alias("sh"))
    few = docs.select(F.lit(1).alias("bucket").cast("long"), "id", neardup.signature(F.col("text"), 4).alias("x")).select("bucket", "id", F.col("x.n_shingles").alias("s"), F.col("id").alias("label"), "x.folded")
    near = neardup.near_in_buckets(few, 80)
    assert near.count() <= len(rows)
    want = {tuple(x) for x in _components(rows, 4)}
    for most in (neardup.PART_HASHES, 4_000):
        monkeypatch.setattr(neardup, "PART_HASHES", most)
        links = neardup.links_in_buckets(near, sets, 80)
        labels = dict(map(tuple, neardup.components(links).collect()))
        assert links.count() < len(rows) * (1 if most > 4_000 else 16)
        assert {(i, c) for i, _, c in want} == {(i, labels.get(i, i)) for i, _ in rows}


def test_the_shuffle_files_of_a_round_are_gone_before_the_next(spark, monkeypatch):
    """Of the n-grams of a level, and of the questions, no more than a round's are shuffled at a time, and none is left out."""
    docs = spark.createDataFrame([(i, f"a b c d {i % 7} a b c e {i % 5}") for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(lm, "CHUNK_CHARS", 200)
    asked, counted, released = lm.asked, lm.gram_counts, []
    parts = {"asked": [], "grams": []}
    monkeypatch.setattr(lm, "release", lambda s: released.append(len(parts["asked"]) + len(parts["grams"])))
    monkeypatch.setattr(lm, "asked", lambda chunked, *a: parts["asked"].append(chunked.count()) or asked(chunked, *a))
    monkeypatch.setattr(lm, "gram_counts", lambda chunked, bitmaps, length, turn: parts["grams"].append((length, turn)) or counted(chunked, bitmaps, length, turn))
    got = {r.doc_id: r.score for r in lm.with_scores(docs, F.lit(True)).collect()}
    assert parts["grams"] == [(n, t) for n in range(1, lm.DEPTH + 1) for t in range(lm.ROUNDS)] and len(parts["asked"]) == lm.ROUNDS
    assert max(parts["asked"]) <= 0.5 * sum(parts["asked"]) and len(released) > len(parts["grams"]) + len(parts["asked"])
    monkeypatch.setattr(lm, "ROUNDS", 1)
    once = {r.doc_id: r.score for r in lm.with_scores(docs, F.lit(True)).collect()}
    assert len(got) == 400 and got.keys() == once.keys() and all(abs(got[k] - once[k]) < 1e-9 for k in got)
