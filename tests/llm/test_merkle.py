"""The Merkle manifest against trees hashed by hand."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree_of(leaves):
    """Levels from the leaves up to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([digest(*level[i : i + 2]) for i in range(0, len(level), 2)])
    return levels


def way(levels, pos):
    """(sibling before, sibling after) on every level from the leaf up."""
    out = []
    for level in levels[:-1]:
        out.append((level[pos - 1], "") if pos % 2 else ("", level[pos + 1] if pos + 1 < len(level) else ""))
        pos //= 2
    return out


def manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for lang in langs]
    trees = [tree_of([leaf_of(*r) for r in g]) for g in groups]
    top = tree_of([t[-1][0] for t in trees])
    out = []
    for n, (group, tree) in enumerate(zip(groups, trees, strict=True)):
        for pos, r in enumerate(group):
            path = way(tree, pos) + way(top, n)
            used = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 or r[4] is None else (*r[:4], r[4] + 1)
            own = leaf_of(*used)
            for before, after in path:
                own = digest(before, own, after)
            out.append((r[0], leaf_of(*r), tree[-1][0], top[-1][0], digest(*(b + a for b, a in path)), own, own == top[-1][0]))
    return sorted(out, key=repr)


def result(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit(1)).withColumn("digest", F.map_from_arrays(F.array(F.lit(1)), F.array(F.lit(2))))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    long = "ü" * 300_000
    made = [(i, f"text {i}", ("en", "fr", "en", "xé")[i % 4], f"s{i % 3}", i) for i in range(-3, 60)]
    made += [(100, None, None, None, None), (101, "", None, "", 0), (None, "x", "en", "s", 1), (None, None, "en", None, None), (7, "other", "en", "s", 2), (8, long, "de", "s", len(long)), (9, "a", "Z", "s", 2**63 - 1)]
    made += [(7, "again", "en", "s", 5)] * 40  # rows that are equal in all
    return made


@pytest.mark.parametrize("levels", [10, 2])
def test_manifest_of_repeats_nulls_and_long_texts(spark, rows, tmp_path, monkeypatch, levels):
    """With segments of two levels a descent opens several records."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BOTTOM", 1 << levels)
    assert result(spark, rows, tmp_path) == manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(i, "t", "en", "s", 1) for i in range(n)]
    assert result(spark, rows, tmp_path) == manifest(rows) if rows else result(spark, rows, tmp_path) == []


def test_records_are_found_by_what_they_hold(spark):
    """Equal subtrees share a record, and every record hashes to its digest."""
    leaves = [digest(str(i % 4)) for i in range(4096 + 5)]
    df = spark.createDataFrame([("t", len(leaves), i, x) for i, x in enumerate(leaves)], "tree string, size long, pos long, digest string")
    built = merkle.build(df)
    records = {r.digest: r.levels for r in built.records.collect()}
    assert built.roots.first().digest == tree_of(leaves)[-1][0] in records
    assert len(records) == 3  # four equal segments, the last leaves', and the one above
    assert all(levels == tree_of(levels[0])[: len(levels)] or len(levels[0]) < 1024 for levels in records.values()) and all(levels[-1] == [d] for d, levels in records.items())
