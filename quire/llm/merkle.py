"""Merkle manifest of a dataset: a content-addressed DAG of digests, and proofs by descent in it.

Every row is a leaf. The leaves of a language, in order of their ids, are hashed in pairs level by level to a
subroot; the subroots, in order of the languages, are hashed in the same way to the root. The DAG is stored as records
from a digest to what lies below it: a record covers a segment of up to ten levels, at most 1,024 digests at its
bottom, so a descent needs a join for every ten levels, and no row grows with the data. A request for a leaf
descends from the root: the digits of its rank choose the child on every level, the children that are not chosen are
collected, and the collected path, reversed, is the proof. Requests of one segment descend as one row.

Defined results: rows that are equal in all columns are leaves each; rows that share an id stand in order of their
digests, a null id comes first; a null language is a language, the first; a language of one row has its leaf as
subroot, a single language its subroot as root; no rows give no result; other columns have no part.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.order import crc32, crc32_sql, ranked
from quire.llm.store import keep, table

#: Levels of a segment, and digests at its bottom. A node has two children.
LEVELS, BOTTOM = 10, 1 << 10
#: The columns that a leaf covers, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<before: string, after: string>>"


class Manifest(NamedTuple):
    #: digest, levels: the digests below, a list for each level, the bottom first
    records: DataFrame
    #: tree, size, digest: the root of every tree, and how many leaves it has
    roots: DataFrame


def leaf(n_chars: Column | None = None) -> Column:
    """Digest of a row; ``n_chars`` stands for the column of that name."""
    text = lambda c: (n_chars if c == "n_chars" and n_chars is not None else F.col(c)).cast("string")
    field = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return F.sha2(F.concat(*(field(text(c)) for c in FIELDS)), 256)


def _levels_above(digests: Column, levels: Column) -> Column:
    """``digests`` and so many levels of pairs above them."""
    above = lambda level: F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: F.sha2(F.concat_ws("", F.slice(level, i * 2 + 1, 2)), 256))
    return F.aggregate(F.sequence(F.lit(1), levels), F.array(digests), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def _depth(size: Column) -> Column:
    """Levels above ``size`` digests, two or more."""
    return F.length(F.bin(size - 1))


def segments(size: Column) -> Column:
    """Records on the way from the root of a tree to a leaf."""
    return F.when(size == 1, 0).otherwise(F.ceil(_depth(size) / LEVELS).cast("int"))


def build(leaves: DataFrame) -> Manifest:
    """The DAG over ``tree, size, pos, digest``: every tree's ``size`` leaves at the places from 0."""
    nodes = leaves.select("tree", "size", F.col("size").alias("n"), "pos", "digest")
    records = []
    while nodes.filter("n > 1").limit(1).count():
        grouped = nodes.filter("n > 1").groupBy("tree", "size", "n", F.floor(F.col("pos") / BOTTOM).alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.pmod("pos", F.lit(BOTTOM)).alias("at"), "digest"))).alias("below"))
        levels = _levels_above(F.transform("below", lambda x: x.digest), F.least(F.lit(LEVELS), _depth(F.col("n"))))
        made = keep(grouped.select("tree", "size", F.ceil(F.col("n") / BOTTOM).alias("n"), "pos", levels.alias("levels")), "segments")
        made = made.withColumn("digest", F.get(F.element_at("levels", -1), F.lit(0)))
        records.append(made.select("digest", "levels"))
        nodes = keep(made.select("tree", "size", "n", "pos", "digest").unionByName(nodes.filter("n = 1")), "nodes")
    roots = nodes.select("tree", "size", "digest")
    if not records:
        return Manifest(roots.select("digest", F.array(F.array("digest")).alias("levels")).limit(0), roots)
    every = records[0]
    for more in records[1:]:
        every = every.unionByName(more)
    return Manifest(keep(every.groupBy("digest").agg(F.first("levels").alias("levels")), "records"), roots)


def _unselected(levels: Column, at: Column) -> Column:
    """The children that a descent to ``at`` at the bottom leaves aside, the top level first."""

    def beside(j: Column) -> Column:
        level, place = F.get(levels, j), F.call_function("shiftright", at, j)
        odd = place % 2 == 1
        sibling = F.coalesce(F.get(level, F.when(odd, place - 1).otherwise(place + 1)), F.lit(""))
        return F.struct(F.when(odd, sibling).otherwise("").alias("before"), F.when(odd, "").otherwise(sibling).alias("after"))

    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(levels) - 2)), beside)


def descend(manifest: Manifest, starts: DataFrame, until: int) -> DataFrame:
    """``starts`` (``tree, left, place, digest, path`` and more) below, until ``until`` records are left to any leaf.

    A row stands for all requests below its ``digest``; it opens the digest's record and goes on with every child
    at its bottom.
    """
    at = starts
    more = [c for c in starts.columns if c not in ("left", "place", "digest", "path")]
    deepest = starts.agg(F.max("left")).first()[0] or 0
    for left in range(deepest, until, -1):
        opened = at.filter(F.col("left") == left).join(manifest.records, "digest")
        bottom = opened.select(*more, "left", "place", "path", "levels", F.posexplode(F.get("levels", F.lit(0))).alias("digit", "digest"))
        on = bottom.select(*more, (F.col("left") - 1).alias("left"), (F.col("place") * BOTTOM + F.col("digit")).alias("place"), "digest", F.concat("path", _unselected(F.col("levels"), F.col("digit"))).alias("path"))
        at = keep(on.unionByName(at.filter(F.col("left") != left).select(on.columns)), "descent")
    return at


def prove(manifest: Manifest, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (``tree, pos`` and more) with ``leaf`` and ``path``: the children not chosen from the leaf up to the root.

    ``starts`` has a row for every tree: where the descent is when it comes to that tree's root.
    """
    above = descend(manifest, starts, 1)
    own = [c for c in requests.columns if c not in ("tree", "pos")]
    asked = requests.groupBy("tree", F.floor(F.col("pos") / BOTTOM).alias("place")).agg(F.collect_list(F.struct(F.pmod("pos", F.lit(BOTTOM)).cast("int").alias("digit"), *own)).alias("asked"))
    opened = above.join(asked, ["tree", "place"]).join(manifest.records, "digest", "left")
    found = opened.select("*", F.explode("asked").alias("one")).drop("asked")
    last = F.when(F.col("left") == 0, F.array().cast(_PATH)).otherwise(_unselected(F.col("levels"), F.col("one.digit")))
    digest = F.when(F.col("left") == 0, F.col("digest")).otherwise(F.get(F.get("levels", F.lit(0)), F.col("one.digit")))
    more = [c for c in starts.columns if c not in ("left", "place", "digest", "path")]
    return found.select(*more, "one.*", digest.alias("leaf"), F.reverse(F.concat("path", last)).alias("path")).drop("digit")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda own, x: F.sha2(F.concat(x["before"], own, x["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["before"], x["after"]))), 256)


def manifest_of(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, altered``: proofs of all rows; ``altered`` is the leaf of a row with which tampering is tried, else null."""
    tampered = (crc32(F.col("doc_id")) % 7 == 0) & F.col("n_chars").isNotNull()
    altered = F.when(tampered, leaf(F.col("n_chars").cast("decimal(20,0)") + 1))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # null comes first
    rows = keep(docs.select(*FIELDS).select(tree.alias("tree"), "doc_id", leaf().alias("digest"), altered.alias("altered")), "leaves")
    leaves = keep(ranked(rows, "tree", ["doc_id", "digest"], "ranked"), "placed")
    langs = build(leaves)
    subroots = langs.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("digest"), F.col("size").alias("leaves"))
    subroots = keep(ranked(subroots, "tree", ["of"], "subroots"), "trees")
    top = build(subroots)
    none = F.array().cast(_PATH).alias("path")
    start = lambda size: [segments(size).alias("left"), F.lit(0).cast("long").alias("place")]
    at_root = top.roots.select("tree", F.col("digest").alias("root"), *start(F.col("size")), "digest", none)
    at_trees = prove(top, at_root, subroots.select("tree", "pos", "of", "leaves"))
    # The path to a subroot is the upper part of the path to a leaf: turned round again, from the root on.
    starts = keep(at_trees.select(F.col("of").alias("tree"), "root", F.col("leaf").alias("subroot"), *start(F.col("leaves")), F.col("leaf").alias("digest"), F.reverse("path").alias("path")), "starts")
    return prove(langs, starts, leaves.select("tree", "pos", "doc_id", "altered"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = manifest_of(table(spark, sf_dir, "documents"))
    reached = proofs.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return reached.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(e: str) -> str:
    return f"coalesce(strlen(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')"


OP13_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, lang, sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
    CASE WHEN {crc32_sql("doc_id")} % 7 = 0 THEN sha256({" || ".join(_field("n_chars + 1" if c == "n_chars" else c) for c in FIELDS)}) END AS altered FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM l),
t AS (SELECT lang, 0 AS level, pos, size AS n, leaf AS digest FROM r
  UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, level, pos // 2, n),
s AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, size AS n, subroot AS digest FROM s
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
w AS (SELECT doc_id, lang, leaf, 0 AS level, pos, size AS n, coalesce(altered, leaf) AS own, '' AS proof FROM r
  UNION ALL SELECT w.doc_id, w.lang, w.leaf, w.level + 1, w.pos // 2, (w.n + 1) // 2, sha256(CASE WHEN w.pos % 2 = 1 THEN t.digest || own ELSE own || coalesce(t.digest, '') END), proof || coalesce(t.digest, '')
  FROM w LEFT JOIN t ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.pos = xor(w.pos, 1) WHERE w.n > 1),
x AS (SELECT doc_id, leaf, subroot, 0 AS level, s.pos, s.size AS n, own, proof FROM w JOIN s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL SELECT doc_id, leaf, subroot, x.level + 1, x.pos // 2, (x.n + 1) // 2, sha256(CASE WHEN x.pos % 2 = 1 THEN u.digest || own ELSE own || coalesce(u.digest, '') END), proof || coalesce(u.digest, '')
  FROM x LEFT JOIN u ON u.level = x.level AND u.pos = xor(x.pos, 1) WHERE x.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified FROM x CROSS JOIN (SELECT digest AS root FROM u WHERE n = 1) WHERE n = 1
"""
