"""Prefixes that conversations share: double-array tries over shards of prefixes, merged above them.

Every conversation is a sequence of turns. It is cut into bands of ``BAND`` turns, so no piece grows with the data; a
piece starts at the node of what stands before it, which is known by an exclusive-or of 128-bit hashes of (place, turn).
Equal pieces are counted once. Pieces are dealt to shards by the prefix of their first turns, longer ones where more than
``SHARD`` pieces share a prefix. A shard numbers its turns densely, packs its pieces into a trie of two arrays,
BASE and CHECK, and walks it: a node's child for a turn is at BASE + turn, if CHECK there names the node. Nodes
above the prefixes of shards, and nodes where a band ends, meet again in other shards; what these know of them is
merged by Spark, and totals of the bands below come up in steps of one, two, four ... bands.

Defined results: rows without ``conv_id`` take no part; a null role or text is empty; turns of one number stand in order
of their digests, a null number comes first; equal rows are turns each; a node is known by 128 bits, two unequal nodes
are taken for one with a probability below 1e-19 for a billion of them; no conversations give no nodes. The digest of a
list of ids is taken in order in one task, from strings of up to ``ENDS`` ids, in bounded memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.order import crc32, crc32_sql, ranked
from quire.llm.store import keep, table

#: Turns of a band, pieces of a shard or below a prefix, bands that one window covers, ids in a string.
BAND, SHARD, SPAN, ENDS = 64, 2048, 1024, 4096
NODE = ["id1", "id2"]


def double_array(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK of the trie over sorted, distinct ``rows`` of codes from 1, filled up with 0; state 0 is the root."""
    size = 2 * (int(rows.max(initial=0)) + int((rows > 0).sum())) + 64
    base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    check[0], free, top = -2, 1, 1
    todo = deque([(0, 0, len(rows), 0)])
    while todo:
        state, low, high, depth = todo.popleft()
        if depth == rows.shape[1]:
            continue
        column = rows[low:high, depth]
        low += int(np.searchsorted(column, 1))
        column = rows[low:high, depth]
        if not len(column):
            continue
        starts = np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1))
        codes = column[starts]
        at = -1
        begin = max(free, int(codes[0]))
        for slot in (np.flatnonzero(check[begin : begin + 64] == -1)[:8] + begin).tolist():
            if slot + codes[-1] - codes[0] < size and (check[slot + codes - codes[0]] == -1).all():
                at = slot - int(codes[0])
                break
        if at < 0:
            at = max(0, top - int(codes[0]))
        if at + codes[-1] >= size:  # codes that lie far apart
            more = int(at + codes[-1] + size)
            base, check = np.pad(base, (0, more - size)), np.pad(check, (0, more - size), constant_values=-1)
            size = more
        base[state] = at
        slots = at + codes
        check[slots] = state
        top = max(top, int(slots[-1]) + 1)
        while check[free] != -1:
            free += 1
        ends = np.append(starts[1:], len(column))
        todo.extend(zip(slots.tolist(), (low + starts).tolist(), (low + ends).tolist(), [depth + 1] * len(slots), strict=True))
    return base[:top], check[:top]


_TURNS = "array<struct<d: long, a: long, b: long, z1: long, z2: long, words: long>>"
_NODES = "band long, j long, id1 long, id2 long, up1 long, up2 long, up_low long, n long, low long, words long, kids long, leaves long, saved long, upper boolean, more boolean"


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense numbers from 0 of equal rows, and how many there are."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), np.int64)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum()) + 1 if len(order) else 0


def nodes_of(shard: pa.Table) -> pa.Table:
    """The nodes of one shard's trie, those above its prefixes marked ``upper``."""
    t = shard.combine_chunks()
    get = lambda c: t.column(c).to_numpy()
    band, r1, r2, n, low, deep = map(get, ("band", "root1", "root2", "n", "low", "q"))
    more = t.column("more").to_numpy(zero_copy_only=False)
    turns = t.column("turns").combine_chunks() if isinstance(t.column("turns"), pa.ChunkedArray) else t.column("turns")
    sizes = np.diff(turns.offsets.to_numpy())
    part = {f: turns.flatten().field(f).to_numpy() for f in ("a", "b", "z1", "z2", "words")}
    code, kinds = _numbered(part["a"], part["b"])
    root, _ = _numbered(r1, r2, band)
    start = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(own)) - np.repeat(start, sizes)
    rows = np.zeros((len(sizes), int(sizes.max(initial=0)) + 1), np.int64)
    rows[:, 0] = root + 1 + kinds
    rows[own, place + 1] = code + 1
    base, check = double_array(rows[np.lexsort(rows.T[::-1])])

    many, none = len(base), np.iinfo(np.int64).max
    count, lowest, words, depth, kids, leaves, saved = (np.zeros(many, np.int64) for _ in range(7))
    lowest[:] = none
    id1, id2, bands = (np.zeros(many, np.int64) for _ in range(3))
    upper, on, seen = (np.zeros(many, bool) for _ in range(3))
    state, k1, k2 = np.zeros(len(sizes), np.int64), r1.copy(), r2.copy()
    going = np.arange(len(sizes))
    for j in range(rows.shape[1]):
        going = going[sizes[going] >= j]
        if j:
            at = start[going] + j - 1
            k1[going] ^= part["z1"][at]
            k2[going] ^= part["z2"][at]
        step = base[state[going]] + rows[going, j]
        assert (check[step] == state[going]).all()
        state[going] = step
        np.add.at(count, step, n[going])
        np.minimum.at(lowest, step, low[going])
        depth[step], bands[step], seen[step] = j, band[going], True
        id1[step], id2[step] = k1[going], k2[going]
        if j:
            words[step] = part["words"][at]
        upper[step] |= deep[going] > j
        last = going[sizes[going] == j]
        on[state[last]] |= more[last]
        np.add.at(leaves, state[last], get("below_leaves")[last])
        np.add.at(saved, state[last], get("below_saved")[last])
    every = np.flatnonzero(seen)
    above = check[every]
    np.add.at(kids, above, ~upper[every])
    childless = np.zeros(many, bool)
    childless[every] = True
    childless[above] = False
    leaves += childless & ~on & ~upper
    saved += np.where(upper | (depth == 0), 0, (count - 1) * words)
    for j in range(rows.shape[1] - 1, 0, -1):
        level = every[(depth[every] == j) & ~upper[every]]
        np.add.at(leaves, check[level], leaves[level])
        np.add.at(saved, check[level], saved[level])
    inner = depth[every] > 0
    parent = np.where(inner, above, every)
    known = inner & ~upper[parent] & (depth[parent] > 0)
    return pa.table({
        "band": bands[every], "j": depth[every], "id1": id1[every], "id2": id2[every], "up1": id1[parent], "up2": id2[parent], "up_low": pa.array(lowest[parent], mask=~known),
        "n": count[every], "low": lowest[every], "words": words[every], "kids": kids[every], "leaves": leaves[every], "saved": saved[every], "upper": upper[every], "more": on[every],
    })


def rebuilt(conversations: DataFrame, turns: int = 4, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """``conv_id, d, a, b, words, length``: every conversation with its first turns from the first of its family; and ``conv_id, length`` of all.

    The first crc32(conv_id) % ``turns`` turns come from conversation ``conv_id - conv_id % family``.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    placed = ranked(keep(rows, "turns"), "conv_id", ["turn", "digest"], "ordered")
    one = placed.select("conv_id", "pos", "size", F.xxhash64(F.lit(1), "digest").alias("a"), F.xxhash64(F.lit(2), "digest").alias("b"), "words")
    h, base = crc32(F.col("conv_id")) % turns, F.col("conv_id") - F.col("conv_id") % family
    heads = one.filter((F.col("pos") < turns - 1) & (F.col("conv_id") == base)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("heads"))
    every = one.filter("pos = 0").select("conv_id", "size", h.alias("h"), base.alias("base")).join(heads, "base", "left")
    every = every.withColumn("heads", F.slice(F.coalesce("heads", F.array().cast("array<struct<pos: long, a: long, b: long, words: long>>")), F.lit(1), F.col("h").cast("int")))
    every = keep(every.select("conv_id", "h", "heads", (F.size("heads") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    head = every.select("conv_id", "length", F.explode("heads").alias("x")).select("conv_id", (F.col("x.pos") + 1).alias("d"), "x.a", "x.b", "x.words", "length")
    known = every.select("conv_id", "h", F.size("heads").cast("long").alias("m"), "length")
    tail = one.join(known, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("d"), "a", "b", "words", "length")
    return head.unionByName(tail), every.select("conv_id", "length")


def pieces_of(rows: DataFrame) -> DataFrame:
    """``conv_id, band, turns, x1, x2, root1, root2, length``: the bands of every conversation and the node at which each starts."""
    d = F.col("d")
    z = [F.xxhash64(F.lit(1), "d", "a", "b").alias("z1"), F.xxhash64(F.lit(2), "d", "b", "a").alias("z2")]
    cut = rows.select("conv_id", F.floor((d - 1) / BAND).alias("band"), "length", F.struct("d", "a", "b", *z, "words").alias("turn"))
    pieces = cut.groupBy("conv_id", "band").agg(F.array_sort(F.collect_list("turn")).cast(_TURNS).alias("turns"), F.bit_xor("turn.z1").alias("x1"), F.bit_xor("turn.z2").alias("x2"), F.first("length").alias("length"))
    pieces = keep(pieces.withColumn("span", F.floor(F.col("band") / SPAN)), "pieces")
    before = lambda w, c: F.coalesce(F.bit_xor(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near, far = W.partitionBy("conv_id", "span").orderBy("band"), W.partitionBy("conv_id").orderBy("span")
    spans = pieces.groupBy("conv_id", "span").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    spans = spans.select("conv_id", "span", before(far, "s1").alias("f1"), before(far, "s2").alias("f2")).filter("span > 0")
    placed = pieces.withColumn("n1", before(near, "x1")).withColumn("n2", before(near, "x2")).join(spans, ["conv_id", "span"], "left")
    far_of = lambda i: F.coalesce(f"f{i}", F.lit(0))
    return placed.select("conv_id", "band", "turns", "x1", "x2", F.col("n1").bitwiseXOR(far_of(1)).alias("root1"), F.col("n2").bitwiseXOR(far_of(2)).alias("root2"), "length")


def _prefix(i: int, q: Column) -> Column:
    """Half of the node that a piece's first ``q`` turns lead to."""
    return F.aggregate(F.slice("turns", F.lit(1), q), F.col(f"root{i}"), lambda x, turn: x.bitwiseXOR(turn[f"z{i}"]))


def shards_of(pieces: DataFrame) -> DataFrame:
    """Distinct pieces with how many there are, their lowest conversation, and ``bucket``: pieces of a bucket share no prefix of ``q`` turns with others."""
    same = ["band", "root1", "root2", "x1", "x2"]
    once = pieces.groupBy(*same).agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.max(F.col("length") > (F.col("band") + 1) * BAND).alias("more"), F.first("turns").alias("turns"))
    once = keep(once.withColumn("q", F.lit(1).cast("long")), "distinct")
    buckets = max(1, -(-once.count() // SHARD))
    for q in range(1, BAND):
        at = [_prefix(i, F.lit(q)).alias(f"p{i}") for i in (1, 2)]
        crowded = keep(once.filter((F.col("q") == q) & (F.size("turns") >= q)).select("band", *at).groupBy("band", "p1", "p2").count().filter(F.col("count") > SHARD).select("band", "p1", "p2", F.lit(True).alias("crowded")), "crowded")
        if not crowded.limit(1).count():
            break
        # At most one of SHARD pieces has a row there.
        once = keep(once.select("*", *at).join(crowded, ["band", "p1", "p2"], "left").withColumn("q", F.when(F.col("crowded"), q + 1).otherwise(F.col("q"))).drop("p1", "p2", "crowded"), "distinct")
    reach = F.least(F.col("q"), F.size("turns")).cast("int")
    return once.withColumn("bucket", F.pmod(F.xxhash64("band", _prefix(1, reach), _prefix(2, reach), F.least(F.col("q"), reach + 1)), F.lit(buckets)))


def walked(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes below the prefixes of shards, and those above, merged: with all that hangs on them in their band."""
    nodes = keep(shards.select("bucket", "band", "root1", "root2", "n", "low", "more", "turns", "q", "below_leaves", "below_saved").groupBy("bucket").applyInArrow(lambda t: nodes_of(t), _NODES), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
    above = nodes.filter("upper").groupBy("band", "j", *NODE).agg(*sums, F.min("low").alias("low"), F.first("words").alias("words"), F.first("up1").alias("up1"), F.first("up2").alias("up2"))
    above = keep(above.withColumn("saved", F.col("saved") + F.when(F.col("j") == 0, 0).otherwise((F.col("n") - 1) * F.col("words"))), "above")
    deepest = above.agg(F.max("j")).first()[0] or 0
    for j in range(deepest, 0, -1):
        up = above.filter(F.col("j") == j).groupBy("band", F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("k"))
        up = up.withColumn("j", F.lit(j - 1).cast("long"))
        add = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
        above = keep(above.join(up, ["band", "j", *NODE], "left").select("band", "j", *NODE, "n", "low", "words", "up1", "up2", add("kids", "k"), add("leaves", "l"), add("saved", "s")), "above")
    return nodes.filter("NOT upper"), above


def below_bands(pieces: DataFrame, roots: DataFrame, bands: int) -> DataFrame:
    """``band, id1, id2, leaves, saved``: what hangs on the node where a band starts, with all bands below."""
    starts = pieces.select(F.col("conv_id").alias("low"), "band", F.col("root1").alias("up1"), F.col("root2").alias("up2"))
    total = roots
    step = 1
    while step < bands:
        at = total.filter(F.col("band") >= step).withColumn("band", F.col("band") - step).join(starts, ["low", "band"])
        up = at.groupBy("band", F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        total = keep(total.join(up, ["band", *NODE], "left").select("band", *NODE, "low", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "below")
        step *= 2
    return total.select("band", *NODE, "leaves", "saved")


def end_digests(ends: DataFrame) -> DataFrame:
    """``id1, id2, ends_sha256`` for ``id1, id2, conv_id``: SHA-256 of a node's ids in order, joined by commas."""

    def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, ids = (b.column(c).to_numpy() for c in (*NODE, "conv_id"))
            cut = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1 if len(ids) else []
            out = [(lo + i, min(lo + i + ENDS, hi)) for lo, hi in zip([0, *cut], [*cut, len(ids)], strict=True) for i in range(0, hi - lo, ENDS)]
            first = [lo for lo, _ in out]
            yield pa.RecordBatch.from_pydict({"id1": k1[first], "id2": k2[first], "first": ids[first], "ids": [",".join(map(str, ids[lo:hi].tolist())) for lo, hi in out]})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, done = None, None, []
        for b in batches:
            for *key, text in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key == own:
                    digest.update(b"," + text.encode())
                    continue
                if own:
                    done.append((*own, digest.hexdigest()))
                own, digest = key, sha256(text.encode())
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in done] for i, c in enumerate((*NODE, "ends_sha256"))}, schema=schema)
            done = []
        if own:
            yield pa.RecordBatch.from_pydict({c: [x] for c, x in zip((*NODE, "ends_sha256"), (*own, digest.hexdigest()), strict=True)}, schema=schema)

    schema = pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("ends_sha256", pa.string())])
    strings = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(strung, "id1 long, id2 long, first long, ids string")
    return strings.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "id1 long, id2 long, ends_sha256 string")


def trie(rows: DataFrame, every: DataFrame) -> DataFrame:
    """The nodes of all prefixes of ``rows`` (``conv_id, d, a, b, words, length``); ``every`` has all ``conv_id, length``."""
    pieces = keep(pieces_of(rows), "placed")
    once = shards_of(pieces)
    none = [F.lit(0).cast("long").alias(f"below_{c}") for c in ("leaves", "saved")]
    bands = (pieces.agg(F.max("band")).first()[0] or 0) + 1
    if bands == 1:
        nodes, above = walked(once.select("*", *none))
    else:
        once = keep(once, "shards")
        _, own = walked(once.select("*", *none))
        below = below_bands(pieces, own.filter("j = 0").select("band", *NODE, "low", "leaves", "saved"), bands)
        ends = [F.col("root1").bitwiseXOR(F.col("x1")).alias("id1"), F.col("root2").bitwiseXOR(F.col("x2")).alias("id2")]
        below = below.select((F.col("band") - 1).alias("band"), *NODE, F.lit(True).alias("more"), F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))
        filled = once.select("*", *ends).join(below, ["band", *NODE, "more"], "left").drop(*NODE).fillna(0, ["below_leaves", "below_saved"])
        nodes, above = walked(filled)
        started = above.filter("j = 0 AND band > 0").select((F.col("band") - 1).alias("band"), *NODE, F.lit(True).alias("more"), F.col("kids").alias("more_kids"))
        nodes = nodes.join(started, ["band", *NODE, "more"], "left").withColumn("kids", F.col("kids") + F.coalesce("more_kids", F.lit(0)))
        above = above.filter("j > 0 OR band = 0")
    # A crowded prefix is above its shards at any place before the last of its band.
    columns = ["band", "j", *NODE, "up1", "up2", "n", "low", "kids", "leaves", "saved"]
    inner = nodes.select(*columns, "up_low").unionByName(above.filter("j > 0").select(*columns, F.lit(None).cast("long").alias("up_low")))
    lows = above.filter("j > 0").select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("low").alias("merged")).unionByName(nodes.filter(F.col("j") == BAND).select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("low").alias("merged")))
    convs = every.agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).filter("n > 0")  # a row
    depth = F.col("band") * BAND + F.col("j")
    resolved = inner.filter(F.col("up_low").isNotNull() | (depth == 1)).select("*", F.lit(None).cast("long").alias("merged")).unionByName(inner.filter(F.col("up_low").isNull() & (depth > 1)).join(lows, ["up1", "up2"], "left").select(*inner.columns, "merged"))
    first = F.broadcast(convs.select(F.col("low").alias("root_low")))
    below = resolved.crossJoin(first).select(*NODE, F.col("low").alias("conv_id"), depth.alias("depth"), F.coalesce(F.when(depth == 1, F.col("root_low")), "up_low", "merged").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    root = convs.select(F.lit(0).cast("long").alias("id1"), F.lit(0).cast("long").alias("id2"), F.col("low").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"))
    totals = above.filter("j = 0 AND band = 0").select(*NODE, F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    root = root.join(totals, NODE, "left").fillna({"n_children": 0, "n_leaves": 1, "saved_tokens": 0})
    last = pieces.filter("length <= (band + 1) * " + str(BAND)).select(F.col("root1").bitwiseXOR(F.col("x1")).alias("id1"), F.col("root2").bitwiseXOR(F.col("x2")).alias("id2"), "conv_id")
    ends = last.unionByName(every.filter("length = 0").select(F.lit(0).cast("long").alias("id1"), F.lit(0).cast("long").alias("id2"), "conv_id"))
    whole = below.unionByName(root).join(end_digests(ends), NODE, "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(table(spark, sf_dir, "conversations")))


OP12_SQL = f"""
WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, sha256(strlen(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) - 1 AS pos FROM t),
c AS (SELECT conv_id, {crc32_sql("conv_id")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, 0 AS part, o.pos, o.digest, o.words FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.digest, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
r AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM b),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS d, '' AS id, CAST(NULL AS VARCHAR) AS up, CAST(0 AS BIGINT) AS words FROM c
  UNION ALL SELECT p.conv_id, p.d + 1, sha256(p.id || r.digest), p.id, r.words FROM p JOIN r ON r.conv_id = p.conv_id AND r.d = p.d + 1),
n AS (SELECT id, d, up, words, min(conv_id) AS low, count(*) AS n FROM p GROUP BY id, d, up, words),
k AS (SELECT up AS id, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
own AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (id)),
s AS (SELECT a.id, sum(CASE WHEN own.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((own.n - 1) * own.words) AS saved FROM own JOIN p AS a ON a.conv_id = own.low AND a.d <= own.d GROUP BY a.id),
e AS (SELECT p.id, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS digest FROM p LEFT JOIN r ON r.conv_id = p.conv_id AND r.d = p.d + 1 WHERE r.d IS NULL GROUP BY p.id)
SELECT own.low AS conv_id, own.d AS depth, up.low AS parent_conv_id, own.n AS n_convs, CAST(own.kids AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM own JOIN s USING (id) LEFT JOIN own AS up ON up.id = own.up LEFT JOIN e USING (id)
"""
