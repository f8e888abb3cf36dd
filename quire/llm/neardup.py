"""Near-duplicate components with HyperMinHash signatures.

Each text's set of word shingles is hashed once. Of every bucket's smallest hash a register keeps the
number of leading zeros and some mantissa bits; empty buckets borrow from others in an order of their
own. Texts with equal sets are one class. Bands of registers deal class representatives into
buckets; all members of a bucket are compared with its leader, the member that meets the most others,
first by the collision-corrected Jaccard estimate, then on the full sets of 64-bit shingle hashes.
A bucket of up to ``FEW`` members that still holds several components is compared in full where it lies, by the
estimate and then on the sets of those that may link; what leaves it is fewer links than it has members. A larger one is dealt again, ``SPLITS``
independent times, by one more band each, and so on; work grows with the rows of buckets and not with
their square. With 64 bands of 6 registers a pair at a
similarity of 0.8 shares no bucket with a probability below 1e-8; that it shares one at first, but
none that is settled or compared in full, has a probability below 1e-7, and the estimate allows for five standard deviations.

Defined results: null texts, empty ones and those without words are empty and linked with nothing;
rows that share a ``doc_id`` are one document, whatever their texts, and get one component; a row
without ``doc_id`` is linked with nothing, has no component and is kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.decontaminate import checked
from quire.llm.store import bound_batches, discard, keep, table
from quire.llm.text import chunks, give_back, hold, mix, word_codes

BANDS, BAND_REGISTERS, MANTISSA_BITS = 64, 6, 10
REGISTERS, SECOND_SALT = BANDS * BAND_REGISTERS, 0x2545F491
#: Members up to which a bucket is compared in full, how many times a larger one is dealt again, and how often in a row.
FEW, SPLITS, DEEPEST = 2000, 8, 7
#: Leaders up to which their registers are broadcast, and pairs of a bucket that are estimated at a time.
LEADERS, PAIRS = 50_000, 1 << 15
#: Shingle hashes of a bucket, or of a part of one, that are compared in full at a time.
PART_HASHES = 2_000_000

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


@functools.lru_cache(1)
def _borrowing() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the order in which it asks others, and its inverse."""
    rng = np.random.default_rng(20_000)
    order = np.array([rng.permutation(REGISTERS) for _ in range(REGISTERS)])
    return order, np.argsort(order, axis=1)


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    s = np.full(len(words) - size + 1, size * 0x9E37, np.uint64)
    for i in range(size):
        s = mix(s + words[i : len(words) - size + 1 + i] * _K[i % 5], i)
    return s


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """Of each text the distinct 64-bit hashes of its ``size``-word shingles; of the whole sequence if it is shorter."""
    codes, hashes, sizes = word_codes(texts)
    words, at = hashes[codes], 0
    windows = _windows(words, size) if len(words) >= size else words[:0]
    for n in sizes.tolist():
        yield np.unique(windows[at : at + n - size + 1]) if n >= size else _windows(words[at : at + n], n)[: n and 1]
        at += n


def registers(hashes: np.ndarray, salt: int = 0x51ED270B) -> np.ndarray:
    """The HyperMinHash registers of a set of hashes that is not empty."""
    x = mix(hashes, salt)
    bucket = ((x >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    packed = np.sort((bucket << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)))
    at = (packed >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    filled, least = at[first], packed[first] & np.uint64(0xFFFFFFFF)
    bits = np.frexp(least.astype(np.float64))[1]  # 0 for 0
    zeros = (32 - bits).astype(np.uint64)
    mantissa = ((least << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA_BITS)
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = (zeros << np.uint64(MANTISSA_BITS)) | mantissa
    if len(filled) < REGISTERS:
        order, place = _borrowing()
        has = np.zeros(REGISTERS, bool)
        has[filled] = True
        empty = np.flatnonzero(~has)
        if len(filled) <= 48:
            out[empty] = out[filled[place[np.ix_(empty, filled)].argmin(axis=1)]]
        else:
            source, left, t = np.zeros(REGISTERS, np.int64), empty, 0
            while len(left):
                asked = order[left, t]
                ok = has[asked]
                source[left[ok]] = asked[ok]
                left, t = left[~ok], t + 1
            out[empty] = out[source[empty]]
    return out


#: Lower ends of the ranges that share a number of leading zeros.
_LOW = 0.5 ** np.arange(1, 33)


def folded(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The registers ``of`` a set of hashes, and as many of a second sketch of it, in a byte each: what the estimate compares."""
    both = np.concatenate((of, registers(hashes, SECOND_SALT)))
    return ((both * np.uint16(0x9E37)) >> np.uint16(8)).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs from the rows of two matrices of folded registers, less the matches expected by chance."""
    x, y = (np.maximum(np.asarray(n, float) / REGISTERS, 1e-9) for n in (n_a, n_b))
    both = (x + y)[:, None] * _LOW
    chance = (_LOW * 2.0**-MANTISSA_BITS * (np.exp(-both) - np.exp(-2 * both))).sum(axis=1) * x * y / (x + y)
    chance = np.minimum(chance, 0.5) + 1 / 256
    return np.maximum(0.0, ((a == b).mean(axis=1) - chance) / (1 - chance))


def possible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and estimate leave a link possible: five standard deviations are allowed for.

    Borrowed registers spread the estimates of small sets by up to 1.5 / sqrt(size) more (measured for sizes from 5 to 3,000).
    """
    least, small, large = percent / 100, np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    slack = 5 * np.sqrt(least * (1 - least) / (2 * REGISTERS)) * (1 + 1.5 / np.sqrt(np.maximum(small, 1)))
    return (100 * small >= percent * large) & (estimate(a, b, n_a, n_b) >= least - slack)


def _matrix(registers: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(registers.to_pylist()), np.uint8).reshape(-1, 2 * REGISTERS)


_SIGNATURE = "n_shingles long, c1 long, c2 long, registers binary, folded binary"


def signature(text: Column, size: int) -> Column:
    """``struct<n_shingles, c1, c2, registers, folded>``: set size, a 128-bit digest of the set, its registers, and what the estimate compares."""

    @F.arrow_udf(_SIGNATURE)
    def signed(batch: pa.Array) -> pa.Array:
        alone()
        n, c1, c2, packed, small = [], [], [], [], []
        for s in chain.from_iterable(shingle_sets(run, size) for run in chunks(batch)):
            r = registers(s) if len(s) else None
            n.append(len(s))
            c1.append(int(mix(s, 1).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            c2.append(int(mix(s, 2).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            packed.append(r.tobytes() if len(s) else None)
            small.append(folded(s, r).tobytes() if len(s) else None)
        columns = [pa.array(x, kind) for x, kind in ((n, pa.int64()), (c1, pa.int64()), (c2, pa.int64()), (packed, pa.binary()), (small, pa.binary()))]
        return pa.StructArray.from_arrays(columns, ["n_shingles", "c1", "c2", "registers", "folded"])

    return signed(text)


def may_link(a: Column, b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sizes and the estimate from folded registers leave a link possible."""

    @F.arrow_udf("boolean")
    def judged(ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        n, m = (c.to_numpy().astype(float) for c in (na, nb))
        return pa.array(possible(_matrix(ra), _matrix(rb), n, m, percent), pa.bool_())

    return judged(a, b, n_a, n_b)


def alone() -> None:
    """Let this worker's caches of other operators go: near-duplicates keep none, and buckets need the room."""
    hold("neardup", lambda: None)


def _by_bucket(batches: Iterator[pa.RecordBatch], of: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``of`` each bucket. They come one after the other; a task holds one of them at a time, or an Arrow batch."""
    alone()
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        bucket = t.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist()]
        for x, y in zip(cuts, cuts[1:], strict=False):
            yield from of(t.slice(x, y - x))
        rest = t.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield from of(rest)
    rest = t = None
    give_back()


def near_in_buckets(few: DataFrame, percent: int) -> DataFrame:
    """``bucket, id, label``: members that may link, by the estimate, with another of the bucket that has a different label, from ``bucket, id, s, label, folded``."""
    kind = few.schema["id"].dataType.simpleString()

    def members_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        s, label = t.column("s").to_numpy().astype(float), t.column("label").to_numpy()
        registers = _matrix(t.column("folded"))
        near = np.zeros(len(s), bool)
        left, right = np.nonzero(np.triu((label[:, None] != label) & (100 * np.minimum(s[:, None], s) >= percent * np.maximum(s[:, None], s)), 1))
        for at in range(0, len(left), PAIRS):
            i, j = left[at : at + PAIRS], right[at : at + PAIRS]
            open_ = ~(near[i] & near[j])
            i, j = i[open_], j[open_]
            ok = possible(registers[i], registers[j], s[i], s[j], percent)
            near[i[ok]] = near[j[ok]] = True
        yield pa.RecordBatch.from_arrays([t.column(name).combine_chunks().filter(pa.array(near)) for name in ("bucket", "id", "label")], ["bucket", "id", "label"])

    rows = few.select("bucket", "id", "s", F.xxhash64("label").alias("label"), "folded").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(lambda batches: _by_bucket(batches, members_of), f"bucket long, id {kind}, label long")


def linking(sets: list[np.ndarray], label: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Places of pairs that link on their sets, as many as join the labels that links join: fewer than there are sets."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    distinct, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    group, marked = np.unique(label[order], return_inverse=True)[1], np.zeros(len(distinct), np.uint8)
    # Behind these places sets are too large for a link.
    ends = np.searchsorted(percent * sizes, 100 * sizes, side="right")
    for i, end in enumerate(ends.tolist()):
        others = i + 1 + np.flatnonzero(group[i + 1 : end] != group[i])
        if not len(others):
            continue
        first, last = int(others[0]), int(others[-1]) + 1
        marked[codes[starts[i] : starts[i + 1]]] = 1
        common = np.add.reduceat(marked[codes[starts[first] : starts[last]]], starts[first:last] - starts[first], dtype=np.int64)[others - first]
        marked[codes[starts[i] : starts[i + 1]]] = 0
        for j in others[100 * common >= percent * (sizes[i] + sizes[others] - common)].tolist():
            if group[j] != group[i]:
                yield int(order[i]), int(order[j])
                group[group == group[j]] = group[i]


def links_in_buckets(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` that link on full sets (``id, sh``) and join the labels of each bucket in ``near`` (``bucket, id, label``) as all its links do.

    A bucket of long sets is cut into parts of ``PART_HASHES``, and each two of them are compared as a bucket of their own, so that a task's memory is bounded.
    """
    kind = near.schema["id"].dataType.simpleString()

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sh, ids = t.column("sh").combine_chunks(), t.column("id").combine_chunks()
        hashes, at = sh.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sh.value_lengths().to_numpy())))
        found = list(linking([hashes[x:y] for x, y in zip(at, at[1:], strict=False)], t.column("label").to_numpy(), percent))
        if found:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)) for x in zip(*found, strict=True)], ["a", "b"])

    sized = near.join(checked(sets.groupBy("id").agg(F.sum(F.size("sh")).alias("hashes"))), "id")
    parts = sized.groupBy("bucket").agg(F.ceil(F.sum("hashes") / PART_HASHES).cast("int").alias("parts"))
    part, other = F.pmod(F.xxhash64("id"), "parts").cast("int"), F.col("other")
    dealt = near.join(checked(parts), "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least(part, other), F.greatest(part, other))).alias("bucket"), "id", "label")
    rows = dealt.join(sets, "id").repartition("bucket").sortWithinPartitions("bucket")
    found = rows.mapInArrow(lambda batches: _by_bucket(batches, pairs_of), f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_set(text: Column, size: int) -> Column:
    """All shingle hashes of a text: ``array<long>``."""

    @F.arrow_udf("array<long>")
    def hashed(batch: pa.Array) -> pa.Array:
        alone()
        sets = [s for run in chunks(batch) for s in shingle_sets(run, size)]
        at = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        return pa.ListArray.from_arrays(at, np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64))

    return hashed(text)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes in ``edges`` (a, b): the smallest node that each reaches.

    Alternating large and small stars; every round is written to the shared folder.
    """
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = keep(both.filter("b > a").join(checked(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        down = keep(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        small = large.join(checked(down), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, keep(small, "edges")
        discard(before, least, large, down)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state


def _band(registers: Column, band: Column) -> Column:
    return F.substring(registers, band * (2 * BAND_REGISTERS) + 1, F.lit(2 * BAND_REGISTERS))


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def star_pairs(level: DataFrame, percent: int) -> DataFrame:
    """``a, b``: each bucket's leader with its other members, from ``bucket, n, id, s``."""
    meets = level.groupBy("id").agg(F.sum("n").alias("meets"))
    leaders = keep(level.join(meets, "id").groupBy("bucket").agg(F.max(F.struct("meets", "id", "s")).alias("top")).select("bucket", F.col("top.id").alias("leader"), F.col("top.s").alias("leader_s")), "leaders")
    met = level.join(checked(leaders), "bucket").filter((F.col("id") != F.col("leader")) & _sizes_allow(F.col("s"), F.col("leader_s"), percent))
    return met.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()


def crowded(dealt: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``a, b`` of the buckets with two rows of ``dealt`` (bucket, band, id, s), and the rows of the larger ones with their number ``n``.

    Most buckets that are shared hold two rows, and their counting says which: only larger ones are looked for again.
    """
    counts = keep(dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).filter("n > 1"), f"{name}_counts")
    large = counts.filter("n > 2").select("bucket", "n")
    return counts.filter("n = 2 AND a <> b").select("a", "b"), keep(dealt.join(checked(large), "bucket").distinct(), name)


def deal_again(large: DataFrame, signed: DataFrame) -> DataFrame:
    """Members of large buckets, each bucket dealt by its own key and one of the next ``SPLITS`` bands."""
    ids = checked(keep(large.select("id").distinct(), "large_ids"))
    registers = signed.filter("n_shingles > 0").join(ids, "id", "left_semi").select("id", F.col("n_shingles").alias("s"), "registers").distinct()
    steps = F.explode(F.sequence(F.lit(1), F.lit(SPLITS))).alias("step")
    next_ = large.select("bucket", "id", "s", "band", steps).withColumn("band", (F.col("band") + F.col("step")) % BANDS)
    return next_.join(registers, ["id", "s"]).select(F.xxhash64("bucket", "band", _band(F.col("registers"), F.col("band"))).alias("bucket"), "band", "id", "s")


def unsettled_buckets(level: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets in ``level`` whose members have several labels, with these; of buckets with the same members one is enough."""
    labelled = level.join(checked(labels), F.col("id") == F.col("node"), "left").select("bucket", "n", "band", "id", "s", F.coalesce("component", "id").alias("label"))
    members = F.sum(F.xxhash64("id", "s").cast("decimal(38,0)"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.first("n").alias("n"), members.alias("members")).filter("x <> y")
    mixed = keep(mixed.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket"), "mixed")
    return keep(labelled.join(checked(mixed), "bucket", "left_semi"), "unsettled")


def linked_components(single: DataFrame, signed: DataFrame, docs: DataFrame, edges: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, component`` from ``edges`` and all links between the rows of ``single``; ``docs`` has their texts."""
    hashes = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(_band(F.col("registers"), i), i))
    dealt = single.select("id", F.col("n_shingles").alias("s"), F.posexplode(hashes).alias("band", "bucket"))
    folded_of = signed.filter("n_shingles > 0").select("id", F.col("n_shingles").alias("s"), "folded")
    twos, level = crowded(dealt, "members")
    labels, tested = components(edges), None

    def joined(labels: DataFrame, near: DataFrame) -> DataFrame:
        """Labels with the links among pairs that may link."""
        nonlocal tested
        near = keep(near.join(tested, ["a", "b"], "left_anti") if tested else near, "near")
        tested = tested.unionByName(near) if tested else near
        return labels if near.isEmpty() else components(labels.toDF("a", "b").unionByName(verified(near, docs, size, percent)))

    for depth in range(DEEPEST + 1):
        pairs = star_pairs(level, percent).unionByName(twos.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
        labels = joined(labels, estimated(pairs, folded_of, percent))
        unsettled = unsettled_buckets(level, labels)
        large = (F.col("n") > FEW) & F.lit(depth < DEEPEST)  # what is together in so many bands is compared in full
        few = unsettled.filter(~large)
        if not few.isEmpty():
            ids = checked(keep(few.select("id").distinct(), "few_ids"))
            some = folded_of.join(ids, "id", "left_semi").distinct()
            near = keep(near_in_buckets(few.join(some, ["id", "s"]), percent), "near_members")
            if not near.isEmpty():
                links = keep(links_in_buckets(near, sets_of(near.select("id"), docs, size), percent), "links")
                labels = components(labels.toDF("a", "b").unionByName(links))
        if unsettled.filter(large).isEmpty():
            break
        twos, level = crowded(deal_again(unsettled.filter(large), signed), "members")
    return labels


def with_components(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component, kept."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    signed = keep(docs.select("id", signature(F.col("text"), size).alias("s")).select("id", "s.n_shingles", "s.c1", "s.c2", "s.registers", "s.folded"), "signatures")
    real = signed.filter("n_shingles > 0 AND id IS NOT NULL")
    of_class = ["n_shingles", "c1", "c2"]
    copies = keep(real.groupBy(*of_class).agg(F.count("*").alias("rows"), F.min("id").alias("first")).filter("rows > 1").drop("rows"), "copies")
    classed = real.join(checked(copies), of_class, "left")
    # The classes that a document with several texts is in are linked by it.
    differ = [F.min(c) != F.max(c) for c in of_class]
    several = keep(real.groupBy("id").agg((differ[0] | differ[1] | differ[2]).alias("differ")).filter("differ").select("id"), "several")
    shared = classed.join(checked(several), "id", "left_semi").select(F.coalesce("first", "id").alias("a"), F.col("id").alias("b")).distinct()
    labels = linked_components(classed.filter("first IS NULL OR first = id"), signed, docs, shared, size, percent)
    every = signed.join(checked(copies), of_class, "left").withColumn("first", F.coalesce("first", "id")).join(checked(labels), F.col("first") == F.col("node"), "left")
    component = F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.coalesce("component", "first"))
    return every.select(F.col("id").alias(key), "n_shingles", component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def estimated(pairs: DataFrame, folded_of: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their folded registers."""
    pairs = keep(pairs, "pairs")
    sides = [folded_of.join(checked(keep(pairs.select(F.col(c).alias("id")).distinct(), f"side_{c}")), "id", "left_semi").distinct() for c in "ab"]
    left, right = keep(sides[0], "left").toDF("a", "na", "ra"), sides[1].toDF("b", "nb", "rb")
    met = pairs.join(right, "b").join(checked(left, LEADERS), "a")
    return met.filter(may_link(F.col("ra"), F.col("rb"), F.col("na"), F.col("nb"), percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``id, sh``: the full sets of the texts of ``ids``."""
    ids = checked(keep(ids.distinct(), "near_ids"))
    # No filter on the sets: it would be pushed below the join, and the function run on every text.
    return keep(docs.join(ids, "id", "left_semi").filter("text IS NOT NULL").select("id", shingle_set(F.col("text"), size).alias("sh")), "sets")


def verified(near: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link on their full sets."""
    sets = sets_of(near.select("a").union(near.select("b")).toDF("id"), docs, size)
    joined = near.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return keep(joined.filter((common > 0) & (100 * common >= percent * (F.size("sa") + F.size("sb") - common))).select("a", "b").distinct(), "links")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_components(docs, size=4).withColumnRenamed("component", "component_id")


_SQL_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE
  list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i : i + 3], ' '))) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 100 * k >= 80 * (na + nb - k)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS root FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(least(root, s.doc_id), s.doc_id) AS component_id, coalesce(root, s.doc_id) >= s.doc_id AS kept FROM s LEFT JOIN c USING (doc_id)
"""
