"""Language-model scores with a probabilistic suffix tree over words.

Texts are coded once, in chunks. Of the training texts all words are counted, and at each level up to
``DEPTH`` the n-grams whose context occurs ``LEAST_CONTEXT`` times; those that occur ``LEAST_NEXT``
times are next words of their context. A context is retained when its next-word distribution
diverges from that of its suffix by enough for its count, or when a longer retained context ends in
it. Next-word probabilities are discounted counts interpolated with the suffix's; the root is the
add-one word distribution. A token is scored at the longest retained suffix of the words before it.

The least counts do not depend on the corpus, so the tree grows with it: words, n-grams and contexts
are Spark tables, and probabilities come from groupings and joins. For scoring, every chunk asks once
for each of its words and n-grams, the questions are joined with the tree's entries, and the answers
meet the chunk again. N-grams are counted and chunks scored in ``ROUNDS``, by their hashes, so that the files of one
round's shuffles are gone before the next. Two things of a fixed size are broadcast: bitmaps, which keep what surely is not
in a table from being shuffled, and the commonest entry of each of ``1 << HEAD_BITS`` slots, which need not be
asked for. The joins behind them are exact.

Words and n-grams are known by 64-bit hashes. Defined results: null and empty texts are the end token
alone; a row without key is a training row; repeated rows each get their own score and count each in
training; without training rows every token has the probability of the one unseen word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.decontaminate import checked
from quire.llm.language import in_fold
from quire.llm.store import bound_batches, discard, keep, release, table
from quire.llm.text import chunks, give_back, mix, trim, word_codes

#: Words in the longest contexts.
DEPTH = 3
#: Least counts of a context and of a next word behind it.
LEAST_CONTEXT, LEAST_NEXT = 4, 2
#: Least divergence from the suffix's distribution times the context's count, in nats; and the discount.
LEAST_DIVERGENCE, DISCOUNT = 20.0, 0.75
#: Characters of a chunk, n-grams that are counted at a time, and most bits of a hash that a bitmap and the slots of common entries tell apart.
CHUNK_CHARS, RUN_GRAMS, BITMAP_BITS, HEAD_BITS = 1_000_000, 1_000_000, 27, 20
#: Rows of the batches that leave Python: the JVM holds a batch as a whole outside its heap.
OUT_ROWS = 65_536
#: Equal parts of the n-grams of a level, and of the chunks, that are shuffled one after the other.
ROUNDS = 4

#: The end token: no word is empty.
END = b""
_K = np.uint64(0x9E3779B97F4A7C15)


def coded(docs: DataFrame) -> DataFrame:
    """One row per chunk of ``id, text, train``: the ids, and packed: train flags, sizes, distinct word hashes, places of the tokens in these."""
    kind = docs.schema["id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            at = 0
            for run in chunks(b.column("text"), CHUNK_CHARS):
                codes, words, sizes = word_codes(run, END)
                ids = b.column("id").slice(at, len(run))
                train = b.column("train").slice(at, len(run)).to_numpy(zero_copy_only=False).astype(np.uint8)
                small = codes.astype(np.uint16 if len(words) <= 1 << 16 else np.int32)
                packed = [pa.array([x.tobytes()], pa.binary()) for x in (train, sizes, words, small)]
                ids = pa.ListArray.from_arrays(pa.array([0, len(run)], pa.int32()), pa.concat_arrays([ids]))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, *packed], ["chunk", "ids", "train", "sizes", "words", "codes"])
                at, number = at + len(run), number + 1
        give_back()

    return docs.select("id", "text", "train").mapInArrow(code, f"chunk long, ids array<{kind}>, train binary, sizes binary, words binary, codes binary")


class Chunk(NamedTuple):
    train: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    codes: np.ndarray

    def trained(self) -> np.ndarray:
        """Whether each token is of a training text."""
        return np.repeat(self.train, self.sizes) > 0

    def places(self) -> np.ndarray:
        """Place of each token in its text."""
        return np.arange(len(self.codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def sequences(self, longest: int) -> list[np.ndarray]:
        """Hashes of the 1 to ``longest`` tokens that end at each place; without meaning where they start before the text."""
        words = self.words[self.codes]
        out = [words]
        for _ in range(longest - 1):
            out.append(np.concatenate((words[:1], mix(out[-1][:-1] * _K ^ words[1:]))))
        return out


def _chunk(b: pa.RecordBatch | pa.Table, i: int) -> Chunk:
    raw = {name: b.column(name)[i].as_buffer() for name in Chunk._fields}
    sizes, words = np.frombuffer(raw["sizes"], np.int64), np.frombuffer(raw["words"], np.uint64)
    return Chunk(np.frombuffer(raw["train"], np.uint8), sizes, words, np.frombuffer(raw["codes"], np.uint16 if len(words) <= 1 << 16 else np.int32))


def _longs(*columns: np.ndarray, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names.split())


def _pieces(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of ``OUT_ROWS``."""
    for at in range(0, rows.num_rows, OUT_ROWS):
        yield rows.slice(at, OUT_ROWS)


def word_counts(chunked: DataFrame) -> DataFrame:
    """``key, c``: hash and count of every training token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = _chunk(b, i)
                c = np.bincount(x.codes[x.trained()], minlength=len(x.words))
                yield from _pieces(_longs(x.words[c > 0], c[c > 0], names="key c"))
        give_back()

    return chunked.select("train", "sizes", "words", "codes").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _bits(keys: DataFrame, spare: int, least: int, most: int) -> int:
    """Bits that tell this many keys apart, and ``spare`` more, within bounds."""
    return min(most, max(least, keys.count().bit_length() + spare))


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the lowest bits of every ``key``, in bytes."""
    size = 1 << _bits(keys, 4, 15, BITMAP_BITS)
    place = F.col("key").bitwiseAND(F.lit(size - 1))
    rows = keys.groupBy(F.shiftright(place, 15).alias("page")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        out[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def possible(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of ``keys`` may be in a bitmap."""
    place = keys & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def in_rounds(made: Callable[[int], DataFrame], name: str) -> list[DataFrame]:
    """The tables of all rounds, each written, and its shuffle files gone, before the next."""
    parts = []
    for turn in range(ROUNDS):
        parts.append(keep(made(turn), f"{name}_{turn}"))
        release(parts[-1].sparkSession)
    return parts


def gram_counts(chunked: DataFrame, bitmaps: Broadcast, length: int, turn: int) -> DataFrame:
    """``key, ctx, suf, c``: n-grams of the training texts with a possible context of ``length`` words and a possible suffix of as many, and these two; those of one round."""
    rounds = np.uint64(ROUNDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, suffixes = bitmaps.value
        run, size = [], 0

        def counted() -> pa.RecordBatch:
            key, ctx, suf = (np.concatenate(x) for x in zip(*run, strict=True))
            run.clear()
            key, first, c = np.unique(key, return_index=True, return_counts=True)
            return _longs(key, ctx[first], suf[first], c, names="key ctx suf c")

        for b in batches:
            for i in range(b.num_rows):
                x = _chunk(b, i)
                *_, short, long = x.sequences(length + 1)
                at = np.flatnonzero(x.trained() & (x.places() >= length))
                at = at[possible(contexts, short[at - 1])]
                at = at[possible(suffixes, short[at])]
                at = at[(long[at] >> np.uint64(32)) % rounds == turn]
                run.append((long[at], short[at - 1], short[at]))
                size += len(at)
                if size >= RUN_GRAMS:
                    yield from _pieces(counted())
                    size = 0
                    trim()
        if size:
            yield from _pieces(counted())
        give_back()

    grams = chunked.select("train", "sizes", "words", "codes").mapInArrow(count, "key long, ctx long, suf long, c long")
    return grams.groupBy("key").agg(F.max("ctx").alias("ctx"), F.max("suf").alias("suf"), F.sum("c").alias("c"))


class Level(NamedTuple):
    """One level of the tree."""

    grams: DataFrame  # key, ctx, suf, c, p: probability of the last word behind the context, retained or not
    retained: DataFrame  # ctx, n, backoff: weight of the suffix


class Tree(NamedTuple):
    tokens: int
    vocabulary: int
    counts: DataFrame  # key, c
    levels: list[Level]

    def entries(self) -> DataFrame:
        """``key, weight, c, next, backoff``: all that is known of a sequence: its count, that as a word, and log10 of its last word's probability and of its suffix's weight as a context."""
        none, words = F.lit(None).cast("float"), F.lit(0).cast("long")
        parts = [self.counts.select("key", F.col("c").alias("weight"), "c", none.alias("next"), none.alias("backoff"))]
        for grams, retained in self.levels:
            parts.append(grams.join(checked(retained), "ctx", "left_semi").select("key", F.col("c").alias("weight"), words.alias("c"), F.log10("p").cast("float").alias("next"), none.alias("backoff")))
            parts.append(retained.select(F.col("ctx").alias("key"), F.col("n").alias("weight"), words.alias("c"), none.alias("next"), F.log10("backoff").cast("float").alias("backoff")))
        return reduce(DataFrame.unionAll, parts).groupBy("key").agg(*(F.max(c).alias(c) for c in ("weight", "c", "next", "backoff")))


def fit(chunked: DataFrame, depth: int = DEPTH) -> Tree:
    """The tree from the training texts of ``coded``."""
    sc = chunked.sparkSession.sparkContext
    counts = keep(word_counts(chunked), "word_counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    found = []
    # What a context or a suffix can be: sequences one word shorter, their counts and probabilities.
    shorter = counts.select("key", "c", ((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("p"))
    for length in range(1, depth + 1):
        candidates = shorter.filter(F.col("c") >= LEAST_CONTEXT).select(F.col("key").alias("ctx"), F.col("c").alias("n"))
        # An n-gram occurs no more often than what it ends in.
        suffixes = shorter.filter(F.col("c") >= LEAST_NEXT).select(F.col("key").alias("suf"), F.col("p").alias("below"))
        bits = [bitmap(x.toDF("key", "_")) for x in (candidates, suffixes)]
        if not bits[0].any():
            break
        shared = sc.broadcast(bits)
        counted = in_rounds(lambda turn: gram_counts(chunked, shared, length, turn).filter(F.col("c") >= LEAST_NEXT), f"counted_{length}")  # noqa: B023
        shared.destroy()
        # By context last: the sums of a context below meet its rows in one task.
        pairs = keep(reduce(DataFrame.unionAll, counted).join(checked(suffixes), "suf").join(checked(candidates), "ctx").withColumn("share", (F.col("c") - DISCOUNT) / F.col("n")), f"pairs_{length}")
        weights = keep(pairs.groupBy("ctx").agg(F.greatest(1 - F.sum("share"), F.lit(1e-9)).alias("backoff"), F.max("n").alias("n")), f"weights_{length}")
        p = F.col("share") + F.col("backoff") * F.col("below")
        discard(*counted)
        grams = keep(pairs.join(checked(weights.drop("n")), "ctx").select("key", "ctx", "suf", "c", "below", p.alias("p")), f"grams_{length}")
        gain = grams.groupBy("ctx").agg(F.sum(F.col("c") * F.log(F.col("p") / F.col("below"))).alias("gain"), F.sum("c").alias("seen"), F.sum("below").alias("below"))
        rest, other = F.greatest(1 - F.col("seen") / F.col("n"), F.lit(0.0)), F.greatest(1 - F.col("below"), F.lit(1e-9))
        divergence = F.col("gain") + F.col("n") * rest * F.log(F.greatest(rest, F.lit(1e-9)) / other)
        contexts = keep(weights.join(gain, "ctx").select("ctx", "n", "backoff", (divergence >= LEAST_DIVERGENCE).alias("own")), f"contexts_{length}")
        found.append((grams, contexts))
        shorter = grams.select("key", "c", "p")
        discard(pairs, weights)
    # A suffix of a retained context is retained.
    levels: list[Level] = []
    for length, (grams, contexts) in reversed(list(enumerate(found, 1))):
        retained = contexts.filter("own").select("ctx", "n", "backoff")
        if levels:
            needed = grams.join(levels[0].retained.select(F.col("ctx").alias("key")), "key", "left_semi").select(F.col("suf").alias("ctx")).distinct()
            retained = contexts.join(needed.withColumn("needed", F.lit(True)), "ctx", "left").filter(F.col("own") | F.col("needed")).select("ctx", "n", "backoff")
        levels.insert(0, Level(grams, keep(retained, f"retained_{length}")))
    return Tree(n, v, counts, levels)


class Known(NamedTuple):
    """Keys with their counts as words and values; either sorted, or each key in the slot of its lowest bits."""

    keys: np.ndarray
    c: np.ndarray
    next: np.ndarray
    backoff: np.ndarray

    def find(self, keys: np.ndarray, slots: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and where these are."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        at = (keys & np.uint64(len(self.keys) - 1)).astype(np.int64) if slots else np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return found, at[found]


def common(entries: DataFrame) -> Known:
    """The commonest of the ``entries`` that fall in each slot."""
    size = 1 << _bits(entries, 0, 4, HEAD_BITS)
    slot = F.col("key").bitwiseAND(F.lit(size - 1))
    rows = entries.groupBy(slot.alias("slot")).agg(F.max(F.struct("weight", "key", "c", "next", "backoff")).alias("e")).select("slot", "e.key", "e.c", "e.next", "e.backoff").toArrow()
    at = rows.column("slot").to_numpy()
    # An empty slot has a key of another slot.
    out = Known(~np.arange(size, dtype=np.uint64), np.zeros(size, np.int64), *(np.full(size, np.nan, np.float32) for _ in "nb"))
    out.keys[at] = rows.column("key").to_numpy().view(np.uint64)
    for name in ("c", "next", "backoff"):
        getattr(out, name)[at] = rows.column(name).to_numpy()
    return out


def asked(chunked: DataFrame, shared: Broadcast, depth: int) -> DataFrame:
    """``chunk, key``: each sequence of a chunk that may be among the entries and is none of the common ones, once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, head = shared.value
        for b in batches:
            for i in range(b.num_rows):
                x, keys = _chunk(b, i), []
                places = x.places()
                for back, key in enumerate((x.words, *x.sequences(depth + 1)[1:])):
                    key = key[places >= back] if back else key
                    key = key[possible(bits, key)]
                    keys.append(np.unique(key[~head.find(key, True)[0]]))
                keys = np.concatenate(keys)
                yield from _pieces(_longs(np.full(len(keys), b.column("chunk")[i].as_py()), keys, names="chunk key"))
        give_back()

    return chunked.select("chunk", "train", "sizes", "words", "codes").mapInArrow(ask, "chunk long, key long")


def score(chunked: DataFrame, tree: Tree) -> DataFrame:
    """``id, n_tokens, n_known, base, score`` of every text of ``coded``."""
    entries = keep(tree.entries(), "entries")
    depth, total = len(tree.levels), tree.tokens + tree.vocabulary + 1.0
    for grams, retained in tree.levels:
        discard(grams, retained)
    discard(tree.counts)
    shared = chunked.sparkSession.sparkContext.broadcast((bitmap(entries), common(entries)))
    kind = chunked.schema["ids"].dataType.elementType.simpleString()

    def scored(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        trim()  # of the chunk before
        bits, head = shared.value
        keys = answer.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        tail = Known(keys[order], *(answer.column(name).to_numpy()[order] for name in ("c", "next", "backoff")))

        def look_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Count as a word, next and backoff of each key."""
            out = np.zeros(len(keys), np.int64), np.full(len(keys), np.nan), np.full(len(keys), np.nan)
            open_ = np.flatnonzero(possible(bits, keys))
            for known, slots in ((head, True), (tail, False)):
                found, at = known.find(keys[open_], slots)
                for values, source in zip(out, known[1:], strict=True):
                    values[open_[found]] = source[at]
                open_ = open_[~found]
            return out

        x = _chunk(chunk, 0)
        c, _, backoff = look_up(x.words)
        sequences, places = x.sequences(depth + 1), x.places()
        following, weights = [], [backoff[x.codes]]
        for back in range(1, depth + 1):
            inside = np.flatnonzero(places >= back)
            columns = np.full((2, len(x.codes)), np.nan)
            columns[:, inside] = look_up(sequences[back][inside])[1:]
            following.append(columns[0])
            weights.append(columns[1])
        base = np.log10((c + 1.0) / total)[x.codes]
        whole, open_ = np.zeros(len(x.codes)), np.ones(len(x.codes), bool)
        for back in range(depth, 0, -1):
            at = np.flatnonzero(open_ & (places >= back))
            weight = weights[back - 1][at - 1]
            at, weight = at[~np.isnan(weight)], weight[~np.isnan(weight)]
            p = following[back - 1][at]
            whole[at] += np.where(np.isnan(p), weight, p)
            open_[at[~np.isnan(p)]] = False
        whole[open_] += base[open_]
        starts = np.cumsum(x.sizes) - x.sizes
        ids = chunk.column("ids").combine_chunks().flatten()
        sums = [pa.array(np.add.reduceat(a, starts)) for a in ((c > 0).astype(np.int64)[x.codes], base, whole)]
        return pa.Table.from_arrays([ids, pa.array(x.sizes), *sums], ["id", "n_tokens", "n_known", "base", "score"])

    def answered(turn: int) -> DataFrame:
        own = chunked.filter(F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == turn)
        answers = asked(own, shared, depth).join(entries.drop("weight"), "key")
        return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, f"id {kind}, n_tokens long, n_known long, base double, score double")

    release(chunked.sparkSession)
    parts = in_rounds(answered, "scores")
    shared.destroy()
    discard(entries)
    return reduce(DataFrame.unionAll, parts)


def with_scores(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, n_known, train_tokens, base_score, score."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunked = keep(coded(rows), "coded")
    tree = fit(chunked)
    return score(chunked, tree).select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold("doc_id", 7, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = with_scores(docs, ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
