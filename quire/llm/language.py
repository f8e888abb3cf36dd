"""Language identification by words first, shorter and shorter character n-grams after.

Words that the training rows know score by their log frequency in each language. An unknown word
scores by its longest n-grams that are known: order 5 first, then 4, down to 1. A text's language is
the one with the largest sum over its words.

The model is fitted on a bounded sample: of each language the ``rows_per_language`` training rows with
the smallest hashed keys and texts, fewer where there are more languages than ``all_rows`` has room for,
but ``LEAST_ROWS`` of each. All words and n-grams of the sample are in the model, which holds one
number for each entry and language that occur together.

Defined results: ``und`` with score 0 for null texts, texts without letters, and where no training
row exists; equal sums go to the language that sorts first; repeated rows each get their own result
and count once in the sample.
"""

from __future__ import annotations

import uuid
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.decontaminate import checked
from quire.llm.store import bound_batches, discard, keep, table
from quire.llm.text import chunks, hold

ROWS_PER_LANGUAGE, ALL_ROWS, LEAST_ROWS = 1000, 20_000, 20
LONGEST_GRAM = 5
#: Tokens kept by a worker; a longer token than this is not kept.
CACHE_ENTRIES, CACHE_CHARS = 120_000, 200
#: Seed of Spark's ``xxhash64``.
SEED = 42

_WORDS = regex.compile(r"\p{L}+").findall


class Model(NamedTuple):
    """Log frequencies over those of an entry that a language lacks, by entry; entries are known by the hash of their order and text."""

    langs: list[str]
    floors: np.ndarray  # orders (0 for words) x languages: the log frequency of what a language lacks
    keys: np.ndarray  # sorted
    start: np.ndarray  # of each key, and the end of the last
    lang: np.ndarray
    gain: np.ndarray


def sample_rows(docs: DataFrame, train: Column, text: str, lang: str, key: str, rows: int, all_rows: int) -> DataFrame:
    """``l, t``: the sample. Most rows are left out by their hash alone, before any are ranked."""
    usable = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("t"))
    place = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = keep(usable.groupBy("l").agg(F.approx_count_distinct("h").alias("n"), F.min(place).alias("least")), "language_counts")
    most = min(rows, max(LEAST_ROWS, all_rows // max(1, counts.count())))
    low = usable.join(checked(counts), "l").filter((place < 2.0 * most / F.col("n")) | (place == F.col("least"))).select("l", "h").distinct()
    chosen = keep(low.withColumn("rank", F.row_number().over(W.partitionBy("l").orderBy("h"))).filter(F.col("rank") <= most).select("l", "h"), "chosen")
    return usable.join(checked(chosen), ["l", "h"], "left_semi").dropDuplicates(["l", "h"]).select("l", "t")


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS_PER_LANGUAGE, all_rows: int = ALL_ROWS) -> Model:
    """The model of a bounded sample of the training rows."""
    sample = sample_rows(docs, train, text, lang, key, rows, all_rows)
    words = keep(sample.select("l", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy("l", "w").agg(F.count("*").alias("c")), "language_words")
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))

    def spans(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.concat(F.lit(str(n)), F.substring(padded, i, F.lit(n))))
        return F.when(F.length(padded) >= n, found).otherwise(F.array().cast("array<string>"))

    grams = words.select("l", F.explode(F.concat(*map(spans, range(1, LONGEST_GRAM + 1)))).alias("name"), "c").groupBy("l", "name").agg(F.sum("c").alias("c"))
    named = words.select("l", F.concat(F.lit("0"), F.col("w")).alias("name"), "c").unionByName(grams)
    entries = keep(named.select("l", F.substring("name", 1, 1).cast("int").alias("order"), F.xxhash64("name").alias("key"), "c"), "language_entries")
    totals = entries.groupBy("l", "order").agg(F.sum("c").alias("total")).collect()
    langs = sorted({r.l for r in totals})
    at = {x: i for i, x in enumerate(langs)}
    total = np.full((LONGEST_GRAM + 1, len(langs)), np.nan)
    for r in totals:
        total[r.order, at[r.l]] = r.total
    floors = np.log10(0.5 / (total + 1))
    if langs:
        floors = np.where(np.isnan(floors), np.nanmin(floors, axis=1, keepdims=True, initial=0.0), floors)
    found = entries.toArrow()
    discard(words, entries)
    number = found.column("l").combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    l = np.array([at[x] for x in number.dictionary.to_pylist()], np.int32)[number.indices.to_numpy()]
    order, key_, c = (found.column(name).to_numpy() for name in ("order", "key", "c"))
    value = np.log10(c / (total[order, l] + 1)) - floors[order, l]
    place = np.lexsort((l, key_.view(np.uint64)))
    keys, first = np.unique(key_.view(np.uint64)[place], return_index=True)
    return Model(langs, floors, keys, np.append(first, len(place)), l[place], value[place].astype(np.float32))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Scorer:
    """Sums of each language per text; one per Python worker and model.

    Every distinct token of a chunk of texts is looked up once. Kept of it are its gains by language and how
    many of its words were found at each order; the last column counts all words.
    """

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.orders = np.zeros((0, LONGEST_GRAM + 2), np.int32)
        self.lang, self.gain = np.zeros(0, np.int32), np.zeros(0, np.float32)

    def _find(self, names: list[str]) -> np.ndarray:
        """Place of each name's entry, or -1."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(n, SEED) for n in names), np.uint64, len(names))
        at = np.minimum(np.searchsorted(self.model.keys, hashes), len(self.model.keys) - 1)
        return np.where(self.model.keys[at] == hashes, at, -1)

    def learn(self, tokens: list[str]) -> None:
        """Keep new tokens."""
        split = [_WORDS(t.lower()) for t in tokens]
        words = list(chain.from_iterable(split))
        owner = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, split), np.int64, len(split)))
        orders = np.zeros((len(tokens), LONGEST_GRAM + 2), np.int32)
        np.add.at(orders[:, -1], owner, 1)
        found = self._find([f"0{w}" for w in words]) if words else np.zeros(0, np.int64)
        entries, owners, weights = [found[found >= 0]], [owner[found >= 0]], [np.ones(int((found >= 0).sum()))]
        np.add.at(orders[:, 0], owners[0], 1)
        left = np.flatnonzero(found < 0)
        for n in range(LONGEST_GRAM, 0, -1):
            grams, of = [], []
            for i in left.tolist():
                padded = f" {words[i]} "
                grams += [f"{n}{padded[k : k + n]}" for k in range(len(padded) - n + 1)]
                of += [i] * max(0, len(padded) - n + 1)
            if not grams:
                continue
            found, of = self._find(grams), np.array(of)
            of, found = of[found >= 0], found[found >= 0]
            many = np.bincount(of, minlength=len(words))
            entries.append(found)
            owners.append(owner[of])
            weights.append(1.0 / many[of])
            np.add.at(orders[:, n], owner[np.flatnonzero(many)], 1)
            left = left[many[left] == 0]
        entry, own, weight = map(np.concatenate, (entries, owners, weights))
        by_token = np.argsort(own, kind="stable")
        entry, own, weight = entry[by_token], own[by_token], weight[by_token]
        size = self.model.start[entry + 1] - self.model.start[entry]
        places = _ranges(self.model.start[entry], size)
        self.size = np.concatenate((self.size, np.bincount(own, weights=size, minlength=len(tokens)).astype(np.int64)))
        self.start = np.cumsum(self.size) - self.size
        self.lang = np.concatenate((self.lang, self.model.lang[places]))
        self.gain = np.concatenate((self.gain, self.model.gain[places] * np.repeat(weight, size).astype(np.float32)))
        self.orders = np.concatenate((self.orders, orders))
        self.at.update(zip(tokens, range(len(self.at), len(self.at) + len(tokens)), strict=True))

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the sum of each language, and the number of words."""
        split = [t.split() for t in texts]
        new = list(set().union(*split).difference(self.at))
        self.learn(new)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        places = _ranges(self.start[ids], self.size[ids])
        cell = np.repeat(text, self.size[ids]) * len(self.model.langs) + self.lang[places]
        gains = np.bincount(cell, weights=self.gain[places], minlength=len(texts) * len(self.model.langs)).reshape(len(texts), -1)
        orders = np.zeros((len(texts), LONGEST_GRAM + 2))
        filled = np.flatnonzero(sizes)
        if len(filled):
            orders[filled] = np.add.reduceat(self.orders[ids], (np.cumsum(sizes) - sizes)[filled], axis=0)
        if len(self.at) > CACHE_ENTRIES or any(len(t) > CACHE_CHARS for t in new):
            self.clear()
        return gains + orders[:, :-1] @ self.model.floors, orders[:, -1]

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [("und", 0.0)] * len(texts)
        total, words = self.sums(texts)
        words = words[:, None]
        mean = total / np.maximum(words, 1) * np.minimum(words, 10) * np.log(10)  # as sure as ten words at most
        best = mean.argmax(axis=1)
        share = 1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1)
        return [(self.model.langs[i], float(p)) if n else ("und", 0.0) for i, p, n in zip(best, share, words[:, 0], strict=True)]


_scorers: dict[str, Scorer] = {}


def scorer(name: str, model: Broadcast) -> Scorer:
    hold("language", _scorers.clear)
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model.value)
    return _scorers[name]


def identify(text: Column, model: Broadcast) -> Column:
    """``struct<lang,score>`` of each text."""
    name = uuid.uuid4().hex

    @F.arrow_udf("lang string, score double")
    def judged(batch: pa.Array) -> pa.Array:
        s = scorer(name, model)
        both = [x for run in chunks(batch) for x in s.judge(run)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in both], pa.string()), pa.array([x[1] for x in both], pa.float64())], ["lang", "score"])

    return judged(text)


def in_fold(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves ``part``; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def with_language(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """``docs`` with a struct column ``language``: fit on the training rows, judge all."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, train, text, lang, key))
    return docs.withColumn("language", identify(F.col(text), model))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold("doc_id", 4, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = with_language(docs, ~held_out)
    return judged.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
