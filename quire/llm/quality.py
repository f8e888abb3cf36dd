"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of its words, of the 1- to 3-grams of its tokens' shapes, and of the
step that its share of distinct word pairs falls in, hashed to ``BINS``. Each is scaled by the log ratio of its counts in the two classes; a linear hinge-loss
model is then fitted by dual coordinate descent.

The model is fitted on a bounded sample: of the training labels whose documents exist, the
``SAMPLE_ROWS`` with the smallest hashed keys, as far as they have ``SAMPLE_BINS`` features in all.

Defined results: null and empty texts have no features and score by the bias alone; without labels
of both classes every score is 0.5; labels for unknown documents, null labels and labels other than
0 and 1 are ignored and take no room in the sample; a document labelled twice counts twice; repeated
rows each get their own score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.language import in_fold
from quire.llm.store import bound_batches, keep, table
from quire.llm.text import chunks, hold

SAMPLE_ROWS, SAMPLE_BINS, BINS, COST, EPOCHS, ALPHA = 8000, 20_000_000, 1 << 18, 1.0, 30, 1.0
#: Tokens kept by a worker; a longer token than this is not kept.
CACHE_ENTRIES, CACHE_CHARS = 120_000, 200

#: Runs of a kind of character, and the sign that stands for them in a shape.
_RUNS = [(regex.compile(p), r) for p, r in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}]+", "a"), (r"\p{N}+", "0"), (r"([^Aa0])\1+", r"\1\1"))]
_STRIP = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def _hash(kind: bytes, s: str) -> int:
    return xxhash.xxh64_intdigest(kind + s.encode()) & 0x7FFFFFFFFFFFFFFF


class Features:
    """Word hash and shape hash of each distinct token, kept by a worker up to a bound."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.pairs = np.zeros((0, 2), np.uint64)

    def learn(self, tokens: list[str]) -> None:
        rows = []
        for t in tokens:
            shape = t
            for run, sign in _RUNS:
                shape = run.sub(sign, shape)
            rows.append((_hash(b"w", _STRIP.sub("", t).lower()), _hash(b"s", shape)))
        first = len(self.at)
        self.at.update(zip(tokens, range(first, first + len(tokens)), strict=True))
        if first + len(rows) > len(self.pairs):
            grown = np.zeros((2 * (first + len(rows)), 2), np.uint64)
            grown[:first] = self.pairs[:first]
            self.pairs = grown
        if rows:
            self.pairs[first : first + len(rows)] = np.array(rows, np.uint64)

    def bins(self, texts: list[str]) -> list[np.ndarray]:
        """Distinct features of each text, ascending."""
        hold("quality", self.clear)
        split = [t.split() for t in texts]
        new = list(set().union(*split).difference(self.at))
        self.learn(new)
        out = []
        for tokens in split:
            both = self.pairs[np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))]
            out.append(_bins(both[:, 0], both[:, 1]))
        if len(self.at) > CACHE_ENTRIES or any(len(t) > CACHE_CHARS for t in new):
            self.at = {}
        return out


def _bins(word: np.ndarray, shape: np.ndarray) -> np.ndarray:
    mixed = [word, shape]
    if len(shape) > 1:
        two = shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:]
        mixed.append(two ^ (two >> np.uint64(29)))
    if len(shape) > 2:
        three = (shape[:-2] * np.uint64(0x9E3779B97F4A7C15) + shape[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + shape[2:]
        mixed.append(three ^ (three >> np.uint64(31)))
    if len(word) >= 8:  # how many of its word pairs are new, in five steps
        pairs = np.sort(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])
        step = 5 * (1 + np.count_nonzero(pairs[1:] != pairs[:-1])) // (len(pairs) + 1) + 1
        mixed.append(np.array([step], np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    h = np.concatenate(mixed)
    return np.unique((h ^ (h >> np.uint64(32))) & np.uint64(BINS - 1)).astype(np.int64)


_features = Features()


def features(text: Column) -> Column:
    """Distinct hashed features of each text: ``array<int>``."""

    @F.arrow_udf("array<int>")
    def binned(batch: pa.Array) -> pa.Array:
        return pa.array([b.astype(np.int32) for run in chunks(batch) for b in _features.bins(run)], pa.list_(pa.int32()))

    return binned(text)


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, size: int, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for the L1-loss linear SVM; the last weight is the bias."""
    w, dual = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + w[-1]) - 1.0
            new = min(max(dual[i] - gradient / square[i], 0.0), cost[i])
            if step := (new - dual[i]) * sign[i]:
                w[rows[i]] += step * values[i]
                w[-1] += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def fit(labelled: DataFrame) -> np.ndarray:
    """Weights of the bins and the bias, from a bounded sample: rows of ``bins array<int>, label int``."""
    got = labelled.select("bins", "label").toArrow()
    labels = got.column("label").to_numpy()
    if len(set(labels)) < 2:
        return np.zeros(BINS + 1)
    rows = [x.values.to_numpy().astype(np.int64) for x in got.column("bins")]
    counts = [np.bincount(np.concatenate([r for r, l in zip(rows, labels, strict=True) if l == c] or [np.zeros(0, np.int64)]), minlength=BINS) + ALPHA for c in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-9) for r in rows]
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, (labels == 1).mean(), (labels == 0).mean())
    w = descend(rows, values, sign, COST * 0.5 / share, BINS)
    return np.concatenate([w[:-1], w[-1:], ratio])


def judge(text: Column, model: Broadcast) -> Column:
    """Score of each text from 0 to 1."""

    @F.arrow_udf("double")
    def scored(batch: pa.Array) -> pa.Array:
        m, out = model.value, []
        w, bias, ratio = m[:BINS], m[BINS], m[BINS + 1 :]
        for run in chunks(batch):
            for b in _features.bins(run):
                margin = bias + (w[b] @ ratio[b] / max(np.sqrt((ratio[b] ** 2).sum()), 1e-9) if len(b) and len(ratio) else 0.0)
                out.append(float(1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))))
        return pa.array(out, pa.float64())

    return scored(text)


def sample(docs: DataFrame, labels: DataFrame, train: Column, text: str, key: str, label: str, rows: int, bins: int = SAMPLE_BINS) -> DataFrame:
    """``bins, label`` of the bounded sample. Keys are chosen before any text is read."""
    usable = labels.filter(train & F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("label"))
    known = usable.join(docs.select(F.col(key).alias("k")), "k", "left_semi")
    chosen = keep(known.withColumn("h", F.xxhash64("k")).orderBy("h", "k", "label").limit(rows), "chosen")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    found = keep(texts.select("h", "k", "label", F.xxhash64("t").alias("ht"), features(F.col("t")).alias("bins")), "sampled")
    order = W.partitionBy(F.lit(0)).orderBy("h", "k", "ht", "label")  # of a bounded number of rows
    first = found.orderBy("h", "k", "ht", "label").limit(rows)
    return first.withColumn("all", F.sum(F.size("bins")).over(order.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("all") <= bins).orderBy("h", "k", "ht", "label").select("bins", "label")


def with_quality(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with a column ``quality_score``; ``train`` is a condition on the labels' rows."""
    bound_batches(docs.sparkSession)
    weights = fit(sample(docs, labels, train, text, key, label, sample_rows))
    model = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.withColumn("quality_score", judge(F.col(text), model))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold("doc_id", 3, 1)
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    judged = with_quality(docs, labels, ~held_out)
    return judged.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
