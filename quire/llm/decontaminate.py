"""Benchmark decontamination with a distributed positional inverted index.

Every document word that the benchmark knows is stored as a posting (document, term, position), and
each document ends with one posting of the term ``END`` at its number of words, so the index alone
gives every document's length. The segments are written by the tasks that read the documents, sorted
by term. A search starts from the rarest term of each window of an item, intersects the
offset-adjusted postings of its second rarest, and then those of the whole item; runs of hits that
are long enough are exact phrase matches. ``proximity_matches`` allows every word to stand up to
``slop`` words off its place.

Only DataFrame functions are used. No list of a term's or a document's postings is ever gathered: hot
terms are scanned in place, and what joins them is broadcast behind a count or else shuffled.

Defined results: null and empty texts have no words; an item of fewer words than a window, but not
none, is one window; items that share an id are one item, items without an id share the empty one;
rows that share a ``doc_id`` are told apart by their texts, equal rows get equal results each.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.store import keep, table

WINDOW = 10
#: The term behind a document's last word.
END = ""
#: Rows up to which a side is broadcast; it is shuffled beyond.
BROADCAST_ROWS = 300_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lowered

DOC = ["doc", "digest"]


def words(text: Column) -> Column:
    """Words of a text as they are written; lower each with ``lowered``."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z to a-z. Most words are lower-case already, which is cheaper to see than to translate."""
    return F.when(word == F.lower(word), word).otherwise(F.translate(word, _UPPER, _LOWER))


def checked(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows, ``BROADCAST_ROWS`` unless given."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Index(NamedTuple):
    #: doc_id, doc, digest, term, pos
    postings: DataFrame
    #: item, id, n, o, term: the words of the items
    items: DataFrame
    #: Number that stands for END.
    end: int


def build(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> Index:
    """Write the postings of ``docs`` for the vocabulary of ``benchmark``."""
    spark = docs.sparkSession
    source = benchmark.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("id"), words(F.col(item_text)).alias("w"))
    source = keep(source.filter(F.size("w") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    exploded = source.select("item", "id", F.size("w").alias("n"), F.posexplode("w").alias("o", "w")).withColumn("w", lowered(F.col("w")))
    vocabulary = keep(exploded.select("w").distinct().withColumn("term", F.monotonically_increasing_id()).unionByName(spark.createDataFrame([(END, -1)], "w string, term long")), "vocabulary")
    items = keep(exploded.join(vocabulary, "w").select("item", "id", "n", "o", "term"), "item_terms")
    placed = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), F.posexplode(F.concat(words(F.col(text)), F.array(F.lit(END)))).alias("pos", "w"))
    postings = placed.withColumn("w", lowered(F.col("w"))).join(checked(vocabulary), "w").select("doc_id", "digest", "term", "pos")
    stored = keep(postings.sortWithinPartitions("term", "doc_id", "digest", "pos"), "postings")
    return Index(stored.withColumn("doc", F.coalesce("doc_id", F.lit(0).cast(dict(stored.dtypes)["doc_id"]))), items, -1)


def anchors(index: Index, window: int = WINDOW) -> DataFrame:
    """For each window that can occur, the places in its item of its rarest and second rarest term: item, n, o1, term1, o2, term2."""
    counts = index.postings.groupBy("term").agg(F.count("*").alias("c"))
    counted = index.items.join(counts, "term", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    lists = counted.groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("o", "term", "c"))).alias("w"))
    windows = lists.select("item", "n", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))).alias("s"))
    ranked = windows.select("item", "n", F.array_sort(F.transform(F.slice("w", F.col("s") + 1, window), lambda x: F.struct(x.c.alias("c"), x.o.alias("o"), x.term.alias("term")))).alias("r")).filter(F.col("r")[0].c > 0)
    return ranked.select("item", "n", F.col("r")[0].o.alias("o1"), F.col("r")[0].term.alias("term1"), F.get("r", F.lit(1)).o.alias("o2"), F.get("r", F.lit(1)).term.alias("term2")).distinct()


def candidates(index: Index, rarest: DataFrame) -> DataFrame:
    """Alignments of items with documents at the rarest terms: item word 0 would stand at ``at``."""
    terms = checked(rarest.select(F.col("term1").alias("term")).distinct())  # far fewer, so postings of other terms are left where they are
    return index.postings.join(terms, "term", "left_semi").join(checked(rarest), F.col("term") == F.col("term1")).select(*DOC, "item", "n", (F.col("pos") - F.col("o1")).alias("at"), "o2", "term2")


def phrase_matches(index: Index, window: int = WINDOW) -> DataFrame:
    """Runs of consecutive item words in documents, at least a window long: doc, digest, item, id, start, stop."""
    rarest = keep(anchors(index, window), "anchors")
    found = candidates(index, rarest)
    second = index.postings.join(checked(rarest.filter("term2 IS NOT NULL").select(F.col("term2").alias("term")).distinct()), "term", "left_semi").select(*DOC, F.col("term").alias("term2"), F.col("pos").alias("p2"))
    both = found.filter("term2 IS NOT NULL").withColumn("p2", F.col("at") + F.col("o2")).join(second, [*DOC, "term2", "p2"])
    single = found.filter("term2 IS NULL")
    aligned = keep(both.select(*DOC, "item", "at").unionByName(single.select(*DOC, "item", "at")).distinct(), "alignments")
    probes = aligned.join(checked(index.items), "item").select(*DOC, "item", "id", "n", "at", "o", "term", (F.col("at") + F.col("o")).alias("pos"))
    near = index.postings.join(checked(aligned.select(*DOC).distinct()), DOC, "left_semi").select(*DOC, "term", "pos")
    hits = probes.join(near, [*DOC, "term", "pos"]).select(*DOC, "item", "id", "n", "at", "o").distinct()
    line = W.partitionBy(*DOC, "item", "at").orderBy("o")
    runs = hits.withColumn("run", F.col("o") - F.row_number().over(line)).groupBy(*DOC, "item", "id", "n", "at", "run").agg(F.min("o").alias("a"), F.max("o").alias("b"))
    return runs.filter(F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n"))).select(*DOC, "item", "id", (F.col("at") + F.col("a")).alias("start"), (F.col("at") + F.col("b") + 1).alias("stop"))


def proximity_matches(index: Index, slop: int, window: int = WINDOW) -> DataFrame:
    """Windows whose words all stand within ``slop`` of their place, seen from their rarest word: doc, digest, item, id, first (word of the item), at."""
    counts = index.postings.groupBy("term").agg(F.count("*").alias("c"))
    lists = index.items.join(counts, "term", "left").groupBy("item", "id", "n").agg(F.array_sort(F.collect_list(F.struct("o", "term", F.coalesce("c", F.lit(0)).alias("c")))).alias("w"))
    windows = lists.select("item", "id", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))).alias("first"), "w").withColumn("w", F.slice("w", F.col("first") + 1, window))
    rare = F.array_min(F.transform("w", lambda x: F.struct(x.c.alias("c"), x.o.alias("o"), x.term.alias("term"))))
    windows = keep(windows.withColumn("rare", rare).filter(F.col("rare").c > 0), "windows")
    starts = index.postings.join(checked(windows), F.col("term") == F.col("rare.term")).select(*DOC, "item", "id", "first", (F.col("pos") - F.col("rare.o")).alias("at"), "w")
    probes = starts.select(*DOC, "item", "id", "first", "at", F.size("w").alias("need"), F.explode("w").alias("x")).select("*", "x.o", "x.term")
    off = F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("off")  # places are looked up one by one, not all of a word's in a document
    hits = probes.select("*", off).withColumn("pos", F.col("at") + F.col("o") + F.col("off")).join(index.postings.select(*DOC, "term", "pos"), [*DOC, "term", "pos"])
    return hits.groupBy(*DOC, "item", "id", "first", "at", "need").agg(F.count_distinct("o").alias("got")).filter("got = need").select(*DOC, "item", "id", "first", "at")


def judge(index: Index, window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, digest, n_words, n_hit, ids (sorted), contaminated."""
    matches = phrase_matches(index, window)
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "stop"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s.n + F.greatest(x.stop - F.greatest(x.start, s.to), F.lit(0))).alias("n"), F.greatest(s.to, x.stop).alias("to")),
    )
    hit = matches.groupBy(*DOC).agg(merged.n.alias("n_hit"), F.array_sort(F.collect_set("id")).alias("ids"))
    ends = index.postings.filter(F.col("term") == index.end).select("doc_id", *DOC, F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return ends.join(hit, DOC, "left").select("doc_id", "digest", "n_words", n_hit.alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), (n_hit > 0).alias("contaminated"))


def digests(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(judge(build(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS.format("text")} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, {_SQL_WORDS.format("text")} AS w FROM benchmark),
v AS (SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS t FROM i, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(s) WHERE len(w) > 0),
p AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS t FROM d, unnest(generate_series(1, len(w))) AS g(s), (SELECT DISTINCT n FROM v) WHERE s + n - 1 <= len(w)),
m AS (SELECT DISTINCT r, s, v.n, id FROM p JOIN v ON p.t = v.t AND p.n = v.n),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM m, unnest(generate_series(s, s + n - 1)) AS g(x) GROUP BY r),
j AS (SELECT r, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN j USING (r)
"""
