"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again.

A document is kept unless a stage says why it goes: quality below a half, no language that stands
out, another document of its near-duplicate group that stays, words of a benchmark. The last stage
encodes what is left.

Every stage takes whole texts of all rows that its predecessor kept. Null and empty texts pass the
quality stage by their score and go in the language stage. For the near-duplicate stage rows that share ``doc_id`` and
text are one document; an id with several texts is a document for each of them, which goes by a hash and not by the id
when its group chooses the smallest; rows without ``doc_id`` are never duplicates. Extra columns of any name and type
pass through up to the last stage: a stage works on the columns it needs and a struct of the whole row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, language, neardup, quality
from quire.llm.store import keep, table

#: Scores below this are as good as no language at all.
LEAST_LANGUAGE_SCORE = 0.4


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs``, and each row as a struct ``whole``."""
    return docs.select(*columns, F.struct("*").alias("whole"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    labels = table(spark, sf_dir, "labels")
    judged = quality.with_quality(_rows(docs, "doc_id", "text"), labels, F.lit(True))
    return judged.filter("quality_score >= 0.5").select("whole.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that stands out."""
    judged = language.with_language(_rows(docs, "doc_id", "text", "lang"), F.lit(True))
    return judged.filter((F.col("language.lang") != "und") & (F.col("language.score") >= LEAST_LANGUAGE_SCORE)).select("whole.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group: five-word shingles, similarity 0.8.

    Of several rows of one id and text the one with the smallest hash of all its columns stays.
    """
    text = F.xxhash64("text")
    several = keep(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min(text) != F.max(text)).alias("several")).filter("several"), "several")
    named = _rows(docs.filter("doc_id IS NOT NULL"), "doc_id", "text").join(decontaminate.checked(several), "doc_id", "left")
    rows = named.select(F.when(F.col("several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("node"), "text", "whole")
    kept = keep(neardup.with_components(rows.select("node", "text"), key="node").filter("kept").groupBy("node").count(), "kept")
    stay = rows.join(decontaminate.checked(kept.select("node")), "node", "left_semi")
    repeated = decontaminate.checked(keep(kept.filter("count > 1").select("node"), "repeated"))
    again = stay.join(repeated, "node", "left_semi").select("node", "whole", F.xxhash64(F.to_json("whole")).alias("hash"))
    first = decontaminate.checked(keep(again.groupBy("node").agg(F.min("hash").alias("hash")), "first"))
    one = again.join(first, ["node", "hash"], "left_semi").dropDuplicates(["node", "hash"])
    return stay.join(repeated, "node", "left_anti").select("whole.*").unionByName(one.select("whole.*")).unionByName(docs.filter("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    index = decontaminate.build(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = keep(decontaminate.phrase_matches(index).select("doc", "digest").distinct(), "contaminated")
    keyed = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("text").alias("digest"), F.struct("*").alias("whole"))
    return keyed.join(decontaminate.checked(hit), ["doc", "digest"], "left_anti").select("whole.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of every text that is left."""
    return bpe.digests(docs, *bpe.vocabulary())


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]
#: The first two stages are fitted models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
