"""Readers of books, page items, spines and tables of contents; content keys; format dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import reading as R

ITEMS = "doc_id string, page_number int, item_no int, str string, x double, y double"
PAGES = "doc_id string, page_number int, text string, ocr_used boolean, from_cache boolean"
SPINE = "doc_id string, spine_index int, href string, html string"
TOC = "doc_id string, path array<int>, label string, href string"


def read_books(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``doc_id, file_name, title, format, text``: every file whole; several paths and globs are read together."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    name = F.col("file_name")
    return files.select(F.concat_ws("::", name, F.sha2("value", 256)).alias("doc_id"), name, R.strip_extension(name).alias("title"), R.book_format(name).alias("format"), F.col("value").alias("text"))


def route_formats(df: DataFrame, name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Rows whose format is read, with ``format``; and the rest, with ``error``."""
    routed = df.withColumn("format", R.book_format(F.col(name)))
    return routed.filter("format IS NOT NULL"), routed.filter("format IS NULL").drop("format").withColumn("error", F.concat(F.lit("unsupported: "), F.coalesce(R.get_extension(F.col(name)), F.lit(""))))


def read_text_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEMS).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def read_spine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPINE).parquet(path)


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOC).parquet(path)


def file_key(content: Column) -> Column:
    """The first 16 bytes of the content's SHA-256, in hex."""
    return F.substring(F.sha2(content, 256), 1, 32)


def fallback_file_key(name: Column, size: Column, modified: Column) -> Column:
    """The key of a file that cannot be read: by name, size and time."""
    seed = F.concat_ws("::", name, size.cast("string"), F.coalesce(modified, F.lit(0)).cast("string"))
    return F.concat(F.lit("meta-"), R.djb2_base36(seed), F.lit("-"), size.cast("string"))
