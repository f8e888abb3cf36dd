"""The library: narrow metadata and wide contents in two tables, cache of page results, backups."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BACKUP_FORMAT, BACKUP_VERSION, CACHE_DAYS = "quire-backup", 1, 45


def latest_per_key(df: DataFrame, *key: str, order: list[Column]) -> DataFrame:
    """The newest row of each key; ``order`` must be total for a fixed result."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def first_wins(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    return df.withColumn("__k", key).withColumn("__n", F.row_number().over(W.partitionBy("__k").orderBy(*order))).filter("__n = 1").drop("__n", "__k")


def first_n(df: DataFrame, *key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def upsert_meta(meta: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Metadata after ``incoming`` books came in: ``id, title, section_count, added_at, last_opened_at, progress``.

    The first day stays, the last opening is now, progress falls back to the old one.
    """
    old, new = meta.alias("o"), incoming.alias("n")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    is_new = F.col("n.id").isNotNull()
    return old.join(new, F.col("o.id") == F.col("n.id"), "full_outer").select(
        pick("id").alias("id"),
        pick("title").alias("title"),
        pick("section_count").alias("section_count"),
        F.coalesce("o.added_at", F.when(is_new, now)).alias("added_at"),
        F.when(is_new, now).otherwise(F.col("o.last_opened_at")).alias("last_opened_at"),
        pick("progress").alias("progress"),
    )


def upsert_contents(contents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Contents with the books of ``incoming`` (``id, sections``) replaced or added."""
    return contents.join(incoming.select("id"), "id", "left_anti").unionByName(incoming.select("id", "sections"))


def migrate_inline(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata with a section count, and contents, from the layout that kept sections inside."""
    sections = F.coalesce("sections", F.array())
    return old.withColumn("section_count", F.size(sections)).drop("sections"), old.filter("sections IS NOT NULL").select("id", "sections")


def load_books(meta: DataFrame, contents: DataFrame) -> DataFrame:
    """Metadata with sections; a book without contents has none."""
    kind = dict(contents.dtypes)["sections"]
    return meta.join(contents, "id", "left").withColumn("sections", F.coalesce("sections", F.array().cast(kind)))


def delete_books(meta: DataFrame, contents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return meta.join(ids, "id", "left_anti"), contents.join(ids, "id", "left_anti")


def shelf(meta: DataFrame) -> DataFrame:
    return meta.orderBy(F.desc("last_opened_at"), "id")


def latest_book(meta: DataFrame) -> DataFrame:
    return shelf(meta).limit(1)


def save_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The newest complete row of each (file_key, lang, page_number)."""
    whole = rows.filter("file_key IS NOT NULL AND file_key <> '' AND lang IS NOT NULL AND page_number IS NOT NULL AND text IS NOT NULL")
    return latest_per_key(cache.unionByName(whole), "file_key", "lang", "page_number", order=[F.desc("updated_at"), F.desc("text")])


def lookup_cache(pages: DataFrame, cache: DataFrame, lang: str) -> DataFrame:
    """Pages with ``cache_hit`` and ``cache_text``; an empty cached text is a hit."""
    found = cache.filter(F.col("lang") == lang).select("file_key", "page_number", F.col("text").alias("cache_text"), F.lit(True).alias("hit"))
    return pages.join(found, ["file_key", "page_number"], "left").withColumn("cache_hit", F.coalesce("hit", F.lit(False))).drop("hit")


def pages_to_recognise(pages: DataFrame, cache: DataFrame, lang: str) -> DataFrame:
    """Pages that need recognition and are not cached."""
    return pages.filter("needs_ocr").join(cache.filter(F.col("lang") == lang), ["file_key", "page_number"], "left_anti")


def prune_cache(cache: DataFrame, now: Column, max_age_days: int = CACHE_DAYS) -> DataFrame:
    return cache.filter(F.col("updated_at") > now - F.expr(f"INTERVAL {max_age_days} DAYS"))


class Restored(NamedTuple):
    books: DataFrame
    settings: str | None
    exported_at: str | None
    #: Counts of the books that were taken, and of those without id or sections.
    restored: int
    skipped: int


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Whole backups in ``path``, the oldest first: those whose manifest was written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/manifest/_SUCCESS"))
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and whole(n))


def export_backup(meta: DataFrame, contents: DataFrame, path: str, settings: str | None = None, app_version: str | None = None, exported_at: str | None = None) -> int:
    """Write all books with their sections as a new version below ``path``, one line of JSON each; how many there are.

    The books are counted as they are written. The manifest (format, version, time, settings, books) follows
    them, and only a version that has one is read, so readers never see half of a backup.
    """
    spark, counted = meta.sparkSession, Observation()
    target = f"{path}/v{max(_versions(spark, path), default=0) + 1}"
    load_books(meta, contents).observe(counted, F.count("*").alias("books")).write.mode("overwrite").json(f"{target}/books")
    books = counted.get["books"]
    at = F.coalesce(F.lit(exported_at), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    row = spark.range(1).select(F.lit(BACKUP_FORMAT).alias("format"), F.lit(BACKUP_VERSION).alias("version"), F.lit(app_version).alias("appVersion"), at.alias("exportedAt"), F.lit(settings).alias("settings"), F.lit(books).alias("books"))
    row.coalesce(1).write.mode("overwrite").json(f"{target}/manifest")
    return books


def restore_backup(spark: SparkSession, path: str, schema: str, save: Callable[[DataFrame], DataFrame], version: int | None = None) -> Restored:
    """Take the books of the newest backup below ``path``, or of ``version``, to ``save``, which writes them and gives back what it wrote.

    Books without id or sections are skipped, and counted as they are read; ``schema`` is that of the books. A folder
    without a whole backup of this format is refused.
    """
    whole = _versions(spark, path)
    if not whole or (version is not None and version not in whole):
        raise ValueError(f"no whole backup in {path}")
    source = f"{path}/v{version or whole[-1]}"
    about = spark.read.schema("format string, version int, exportedAt string, settings string").json(f"{source}/manifest").first()
    if about is None or (about.format, about.version) != (BACKUP_FORMAT, BACKUP_VERSION):
        raise ValueError(f"not a backup of this format: {source}")
    counted, fine = Observation(), F.col("id").isNotNull() & (F.col("id").cast("string") != "") & F.coalesce(F.size("sections") > 0, F.lit(False))
    rows = spark.read.schema(schema).json(f"{source}/books").observe(counted, F.count("*").alias("all"), F.count_if(fine).alias("fine"))
    saved = save(rows.filter(fine))
    n = counted.get
    return Restored(saved, about.settings, about.exportedAt, n["fine"], n["all"] - n["fine"])


def missing_from(required: DataFrame, present: DataFrame) -> DataFrame:
    """Rows that are required more often than they are there."""
    return required.exceptAll(present.select(*required.columns))


def parse_settings(df: DataFrame, json: str = "json") -> DataFrame:
    """Adds ``settings``: enumerations checked, numbers clamped, defaults for what is bad."""
    s = F.from_json(json, "tone string, ocr string, rate string, fontScale string, keepScreenOn string")
    number = lambda c, d, lo, hi: F.least(F.greatest(F.when(F.coalesce(c.try_cast("double"), F.lit(0.0)) == 0, F.lit(d)).otherwise(c.try_cast("double")), F.lit(lo)), F.lit(hi))
    one_of = lambda c, d, *xs: F.when(c.isin(*xs), c).otherwise(d)
    return df.withColumn("settings", F.struct(one_of(s.tone, "light", "dark", "light").alias("tone"), one_of(s.ocr, "auto", "auto", "always", "off").alias("ocr"), number(s.rate, 1.0, 0.5, 3.0).alias("rate"), number(s.fontScale, 100.0, 85.0, 140.0).alias("font_scale"), (F.coalesce(s.keepScreenOn, F.lit("true")) != "false").alias("keep_screen_on")))
