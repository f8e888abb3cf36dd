"""Pages of books that are still arriving: order, publishing, recognition attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

# They must equal the source application's for equal results.
MIN_PAGES, MIN_REMAINING, MIN_CHARS, AFTER_MS, FORCE_PAGES, BATCH_PAGES, RETRY_CHARS = 6, 8, 2000, 2500, 48, 10, 20


def contiguous_prefix(pages: DataFrame, key: str, order: str = "page_number") -> DataFrame:
    """Pages from 1 on without a gap."""
    return pages.withColumn("__i", F.row_number().over(W.partitionBy(key).orderBy(order))).filter(F.col("__i") == F.col(order)).drop("__i")


def page_summary(pages: DataFrame, *key: str) -> DataFrame:
    return pages.groupBy(*key).agg(F.count("*").alias("pages"), F.count_if("ocr_used").alias("ocr_pages"), F.count_if("from_cache").alias("cached_pages"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.bool_or("has_text").alias("any_text"))


def first_publish(pages: DataFrame, key: str, min_pages: int = MIN_PAGES, min_remaining: int = MIN_REMAINING, min_chars: int = MIN_CHARS, after_ms: int | None = None, force_pages: int = FORCE_PAGES, text: str = "text") -> DataFrame:
    """Adds ``first``: the page with which a book is first published, or null.

    With ``after_ms`` (and a column ``ts``) the time since the book's first page counts too, unless the book is long.
    """
    line = W.partitionBy(key).orderBy("page_number")
    total = F.count("*").over(W.partitionBy(key))
    ready = (F.col("page_number") >= min_pages) & (total - F.col("page_number") >= min_remaining) & (F.sum(F.length(text)).over(line) >= min_chars)
    staged = pages.withColumn("__total", total).withColumn("__ready", ready)
    if after_ms is not None:
        waited = F.unix_millis("ts") - F.unix_millis(F.min("ts").over(W.partitionBy(key)))
        staged = staged.withColumn("__ready", F.col("__ready") & ((waited >= after_ms) | (F.col("__total") >= force_pages)))
    return staged.withColumn("first", F.min(F.when(F.col("__ready"), F.col("page_number"))).over(W.partitionBy(key))).drop("__total", "__ready")


def publish_batches(pages: DataFrame, key: str, batch: int = BATCH_PAGES, **limits) -> DataFrame:
    """Adds ``batch_no``: 0 for the first publication, then every ``batch`` pages; all in 0 if none is early."""
    later = F.floor((F.col("page_number") - F.col("first") - 1) / batch) + 1
    return first_publish(pages, key, **limits).withColumn("batch_no", F.coalesce(F.when(F.col("page_number") <= F.col("first"), 0).otherwise(later), F.lit(0)))


def best_candidate(attempts: DataFrame, key: str, order: list[str], text: str = "text", confidence: str = "confidence") -> DataFrame:
    """The best recognition attempt of each key, with its ``score`` and whether a ``retry`` is worth it."""
    c = F.col(text)
    score = T.count_meaningful(c) * 2 + F.coalesce(confidence, F.lit(0)) - T.symbol_ratio(c, "candidate") * 120
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), *order))
    return attempts.withColumn("score", score).withColumn("retry", T.count_meaningful(c) < RETRY_CHARS).withColumn("__n", n).filter("__n = 1").drop("__n")


def narrow_language(pages: DataFrame, key: str, text: str = "text", mixed: str = "eng+chi_sim") -> DataFrame:
    """``key, language``: the recognition models that the first page with enough text asks for."""
    c = F.col(text)
    cjk, latin = T.count(c, f"[{T.CJK}]"), T.count(c, "[A-Za-z]")
    total = cjk + latin
    language = F.when(cjk >= total * 0.85, "chi_sim").when(cjk >= total * 0.4, "chi_sim+eng").when(latin >= total * 0.95, "eng").otherwise(mixed)
    fit = pages.filter((T.count_meaningful(c) >= 60) & (total > 0))
    return fit.groupBy(key).agg(F.min_by(language, "page_number").alias("language"))
