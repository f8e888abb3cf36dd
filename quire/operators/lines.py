"""Lines, blocks and page text: what is noise, what repeats, what is poor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T


def explode_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, line_no, line``: every line of every text, numbered from 0."""
    return docs.select(key, F.posexplode(F.split(T.normalize_line_breaks(F.col(text)), "\n")).alias("line_no", "line"))


def explode_blocks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, block_no, block``: runs of lines between blank lines."""
    return docs.select(key, F.posexplode(F.split(T.normalize_line_breaks(F.col(text)), "\n{2,}")).alias("block_no", "block"))


def edge_rank(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``n_lines`` and ``near_edge``: among the first or last three lines."""
    counted = lines.withColumn("n_lines", F.count("*").over(W.partitionBy(key)))
    return counted.withColumn("near_edge", (F.col("line_no") <= 2) | (F.col("line_no") >= F.col("n_lines") - 3))


def is_noise(line: Column, near_edge: Column) -> Column:
    """Rule lines, page numbers, tiny codes, scraps at page edges, mostly symbols. Empty lines are not noise."""

    def noise(x: Column) -> Column:
        scrap = near_edge & (F.length(x.t) <= 8) & (x.meaningful <= 4)
        symbols = (x.meaningful <= 6) & (T.symbol_ratio(x.t) > 0.5)
        return (x.t != "") & (T.has(x.t, T.NOISE_LINE) | scrap | symbols)

    return T.let(T.normalize_whitespace(line), lambda t: T.let(F.struct(t.alias("t"), T.count_meaningful(t).alias("meaningful")), noise))


def drop_noise_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    return edge_rank(lines, key).filter(~is_noise(F.col("line"), F.col("near_edge"))).select(*lines.columns)


def flag_repeated(lines: DataFrame, key: str = "doc_id", min_count: int = 2, max_len: int = T.REPEATED_LINE_CHARS) -> DataFrame:
    """Adds ``line_key`` and ``repeated``: the key stands ``min_count`` times in the document and the line is short."""
    keyed = lines.withColumn("line_key", T.line_key(F.col("line")))
    many = F.count("*").over(W.partitionBy(key, "line_key")) >= min_count
    return keyed.withColumn("repeated", many & (F.col("line_key") != "") & (F.length(T.normalize_whitespace(F.col("line"))) <= max_len))


def drop_repeated_lines(lines: DataFrame, key: str = "doc_id", scope: str = "doc", min_count: int = 2, max_len: int = T.REPEATED_LINE_CHARS) -> DataFrame:
    """Drops all copies of short lines that repeat, then noise.

    ``scope="corpus"`` counts the documents in which a key stands, over the whole table; the frequent
    keys are joined, and skewed keys are left to adaptive execution.
    """
    ranked = edge_rank(lines, key)
    if scope == "doc":
        flagged = flag_repeated(ranked, key, min_count, max_len)
    else:
        keyed = ranked.withColumn("line_key", T.line_key(F.col("line")))
        often = keyed.filter("line_key <> ''").select(key, "line_key").distinct().groupBy("line_key").count().filter(F.col("count") >= min_count).select("line_key", F.lit(True).alias("often"))
        # Lines without a key are the commonest of all: a random number keeps them from meeting in one task.
        spread = F.when(F.col("line_key") == "", F.concat(F.lit("\0"), F.rand(7).cast("string"))).otherwise(F.col("line_key"))
        flagged = keyed.withColumn("__spread", spread).join(often.withColumnRenamed("line_key", "__spread"), "__spread", "left").withColumn("repeated", F.coalesce("often", F.lit(False)) & (F.length(T.normalize_whitespace(F.col("line"))) <= max_len))
    return flagged.filter(~F.col("repeated") & ~is_noise(F.col("line"), F.col("near_edge"))).select(*lines.columns)


def line_key_counts(lines: DataFrame) -> DataFrame:
    return lines.select(T.line_key(F.col("line")).alias("line_key")).filter("line_key <> ''").groupBy("line_key").agg(F.count("*").alias("n"))


def concat_ordered(df: DataFrame, key: str, order: str, text: str, sep: str) -> DataFrame:
    """``key, text``: the texts of a key joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x.t), sep).alias(text))


def is_toc_line(c: Column) -> Column:
    return T.has(c, T.TOC_LINE)


def _lines_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(T.normalize_line_breaks(c), "\n"), T.js_trim), lambda x: x != "")


def is_toc_block(c: Column) -> Column:
    lines = _lines_of(c)
    toc = F.size(F.filter(lines, is_toc_line))
    return (F.size(lines) >= 2) & (toc >= 2) & (toc >= F.ceil(F.size(lines) * 0.6))


def flag_toc_blocks(blocks: DataFrame, block: str = "block") -> DataFrame:
    return blocks.withColumn("is_toc", is_toc_block(F.col(block)))


def drop_blocks(blocks: DataFrame, block: str = "block") -> DataFrame:
    """Without empty blocks, page numbers, reference headings, short boilerplate and tables of contents."""
    t = T.clean_display_text(F.col(block))
    gone = (t == "") | T.has(t, T.PAGE_ARTIFACT) | T.has(t, T.REFERENCE_HEADING) | ((F.length(t) <= 96) & T.has(t, T.BOILERPLATE_LINE)) | is_toc_block(t)
    return blocks.filter(~gone)


def line_shape(lines: DataFrame, *key: str, line: str = "line") -> DataFrame:
    """Per key: lines, average length, tiny, short and soft-ending ones."""
    n = F.length(line)
    return lines.groupBy(*key).agg(
        F.count("*").alias("n_lines"),
        F.avg(n).alias("avg_len"),
        F.count_if(n <= 4).alias("tiny"),
        F.count_if(n <= 48).alias("short"),
        F.count_if(~T.has_strong_ending(F.col(line))).alias("soft"),
    )


def wrapped(n_lines: Column, avg_len: Column, short: Column, soft: Column) -> Column:
    return (n_lines >= 3) & ((avg_len <= 52) | (short >= F.ceil(n_lines * 0.6)) | (soft >= F.ceil(n_lines * 0.5)))


def flag_wrapped_blocks(lines: DataFrame, *key: str, line: str = "line") -> DataFrame:
    """The line shape of each block, with ``wrapped``: its lines look hard-wrapped."""
    return line_shape(lines, *key, line=line).withColumn("wrapped", wrapped(F.col("n_lines"), F.col("avg_len"), F.col("short"), F.col("soft")))


#: What a wrong decoding leaves behind, and the fewest characters of a page with a text layer.
MOJIBAKE = f"[□■◆◇\ufffd]{{2,}}|(?:[ÃÂæçèé][^{T.WS[1:-1]}]*){{3,}}"
MIN_TEXT_CHARS = 36
#: Found in the first characters of most lines, without counting the rest; and as many characters of a page as mostly settle whether it has text.
_THREE_MEANINGFUL, _START_CHARS = f"(?:[A-Za-z0-9{T.CJK}][^A-Za-z0-9{T.CJK}]*){{3}}", 512


def low_quality(c: Column) -> Column:
    """Whether page text is empty, wrongly decoded, mostly symbols or in scraps."""

    def judged(t: Column) -> Column:
        lines = _lines_of(c)
        stats = F.struct(t.alias("t"), F.length(T.replace(t, f"{T.WS}+", "")).alias("compact"), T.count_meaningful(t).alias("meaningful"), F.size(lines).alias("lines"), lines.alias("all"))
        return T.let(stats, poor)

    def poor(x: Column) -> Column:
        tiny = F.size(F.filter(x["all"], lambda y: ~T.has(y, _THREE_MEANINGFUL))) / F.greatest(x.lines, F.lit(1))
        average = F.aggregate(x["all"], F.lit(0), lambda a, y: a + F.length(y)) / F.greatest(x.lines, F.lit(1))
        return (
            (x.t == "")
            | ((x.compact >= 30) & (x.meaningful / F.greatest(x.compact, F.lit(1)) < 0.45))
            | ((x.lines >= 12) & (average < 5))
            | ((x.lines >= 8) & (tiny > 0.45))
            | T.has(x.t, MOJIBAKE)
            | (F.length(T.replace(x.t, f"[{T.WS[1:-1]}{T.SYMBOL_VARIANTS['page']}]+", "")) / F.greatest(x.compact, F.lit(1)) > 0.32)
        )

    return T.let(T.normalize_whitespace(c), judged)


def needs_ocr(c: Column, mode: str = "auto", min_chars: int = MIN_TEXT_CHARS, low: Column | None = None) -> Column:
    """Whether a page is to be recognised; ``low`` is its ``low_quality`` if that is known already."""
    if mode in ("off", "always"):
        return F.lit(mode == "always")
    text = F.coalesce(c, F.lit(""))
    few = F.when(T.count_meaningful(F.left(text, F.lit(_START_CHARS))) >= min_chars, False).otherwise(T.count_meaningful(text) < min_chars)
    return few | (low_quality(text) if low is None else low)


def non_empty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(T.js_trim(F.col(column)) != "")
