"""Sections of books: from headings, from length, from pages, from spines; merging and naming them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import reading as R
from quire.functions import text as T
from quire.operators import folds
from quire.operators import segments as G
from quire.operators.lines import drop_blocks, is_toc_line

# They must equal the source application's for equal results.
TARGET_CHARS, SHORT_CHARS, AGGRESSIVE_CHARS = 2200, 360, 820
PAGE_SOFT_CHARS, PAGE_SOFT_PAGES, PAGE_HARD_CHARS, PAGE_HARD_PAGES = 2600, 4, 5200, 7
SPINE_TOC_CHARS, SPINE_TITLE_CHARS, SPINE_HARD_CHARS, SPINE_ITEMS = 780, 2600, 5400, 10
HINT_HEADINGS, HINT_LENGTH = "按文本标题拆分", "按段落长度自动分段"


def heading_islands(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``is_heading``, ``section_no`` (0 before the first heading) and ``headings`` of the document."""
    staged = lines.withColumn("is_heading", T.is_heading_line(F.col("line")))
    line = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    one = F.col("is_heading").cast("int")
    return staged.withColumn("section_no", F.sum(one).over(line)).withColumn("headings", F.sum(one).over(W.partitionBy(key)))


def next_heading(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headings with the line on which their section ends (exclusive); null for the last."""
    heads = lines.filter(T.is_heading_line(F.col("line")))
    return heads.withColumn("end_line", F.lead("line_no").over(W.partitionBy(key).orderBy("line_no")))


def split_sections_by_heading(lines: DataFrame, key: str = "doc_id", min_headings: int = 2, keep_preamble: bool = False) -> DataFrame:
    """``key, section_no, title, text``: from each heading to the next; sections without a body are dropped, as is what stands before the first."""
    islands = heading_islands(lines, key).filter(F.col("headings") >= min_headings)
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "line"))))
    made = islands.groupBy(key, F.col("section_no").alias("n")).agg(F.max(F.when(F.col("is_heading"), T.clean_heading(F.col("line")))).alias("title"), T.js_trim(F.array_join(F.transform(body, lambda x: x.line), "\n")).alias("text"))
    real = made.filter((F.col("text") != "") & (F.lit(keep_preamble) | (F.col("n") > 0)))
    return renumber_sections(real, key, "n").select(key, "section_no", "title", "text")


def renumber_sections(df: DataFrame, key: str, order: str, offset: DataFrame | None = None) -> DataFrame:
    """Adds ``section_no`` from 1, behind the ``section_count`` of ``offset`` (key, section_count) if given."""
    numbered = df.withColumn("section_no", F.row_number().over(W.partitionBy(key).orderBy(order)))
    if offset is None:
        return numbered
    return numbered.join(offset, key, "left").withColumn("section_no", F.col("section_no") + F.coalesce("section_count", F.lit(0))).drop("section_count")


def append_sections(existing: DataFrame, new: DataFrame, key: str = "doc_id", order: str = "section_no") -> DataFrame:
    """Sections with more behind them; earlier ones are not rewritten."""
    counts = existing.groupBy(key).agg(F.max("section_no").alias("section_count"))
    later = renumber_sections(new.withColumnRenamed("section_no", "__order") if order == "section_no" else new, key, "__order" if order == "section_no" else order, counts)
    return existing.unionByName(later.select(*existing.columns))


def chunk_by_length(df: DataFrame, column: str, out: str, target: int = TARGET_CHARS) -> DataFrame:
    """Adds chunks of paragraphs up to ``target`` characters, joiners not counted."""
    staged = df.withColumn("__len", F.transform(column, F.length))
    init = {"size": F.lit(0)}
    at = folds.starts(F.col("__len"), init, lambda s, x: s.size + x > target, lambda s, x, new: {"size": F.when(new, x).otherwise(s.size + x)})
    staged = staged.withColumn("__at", at)
    return staged.withColumn(out, F.transform(folds.groups(F.col(column), F.col("__at")), lambda g: F.array_join(g, "\n\n"))).drop("__len", "__at")


def detect_page_heading(text: Column, first_n: int = 10) -> Column:
    """The first of the first lines of a page that reads like a heading, or null."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), T.js_trim), lambda x: x != ""), 1, first_n)
    return F.get(F.filter(lines, lambda x: T.has(x, T.PAGE_HEADING)), F.lit(0))


def strip_leading_heading(text: Column, title: Column) -> Column:
    """Text without its first line if that is the title; kept where nothing else is left."""
    lines = F.filter(F.transform(F.split(T.normalize_line_breaks(text), "\n"), T.js_trim), lambda x: x != "")
    first, rest = F.get(lines, F.lit(0)), T.js_trim(F.array_join(F.slice(lines, 2, 1_000_000_000), "\n"))
    key = T.section_key(F.coalesce(title, F.lit("")))
    same = (key != "") & (T.section_key(first) == key)
    return F.when(F.size(lines) == 0, "").when(same, F.when(rest != "", rest).otherwise(first)).otherwise(T.js_trim(text))


def split_sections_by_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, section_no, title, text, source_hint`` from pages ``key, page_number, text, ocr_used``.

    A heading starts a section; so does a length, at the end of a sentence or at a hard limit. The fold
    runs over one array of pages per book and carries lengths and flags; texts are joined behind it.
    """
    line = W.partitionBy(key).orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
    flagged = pages.withColumn("text", T.js_trim(F.coalesce("text", F.lit("")))).withColumn("heading", detect_page_heading(F.col("text")))
    flagged = flagged.withColumn("__before", F.coalesce(F.last(F.nullif(F.col("text"), F.lit("")), ignorenulls=True).over(line), F.lit("")))  # past blank pages
    first_line, last_line = F.substring_index("text", "\n", 1), F.element_at(F.split("text", "\n"), -1)
    page = F.struct("page_number", "text", "ocr_used", "heading", F.length("text").alias("len"), T.has_strong_ending(F.col("text")).alias("strong"), T.is_short_heading(last_line).alias("heads"), T.is_heading_line(first_line).alias("starts"))
    blank = F.when(T.needs_space(F.col("__before"), F.col("text")), " ").otherwise("").alias("blank")
    books = flagged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page.alias("p"), blank))).alias("__items"))

    def new(s: Column, x: Column) -> Column:
        clean = s.strong & ((s.len > PAGE_SOFT_CHARS) | (s.pages >= PAGE_SOFT_PAGES))
        return x.p.heading.isNotNull() | clean | (s.len > PAGE_HARD_CHARS) | (s.pages >= PAGE_HARD_PAGES)

    def step(s: Column, x: Column, is_new: Column) -> dict[str, Column]:
        gap = F.when(x.p.len == 0, 0).when(s.len == 0, 0).when(s.strong | s.heads | x.p.starts, 2).otherwise(F.length(x.blank))
        keep_end = (x.p.len == 0) & ~is_new
        return {"len": F.when(is_new, x.p.len).otherwise(s.len + gap + x.p.len), "pages": F.when(is_new, 1).otherwise(s.pages + 1), "strong": F.when(keep_end, s.strong).otherwise(x.p.strong), "heads": F.when(keep_end, s.heads).otherwise(x.p.heads)}

    books = books.withColumn("__at", folds.starts(F.col("__items"), {"len": F.lit(0), "pages": F.lit(0), "strong": F.lit(False), "heads": F.lit(False)}, new, step))

    def section(g: Column, i: Column) -> Column:
        zero = F.struct(F.lit("").alias("t"), F.lit(False).alias("end"))
        text = F.aggregate(g, zero, lambda s, x: F.struct(F.when(x.p.text == "", s.t).when(s.t == "", x.p.text).when(s.end | x.p.starts, F.concat(s.t, F.lit("\n\n"), x.p.text)).otherwise(F.concat(s.t, x.blank, x.p.text)).alias("t"), F.when(x.p.text == "", s.end).otherwise(x.p.strong | x.p.heads).alias("end"))).t
        ocr = F.size(F.filter(g, lambda x: x.p.ocr_used))
        hint = F.concat(F.lit("第 "), F.get(g, F.lit(0)).p.page_number.cast("string"), F.lit(" - "), F.element_at(g, -1).p.page_number.cast("string"), F.lit(" 页"), F.when(ocr > 0, F.concat(F.lit(" · OCR "), ocr.cast("string"), F.lit(" 页"))).otherwise(""))
        return F.struct(F.get(g, F.lit(0)).p.heading.alias("heading"), text.alias("text"), hint.alias("source_hint"))

    made = G.exploded(books.withColumn("__groups", folds.groups(F.col("__items"), F.col("__at"))).withColumn("__sections", F.transform("__groups", section)), "__sections", "n", "s", key).select(key, "n", "s.*").filter("text <> ''")
    numbered = renumber_sections(made, key, "n")
    title = T.clean_heading(F.coalesce("heading", F.concat(F.lit("PDF 分段 "), F.col("section_no").cast("string"))))
    return numbered.select(key, "section_no", title.alias("title"), "text", "source_hint")


def section_line_stats(lines: DataFrame, *key: str, line: str = "line") -> DataFrame:
    """Per section: lines, boilerplate and table-of-contents lines, and whether all are one of them."""
    boiler, toc = T.has(F.col(line), T.BOILERPLATE_LINE), is_toc_line(F.col(line))
    return lines.groupBy(*key).agg(F.count("*").alias("n_lines"), F.count_if(boiler & (F.length(line) <= 120)).alias("boilerplate"), F.count_if(toc).alias("toc"), F.bool_and(boiler | toc).alias("all_furniture"))


def drop_sections(sections: DataFrame, stats: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections that are worth reading; all of a book that would lose every one. ``stats`` as of ``section_line_stats``."""
    s = sections.join(stats, [key, "section_no"], "left")
    n, chars = F.coalesce("n_lines", F.lit(0)), F.length("text")
    book = W.partitionBy(key)
    first = F.col("section_no") == F.min("section_no").over(book)
    many = F.count("*").over(book) > 80
    gone = (
        (T.js_trim(F.col("text")) == "")
        | ((n >= 2) & (F.col("boilerplate") >= F.ceil(n * 0.5)))
        | (T.clean_heading(F.col("title")).rlike(T.BOILERPLATE_TITLE) & (chars < TARGET_CHARS))
        | ((n >= 3) & (F.col("toc") >= F.ceil(n * 0.55)) & (chars < AGGRESSIVE_CHARS))
        | (first & (n > 0) & F.coalesce("all_furniture", F.lit(False)))
        | (many & T.is_generic_title(F.col("title")) & (chars < SHORT_CHARS))
    )
    flagged = s.withColumn("__gone", F.coalesce(gone, F.lit(False))).withColumn("__left", F.count_if(~F.col("__gone")).over(book))
    return flagged.filter(~F.col("__gone") | (F.col("__left") == 0)).select(*sections.columns)


def merge_short_sections(sections: DataFrame, key: str = "doc_id", format_: str = "TXT") -> DataFrame:
    """Short neighbouring sections merged; ``key, first, section_no, title, text, source_hint``."""
    book = W.partitionBy(key)
    flags = sections.withColumn("len", F.length("text")).withColumn("generic", T.is_generic_title(F.col("title"))).withColumn("major", T.is_major_title(F.col("title"))).withColumn("__n", F.count("*").over(book))
    flags = flags.withColumn("strong", T.has_strong_ending(F.col("text"))).withColumn("heads", T.is_short_heading(F.element_at(F.split("text", "\n"), -1))).withColumn("starts", T.is_heading_line(F.substring_index("text", "\n", 1)))
    aggressive = (F.lit(format_ == "EPUB") & (F.col("__n") > 60)) | (F.col("__n") > 120)
    rows = flags.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_no", "title", "text", "source_hint", "len", "generic", "major", "strong", "heads", "starts"))).alias("__s"), F.first(aggressive).alias("__hard"))
    before = F.concat(F.array(F.lit("")), F.slice(F.transform("__s", lambda x: x.text), 1, F.greatest(F.size("__s") - 1, F.lit(0))))
    rows = rows.withColumn("__items", F.zip_with("__s", before, lambda x, b: F.struct(x.alias("p"), F.when(T.needs_space(b, x.text), " ").otherwise("").alias("blank"))))
    limit = F.when(F.col("__hard"), AGGRESSIVE_CHARS).otherwise(SHORT_CHARS)

    def new(s: Column, x: Column) -> Column:
        fits = (s.len + x.p.len <= TARGET_CHARS) & ((x.p.len < limit) | (s.len < limit))
        soft = F.col("__hard") | s.generic | x.p.generic
        return ~(fits & soft & (F.col("__hard") | ~(s.major & x.p.major)))

    def step(s: Column, x: Column, is_new: Column) -> dict[str, Column]:
        gap = F.when(s.strong | s.heads | x.p.starts, 2).otherwise(F.length(x.blank))
        takes = s.generic & ~x.p.generic
        return {"len": F.when(is_new, x.p.len).otherwise(s.len + gap + x.p.len), "generic": F.when(is_new, x.p.generic).otherwise(s.generic & x.p.generic), "major": F.when(is_new | takes, x.p.major).otherwise(s.major), "strong": x.p.strong, "heads": x.p.heads}

    init = {"len": F.lit(0), "generic": F.lit(False), "major": F.lit(False), "strong": F.lit(False), "heads": F.lit(False)}
    rows = rows.withColumn("__at", folds.starts(F.col("__items"), init, new, step))

    def merged(g: Column) -> Column:
        zero = F.struct(F.lit("").alias("t"), F.lit(False).alias("end"), F.lit("").alias("h"))
        out = F.aggregate(g, zero, lambda s, x: F.struct(F.when(s.t == "", x.p.text).when(s.end | x.p.starts, F.concat(s.t, F.lit("\n\n"), x.p.text)).otherwise(F.concat(s.t, x.blank, x.p.text)).alias("t"), (x.p.strong | x.p.heads).alias("end"), T.merge_source_hint(s.h, x.p.source_hint).alias("h")))
        named = F.filter(g, lambda x: ~x.p.generic)
        first = F.get(g, F.lit(0)).p
        return F.struct(first.section_no.alias("first"), F.when(first.generic & (F.size(named) > 0), F.get(named, F.lit(0)).p.title).otherwise(first.title).alias("title"), out.t.alias("text"), out.h.alias("source_hint"))

    rows = rows.withColumn("__groups", folds.groups(F.col("__items"), F.col("__at"))).withColumn("__merged", F.transform("__groups", merged))
    return G.exploded(rows, "__merged", "n", "m", key).select(key, (F.col("n") + 1).alias("section_no"), "m.*")


def prepare_sections(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections with their text cleaned block by block and cut into paragraphs; empty ones are dropped."""
    blocks = drop_blocks(G.paragraph_blocks(sections, key, "section_no")).withColumn("__one", F.struct("block_no", "block"))
    body = blocks.groupBy(key, "section_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("__one")), lambda x: x.block), "\n\n").alias("text"))
    split = G.split_paragraphs(body, key, "section_no").filter(F.size("paragraphs") > 0)
    return sections.drop("text").join(split, [key, "section_no"]).withColumn("text", F.array_join("paragraphs", "\n\n")).withColumn("title", T.clean_heading(F.col("title")))


def normalize_sections(sections: DataFrame, key: str = "doc_id", format_: str = "TXT", fallback_title: str = "正文") -> DataFrame:
    """``key, section_no, id, title, text, paragraphs, paragraph_count, preview, source_hint`` from raw sections ``key, section_no, title, text, source_hint``."""
    prepared = prepare_sections(sections, key).select(key, "section_no", "title", "text", "source_hint")
    raw = G.exploded(sections.withColumn("__l", F.filter(F.transform(F.split(T.normalize_line_breaks(F.col("text")), "\n"), T.clean_display_text), lambda x: x != "")), "__l", "i", "line", key, "section_no")
    merged = merge_short_sections(drop_sections(prepared, section_line_stats(raw, key, "section_no"), key), key, format_)
    final = G.split_paragraphs(merged, key, "section_no").filter(F.size("paragraphs") > 0)
    staged = merged.drop("text").join(final, [key, "section_no"]).withColumn("text", F.array_join("paragraphs", "\n\n"))
    staged = G.sentences(staged, "text", "__sentences").withColumn("preview", T.preview(F.coalesce(F.get("__sentences", F.lit(0)), F.get("paragraphs", F.lit(0)))))
    numbered = renumber_sections(staged.withColumnRenamed("section_no", "__n"), key, "__n")
    return numbered.select(key, "section_no", F.concat(F.lit("section-"), F.col("section_no").cast("string")).alias("id"), T.resolve_title(F.col("title"), F.col("preview"), F.col("section_no"), fallback_title).alias("title"), "text", "paragraphs", F.greatest(F.size("paragraphs"), F.lit(1)).alias("paragraph_count"), "preview", "source_hint")


def book_totals(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, section_count, total_characters, total_paragraphs``."""
    return sections.groupBy(key).agg(F.count("*").alias("section_count"), F.sum(F.length("text")).alias("total_characters"), F.sum(F.greatest(F.coalesce("paragraph_count", F.lit(1)), F.lit(1))).alias("total_paragraphs"))


def next_readable(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``next_readable``: the first later section that has any text."""
    later = W.partitionBy(key).orderBy("section_no").rowsBetween(1, W.unboundedFollowing)
    return sections.withColumn("next_readable", F.min(F.when(T.js_trim(F.col("text")) != "", F.col("section_no"))).over(later))


def flatten_toc(toc: DataFrame) -> DataFrame:
    """Entries of a table of contents ``doc_id, path, label, href`` in reading order: ``entry_no`` is added."""
    return toc.withColumn("entry_no", F.row_number().over(W.partitionBy("doc_id").orderBy("path")) - 1)


def match_toc(toc: DataFrame, spine: DataFrame, key: str = "doc_id") -> DataFrame:
    """Markers ``key, title, spine_index``: entries matched to the first spine item of the same address, else to one that ends alike.

    Both joins stay within a document.
    """
    entries = flatten_toc(toc).withColumn("title", T.clean_heading(F.coalesce("label", F.lit("")))).withColumn("__h", R.normalize_href(F.col("href"))).filter("title <> '' AND __h <> ''")
    items = spine.select(F.col(key), "spine_index", R.normalize_href(F.col("href")).alias("__s"))
    exact = entries.join(items.groupBy(key, F.col("__s").alias("__h")).agg(F.min("spine_index").alias("exact")), [key, "__h"], "left")
    rest = exact.filter("exact IS NULL").select(key, "entry_no", "__h").distinct()
    alike = rest.join(items, key).filter(F.col("__s").endswith(F.col("__h")) | F.col("__h").endswith(F.col("__s"))).groupBy(key, "entry_no").agg(F.min("spine_index").alias("alike"))
    return exact.join(alike, [key, "entry_no"], "left").select(key, "entry_no", "title", F.coalesce("exact", "alike").alias("spine_index")).filter("spine_index IS NOT NULL")


def order_markers(markers: DataFrame, key: str = "doc_id") -> DataFrame:
    """``markers`` with their ``place`` from 0 in each document: by spine item, those of one in the order of their entries; dealt by ranges and sorted."""
    line = W.partitionBy(key).orderBy("spine_index", "entry_no")
    return markers.withColumn("place", F.row_number().over(line) - 1).orderBy(key, "place")


def active_toc_title(spine: DataFrame, markers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``toc_title``: that of the last marker at or before each spine item."""
    last = markers.groupBy(key, "spine_index").agg(F.max_by("title", "entry_no").alias("__t"))
    line = W.partitionBy(key).orderBy("spine_index").rowsBetween(W.unboundedPreceding, 0)
    return spine.join(last, [key, "spine_index"], "left").withColumn("toc_title", F.last("__t", ignorenulls=True).over(line)).drop("__t")


def merge_spine_sections(spine: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, section_no, title, text, source_hint`` from spine items ``key, spine_index, title, toc_title, text``.

    A new entry of the table of contents, a new title, a length or a number of items starts a section. An
    item without any title is called by the sections before it, and so is not looked for in its text.
    """
    real = lambda c: F.when(T.js_trim(F.col(c)) != "", F.col(c))
    named = spine.withColumn("__title", T.clean_heading(F.coalesce(real("toc_title"), real("title"))))
    named = named.withColumn("text", strip_leading_heading(T.normalize_whitespace(F.coalesce("text", F.lit(""))), F.coalesce("__title", F.lit("")))).filter("text <> ''")
    ends = T.has_strong_ending(F.col("text")) | T.is_short_heading(F.element_at(F.split("text", "\n"), -1))
    item = F.struct("spine_index", F.col("__title").alias("title"), "text", F.length("text").alias("len"), T.section_key(F.coalesce("toc_title", F.lit(""))).alias("toc"), T.section_key(F.col("__title")).alias("called"), ends.alias("ends"), T.is_heading_line(F.substring_index("text", "\n", 1)).alias("starts"))
    books = named.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__s"))
    before = F.concat(F.array(F.lit("")), F.slice(F.transform("__s", lambda x: x.text), 1, F.greatest(F.size("__s") - 1, F.lit(0))))
    books = books.withColumn("__items", F.zip_with("__s", before, lambda x, b: F.struct(x.alias("p"), F.when(T.needs_space(b, x.text), " ").otherwise("").alias("blank"))))

    def untitled(number: Column) -> Column:
        return F.concat(F.lit("章节 "), number.cast("string"))

    def name(s: Column, x: Column) -> Column:
        return F.coalesce(x.p.called, F.concat(F.lit("章节"), F.greatest(s.groups, F.lit(1)).cast("string")))

    def new(s: Column, x: Column) -> Column:
        other = F.when(x.p.toc != "", (x.p.toc != s.toc) & (s.len >= SPINE_TOC_CHARS)).otherwise((name(s, x) != "") & (name(s, x) != s.called) & (s.len >= SPINE_TITLE_CHARS))
        return other | (s.len >= SPINE_HARD_CHARS) | (s.items >= SPINE_ITEMS)

    def step(s: Column, x: Column, is_new: Column) -> dict[str, Column]:
        grown = s.len + F.when(s.ends | x.p.starts, 2).otherwise(F.length(x.blank)) + x.p.len
        takes = is_new | s.nameless
        first = lambda own, old: F.when(is_new | (s.nameless & (own != "")), own).otherwise(old)
        return {"groups": s.groups + is_new.cast("int"), "len": F.when(is_new, x.p.len).otherwise(grown), "items": F.when(is_new, 1).otherwise(s["items"] + 1), "toc": F.when(is_new, x.p.toc).otherwise(first(x.p.toc, s.toc)), "called": F.when(is_new, name(s, x)).otherwise(first(name(s, x), s.called)), "ends": x.p.ends, "nameless": F.when(takes, x.p.title.isNull() | x.p.title.startswith("章节 ")).otherwise(F.lit(False))}

    init = {"groups": F.lit(0), "len": F.lit(0), "items": F.lit(0), "toc": F.lit(""), "called": F.lit(""), "ends": F.lit(False), "nameless": F.lit(False)}
    books = books.withColumn("__at", folds.starts(F.col("__items"), init, new, step))

    def section(g: Column, i: Column) -> Column:
        zero = F.struct(F.lit("").alias("t"), F.lit(False).alias("end"))
        text = F.aggregate(g, zero, lambda s, x: F.struct(F.when(s.t == "", x.p.text).when(s.end | x.p.starts, F.concat(s.t, F.lit("\n\n"), x.p.text)).otherwise(F.concat(s.t, x.blank, x.p.text)).alias("t"), x.p.ends.alias("end"))).t
        titled = F.filter(F.transform(g, lambda x: x.p.title), lambda t: t.isNotNull() & ~t.startswith("章节 "))
        a, b = F.get(g, F.lit(0)).p.spine_index.cast("string"), F.element_at(g, -1).p.spine_index.cast("string")
        hint = F.concat(F.lit("EPUB spine "), a, F.when(a == b, "").otherwise(F.concat(F.lit(" - "), b)))
        placeholder = F.coalesce(F.element_at(F.transform(g, lambda x: x.p.title), -1), untitled(F.when(F.size(g) > 1, i + 1).otherwise(F.greatest(i, F.lit(1)))))
        return F.struct(F.coalesce(F.get(titled, F.lit(0)), placeholder).alias("title"), T.js_trim(text).alias("text"), hint.alias("source_hint"))

    made = books.withColumn("__groups", folds.groups(F.col("__items"), F.col("__at"))).withColumn("__sections", F.transform("__groups", section))
    return G.exploded(made, "__sections", "n", "s", key).select(key, (F.col("n") + 1).alias("section_no"), "s.*")
