"""Queries over sections, headings and tables of contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lines as L
from quire.operators import sections as X
from quire.plans import registry as S
from quire.plans.registry import query, read

#: Every ninth line becomes a heading; some bring a body of nothing but a heading.
_LINES = f"{S.LINES}, hl AS (SELECT doc_id, line_no, CASE WHEN line_no % 9 = 4 THEN '# Chapter ' || line_no WHEN line_no % 27 = 5 THEN 'Part ' || line_no ELSE line END AS line FROM ln)"


def _headed(spark, sf_dir):
    n = F.col("line_no")
    line = F.when(n % 9 == 4, F.concat(F.lit("# Chapter "), n.cast("string"))).when(n % 27 == 5, F.concat(F.lit("Part "), n.cast("string"))).otherwise(F.col("line"))
    return L.explode_lines(read(spark, sf_dir, "documents", "doc_id", "text")).withColumn("line", line)


_ISLANDS = f"i AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY line_no) AS n, sum(h) OVER (PARTITION BY doc_id) AS heads FROM (SELECT *, CAST({S.has('line', T.HEADING)} AS INT) AS h FROM hl))"


@query("d09_g01_g02_sections_by_heading", f"""WITH {_LINES}, {_ISLANDS}, s AS (SELECT doc_id, n, {S.heading("max(line) FILTER (h = 1)")} AS title, {S.trim("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (h = 0), '')")} AS text FROM i WHERE heads >= 2 AND n > 0 GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS section_no, title, md5(text) AS text FROM s WHERE text <> ''""")
def by_heading(spark, sf_dir):
    return X.split_sections_by_heading(_headed(spark, sf_dir)).withColumn("text", F.md5("text"))


@query("g03_next_heading", f"WITH {_LINES} SELECT doc_id, line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS end_line FROM hl WHERE {S.has('line', T.HEADING)}")
def next_heading(spark, sf_dir):
    return X.next_heading(_headed(spark, sf_dir)).select("doc_id", "line_no", "end_line")


_PARTS = f"list_filter(list_transform(string_split({S.breaks('text')}, chr(10)), lambda x: {S.trim('x')}), lambda x: x <> '')"


@query("d10_chunks", f"""WITH RECURSIVE p AS (SELECT doc_id, CAST(g.i AS INTEGER) AS i, l[g.i] AS t FROM (SELECT doc_id, {_PARTS} AS l FROM documents), unnest(generate_series(1, len(l))) AS g(i)),
r AS (SELECT doc_id, i, length(t) AS size, 0 AS g FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN r.size + length(t) > 600 THEN length(t) ELSE r.size + length(t) END, r.g + CASE WHEN r.size + length(t) > 600 THEN 1 ELSE 0 END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
SELECT doc_id, g AS chunk_no, md5(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS text FROM r JOIN p USING (doc_id, i) GROUP BY 1, 2""")
def chunks(spark, sf_dir):
    from quire.operators.segments import exploded

    parts = F.filter(F.transform(F.split(T.normalize_line_breaks(F.col("text")), "\n"), T.js_trim), lambda x: x != "")
    rows = X.chunk_by_length(read(spark, sf_dir, "documents", "doc_id", "text").withColumn("p", parts), "p", "c", 600)
    return exploded(rows, "c", "chunk_no", "t", "doc_id").select("doc_id", "chunk_no", F.md5("t").alias("text"))


_HEADED_TEXT = "(CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Chapter ' || doc_id || ' opens' || chr(10) WHEN doc_id % 3 = 1 THEN '  第三章 风起' || chr(10) ELSE '' END || coalesce(text, ''))"
_TOP = f"list_filter(list_transform(string_split({_HEADED_TEXT}, chr(10)), lambda x: {S.trim('x')}), lambda x: x <> '')[1:10]"


def _with_heading():
    mark = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\nChapter "), F.col("doc_id").cast("string"), F.lit(" opens\n"))).when(F.col("doc_id") % 3 == 1, "  第三章 风起\n").otherwise("")
    return F.concat(mark, F.coalesce("text", F.lit("")))


@query("d11_h06_page_heading", f"SELECT doc_id, list_filter({_TOP}, lambda x: {S.has('x', T.PAGE_HEADING)})[1] AS heading FROM documents")
def page_heading(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.detect_page_heading(_with_heading()).alias("heading"))


_KEY = lambda e: S.rr(f"lower({S.heading(e)})", f"[^a-z0-9{T.CJK}]+")
_ALL = f"list_filter(list_transform(string_split({S.breaks(_HEADED_TEXT)}, chr(10)), lambda x: {S.trim('x')}), lambda x: x <> '')"
_TITLE = "CASE WHEN doc_id % 6 = 0 THEN 'CHAPTER ' || doc_id || ' -- Opens!' ELSE '第三章 风起' END"


@query("d14_leading_heading", f"""SELECT doc_id, md5(CASE WHEN len(l) = 0 THEN '' WHEN {_KEY('title')} <> '' AND {_KEY('l[1]')} = {_KEY('title')} THEN CASE WHEN {S.trim("array_to_string(l[2:], chr(10))")} <> '' THEN {S.trim("array_to_string(l[2:], chr(10))")} ELSE l[1] END ELSE {S.trim('t')} END) AS text
FROM (SELECT doc_id, {_HEADED_TEXT} AS t, {_ALL} AS l, {_TITLE} AS title FROM documents)""")
def leading_heading(spark, sf_dir):
    title = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("CHAPTER "), F.col("doc_id").cast("string"), F.lit(" -- Opens!"))).otherwise("第三章 风起")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip_leading_heading(_with_heading(), title)).alias("text"))


@query("f03_section_line_stats", f"""WITH {S.LINES} SELECT doc_id, line_no // 6 AS section_no, count(*) AS n_lines, count(*) FILTER (length(line) <= 120 AND {S.has('line', T.BOILERPLATE_LINE)}) AS boilerplate, count(*) FILTER ({S.has('line', T.TOC_LINE)}) AS toc,
bool_and({S.has('line', T.BOILERPLATE_LINE)} OR {S.has('line', T.TOC_LINE)}) AS all_furniture FROM (SELECT doc_id, line_no, CASE WHEN line_no % 12 < 6 THEN line || ' .... ' || line_no WHEN line_no % 5 = 1 THEN 'Copyright ' || line ELSE line END AS line FROM ln) GROUP BY 1, 2""")
def line_stats(spark, sf_dir):
    n, c = F.col("line_no"), F.col("line")
    line = F.when(n % 12 < 6, F.concat(c, F.lit(" .... "), n.cast("string"))).when(n % 5 == 1, F.concat(F.lit("Copyright "), c)).otherwise(c)
    lines = L.explode_lines(read(spark, sf_dir, "documents", "doc_id", "text")).withColumn("line", line).withColumn("section_no", F.floor(n / 6).cast("int"))
    return X.section_line_stats(lines, "doc_id", "section_no")


@query("c11_next_readable", "SELECT conv_id, turn, min(CASE WHEN turn % 3 > 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_readable FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def next_readable(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn").distinct().select("conv_id", F.col("turn").alias("section_no"), F.when(F.col("turn") % 3 > 0, "x").otherwise(" ").alias("text"))
    return X.next_readable(rows, "conv_id").select("conv_id", F.col("section_no").alias("turn"), "next_readable")


@query("i02_append_sections", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS INTEGER) AS section_no, md5(text) AS text FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)")
def append(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").distinct()
    order = F.struct(F.col("role").isNull(), "role", F.col("turn").isNull(), "turn").alias("o")  # nulls last
    early = F.coalesce(F.col("role") < "b", F.lit(False))
    rows = rows.select("conv_id", F.md5("text").alias("text"), order, early.alias("early"))
    existing = X.renumber_sections(rows.filter("early"), "conv_id", "o").select("conv_id", "section_no", "text")
    return X.append_sections(existing, rows.filter("NOT early"), "conv_id", "o")


@query("f01_book_totals", "SELECT conv_id, count(*) AS section_count, sum(length(text)) AS total_characters, sum(greatest(turn % 4, 1)) AS total_paragraphs FROM conversations GROUP BY 1")
def totals(spark, sf_dir):
    return X.book_totals(read(spark, sf_dir, "conversations").withColumn("paragraph_count", F.col("turn") % 4), "conv_id")




_BOOKS = """s AS (SELECT page_id // 10 AS book, CAST(page_id % 10 AS INTEGER) AS spine_index, 'text/p' || page_id % 10 || '.html' AS href FROM pages),
t AS (SELECT page_id // 10 AS book, CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id % 3, page_id % 10) - 1 AS INTEGER) AS entry_no, 'Title ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'text/p' ELSE 'p' END || page_id % 10 || '.html' AS href FROM pages WHERE page_id % 4 < 3),
m AS (SELECT t.book, t.entry_no, any_value(t.title) AS title, coalesce(min(spine_index) FILTER (s.href = t.href), min(spine_index) FILTER (ends_with(s.href, t.href) OR ends_with(t.href, s.href))) AS spine_index FROM t JOIN s USING (book) GROUP BY 1, 2),
l AS (SELECT book, spine_index, arg_max(title, entry_no) AS title FROM m WHERE spine_index IS NOT NULL GROUP BY 1, 2)"""


def _spine_and_toc(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "page_id")
    n = F.col("page_id") % 10
    book = F.floor(F.col("page_id") / 10).alias("book")
    spine = pages.select(book, n.cast("int").alias("spine_index"), F.concat(F.lit("./text/P"), n.cast("string"), F.lit(".html#top")).alias("href"))
    href = F.concat(F.when(F.col("page_id") % 2 == 0, "text/p").otherwise("p"), n.cast("string"), F.lit(".html#a"))
    entries = pages.filter("page_id % 4 < 3").select(book, F.array((F.col("page_id") % 3).cast("int"), n.cast("int")).alias("path"), F.concat(F.lit("# Title  "), F.col("page_id").cast("string")).alias("label"), href.alias("href"))
    return spine.withColumnRenamed("book", "doc_id"), entries.withColumnRenamed("book", "doc_id")


@query("a05_d18_e01_e02_toc", f"""WITH {_BOOKS}
SELECT s.book, s.spine_index, last_value(l.title IGNORE NULLS) OVER (PARTITION BY s.book ORDER BY s.spine_index ROWS UNBOUNDED PRECEDING) AS toc_title FROM s LEFT JOIN l USING (book, spine_index)""")
def toc(spark, sf_dir):
    spine, entries = _spine_and_toc(spark, sf_dir)
    return X.active_toc_title(spine, X.match_toc(entries, spine)).select(F.col("doc_id").alias("book"), "spine_index", "toc_title")




@query("h04_ordered_markers", f"WITH {_BOOKS} SELECT book, entry_no, title, spine_index, CAST(row_number() OVER (PARTITION BY book ORDER BY spine_index, entry_no) - 1 AS INTEGER) AS place FROM m WHERE spine_index IS NOT NULL")
def ordered_markers(spark, sf_dir):
    spine, entries = _spine_and_toc(spark, sf_dir)
    return X.order_markers(X.match_toc(entries, spine)).select(F.col("doc_id").alias("book"), "entry_no", "title", "spine_index", "place")


@query("d12_pages_to_sections")
def by_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), "text", (F.col("role") == "assistant").alias("ocr_used"))
    return X.split_sections_by_pages(pages)


@query("d13_repaired")
def repaired(spark, sf_dir):
    """Every row on its own, those too that share an id: rows are numbered once, in a table."""
    from quire.operators.repair import repair_line_breaks
    from quire.plans.stream_queries import place_for

    path = place_for(spark, "numbered")
    read(spark, sf_dir, "documents", "doc_id", "text").withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.select("row", "doc_id").join(repair_line_breaks(rows, "row"), "row").drop("row")


@query("d15_d17_c03_c05_normalized")
def normalized(spark, sf_dir):
    """Every conversation as a book, a turn as a raw section."""
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    raw = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section_no"), F.concat(F.lit("Chapter "), F.col("turn").cast("string"), F.lit(" "), F.col("role")).alias("title"), "text", F.col("role").alias("source_hint"))
    return X.normalize_sections(raw)


@query("d19_merged_spine")
def merged_spine(spark, sf_dir):
    """The pages of a host as books of up to a hundred spine items, by page ids."""
    from pyspark.sql import Window as W

    from quire.functions import reading as R

    pages = read(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("doc_id", F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("#"), F.floor(F.col("page_id") / 100).cast("string")))
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("page_id")) - 1
    spine = pages.select("doc_id", order.alias("spine_index"), F.regexp_extract("url", "([^/?#]*)[?#]*$", 1).alias("title"), F.regexp_extract("url", "://[^/]*/([^/?#]*)/", 1).alias("toc_title"), R.html_to_text(F.col("html")).alias("text"))
    return X.merge_spine_sections(spine)
