"""Queries over segments, sentences, paragraphs and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import segments as G
from quire.plans import registry as S
from quire.plans.registry import query, read

_SEGMENTS = f"list_filter(list_transform(string_split({S.steps(S.rr(S.readable('text'), chr(10) + '+', ' '), S.groups(G.SEGMENT_STEPS))}, chr(1)), lambda x: {S.whitespace('x')}), lambda x: x <> '')"
_KEEPS = "((" + S.has("b", r"[0-9]\.\z") + " AND " + S.has("t", r"\A[0-9]") + ") OR (" + S.has("b", G.SHORT_WORD_PERIOD) + " AND " + S.has("t", r"\A[a-z]") + ") OR " + " OR ".join(S.has("b", p) for p in G.KEEPS_PERIOD) + ")"
_MERGE = S.gather("sg", f"NOT (x.keeps OR NOT s.strong OR (s.len < {G.SHORT_FRAGMENT} AND NOT s.alone) OR x.continues)", {"keeps": _KEEPS, "continues": S.has("t", G.CONTINUES)}, "st")
_SENTENCES = f"WITH RECURSIVE sg AS (SELECT doc_id AS k, {_SEGMENTS} AS l FROM documents), {_MERGE}"


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text")


@query("d02_d03_segments", f"SELECT doc_id, CAST(g.i - 1 AS INTEGER) AS segment_no, l[g.i] AS segment FROM (SELECT doc_id, {_SEGMENTS} AS l FROM documents), unnest(generate_series(1, len(l))) AS g(i)")
def segments(spark, sf_dir):
    return G.exploded(_docs(spark, sf_dir).withColumn("s", G.segments(F.col("text"))), "s", "segment_no", "segment", "doc_id")


@query("d04_sentences", f"{_SENTENCES} SELECT k AS doc_id, CAST(g - 1 AS INTEGER) AS sentence_no, t AS sentence FROM st_g")
def sentences(spark, sf_dir):
    staged = G.sentences(_docs(spark, sf_dir), "text", "s")
    return G.exploded(staged, "s", "sentence_no", "sentence", "doc_id")


_BUCKET_NEW = f"NOT ((s.len < {G.MIN_PARAGRAPH} OR x.len < {G.SHORT_SENTENCE} OR s.len + CASE WHEN x.space THEN 1 ELSE 0 END + x.len <= {G.IDEAL_PARAGRAPH} OR NOT s.strong) AND s.len + CASE WHEN x.space THEN 1 ELSE 0 END + x.len <= {G.MAX_PARAGRAPH})"
_SEGMENT_LISTS = f"sl AS (SELECT doc_id AS k, {_SEGMENTS} AS l FROM documents)"


@query("d07_bucketed_paragraphs", f"WITH RECURSIVE {_SEGMENT_LISTS}, {S.gather('sl', _BUCKET_NEW, {}, 'pg')} SELECT k AS doc_id, CAST(g - 1 AS INTEGER) AS paragraph_no, md5(t) AS text FROM pg_g")
def bucketed(spark, sf_dir):
    staged = _docs(spark, sf_dir).withColumn("p", G.segments(F.col("text")))
    return G.exploded(G.bucket_sentences(staged, "p", "s"), "s", "paragraph_no", "t", "doc_id").select("doc_id", "paragraph_no", F.md5("t").alias("text"))


_LINE_LIST = f"list_filter(list_transform(string_split({S.breaks('text')}, chr(10)), lambda x: {S.whitespace('x')}), lambda x: x <> '' AND NOT {S.has('x', '[0-9¹²³]')})"


@query("d08_tiny_paragraphs", f"WITH RECURSIVE tl AS (SELECT doc_id AS k, {_LINE_LIST} AS l FROM documents), {S.gather('tl', f'NOT (x.len < {G.MIN_PARAGRAPH} AND s.len < {G.MAX_PARAGRAPH} AND NOT x.standalone)', {}, 'tp')} SELECT k AS doc_id, CAST(g - 1 AS INTEGER) AS paragraph_no, md5(t) AS text FROM tp_g")
def tiny(spark, sf_dir):
    """The lines that the SQL can follow; ``d08_all_lines`` has all."""
    return _tiny(spark, sf_dir, lambda x: (x != "") & ~x.rlike("[0-9¹²³]"))


@query("d08_all_lines")
def tiny_everywhere(spark, sf_dir):
    return _tiny(spark, sf_dir, lambda x: x != "")


def _tiny(spark, sf_dir, taken):
    lines = F.filter(F.transform(F.split(T.normalize_line_breaks(F.col("text")), "\n"), T.normalize_whitespace), taken)
    staged = G.merge_tiny_paragraphs(_docs(spark, sf_dir).withColumn("l", lines), "l", "s")
    return G.exploded(staged, "s", "paragraph_no", "t", "doc_id").select("doc_id", "paragraph_no", F.md5("t").alias("text"))


_UNIT_LANG = f"CASE WHEN x.lang <> s.lang AND x.len <= {G.STICKY_CHARS} THEN s.lang ELSE x.lang END"
_UNITS = S.gather("sl", f"({_UNIT_LANG}) <> s.lang OR s.len >= {G.UNIT_MAX} OR (s.len >= {G.UNIT_IDEAL} AND s.strong)", {"lang": S.language("t")}, "un", {"lang": ("lang", f"CASE WHEN xlang <> slang AND xlen <= {G.STICKY_CHARS} THEN slang ELSE xlang END")})


@query("d20_e06_units", f"WITH RECURSIVE {_SEGMENT_LISTS}, {_UNITS} SELECT k AS doc_id, CAST(g - 1 AS INTEGER) AS unit_no, CAST(first - 1 AS INTEGER) AS first, CAST(size AS INTEGER) AS size, md5(t) AS text FROM un_g")
def units(spark, sf_dir):
    staged = G.build_units(_docs(spark, sf_dir).withColumn("s", G.segments(F.col("text"))), "s")
    return G.exploded(staged, "units", "unit_no", "u", "doc_id").select("doc_id", "unit_no", "u.first", "u.size", F.md5("u.text").alias("text"))


@query(
    "d21_boundaries",
    f"""WITH {_SEGMENT_LISTS}, e AS (SELECT k, CAST(g.i - 1 AS INTEGER) AS no, l[g.i] AS t, CASE WHEN g.i > 1 AND g.i > CASE WHEN k % 3 < len(l) THEN k % 3 ELSE 0 END + 1 THEN {S.needs_space('l[g.i - 1]', 'l[g.i]')} ELSE false END AS space, len(l) AS n FROM sl, unnest(generate_series(1, len(l))) AS g(i)),
f AS (SELECT * FROM e WHERE no >= CASE WHEN k % 3 < n THEN k % 3 ELSE 0 END)
SELECT k AS doc_id, no AS sentence_no, CAST(sum(length(t) + CASE WHEN space THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY no) - length(t) AS INTEGER) AS start FROM f""",
)
def boundaries(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", G.segments(F.col("text")).alias("sentences"), F.lit(0).alias("first"), (F.col("doc_id") % 3).cast("int").alias("from_no"))
    return G.exploded(G.slice_unit(rows, "from_no"), "boundaries", "n", "b", "doc_id").select("doc_id", "b.sentence_no", "b.start")


@query(
    "d22_g03_g04_sentence_map",
    f"""WITH RECURSIVE pl AS (SELECT doc_id, CAST(g.i - 1 AS INTEGER) AS paragraph_no, l[g.i] AS text FROM (SELECT doc_id, string_split({S.breaks('text')}, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) AS g(i)),
sg AS (SELECT doc_id || ':' || paragraph_no AS k, {_SEGMENTS} AS l FROM pl), {_MERGE},
n AS (SELECT CAST(split_part(k, ':', 1) AS BIGINT) AS doc_id, CAST(split_part(k, ':', 2) AS INTEGER) AS paragraph_no, g, t FROM st_g),
m AS (SELECT doc_id, paragraph_no, md5(t) AS sentence, length(t) AS chars, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_no, g) - 1 AS INTEGER) AS sentence_no FROM n)
SELECT doc_id, paragraph_no, sentence, sentence_no, min(sentence_no) OVER (PARTITION BY doc_id, paragraph_no) AS starts_at, CAST(coalesce(sum(chars) OVER (PARTITION BY doc_id ORDER BY sentence_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM m""",
)
def sentence_map(spark, sf_dir):
    from quire.operators.progress import chars_before

    paragraphs = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(T.normalize_line_breaks(F.col("text")), "\n")).alias("paragraph_no", "text"))
    mapped = chars_before(G.sentence_map(paragraphs, "doc_id"), "doc_id")
    return mapped.withColumn("sentence", F.md5("sentence"))


@query(
    "d23_i03_quick_points",
    """SELECT doc_id, CASE WHEN n <= 5 THEN list_transform(generate_series(0, n - 1), lambda x: CAST(x AS INTEGER)) ELSE list_sort(list_distinct(list_transform(generate_series(0, 4), lambda s: CAST(floor(s / 4.0 * (n - 1) + 0.5) AS INTEGER)))) END AS points
FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)""",
)
def points(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", G.quick_points(F.size(F.split("text", "\n"))).alias("points"))




@query("e06_sentence_units", f"WITH RECURSIVE {_SEGMENT_LISTS}, {_UNITS} SELECT k AS doc_id, CAST(x.s - 1 AS INTEGER) AS sentence_no, CAST(g - 1 AS INTEGER) AS unit_no FROM un_g, unnest(generate_series(first, first + size - 1)) AS x(s)")
def sentence_units(spark, sf_dir):
    staged = _docs(spark, sf_dir).withColumn("s", G.segments(F.col("text")))
    return G.units_of_sentences(G.build_units(staged, "s"), "units", "doc_id")
