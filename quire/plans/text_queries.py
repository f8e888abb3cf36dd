"""Queries over documents, lines and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import reading as R
from quire.functions import text as T
from quire.operators import lines as L
from quire.plans import registry as S
from quire.plans.registry import q, query, read
from quire.sources.books import fallback_file_key, read_spine, read_text_items, read_toc, route_formats


@query(
    "b01_b12_cleaning",
    f"""SELECT doc_id, md5({S.breaks('text')}) AS breaks, md5({S.whitespace('text')}) AS whitespace, md5({S.readable('text')}) AS readable,
  md5({S.heading('text')}) AS heading, md5({S.rr(f"lower({S.heading('text')})", f'[^a-z0-9{T.CJK}]+')}) AS section_key, md5({S.line_key('text')}) AS line_key FROM documents""",
)
def cleaning(spark, sf_dir):
    c = F.col("text")
    both = {"breaks": T.normalize_line_breaks(c), "whitespace": T.normalize_whitespace(c), "readable": T.normalize_readable(c), "heading": T.clean_heading(c), "section_key": T.section_key(c), "line_key": T.line_key(c)}
    return read(spark, sf_dir, "documents").select("doc_id", *(F.md5(x).alias(k) for k, x in both.items()))


@query(
    "b13_b16_counts",
    f"""SELECT doc_id, {S.meaningful('text')} AS meaningful, round({S.symbols('text', 'line')}, 9) AS line_symbols, round({S.symbols('text', 'page')}, 9) AS page_symbols,
  round({S.symbols('text', 'candidate')}, 9) AS candidate_symbols, {S.language('text')} AS lang, {S.strong('text')} AS strong, {S.has(S.trim('text'), T.STRONG_END_DOT)} AS strong_dot FROM documents""",
)
def counts(spark, sf_dir):
    c = F.col("text")
    compact = T.replace(c, f"{T.WS}+", "")
    ratios = [F.round(T.symbol_ratio(c, v, compact), 9).alias(f"{v}_symbols") for v in ("line", "page", "candidate")]
    return read(spark, sf_dir, "documents").select("doc_id", T.count_meaningful(c).alias("meaningful"), *ratios, T.detect_lang(c).alias("lang"), T.has_strong_ending(c).alias("strong"), T.has_strong_ending(c, dot_is_strong=True).alias("strong_dot"))


#: References of all kinds, put in by rule behind the documents' lines.
_MARKED = ["[{n}] ", "（{n}）", " ({n}, {n}) ", "¹²", "【{n}】"]
_MARK_SQL = "CASE line_no % 5 " + " ".join(f"WHEN {i} THEN {q(m)}" for i, m in enumerate(_MARKED)) + " END"


@query(
    "b05_b08_references",
    rf"""WITH {S.LINES}, m AS (SELECT doc_id, line_no, line, line || replace({_MARK_SQL}, '{{n}}', CAST(line_no % 90 + 1 AS VARCHAR)) || chr(10) || CASE WHEN line_no % 7 = 3 THEN 'References' || chr(10) || 'x' ELSE '' END AS t FROM ln),
n AS (SELECT *, {S.steps(S.rr(S.rr(S.breaks('t'), rf'(?m)^{T.WS}*[0-9]{{1,3}}{T.WS}*$', chr(10)), rf'(\A|\n){T.WS}*(?:[0-9]{{1,2}}|[\[(（【][0-9]{{1,3}}[\])）】])({T.WS}|["“‘(（【\[{T.CJK}A-Za-z])', chr(92) + '1' + chr(92) + '2'), [(T.BRACKET_REFERENCES, ''), (T.PAREN_REFERENCES, ''), (T.SUPERSCRIPTS, ''), ('[ \t]{2,}', ' '), (chr(10) + '{3,}', chr(10) * 2), *T.TRIM])} AS s FROM m)
SELECT doc_id, line_no, s AS stripped, {S.readable('s')} AS display, {S.rr('t', T.REFERENCE_SECTION)} AS cut FROM n WHERE NOT {S.has('line', rf'^{T.WS}*[0-9]|[(（【\[][0-9]')} """,
)
def references(spark, sf_dir):
    """The lines that the SQL can follow; ``b05_b08_all_lines`` has all."""
    return _references(_marked_lines(spark, sf_dir).filter(~T.has(F.col("line"), rf"^{T.WS}*[0-9]|[(（【\[][0-9]")))


@query("b05_b08_all_lines")
def all_references(spark, sf_dir):
    return _references(_marked_lines(spark, sf_dir))


def _marked_lines(spark, sf_dir):
    n = (F.col("line_no") % 90 + 1).cast("string")
    mark = R.lookup((F.col("line_no") % 5).cast("string"), {str(i): m for i, m in enumerate(_MARKED)}, F.lit(""))
    tail = F.when(F.col("line_no") % 7 == 3, "References\nx").otherwise("")
    return L.explode_lines(read(spark, sf_dir, "documents", "doc_id", "text")).withColumn("t", F.concat("line", F.replace(mark, F.lit("{n}"), n), F.lit("\n"), tail))


def _references(marked):
    t = F.col("t")
    return marked.select("doc_id", "line_no", T.strip_reference_artifacts(t).alias("stripped"), T.clean_display_text(t).alias("display"), T.cut_reference_section(t).alias("cut"))


@query(
    "b17_b21_line_flags",
    f"""WITH {S.LINES}, p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM
  (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 0 THEN '# Chapter ' || line_no WHEN line_no % 11 = 5 THEN 'Abstract: ' || line WHEN line_no % 13 = 6 THEN 'Chapter ' || line_no || ' ' || substr(line, 1, 12) ELSE line END AS line FROM ln))
SELECT doc_id, line_no, {S.has('line', T.HEADING)} AS heading, {S.short_heading('line')} AS short_heading, {S.hard_break('line')} AS hard_break, {S.standalone('line')} AS standalone,
  coalesce({S.needs_space('line', 'nxt')}, false) AS spaced, md5(line || CASE WHEN {S.needs_space('line', 'nxt')} THEN ' ' ELSE '' END || nxt) AS joined FROM p""",
)
def line_flags(spark, sf_dir):
    from pyspark.sql import Window as W

    n, line = F.col("line_no"), F.col("line")
    marked = F.when(n % 7 == 0, F.concat(F.lit("# Chapter "), n.cast("string"))).when(n % 11 == 5, F.concat(F.lit("Abstract: "), line)).when(n % 13 == 6, F.concat(F.lit("Chapter "), n.cast("string"), F.lit(" "), F.substring(line, 1, 12))).otherwise(line)
    lines = L.explode_lines(read(spark, sf_dir, "documents", "doc_id", "text")).withColumn("line", marked)
    lines = lines.withColumn("nxt", F.lead("line").over(W.partitionBy("doc_id").orderBy("line_no")))
    c, nxt = F.col("line"), F.col("nxt")
    return lines.select("doc_id", "line_no", T.is_heading_line(c).alias("heading"), T.is_short_heading(c).alias("short_heading"), T.is_hard_break(c).alias("hard_break"), T.is_standalone(c).alias("standalone"), F.coalesce(T.needs_space(c, nxt), F.lit(False)).alias("spaced"), F.md5(T.join_text(c, nxt)).alias("joined"))


_A, _B = S.trim("a"), S.trim("b")


@query(
    "b18_join_flowing",
    f"""WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role) AS b FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN {_A} = '' THEN {_B} WHEN {_B} = '' THEN {_A} WHEN {S.strong('a')} OR {S.short_heading(f"string_split({_A}, chr(10))[-1]")} OR {S.has(f"string_split({_B}, chr(10))[1]", T.HEADING)} THEN {_A} || chr(10) || chr(10) || {_B}
  WHEN {S.needs_space('a', 'b')} THEN {_A} || ' ' || {_B} ELSE {_A} || {_B} END) AS joined FROM p WHERE b IS NOT NULL""",
)
def flowing(spark, sf_dir):
    from pyspark.sql import Window as W

    turns = read(spark, sf_dir, "conversations").withColumn("b", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn", "role")))
    return turns.filter("b IS NOT NULL").select("conv_id", "turn", F.md5(T.join_flowing(F.col("text"), F.col("b"))).alias("joined"))


_TITLES = ["Chapter {n} The Storm", "第{n}章 起航", "section {n}", "目录", "正文", "{line}", "Contents", ""]
_TITLE_SQL = "replace(replace(CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(_TITLES)) + " END, '{n}', CAST(doc_id % 40 AS VARCHAR)), '{line}', string_split(text, chr(10))[1])"
_GENERIC = f"({S.heading('title')} = '' OR {S.has(S.heading('title'), T.GENERIC_TITLE_WORD)} OR {S.has(S.heading('title'), T.GENERIC_TITLE_WORD_CN)})"
_FIRST = S.whitespace("string_split(text, chr(10))[1]")


@query(
    "b22_b25_titles",
    f"""WITH d AS (SELECT doc_id, source, {_TITLE_SQL} AS title, CASE WHEN length({_FIRST}) > 30 THEN {S.trim(f'substr({_FIRST}, 1, 30)')} || '…' ELSE {_FIRST} END AS preview FROM documents WHERE text IS NOT NULL)
SELECT doc_id, title, preview, {S.has(S.heading('title'), T.MAJOR_TITLE)} AS major, {_GENERIC} AS generic,
  CASE WHEN {S.heading('title')} <> '' AND NOT {S.has(S.heading('title'), T.BOILERPLATE_TITLE)} AND NOT {_GENERIC} THEN {S.heading('title')} WHEN preview <> '' THEN preview ELSE '正文 · ' || doc_id END AS resolved,
  CASE WHEN doc_id % 3 = 0 OR source = 'src' || doc_id THEN source ELSE source || ' · ' || 'src' || doc_id END AS hint FROM d""",
)
def titles(spark, sf_dir):
    n = (F.col("doc_id") % 40).cast("string")
    first = F.split("text", "\n")[0]
    title = F.replace(F.replace(R.lookup((F.col("doc_id") % 8).cast("string"), {str(i): t for i, t in enumerate(_TITLES)}, F.lit("")), F.lit("{n}"), n), F.lit("{line}"), first)
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "source", title.alias("title"), T.preview(first).alias("preview"))
    t = F.col("title")
    other = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.concat(F.lit("src"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", "title", "preview", T.is_major_title(t).alias("major"), T.is_generic_title(t).alias("generic"), T.resolve_title(t, F.col("preview"), F.col("doc_id")).alias("resolved"), T.merge_source_hint(F.col("source"), other).alias("hint"))


_EXT = "lower(string_split(url, '.')[-1])"


def _case(e: str, values: dict, default: str) -> str:
    return f"CASE {e} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {default} END"


@query(
    "a03_b10_b26_paths",
    f"""SELECT page_id, {S.rr('url', r'\.[^.]+\z')} AS stem, {_EXT} AS extension, {_case(_EXT, R.MIME_TYPES, q('application/octet-stream'))} AS mime, {_case(_EXT, R.FORMATS, 'NULL')} AS format,
  {_case(_EXT, R.FORMATS, 'NULL')} IS NULL AS rejected, lower({S.trim(S.steps("string_split(url, '#')[1]", R.NORMAL_HREF))}) AS href
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '.TXT' WHEN 1 THEN './' || url || '#x.epub' WHEN 2 THEN url || '.md' ELSE url END AS url FROM pages)""",
)
def paths(spark, sf_dir):
    u, n = F.col("url"), F.col("page_id") % 4
    marked = F.when(n == 0, F.concat(u, F.lit(".TXT"))).when(n == 1, F.concat(F.lit("./"), u, F.lit("#x.epub"))).when(n == 2, F.concat(u, F.lit(".md"))).otherwise(u)
    fine, bad = route_formats(read(spark, sf_dir, "pages", "page_id", "url").withColumn("url", marked), "url")
    pages = fine.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)), allowMissingColumns=True)
    return pages.select("page_id", R.strip_extension(u).alias("stem"), R.get_extension(u).alias("extension"), R.guess_mime(u).alias("mime"), "format", "rejected", R.normalize_href(u).alias("href"))


def _unescaped(rows: str, key: str) -> str:
    """SQL of ``key, text`` from ``rows`` (``key, text``) with character references put in."""
    names = ", ".join(f"({q(n)}, {q(c)})" for n, c in R.REFERENCES.items())
    odd = " ".join(f"WHEN {n} THEN chr({ord(c)})" for n, c in R.ODD_NUMBERS.items())
    bare = "^(?:" + "|".join(R.BARE_REFERENCES) + ")"
    return f"""WITH d AS ({rows}), cut AS (SELECT {key}, string_split(text, '&') AS l FROM d), p AS (SELECT {key}, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM cut), refs(name, c) AS (VALUES {names}),
n AS (SELECT *, regexp_extract(x, '^#(?:[0-9]+|[xX][0-9a-fA-F]+);?') AS number, regexp_extract(x, '^[^\\t\\n\\f <&#;]{{1,32}};?') AS name, regexp_extract(x, '{bare}') AS bare, regexp_extract(x, '^#0*([0-9]*)', 1) AS dec, regexp_extract(x, '^#[xX]0*([0-9a-fA-F]*)', 1) AS hex FROM p),
v AS (SELECT *, CASE WHEN number SIMILAR TO '#[xX].*' THEN CASE WHEN hex = '' THEN 0 WHEN length(hex) <= 8 THEN list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(lower(hex), ''), lambda z: CAST(instr('0123456789abcdef', z) - 1 AS BIGINT))), lambda s, z: s * 16 + z) ELSE 1114112 END
  WHEN dec = '' THEN 0 WHEN length(dec) <= 9 THEN CAST(dec AS BIGINT) ELSE 1114112 END AS c FROM n),
o AS (SELECT v.{key}, v.i, CASE WHEN v.i = 1 THEN x WHEN number <> '' THEN (CASE v.c {odd} ELSE CASE WHEN v.c > 1114111 OR v.c BETWEEN 55296 AND 57343 THEN chr(65533) WHEN v.c BETWEEN 1 AND 8 OR v.c = 11 OR v.c BETWEEN 14 AND 31 OR v.c = 127 OR v.c BETWEEN 64976 AND 65007 OR v.c % 65536 >= 65534 THEN '' ELSE chr(CAST(v.c AS INTEGER)) END END) || x[length(number) + 1:]
  WHEN v.name <> '' THEN coalesce(a.c || x[length(v.name) + 1:], b.c || x[length(bare) + 1:], '&' || x) ELSE '&' || x END AS piece FROM v LEFT JOIN refs AS a ON a.name = v.name LEFT JOIN refs AS b ON b.name = v.bare)
SELECT {key}, string_agg(piece, '' ORDER BY i) AS text FROM o GROUP BY {key}"""


@query("b27_html_to_text", _unescaped(f"SELECT page_id, {S.steps('html', R.HTML_TO_TEXT)} AS text FROM pages", "page_id"))
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", R.html_to_text(F.col("html")).alias("text"))


_REFERENCES = list(R.REFERENCES)


@query("b27_references", _unescaped(f"SELECT doc_id, text || ' a&#' || doc_id * 37 % 1200000 || ';b&#x' || lower(to_base(doc_id * 91 % 70000, 16)) || '&#' || doc_id % 200 || ' &' || [{', '.join(map(q, _REFERENCES))}][doc_id % {len(_REFERENCES)} + 1] || 'tail; &' || [{', '.join(map(q, _REFERENCES))}][doc_id * 7 % {len(_REFERENCES)} + 1] AS text FROM documents WHERE text IS NOT NULL", "doc_id"))
def references(spark, sf_dir):
    """Texts with references of every kind behind them: in range, out of it, odd, named, named without end."""
    d, names = F.col("doc_id"), F.split(F.lit(" ".join(_REFERENCES)), " ")
    name = lambda n: F.get(names, (n % len(_REFERENCES)).cast("int"))
    text = F.concat("text", F.lit(" a&#"), (d * 37 % 1_200_000).cast("string"), F.lit(";b&#x"), F.lower(F.hex(d * 91 % 70_000)), F.lit("&#"), (d % 200).cast("string"), F.lit(" &"), name(d), F.lit("tail; &"), name(d * 7))
    return read(spark, sf_dir, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", R.unescape(text).alias("text"))


_ROLL = "list_reduce(list_prepend(CAST({start} AS HUGEINT), list_transform(string_split({seed}, ''), lambda c: CAST(CASE WHEN c = '' THEN 0 ELSE unicode(c) END AS HUGEINT))), lambda a, c: (a * {factor} + c) % 4294967296)"
_SEED = "(source || '::' || coalesce(lang, '') || '::' || coalesce(n_chars, 0))"


@query(
    "a06_b32_ids",
    f"""SELECT doc_id, 'book-' || lower(to_base(CAST({_ROLL.format(start=5381, seed=_SEED, factor=33)} AS BIGINT), 36)) AS book_id,
  'library-cover-c' || ({_ROLL.format(start=0, seed='source', factor=31)} % 6) AS cover, substr(sha256(coalesce(text, '')), 1, 32) AS file_key FROM documents""",
)
def ids(spark, sf_dir):
    from quire.sources.books import file_key

    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", R.book_id(F.col("source"), F.col("lang"), F.col("n_chars")).alias("book_id"), R.cover_class(F.col("source")).alias("cover"), file_key(F.coalesce("text", F.lit(""))).alias("file_key"))


@query("c01_noise_lines", f"WITH {S.LINES} SELECT doc_id, line_no, line FROM ln WHERE NOT coalesce({S.noise()}, false)")
def noise_lines(spark, sf_dir):
    return L.drop_noise_lines(L.explode_lines(read(spark, sf_dir, "documents", "doc_id", "text")))


_KEYED = f"k AS (SELECT *, {S.line_key('line')} AS line_key, count(*) OVER (PARTITION BY doc_id, {S.line_key('line')}) AS n FROM ln)"
_REPEATED = f"(n >= 2 AND line_key <> '' AND length({S.whitespace('line')}) <= {T.REPEATED_LINE_CHARS})"


@query("c02_repeated_lines", f"WITH {S.LINES}, {_KEYED} SELECT doc_id, line_no, line FROM k WHERE NOT {_REPEATED} AND NOT {S.noise()}")
def repeated_lines(spark, sf_dir):
    return L.drop_repeated_lines(L.explode_lines(read(spark, sf_dir, "documents", "doc_id", "text")))


@query(
    "c02_repeated_lines_corpus",
    f"""WITH {S.LINES}, k AS (SELECT *, {S.line_key('line')} AS line_key FROM ln), f AS (SELECT line_key, count(DISTINCT doc_id) AS n FROM k WHERE line_key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, line_no, line FROM k LEFT JOIN f USING (line_key) WHERE NOT (n IS NOT NULL AND length({S.whitespace('line')}) <= {T.REPEATED_LINE_CHARS}) AND NOT {S.noise()}""",
)
def repeated_lines_corpus(spark, sf_dir):
    return L.drop_repeated_lines(L.explode_lines(read(spark, sf_dir, "documents", "doc_id", "text")), scope="corpus", min_count=3)


@query("f02_line_key_counts", f"WITH {S.LINES} SELECT {S.line_key('line')} AS line_key, count(*) AS n FROM ln WHERE {S.line_key('line')} <> '' GROUP BY 1")
def key_counts(spark, sf_dir):
    return L.line_key_counts(L.explode_lines(read(spark, sf_dir, "documents", "doc_id", "text")))


_BLOCKS = f"""bk AS (SELECT doc_id, CAST(g.i - 1 AS INTEGER) AS block_no, l[g.i] AS block FROM (SELECT doc_id, regexp_split_to_array({S.breaks(f"replace(text, '.' || chr(10), '.' || chr(10) || chr(10))")}, '\\n{{2,}}') AS l FROM documents) AS d, unnest(generate_series(1, len(l))) AS g(i))"""
_BLOCK_LINES = f"list_filter(list_transform(string_split(block, chr(10)), lambda x: {S.trim('x')}), lambda x: x <> '')"
_TOC = f"(len({_BLOCK_LINES}) >= 2 AND len(list_filter({_BLOCK_LINES}, lambda x: {S.has('x', T.TOC_LINE)})) >= 2 AND len(list_filter({_BLOCK_LINES}, lambda x: {S.has('x', T.TOC_LINE)})) >= ceil(len({_BLOCK_LINES}) * 0.6))"


def _blocks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.replace("text", F.lit(".\n"), F.lit(".\n\n")))
    return L.explode_blocks(docs)


@query("c04_toc_blocks", f"WITH {_BLOCKS} SELECT doc_id, block_no, {_TOC} AS is_toc FROM bk")
def toc_blocks(spark, sf_dir):
    return L.flag_toc_blocks(_blocks(spark, sf_dir)).select("doc_id", "block_no", "is_toc")


@query(
    "c06_f04_wrapped_blocks",
    f"""WITH {_BLOCKS}, x AS (SELECT doc_id, block_no, unnest({_BLOCK_LINES}) AS line FROM bk),
a AS (SELECT doc_id, block_no, count(*) AS n_lines, avg(length(line)) AS avg_len, count(*) FILTER (length(line) <= 4) AS tiny, count(*) FILTER (length(line) <= 48) AS short, count(*) FILTER (NOT {S.strong('line')}) AS soft FROM x GROUP BY 1, 2)
SELECT * REPLACE (round(avg_len, 6) AS avg_len), n_lines >= 3 AND (avg_len <= 52 OR short >= ceil(n_lines * 0.6) OR soft >= ceil(n_lines * 0.5)) AS wrapped FROM a""",
)
def wrapped_blocks(spark, sf_dir):
    lines = _blocks(spark, sf_dir).select("doc_id", "block_no", F.explode(F.split("block", "\n")).alias("line")).withColumn("line", T.js_trim(F.col("line"))).filter("line <> ''")
    return L.flag_wrapped_blocks(lines, "doc_id", "block_no").withColumn("avg_len", F.round("avg_len", 6))


_LOW_LINES = f"list_filter(list_transform(string_split({S.breaks('text')}, chr(10)), lambda x: {S.trim('x')}), lambda x: x <> '')"
_COMPACT = S.rr(S.whitespace("text"), T.WS)
_LOW = f"""({S.whitespace('text')} = '' OR {S.has(S.whitespace('text'), L.MOJIBAKE)} OR (length({_COMPACT}) >= 30 AND {S.meaningful('text')} / length({_COMPACT})::DOUBLE < 0.45) OR {S.symbols(S.whitespace('text'), 'page')} > 0.32
  OR (len({_LOW_LINES}) >= 8 AND len(list_filter({_LOW_LINES}, lambda x: {S.meaningful('x')} <= 2)) / len({_LOW_LINES})::DOUBLE > 0.45) OR (len({_LOW_LINES}) >= 12 AND list_sum(list_transform({_LOW_LINES}, lambda x: length(x))) / len({_LOW_LINES})::DOUBLE < 5))"""


@query("c07_c08_text_quality", f"SELECT doc_id, {_LOW} AS low_quality, {S.meaningful('text')} < {L.MIN_TEXT_CHARS} OR {_LOW} AS needs_ocr FROM documents")
def text_quality(spark, sf_dir):
    c = F.col("text")
    judged = read(spark, sf_dir, "documents").select("doc_id", "text", L.low_quality(c).alias("low_quality"))
    return judged.select("doc_id", "low_quality", L.needs_ocr(c, low=F.col("low_quality")).alias("needs_ocr"))


@query("c12_f07_rejoined", f"WITH {S.LINES} SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text FROM ln WHERE {S.trim('line')} <> '' GROUP BY 1")
def rejoined(spark, sf_dir):
    lines = L.non_empty(L.explode_lines(read(spark, sf_dir, "documents", "doc_id", "text")), "line")
    return L.concat_ordered(lines, "doc_id", "line_no", "line", "\n").withColumn("line", F.md5("line")).withColumnRenamed("line", "text")


@query("a06_fallback_keys", f"""SELECT page_id, 'meta-' || lower(to_base(CAST({_ROLL.format(start=5381, seed="(url || '::' || length(html) || '::' || coalesce(page_id * 1000, 0))", factor=33)} AS BIGINT), 36)) || '-' || length(html) AS file_key FROM pages""")
def fallback_keys(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return pages.select("page_id", fallback_file_key(F.col("url"), F.length("html"), F.col("page_id") * 1000).alias("file_key"))


@query("a05_spine_and_toc", """SELECT 'b' || page_id // 10 AS doc_id, CAST(page_id % 10 AS INTEGER) AS spine_index, url AS href, length(html) AS chars, CASE WHEN page_id % 3 = 0 THEN 'Entry ' || page_id END AS label FROM pages""")
def spine_and_toc(spark, sf_dir):
    """Both tables written and read again by their readers; other columns of the files are left aside."""
    from quire.plans.stream_queries import place_for

    place = place_for(spark, "spine")
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    book = F.concat(F.lit("b"), F.floor(F.col("page_id") / 10).cast("string")).alias("doc_id")
    at = (F.col("page_id") % 10).cast("int")
    pages.select(book, at.alias("spine_index"), F.col("url").alias("href"), "html", F.lit(1).alias("more")).write.parquet(f"{place}/spine")
    pages.filter("page_id % 3 = 0").select(book, F.array(at).alias("path"), F.concat(F.lit("Entry "), F.col("page_id").cast("string")).alias("label"), F.col("url").alias("href")).write.parquet(f"{place}/toc")
    spine, toc = read_spine(spark, f"{place}/spine"), read_toc(spark, f"{place}/toc").withColumn("spine_index", F.get("path", F.lit(0)))
    return spine.join(toc.drop("path", "href"), ["doc_id", "spine_index"], "left").select("doc_id", "spine_index", "href", F.length("html").alias("chars"), "label")


@query("a04_d01_read_items", "SELECT 'v' || vec_id AS doc_id, count(*) AS items, count(*) FILTER (i % 4 <> 1) AS visible FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY vec_id")
def read_items(spark, sf_dir):
    """Components of vectors as items of a page, blank ones among them, through the reader of items."""
    from quire.plans.stream_queries import place_for

    path = place_for(spark, "items")
    items = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    items.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("doc_id"), F.lit(1).alias("page_number"), F.col("i").alias("item_no"), F.when(F.col("i") % 4 == 0, " ").otherwise("w").alias("str"), F.col("x").cast("double").alias("x"), F.lit(0.0).alias("y")).write.parquet(path)
    return read_text_items(spark, path).groupBy("doc_id").agg(F.count("*").alias("items"), F.count_if(T.js_trim(F.col("str")) != "").alias("visible"))


@query("b33_section_labels", """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '第 ' || (doc_id % 7 + 1) || ' 章' ELSE '正文' END || ' · ' || source || CASE WHEN coalesce(lang, '') <> '' AND lang <> source THEN ' · ' || lang ELSE '' END || ' · ' || n_chars || ' 段' AS label FROM documents""")
def section_labels(spark, sf_dir):
    d = F.col("doc_id")
    label = R.section_label(d % 7, d % 3 + 1, F.col("source"), F.col("lang"), F.col("n_chars"))
    return read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars").select("doc_id", label.alias("label"))
