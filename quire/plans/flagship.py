"""The flagship: documents to cleaned text with what was kept, its language, quality and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import reading as R
from quire.functions import text as T
from quire.operators import lines as L
from quire.plans import registry as S
from quire.plans.registry import query, read
from quire.plans.text_queries import _LOW, _REPEATED, _ROLL

_GONE = f"({_REPEATED} OR {S.noise()})"
_SQL = f"""WITH {S.LINES}, k AS (SELECT *, {S.line_key('line')} AS line_key, count(*) OVER (PARTITION BY doc_id, {S.line_key('line')}) AS n FROM ln),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT {_GONE}) AS kept_lines, coalesce(string_agg(CASE WHEN NOT {_GONE} THEN line END, chr(10) ORDER BY line_no), '') AS raw FROM k GROUP BY 1),
t AS (SELECT doc_id, n_lines, kept_lines, {S.readable('raw')} AS text FROM g)
SELECT t.doc_id, n_lines, kept_lines, md5(t.text) AS text_md5, {S.meaningful('t.text')} AS meaningful, {S.language('t.text')} AS lang, {S.meaningful('text')} < {L.MIN_TEXT_CHARS} OR {_LOW} AS needs_ocr,
  'book-' || lower(to_base(CAST({_ROLL.format(start=5381, seed="(coalesce(s, '') || '::TXT::' || length(t.text))", factor=33)} AS BIGINT), 36)) AS book_id
FROM t JOIN (SELECT doc_id, source AS s FROM documents) USING (doc_id)"""


def clean_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_lines, kept_lines, text``: one shuffle on doc_id serves the repeats, the edges and the join back."""
    lines = docs.select("doc_id", "source", F.posexplode(F.split(T.normalize_line_breaks(F.col("text")), "\n")).alias("line_no", "line")).repartition("doc_id")
    flagged = L.flag_repeated(L.edge_rank(lines))
    kept = ~(F.col("repeated") | L.is_noise(F.col("line"), F.col("near_edge")))
    parts = F.array_sort(F.collect_list(F.when(kept, F.struct("line_no", "line"))))
    rows = flagged.groupBy("doc_id", "source").agg(F.count("*").alias("n_lines"), F.count_if(kept).alias("kept_lines"), F.array_join(F.transform(parts, lambda x: x.line), "\n").alias("raw"))
    return rows.select("doc_id", "source", "n_lines", "kept_lines", T.normalize_readable(F.col("raw")).alias("text"))


@query("flagship", _SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    rows = clean_documents(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return rows.select("doc_id", "n_lines", "kept_lines", F.md5(c).alias("text_md5"), T.count_meaningful(c).alias("meaningful"), T.detect_lang(c).alias("lang"), L.needs_ocr(c).alias("needs_ocr"), R.book_id(F.col("source"), F.lit("TXT"), F.length(c)).alias("book_id"))
