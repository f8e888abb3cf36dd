"""Sections from pages and their normal form."""

from pyspark.sql import functions as F

from quire.operators import sections as X
from quire.operators.lines import explode_lines


def test_pages_to_sections(spark):
    pages = spark.createDataFrame(
        [("b", 1, "第一章 渡口\n老人把船停在岸边，等着", False), ("b", 2, "第一批赶集的人。", True), ("b", 3, "第二章 山路\n雪盖住了脚印。", False)],
        "doc_id string, page_number int, text string, ocr_used boolean",
    )
    got = X.split_sections_by_pages(pages).orderBy("section_no").collect()
    assert [r.title for r in got] == ["第一章 渡口", "第二章 山路"]
    assert "停在岸边，等着第一批" in got[0].text and got[0].source_hint == "第 1 - 2 页 · OCR 1 页"


def test_markdown_headings(spark):
    text = "前面的话\n# 第一章 早市\n内容一。\n# 第二章 山路\n内容二。\n# 第三章 灯火\n内容三。"
    got = X.split_sections_by_heading(explode_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))).orderBy("section_no").collect()
    assert [r.title for r in got] == ["第一章 早市", "第二章 山路", "第三章 灯火"] and got[0].text == "内容一。"


def test_page_heading(spark):
    rows = [("第三章 石板路\n正文",), ("Chapter 5 A Long Road\ntext",), ("just text",)]
    got = [r.h for r in spark.createDataFrame(rows, "t string").select(X.detect_page_heading(F.col("t")).alias("h")).collect()]
    assert got == ["第三章 石板路", "Chapter 5 A Long Road", None]


def test_merge_short_sections(spark):
    rows = [(1, 1, "Chapter 1", "豆子剥完了。", "a"), (1, 2, "桂花", "灯亮了起来。", "b"), (1, 3, "井水", "x" * 3000, "c")]
    got = X.merge_short_sections(spark.createDataFrame(rows, "doc_id int, section_no int, title string, text string, source_hint string")).orderBy("section_no").collect()
    assert [(r.title, r.source_hint) for r in got] == [("桂花", "a · b"), ("井水", "c")] and got[0].text == "豆子剥完了。\n\n灯亮了起来。"
