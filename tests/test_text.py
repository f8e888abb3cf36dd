"""Cases of each rule, on tiny frames."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lines as L
from quire.operators import segments as G


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.clean_display_text, "据统计[7]，河水流量逐年减少（4），数据见表格²。", "据统计，河水流量逐年减少，数据见表格。"),
        (T.clean_display_text, "慢 慢 走 路 ，看 看 路 边 的 野 花 。", "慢慢走路，看看路边的野花。"),
        (T.strip_intra_cjk_space, "打开 Spark 任务 查看 日志", "打开 Spark 任务查看日志"),
        (T.normalize_readable, "第七章　河流　和　山谷", "第七章河流和山谷"),
        (T.has_strong_ending, "雨停了。", True),
        (T.has_strong_ending, "雨还没有停", False),
        (T.has_strong_ending, "“走吧。”", True),
        (T.is_major_title, "第八章 渡口", True),
        (T.is_major_title, "Chapter 9", True),
        (T.is_major_title, "桌上有一杯茶", False),
        (T.is_generic_title, "正文", False),
        (T.is_generic_title, "Chapter 5 A Long Road", True),
        (T.detect_lang, "山上的雪还没有化，路很滑。", "zh-CN"),
        (T.detect_lang, "A heron stood by the old mill.", "en-US"),
        (T.detect_lang, "駅前の本屋で地図を買いました。", "ja-JP"),
        (T.count_meaningful, "茶杯 cup 42 ……？", 7),
        (T.preview, "就这样。", "就这样。"),
        (T.line_key, "河岸通讯 第31/32/33号 双月合刊", "河岸通讯第###号双月合刊"),
    ],
)
def test_functions(spark, f, text, want):
    assert one(spark, text, f) == want


def test_speech_text(spark):
    got = one(spark, "她合上《河边旧事》——借来的册子（第9页），慢慢想了一会儿……", T.sanitize_for_speech)
    assert "河边旧事" in got and not set("《》—（）") & set(got)


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("门开了。没有人。风很大。", 1),
        ("Prof. Lind weighed the stone at 2.75 kg. It went back into the river that evening without a sound.", 1),
        ("山脚下的村子只有一条石板路，路的两边种着桂花树，每到九月整个村子都是甜的，连井水里也有香味。老人们坐在门口剥豆子，说的都是几十年前的事情，谁家盖了房子，谁家的牛走丢了又自己回来。等到天黑的时候，灯一盏一盏地亮起来，远远看去就像一串落在山谷里的星星，过路的人总要停下来看一看。", 3),
    ],
)
def test_sentences(spark, text, n):
    got = G.sentences(spark.createDataFrame([(text,)], "t string"), "t", "s").first().s
    assert len(got) == n and "".join(got).replace(" ", "") == text.replace(" ", "")


def test_paragraphs(spark):
    text = "A miller walked along the frozen\ncanal at dusk and counted\nthe boats that lay there.\n\n渡船的老人在天亮之前解开了缆绳，仔细地看了看水面上的薄雾，然后慢慢地把船撑到对岸，等着第一个赶集的人从山路上走下来，心里盘算着今年的收成和孩子们回家的日子。"
    got = G.split_paragraphs(spark.createDataFrame([(1, text)], "id int, text string"), "id").first().paragraphs
    assert len(got) == 2 and "canal at dusk and counted the boats" in got[0]


def test_repeated_lines(spark):
    text = "上游的水位比去年低。\n河岸通讯 第31/32/33号 双月合刊\n下游的桥下个月修好。\n河岸通讯 第34/35/36号 双月合刊"
    lines = L.explode_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [r.line for r in L.drop_repeated_lines(lines).orderBy("line_no").collect()] == ["上游的水位比去年低。", "下游的桥下个月修好。"]


def test_idempotence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL")
    for f in (T.normalize_whitespace, T.normalize_readable):
        assert docs.filter(f(f(F.col("text"))) != f(F.col("text"))).count() == 0
