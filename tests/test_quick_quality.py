"""Cheaper steps on whole texts against the plain ones that the SQL has."""

import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lines as L
from quire.operators import segments as G
from tests.test_quick_segments import PARTS, texts

MORE = [*PARTS, "MRN", "mrn", "Tel", "DOB", "vol", "Fax", "Nope", "\n", "\n\n", "\n\n\n", "\t", " ", "　", "\x02", "文", "□", "Ã", "%", "=", "*" * 9, "word " * 9]


def odd_texts(n: int) -> list[str]:
    r = random.Random(11)
    return ["", "No.ID.Ref.", "No. ID. x", "ID:7.No.8.", "\n\n\n\n", "a 　b"] + ["".join(r.choice(MORE) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_numbered_abbreviations_are_looked_for_by_two_letters(spark):
    """Each boundary between words tried all eight of them."""
    assert len(G.QUICK_STEPS[2][0]) > len(G.SEGMENT_STEPS[3][0]) and G.QUICK_STEPS[3:] == G.SEGMENT_STEPS[4:]
    df = spark.createDataFrame([(t,) for t in [*texts(10_000), *odd_texts(20_000)]], "t string")
    plain, now = (T.replace(F.col("t"), *step) for step in (G.SEGMENT_STEPS[3], G.QUICK_STEPS[2]))
    judged = df.select("t", plain.alias("plain"), now.alias("now"))
    assert judged.filter("plain <> now").count() == 0 and judged.filter("now <> t").count() > 5_000


def test_single_characters_are_replaced_without_a_regex(spark):
    steps = [*T.READABLE, ("\x02", ".")]
    df = spark.createDataFrame([(t,) for t in odd_texts(5_000)], "t string")
    plain = F.col("t")
    for step in steps:
        plain = T.replace(plain, *step)
    now = df.select(T.chain(F.col("t"), steps).alias("now"))
    assert now._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == len(steps) - 2
    assert df.filter(T.chain(F.col("t"), steps) != plain).count() == 0


def test_quality_of_text_is_as_counted_in_full(spark):
    """Symbols were counted behind a pass of their own over the text, characters of lines and of the page to the end."""
    df = spark.createDataFrame([(t,) for t in [*odd_texts(5_000), *("\n".join(x) for x in zip(*[iter(odd_texts(20_000))] * 12, strict=False))]], "t string")
    c = F.col("t")
    t, lines = T.normalize_whitespace(c), L._lines_of(c)
    n, compact = F.greatest(F.size(lines), F.lit(1)), F.length(T.replace(t, f"{T.WS}+", ""))
    tiny = F.size(F.filter(lines, lambda y: T.count_meaningful(y) <= 2)) / n
    average = F.aggregate(lines, F.lit(0), lambda a, y: a + F.length(y)) / n
    low = (t == "") | ((compact >= 30) & (T.count_meaningful(t) / F.greatest(compact, F.lit(1)) < 0.45)) | ((n >= 12) & (average < 5)) | ((n >= 8) & (tiny > 0.45)) | T.has(t, L.MOJIBAKE) | (T.symbol_ratio(t, "page") > 0.32)
    judged = df.select(low.alias("low"), (low | (T.count_meaningful(c) < L.MIN_TEXT_CHARS)).alias("ocr"), L.low_quality(c).alias("low_now"), L.needs_ocr(c).alias("ocr_now"))
    assert judged.filter("low <> low_now OR ocr <> ocr_now").count() == 0
    assert 100 < judged.filter("low").count() < df.count() - 100
    long = spark.createDataFrame([("." * 600 + "a" * 40,), ("." * 600 + "a" * 30,)], "t string").select(L.needs_ocr(F.col("t"), low=F.lit(False)).alias("x"))
    assert str(L._START_CHARS) in long._jdf.queryExecution().analyzed().toString()
    assert [r.x for r in long.collect()] == [False, True]
