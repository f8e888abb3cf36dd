"""Steps that look back from a period against the steps as the SQL has them."""

import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import segments as G

PARTS = ["Mr", "mr", "Dr", "No", "Figs", "Prof", "ID", "ref", "x", "U", "S", "A", "é", "ß", "_", "7", "42", "-", "#", ":", " ", " ", "  ", "(", "\U0001f600", "。", "!", "end", "The", " ", *["."] * 12]


def texts(n: int) -> list[str]:
    r = random.Random(7)
    return ["", ".", "Mr.", "Mr.Dr.No.Figs. x", "U.S.A. x", "A.B.C.D.", "aMr. x", "\U0001f600Mr. x", "\U0001f600A. x", "No.No.No.No.", "Mr.A.Mr.A."] + ["".join(r.choice(PARTS) for _ in range(r.randint(1, 24))) for _ in range(n)]


def test_periods_that_end_no_sentence(spark):
    """Equal texts from three steps and from two that look back, runs of abbreviations and initials and all planes among them."""
    df = spark.createDataFrame([(t,) for t in texts(20_000)], "t string")
    same = df.filter(T.chain(F.col("t"), G.SEGMENT_STEPS[:3]) == T.chain(F.col("t"), G.QUICK_STEPS[:2]))
    assert same.count() == df.count()
    assert df.filter(T.chain(F.col("t"), G.QUICK_STEPS[:2]).contains("\x02")).count() > 5_000
    assert len(G.QUICK_STEPS) == len(G.SEGMENT_STEPS) - 1


def test_ends_that_keep_their_period(spark):
    """Equal to all the patterns over whole texts."""
    rows = texts(20_000)
    df = spark.createDataFrame(list(zip(rows, rows[1:] + rows[:1], strict=True)), "b string, x string")
    before, x = F.col("b"), F.col("x")
    plain = (T.has(before, r"[0-9]\.\z") & T.has(x, r"\A[0-9]")) | (T.has(before, G.SHORT_WORD_PERIOD) & T.has(x, r"\A[a-z]"))
    for p in G.KEEPS_PERIOD:
        plain = plain | T.has(before, p)
    judged = df.select(plain.alias("plain"), G.keeps_period(before, x).alias("now"))
    assert judged.filter("plain <> now").count() == 0 and judged.filter("now").count() > 1_000
