"""The unit of each sentence is found inside its row: no shuffle, and the same as by the join of tables."""

from pyspark.sql import functions as F

from quire.operators import segments as G


def test_same_as_the_join_and_no_shuffle(spark):
    text = "The ferry crossed. 海上的风很大。 Mr. Smith rang the bell at 3.5 miles! Bells? " * 9
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "One."), (5, text[9:] * 3)], "doc_id long, text string")
    staged = docs.withColumn("s", G.segments(F.col("text")))
    built = G.build_units(staged, "s")
    got = G.units_of_sentences(built, "units", "doc_id")
    tables = G.exploded(built, "units", "unit_no", "u", "doc_id").select("doc_id", "unit_no", "u.first", "u.size")
    joined = G.unit_of_sentence(tables, G.exploded(staged, "s", "sentence_no", "t", "doc_id").drop("t"), "doc_id")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "sentence_no", "unit_no").collect()))
    assert rows(got) == rows(joined) and {r[0] for r in rows(got)} == {1, 4, 5}


def test_query_has_no_join(spark, tmp_path):
    from quire.plans import load

    spark.createDataFrame([(1, "One. Two. Three.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = load().QUERIES["e06_sentence_units"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_white_space_before_the_split(spark):
    """Pieces are those of a normalization of each piece, whatever stands between and inside them."""
    from quire.functions import text as T

    texts = ["One.\n  Two.\t \tThree!  Four", " a \x01 b\x02 c.  D.\r\n\r\n E", "No.\t 5.\n 6. 7", "。 。　 x  y；\n\nz", "\t\n ", "", None, "A. B.  C", "x .  Y\t\t。\t\tz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.regexp_replace(T.normalize_readable(F.col("t")), "\n+", " ")
    each = F.filter(F.transform(F.split(T.chain(whole, G.SEGMENT_STEPS), "\x01"), T.normalize_whitespace), lambda x: x != "")
    assert df.filter(~each.eqNullSafe(G.segments(F.col("t")))).count() == 0


def test_units_take_no_flags_that_they_do_not_use(spark):
    """Units and boundaries do not ask whether a sentence stands alone."""
    df = spark.createDataFrame([(["One.", "See: two."],)], "s array<string>")
    plan = G.build_units(df, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "references|bibliography" not in plan
