"""Registered queries that leave nothing of their tables out."""

import hashlib

from quire.plans import load


def _documents(spark, tmp_path, *texts):
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_references_are_stripped_on_all_lines(spark, tmp_path):
    folder = _documents(spark, tmp_path, "研究表明[12]，全球气温上升趋势明显（3），详见附录¹。\n3 apples were sold\nplain words here\nsee (4) and [5, 6] too")
    got = {r.line_no: r.display for r in load().QUERIES["b05_b08_all_lines"](spark, folder).collect()}
    assert got == {0: "研究表明，全球气温上升趋势明显，详见附录。", 1: "apples were sold", 2: "plain words here", 3: "see and too\nReferences\nx"}


def test_lines_with_digits_are_merged_too(spark, tmp_path):
    lines = ["First short line", "has 3 items in it", "third line here", "x" * 400, "tail 7"]
    folder = _documents(spark, tmp_path, "\n".join(lines))
    got = [r.text for r in load().QUERIES["d08_all_lines"](spark, folder).orderBy("paragraph_no").collect()]
    # Short lines go to the paragraph before; a long one starts its own, and takes none when it is beyond the longest.
    assert got == [hashlib.md5(t.encode()).hexdigest() for t in (" ".join(lines[:3]), *lines[3:])]


def test_all_roles_are_appended(spark, tmp_path):
    import duckdb

    rows = [(c, t, None if k == 12 else f"{'az'[k % 2]}{k:02d}", f"{c}/{t}/{k}") for c in (1, 2) for t in (0, 1) for k in range(13)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = sorted(tuple(r) for r in load().QUERIES["i02_append_sections"](spark, str(tmp_path)).collect())
    assert len(got) == 52 and got == sorted(con.execute(load().ORACLE_SQL["i02_append_sections"]).fetchall())


def test_append_equals_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet{'/*.parquet' if __import__('os').path.isdir(folder + '/conversations.parquet') else ''}')")
    got = sorted(tuple(r) for r in load().QUERIES["i02_append_sections"](spark, folder).collect())
    assert got == sorted(con.execute(load().ORACLE_SQL["i02_append_sections"]).fetchall())


def test_probes_reach_all_documents_and_whole_texts(spark, tmp_path):
    texts = [f"{'a' * (i % 7 + 1)}\n{'b' * 9000}\nc" for i in range(1500)]
    folder = _documents(spark, tmp_path, *texts)
    spark.range(6000).withColumnRenamed("id", "event_id").write.parquet(f"{folder}/events.parquet")
    got = load().QUERIES["e07_all_documents"](spark, folder).collect()
    assert len(got) == 6000 and {r.doc_id for r in got} == set(range(1500)) and max(r["at"] for r in got) > 8900
    for r in got:
        starts = [0, len(texts[r.doc_id].split("\n")[0]) + 1, len(texts[r.doc_id]) - 1]
        assert r.sentence_no == max(r.event_id % 3, sum(s <= r["at"] for s in starts) - 1)
