"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from quire.operators import pages as P
from quire.operators import progress as G
from quire.streaming import imports as I
from quire.streaming.state import typed_state

PAGES = "doc_id string, page_number int, total int, text string, ts timestamp"


def run(spark, frame, tmp_path, mode="append"):
    name = f"s{abs(hash(str(tmp_path))) % 10**9}"
    with typed_state(spark):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _stream(spark, tmp_path, *parts):
    """A stream of pages (doc_id, page_number, total, text), each part a micro-batch, a page for each second."""
    for i, rows in enumerate(parts):
        frame = spark.createDataFrame([(*r, f"2024-01-01 00:{r[1] // 60:02}:{r[1] % 60:02}") for r in rows], PAGES.replace("timestamp", "string"))
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_release_in_order_equals_batch(spark, tmp_path):
    rows = [(d, n, 30, "x" * 350) for d in ("a", "b") for n in range(1, 31) if (d, n) != ("b", 12)]
    odd = lambda wanted: [r for r in rows if r[1] % 2 == wanted]  # noqa: E731  odd pages arrive first
    got = {(r.doc_id, r.page_number, r.batch_no) for r in run(spark, I.release_in_order(_stream(spark, tmp_path, odd(1), odd(0))), tmp_path).collect()}
    pages = spark.createDataFrame([(*r, None) for r in rows], PAGES)
    batch = P.publish_batches(P.contiguous_prefix(pages, "doc_id"), "doc_id", min_remaining=-100).filter("doc_id = 'a'")
    assert {x for x in got if x[0] == "a"} == {(r.doc_id, r.page_number, r.batch_no) for r in batch.collect()}
    assert {n for d, n, _ in got if d == "b"} == set(range(1, 12))


def test_first_publication_waits_for_time(spark, tmp_path):
    rows = [("a", n, 30, "x" * 1000) for n in range(1, 31)] + [("l", n, 60, "x" * 1000) for n in range(1, 61)]
    got = {(r.doc_id, r.page_number): r.batch_no for r in run(spark, I.release_in_order(_stream(spark, tmp_path, rows), after_ms=9000), tmp_path).collect()}
    assert got[("a", 10)] == 0 and got[("a", 11)] == 1 and got[("l", 6)] == 0 and got[("l", 7)] == 1


def test_documents_end_and_replays_change_nothing(spark, tmp_path):
    """Blank documents are empty, a gap is flushed when time has passed it, a failed page ends its document; what was released stays."""
    first = [("e", 1, 2, ""), ("e", 2, 2, " \u3000\n"), ("g", 1, 4, "one"), ("g", 3, 4, "three"), ("f", 1, 1, "x"), ("n", 1, 3, None)]
    replay = [("f", 1, 1, "again"), ("e", 1, 2, "text"), ("g", 1, 4, "again"), ("n", 1, 3, "again"), ("n", 2, 3, "two")]
    stream = _stream(spark, tmp_path, first, replay, [("z", 1000, 1001, "z")], [("f", 1, 1, "late")], [("z", 1200, 1201, "z")])
    got = run(spark, I.release_in_order(stream, wait="20 seconds", remember="10 minutes", watermark="5 seconds"), tmp_path).collect()
    assert sorted((r.doc_id, r.page_number, r.text) for r in got if r.page_number and r.doc_id != "z") == [("e", 1, ""), ("e", 2, " \u3000\n"), ("f", 1, "x"), ("g", 1, "one"), ("g", 3, "three"), ("n", 1, ""), ("n", 2, "two")]
    assert sorted((r.doc_id, r.error) for r in got if r.error and r.doc_id != "z") == [("e", "empty"), ("g", "gap"), ("n", "gap")]
    held = {r.key.doc_id: r.value for r in spark.read.format("statestore").option("stateVarName", "at").load(str(tmp_path / "cp")).collect()}
    assert set(held) == {"z"}  # the stones of the others have crumbled
    assert {r.key.doc_id for r in spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "cp")).collect()} <= {"z"}


def test_pages_wait_in_typed_rows(spark, tmp_path):
    stream = _stream(spark, tmp_path, [("a", 1, 5, "one"), ("a", 4, 5, "four"), ("a", 3, 5, "three"), ("b", 1, 1, "x")])
    got = run(spark, I.release_in_order(stream), tmp_path).collect()
    assert sorted((r.doc_id, r.page_number) for r in got) == [("a", 1), ("b", 1)]
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "cp"))
    assert sorted((r.key.doc_id, r.user_map_key.page_number, r.user_map_value.text) for r in waiting.collect()) == [("a", 3, "three"), ("a", 4, "four")]
    at = {r.key.doc_id: r.value for r in spark.read.format("statestore").option("stateVarName", "at").load(str(tmp_path / "cp")).collect()}
    assert (at["a"].next_page, at["a"].ended, at["b"].ended) == (2, False, True)


def test_a_failed_page_keeps_what_was_released(spark, tmp_path):
    rows = [("a", 1, 4, "one", False), ("a", 2, 4, "two", None), ("a", 3, 4, None, True), ("a", 4, 4, "four", False)]
    frame = spark.createDataFrame(rows, "doc_id string, page_number int, total int, text string, failed boolean").withColumn("ts", F.timestamp_seconds("page_number"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    got = [(r.page_number, r.error) for r in run(spark, I.release_in_order(stream), tmp_path).collect()]
    assert got == [(1, None), (2, None), (None, "failed")]


def test_ewma_equals_batch(spark, tmp_path):
    rows = [(k, i, float(v)) for k in "xy" for i, v in enumerate([50, 100, 80, 60])]
    events = spark.createDataFrame(rows, "key string, ts int, ms_per_char double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = {r.key: r.ewma for r in run(spark, I.ewma_stream(stream), tmp_path, "update").collect()}
    want = {r.key: r.ewma for r in G.ewma(events, "key", "ts").collect()}
    assert got == pytest.approx(want)


def test_first_publish_needs_time_or_length(spark):
    rows = [("a", n, 20, "x" * 500, f"2024-01-01 00:00:{n:02d}") for n in range(1, 21)]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, total int, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert P.first_publish(pages, "doc_id").first()["first"] == 6
    assert P.first_publish(pages, "doc_id", after_ms=8000).first()["first"] == 9


def test_sessions(spark):
    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 5, 9, 40, 41)] + [("b", "2024-01-01 00:00:07")]
    events = spark.createDataFrame(rows, "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.k, r.start.second, r.n) for r in I.windowed_counts(events, "10 seconds", by="k", session=True).collect())
    assert got == [("a", 0, 3), ("a", 40, 2), ("b", 7, 1)]
