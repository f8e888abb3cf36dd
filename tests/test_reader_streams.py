"""The reader's loop as streams: each against its batch operator, in several orders of arrival."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import library as B
from quire.operators import progress as G
from quire.streaming import imports as I
from quire.streaming import progress_table as T
from quire.streaming import reader as R
from quire.streaming.state import PROVIDER, typed_state


def stream_of(spark, tmp_path, schema, *parts, name="in"):
    """A stream whose micro-batches are ``parts``; ``ts`` is given in seconds."""
    for i, rows in enumerate(parts):
        frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis((F.col("ts") * 1000).cast("long")))
        frame.coalesce(1).write.parquet(str(tmp_path / name / f"{i:03}"))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))


def batch_of(spark, schema, rows):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis((F.col("ts") * 1000).cast("long")))


def run(spark, frame, tmp_path, mode="append", by_the_clock=False):
    name = f"r{abs(hash(str(tmp_path))) % 10**9}"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", not by_the_clock)
    with typed_state(spark):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120), query.stop()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.table(name).collect(), query


def states(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "cp")).collect()


def test_the_sessions_store_is_set_back(spark):
    before = spark.conf.get(PROVIDER, None)
    with typed_state(spark):
        assert "RocksDB" in spark.conf.get(PROVIDER)
    assert spark.conf.get(PROVIDER, None) == before


# Saves

UPDATES = "book_id string, ts double, seq long, immediate boolean"
CLOSING = ("end", 10_000.0, 0, False)


@pytest.mark.parametrize("order", [0, 1, 2])
def test_saves_wait_for_a_pause_in_any_order(spark, tmp_path, order):
    rng = random.Random(7)
    rows = [("a", 0.0, 1, False), ("a", 0.5, 2, False), ("a", 1.0, 3, False), ("a", 2.2, 4, False), ("a", 3.0, 5, True), ("a", 3.1, 6, False), ("b", 1.0, 1, True), ("b", 1.0, 2, False), ("b", 2.2, 3, False)]
    rows += [("c", round(rng.uniform(0, 40), 1), i, rng.random() < 0.2) for i in range(60)]
    mixed = sorted(rows, key=lambda r: r[1]) if order == 0 else rng.sample(rows, len(rows))
    parts = [mixed] if order < 2 else [mixed[:20], mixed[20:45], mixed[45:]]
    got, _ = run(spark, R.saves(stream_of(spark, tmp_path, UPDATES, *parts, [CLOSING]), watermark="60 seconds"), tmp_path)
    want = G.saves(batch_of(spark, UPDATES, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert sorted((r.seq, r.saved_ms, r.cause) for r in got if r.book_id == "a") == [(3, 2200, "pause"), (5, 3000, "chapter"), (6, 4300, "pause")]
    assert not [s for s in states(spark, tmp_path, "held") if s.key.book_id != "end"]


def test_a_chapter_is_saved_as_it_comes_and_once(spark, tmp_path):
    """The last update of a stream waits; an immediate one does not, and a replay of it is not saved again."""
    rows = [("a", 1.0, 1, True), ("a", 2.0, 2, False)]
    got, _ = run(spark, R.saves(stream_of(spark, tmp_path, UPDATES, rows, rows)), tmp_path)
    assert [(r.seq, r.cause) for r in got] == [(1, "chapter")]


# Newest runs

RESULTS = "doc_id string, gen long, result long, ts double"


@pytest.mark.parametrize("order", range(3))
def test_newest_run_in_any_order(spark, tmp_path, order):
    rng = random.Random(order)
    rows = [(d, g, g * 100 + i, float(g * 10 + i)) for d in "abc" for g in range(1, 4 + (d == "b")) for i in range(5)]
    rng.shuffle(rows)
    parts = [rows[i::3] for i in range(3)]
    got, _ = run(spark, R.newest_runs(stream_of(spark, tmp_path, RESULTS, *parts, [("z", 1, 1, 90_000.0)])), tmp_path)
    want = G.drop_superseded(batch_of(spark, RESULTS, rows), "doc_id").select("doc_id", "gen", "result").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {s.key.doc_id for s in states(spark, tmp_path, "held")} == {"z"}


def test_a_run_is_remembered_for_a_time(spark, tmp_path):
    """An old result after the newest was given out changes nothing, until the document is forgotten."""
    late = [[("a", 2, 1, 1.0)], [("z", 1, 1, 8000.0)], [("a", 1, 9, 7900.0)], [("z", 1, 2, 20_000.0)]]
    got, _ = run(spark, R.newest_runs(stream_of(spark, tmp_path, RESULTS, *late), remember="1 hour", watermark="10 minutes"), tmp_path)
    assert [tuple(r) for r in got if r.doc_id == "a"] == [("a", 2, 1)]
    assert "a" not in {s.key.doc_id for s in states(spark, tmp_path, "top")}


# Cached pages

CACHE = "file_key string, lang string, page_number int, text string, ts double"


def test_cached_pages_live_as_long_as_the_batch_keeps_them(spark, tmp_path):
    day = 86_400.0
    rows = [("f", "eng", 1, "one", 0.0), ("f", "eng", 2, "", 10 * day), ("f", "deu", 1, "eins", 20 * day), ("f", "eng", 1, "older", -1.0), (None, "eng", 1, "x", 0.0), ("", "eng", 1, "x", 0.0), ("f", None, 1, "x", 0.0), ("f", "eng", None, "x", 0.0)]
    asked = [("f", lang, n, None, at * day) for at in (44.9, 45, 54.9, 55, 64.9, 65) for lang, n in (("eng", 1), ("eng", 2), ("deu", 1), ("deu", 2))]
    got, _ = run(spark, R.cached_pages(stream_of(spark, tmp_path, CACHE, rows, asked)), tmp_path, by_the_clock=True)
    cache = batch_of(spark, CACHE, rows).withColumnRenamed("ts", "updated_at")
    saved = B.save_cache(cache.limit(0), cache)
    for at in (44.9, 45, 54.9, 55, 64.9, 65):
        live = {(r.lang, r.page_number): r.text for r in B.prune_cache(saved, F.timestamp_seconds(F.lit(at * day))).collect()}
        now = [r for r in got if r.ms == int(at * day * 1000)]
        assert {(r.lang, r.page_number): r.cache_text for r in now if r.cache_hit} == live and len(now) == 4


def test_the_store_lets_go_of_old_pages(spark, tmp_path):
    """By the clock, without an event that asks for them."""
    now = time.time()
    stream = stream_of(spark, tmp_path, CACHE, [("f", "eng", 1, "one", now), ("f", "eng", 2, "two", now)])
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)

    def once():
        with typed_state(spark):
            R.cached_pages(stream, "8 seconds").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)

    once()
    assert len(states(spark, tmp_path, "pages")) == 2
    time.sleep(9)
    frame = spark.createDataFrame([("g", "eng", 1, None, now)], CACHE).withColumn("ts", F.timestamp_millis((F.col("ts") * 1000).cast("long")))
    frame.coalesce(1).write.parquet(str(tmp_path / "in" / "later"))
    once()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert not states(spark, tmp_path, "pages")


# Readers that wait

WAITING, APPENDED = "book_id string, last_section int, ts double", "book_id string, section_no int, ts double"


@pytest.mark.parametrize("first", ["readers", "sections"])
def test_readers_resume_in_any_order(spark, tmp_path, first):
    waiting = [("a", 3, 100.0), ("b", 5, 100.0), ("c", 1, 200.0), ("d", 2, 300.0), ("e", 7, 5000.0)]
    appended = [("a", 4, 160.0), ("a", 5, 170.0), ("b", 6, 99.0), ("b", 6, 9000.0), ("c", 2, 200.0), ("e", 8, 5001.0), ("f", 1, 100.0)]
    closing = 20_000.0
    w = stream_of(spark, tmp_path, WAITING, *([waiting, [], []] if first == "readers" else [[], waiting, []]), [("end", 0, closing)], [("end", 0, closing)], name="w")
    a = stream_of(spark, tmp_path, APPENDED, *([[], appended, []] if first == "readers" else [appended, [], []]), [("end", 9, closing)], [("end", 9, closing)], name="a")
    got, query = run(spark, R.resumed_readers(w, a), tmp_path)
    want = G.resume_after_append(batch_of(spark, WAITING, waiting), batch_of(spark, APPENDED, appended), "book_id", within="1 hour").collect()
    key = lambda rows: sorted(((r.book_id, r.last_section, r.section_no, r.resumed_at) for r in rows if r.book_id != "end"), key=repr)
    assert key(got) == key(want)
    assert {(r.book_id, r.section_no) for r in got if r.book_id != "end"} == {("a", 4), ("b", None), ("c", 2), ("d", None), ("e", 8)}


def test_late_sections_are_dropped_and_state_shrinks(spark, tmp_path):
    """The watermark is the lower one of both sides; behind it neither side keeps rows, nor takes them."""
    w = stream_of(spark, tmp_path, WAITING, [("a", 3, 100.0)], *([("end", 0, 20_000.0 + i)] for i in range(4)), name="w")
    a = stream_of(spark, tmp_path, APPENDED, [("x", 1, 100.0)], [("end", 9, 20_000.0)], [("end", 9, 20_001.0)], [("a", 4, 150.0)], [("end", 9, 20_003.0)], name="a")
    got, query = run(spark, R.resumed_readers(w, a), tmp_path)
    assert [(r.book_id, r.section_no) for r in got] == [("a", None)]
    last = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in last) >= 1 and last[-1]["numRowsTotal"] <= 8


# Progress table

PROGRESS = "book_id string, section_index int, updated_at int, seq int"


def test_progress_table_takes_replays_and_compacts(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(f"b{rng.randrange(6)}", rng.randrange(50), rng.randrange(100), n * 10 + i) for i in range(8)] for n in range(9)]
    path = str(tmp_path / "table")
    frames = [spark.createDataFrame(rows, PROGRESS) for rows in batches]
    assert T.read_progress(spark, path, PROGRESS).count() == 0
    for n, frame in enumerate(frames):
        T.merge_batch(frame, n, path, compact_every=3)
        want = {}
        for r in sorted((r for rows in batches[: n + 1] for r in rows), key=lambda r: (r[2], r[3])):
            want[r[0]] = r
        for replay in (n, max(0, n - 2)):  # as after a failure
            assert {r.book_id: tuple(r) for r in T.read_progress(spark, path, PROGRESS).collect()} == want
            T.merge_batch(frames[replay], replay, path, compact_every=3)
        assert len([p for p in (tmp_path / "table").iterdir() if p.is_dir()]) <= 2 * 3 + 3
    (tmp_path / "table" / "d-99").mkdir()  # half-written
    assert {r.book_id: tuple(r) for r in T.read_progress(spark, path, PROGRESS).collect()} == want


def test_progress_stream(spark, tmp_path):
    for i, rows in enumerate([[("a", 1, 5, 0), ("a", 2, 6, 1)], [("b", 9, 5, 0)], [("a", 3, 6, 2), ("a", 0, 1, 3)]]):
        spark.createDataFrame(rows, PROGRESS).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(PROGRESS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        T.upsert_progress(stream, str(tmp_path / "out"), str(tmp_path / "cp"), compact_every=2).awaitTermination()
        assert {(r.book_id, r.section_index) for r in T.read_progress(spark, str(tmp_path / "out"), PROGRESS).collect()} == {("a", 3), ("b", 9)}


# Late data

EVENTS = "k string, ts double"


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_late_rows_count_before_the_watermark_only(spark, tmp_path, kind):
    minute = 60.0
    parts = [[("a", 2 * minute), ("a", 5 * minute), ("b", 6 * minute)], [("a", 30 * minute)], [("z", 31 * minute)], [("a", 22 * minute), ("a", 1 * minute)], [("z", 300 * minute)], [("z", 301 * minute)]]
    how = {"tumbling": {}, "sliding": {"slide": "5 minutes"}, "session": {"session": True}}[kind]
    counted = I.windowed_counts(stream_of(spark, tmp_path, EVENTS, *parts), "10 minutes", by="k", watermark="10 minutes", **how)
    got, query = run(spark, counted, tmp_path)
    taken = [r for p in parts for r in p if r != ("a", 1 * minute)]  # behind the watermark of 20 minutes, which holds from the batch after next; the other late row is not
    want = I.windowed_counts(batch_of(spark, EVENTS, taken), "10 minutes", by="k", **how).filter("k <> 'z'").collect()
    assert sorted(tuple(r) for r in got if r.k != "z") == sorted(map(tuple, want))
    progress = [p["stateOperators"][0] for p in query.recentProgress]
    assert sum(p["numRowsDroppedByWatermark"] for p in progress) >= 1
    assert max(p["numRowsTotal"] for p in progress) > progress[-1]["numRowsTotal"]
