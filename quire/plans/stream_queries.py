"""Streams over the tables, run until all that is there is taken in; their SQL says what must have come out by then."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import progress as P
from quire.plans.registry import query, read
from quire.streaming import imports as I
from quire.streaming import progress_table as T
from quire.streaming import reader as R
from quire.streaming.state import typed_state

#: Streams by the clock end by themselves only without batches that have no data.
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def place_for(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; only a local master without that setting gets a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/quire-{sc.applicationId}/{uuid.uuid4().hex}-{name}"


def streamed(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet at ``path``, a file or a folder, as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern it may be a file


def drained(frame: DataFrame, name: str, typed: bool = True) -> DataFrame:
    """What the stream ``frame`` gives once it has taken in all that is there; ``typed`` if it keeps state variables.

    The store of state variables takes a few MB of disk for each partition and side, however little it holds.
    """
    spark = frame.sparkSession
    place = place_for(spark, name)
    with typed_state(spark) if typed else nullcontext():
        query_ = frame.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        query_.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{place}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


_E = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), last AS (SELECT max(ms) AS now FROM e)"


@query("k03_k04_released_pages", """WITH t AS (SELECT conv_id, row_number() OVER w AS page_number, text, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)),
c AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY page_number) AS so_far FROM t), f AS (SELECT conv_id, min(page_number) AS first FROM c WHERE total - page_number >= 1 AND so_far >= 300 GROUP BY 1)
SELECT c.conv_id AS doc_id, CAST(page_number AS INTEGER) AS page_number, length(text) AS chars, CAST(coalesce(CASE WHEN page_number <= first THEN 0 ELSE (page_number - first - 1) // 2 + 1 END, 0) AS INTEGER) AS batch_no, CAST(NULL AS VARCHAR) AS error FROM c LEFT JOIN f USING (conv_id)
UNION ALL SELECT conv_id, NULL, NULL, NULL, 'empty' FROM t GROUP BY conv_id HAVING bool_and(coalesce(text, '') SIMILAR TO '\\s*')""")
def released_pages(spark, sf_dir):
    """Turns as pages, which the stream gets in any order."""
    turns = read(spark, sf_dir, "conversations").withColumn("page_number", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role")))
    pages = turns.select(F.col("conv_id").alias("doc_id"), "page_number", F.count("*").over(W.partitionBy("conv_id")).cast("int").alias("total"), "text", F.timestamp_seconds("page_number").alias("ts"))
    path = place_for(spark, "pages")
    pages.repartition(F.xxhash64("text")).write.parquet(path)
    released = I.release_in_order(streamed(spark, path), min_pages=1, min_remaining=1, min_chars=300, after_ms=0, batch=2)
    return drained(released.select("doc_id", "page_number", F.length("text").alias("chars"), "batch_no", "error"), "released")


@query("k05_progress_table", "SELECT user_id AS book_id, arg_max(event_id % 50, (epoch_us(ts) // 1000, event_id)) AS section_index, max(epoch_us(ts) // 1000) AS updated_at, arg_max(event_id, (epoch_us(ts) // 1000, event_id)) AS seq FROM events GROUP BY 1")
def progress_table(spark, sf_dir):
    place = place_for(spark, "progress")
    updates = _events(spark, sf_dir).select(F.col("user_id").alias("book_id"), (F.col("event_id") % 50).alias("section_index"), F.unix_millis("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    T.upsert_progress(updates, f"{place}/table", f"{place}/checkpoint").awaitTermination()
    return T.read_progress(spark, f"{place}/table", updates.schema)


_HOURS = 6 * 3_600_000
_SAVES = f"""WITH {_E}, n AS (SELECT *, event_type = 'purchase' AS immediate, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS next FROM e)
SELECT user_id AS book_id, event_id AS seq, CASE WHEN immediate THEN ms ELSE ms + {_HOURS} END AS saved_ms, CASE WHEN immediate THEN 'chapter' ELSE 'pause' END AS cause FROM n CROSS JOIN last WHERE immediate OR (next IS NULL OR next - ms >= {_HOURS})"""


def _updates(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("book_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("immediate"))


@query("k07_saves", _SAVES)
def saves(spark, sf_dir):
    return P.saves(_updates(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))), gap="6 hours")


@query("k07_saves_stream", f"{_SAVES} AND (immediate OR ms + {_HOURS} <= now)")
def saves_stream(spark, sf_dir):
    """Without those that may still be followed by another."""
    return drained(R.saves(_updates(_events(spark, sf_dir)), gap="6 hours", watermark="0 seconds"), "saves")


@query("k08_cache_stream", f"""WITH {_E}, r AS (SELECT user_id % 50 AS book, CASE WHEN event_id % 2 = 0 THEN 'eng' ELSE 'deu' END AS lang, CAST(event_id % 20 AS INTEGER) AS page_number, ms, event_type, event_id FROM e),
w AS (SELECT book, lang, page_number, ms, arg_max(event_type, event_id) AS text FROM r WHERE event_type <> 'view' GROUP BY ALL)
SELECT 'f' || r.book AS file_key, r.lang, r.page_number, r.ms, coalesce(w.ms > r.ms - 3 * 86400000, FALSE) AS cache_hit, CASE WHEN w.ms > r.ms - 3 * 86400000 THEN w.text END AS cache_text
FROM r ASOF LEFT JOIN w ON r.book = w.book AND r.lang = w.lang AND r.page_number = w.page_number AND r.ms >= w.ms WHERE r.event_type = 'view'""")
def cache_stream(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = e.select(F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("file_key"), F.when(F.col("event_id") % 2 == 0, "eng").otherwise("deu").alias("lang"), (F.col("event_id") % 20).alias("page_number"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("text"), "ts")
    own = spark.conf.get(_NO_DATA)
    spark.conf.set(_NO_DATA, "false")
    try:
        return drained(R.cached_pages(rows, lifetime="3 days"), "lookups")
    finally:
        spark.conf.set(_NO_DATA, own)


@query("k09_newest_stream", f"WITH {_E} SELECT user_id AS doc_id, event_id // 100 % 7 AS gen, event_id AS result FROM (SELECT *, max(event_id // 100 % 7) OVER (PARTITION BY user_id) AS newest FROM e) CROSS JOIN last WHERE event_id // 100 % 7 = newest AND ms + 3600000 <= now")
def newest_stream(spark, sf_dir):
    """Without results of the last hour, which a newer run may still replace."""
    results = _events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), (F.floor(F.col("event_id") / 100) % 7).alias("gen"), F.col("event_id").alias("result"), "ts")
    return drained(R.newest_runs(results, wait="1 hour", watermark="0 seconds"), "newest")


_RESUMED = f"""WITH {_E}, w AS (SELECT user_id AS book_id, event_id % 50 AS last_section, event_id AS seq, ts FROM e WHERE event_type = 'view'), a AS (SELECT user_id AS book_id, event_id % 50 AS section_no, ts FROM e WHERE event_type = 'signup'),
last2 AS (SELECT least((SELECT max(ts) FROM w), (SELECT max(ts) FROM a)) AS now)
SELECT w.book_id, w.last_section, w.seq, a.section_no, epoch_us(a.ts) // 1000 AS resumed_ms FROM w CROSS JOIN last2 LEFT JOIN a ON a.book_id = w.book_id AND a.section_no = w.last_section + 1 AND a.ts BETWEEN w.ts AND w.ts + INTERVAL 3 DAYS"""


def _sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    waiting = events.filter("event_type = 'view'").select(F.col("user_id").alias("book_id"), (F.col("event_id") % 50).alias("last_section"), F.col("event_id").alias("seq"), "ts")
    return waiting, events.filter("event_type = 'signup'").select(F.col("user_id").alias("book_id"), (F.col("event_id") % 50).alias("section_no"), "ts")


@query("k10_waiting_readers", _RESUMED)
def waiting_readers(spark, sf_dir):
    waiting, appended = _sides(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return P.resume_after_append(waiting, appended, "book_id", within="3 days").select("book_id", "last_section", "seq", "section_no", F.unix_millis("resumed_at").alias("resumed_ms"))


@query("k10_readers_stream", f"{_RESUMED} WHERE a.ts IS NOT NULL OR w.ts + INTERVAL 3 DAYS < now")
def readers_stream(spark, sf_dir):
    """Without readers for whom a section may still come."""
    out = drained(R.resumed_readers(*_sides(_events(spark, sf_dir)), within="3 days", watermark="0 seconds"), "resumed", typed=False)
    return out.select("book_id", "last_section", "seq", "section_no", F.unix_millis("resumed_at").alias("resumed_ms"))


@query("k12_windows_stream", f"WITH {_E} SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM e CROSS JOIN last WHERE epoch_ms(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) + 86400000 <= now GROUP BY 1, 2")
def windows_stream(spark, sf_dir):
    """Days that the watermark has passed."""
    return drained(I.windowed_counts(_events(spark, sf_dir), "1 day", by="event_type", watermark="0 seconds"), "windows", typed=False)
