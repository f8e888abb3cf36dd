"""Queries over events, conversations and the library tables they stand for."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import reading as R
from quire.operators import library as B
from quire.operators import progress as P
from quire.plans import registry as S
from quire.plans.registry import query, read

_MS = "CAST(floor(abs(value) * 10) AS BIGINT)"


def _events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.withColumn("ms", F.floor(F.abs("value") * 10).cast("long"))


@query("b33_labels", f"""SELECT event_id, CASE WHEN s < 60 THEN greatest(1, s) || ' 秒' WHEN m < 60 THEN m || ' 分钟' ELSE m // 60 || ' 小时 ' || m % 60 || ' 分钟' END AS duration,
  CASE WHEN p = 0 THEN '开头 1/' || n WHEN p = n - 1 THEN '结尾 ' || n || '/' || n ELSE CAST(floor(p / greatest(1, n - 1)::DOUBLE * 100 + 0.5) AS BIGINT) || '% · ' || (p + 1) || '/' || n END AS point, format('{{:,}}', ms) AS grouped
FROM (SELECT event_id, ms, p, n, CAST(floor(ms * 60 / 1000.0 + 0.5) AS BIGINT) AS s, CAST(floor(CAST(floor(ms * 60 / 1000.0 + 0.5) AS BIGINT) / 60.0 + 0.5) AS BIGINT) AS m FROM (SELECT event_id, {_MS} AS ms, event_id % 7 AS p, event_id % 7 + event_id % 5 + 1 AS n FROM events))""")
def labels(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("p", F.col("event_id") % 7).withColumn("n", F.col("event_id") % 7 + F.col("event_id") % 5 + 1)
    return e.select("event_id", R.approx_duration(F.col("ms") * 60).alias("duration"), R.quick_point_label(F.col("p"), F.col("n")).alias("point"), R.format_count(F.col("ms")).alias("grouped"))


@query("b34_clamp_map", "SELECT l_orderkey, l_linenumber, least(greatest(CAST(l_quantity AS DOUBLE), 10.0), 40.0) AS clamped, round(0.5 + (CAST(l_quantity AS DOUBLE) - 1.0) / 49.0 * 2.5, 6) AS mapped FROM lineitem")
def clamp_map(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", R.clamp(q, 10.0, 40.0).alias("clamped"), F.round(R.map_range(q, 1.0, 50.0, 0.5, 3.0), 6).alias("mapped"))


@query("b37_requests", f"SELECT doc_id, CASE WHEN {S.trim('text')} = '' THEN 'empty_text' WHEN length({S.trim('text')}) > 5000 THEN 'text_too_long' END AS error_code FROM documents")
def requests(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", R.validate_request(F.col("text")).alias("error_code"))


_REQUEST = """CASE doc_id % 4 WHEN 0 THEN ' de-DE ' WHEN 1 THEN '' WHEN 2 THEN 'fr-FR' END"""


@query("b37_speech_requests", f"""SELECT doc_id, {S.trim("coalesce(text, '')")} AS text, trim(coalesce(source, '')) AS voice, coalesce(nullif(trim({_REQUEST}), ''), 'en-US') AS lang, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 3 * 0.75 END AS DOUBLE) AS rate, CASE doc_id % 5 WHEN 1 THEN 1.25 ELSE 1.0 END::DOUBLE AS pitch,
  CASE WHEN {S.trim("coalesce(text, '')")} = '' THEN 'empty_text' WHEN length({S.trim("coalesce(text, '')")}) > 5000 THEN 'text_too_long' END AS error_code FROM documents""")
def speech_requests(spark, sf_dir):
    """Requests in JSON with languages, rates and pitches that are missing, empty, zero or no number."""
    d = F.col("doc_id")
    lang = F.when(d % 4 == 0, " de-DE ").when(d % 4 == 1, "").when(d % 4 == 2, "fr-FR")
    pitch = F.when(d % 5 == 1, "1.25").when(d % 5 == 2, "none").when(d % 5 == 3, "0")
    request = F.to_json(F.struct("text", F.col("source").alias("voice"), lang.alias("lang"), (d % 3 * 0.75).alias("rate"), pitch.alias("pitch")))
    return read(spark, sf_dir, "documents").select("doc_id", R.speech_request(request).alias("r")).select("doc_id", "r.*")


@query("i04_missing_assets", """SELECT file_key, page_number, count(*) AS missing FROM (SELECT user_id AS file_key, event_id % 25 AS page_number FROM events WHERE event_type <> 'error' EXCEPT ALL SELECT user_id, event_id % 20 FROM events WHERE event_type <> 'view') GROUP BY 1, 2""")
def missing_assets(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    pages = lambda n: (F.col("event_id") % n).alias("page_number")
    required = e.filter("event_type <> 'error'").select(F.col("user_id").alias("file_key"), pages(25))
    present = e.filter("event_type <> 'view'").select(F.col("user_id").alias("file_key"), pages(20))
    return B.missing_from(required, present).groupBy("file_key", "page_number").agg(F.count("*").alias("missing"))


@query("a09_a10_e05_backup", """SELECT 'd' || doc_id AS id, n_chars, length(text) AS chars, (SELECT count(*) FROM documents WHERE text <> '') AS restored, (SELECT count(*) FROM documents WHERE coalesce(text, '') = '') AS skipped, '{"rate":1.5}' AS settings, '2024-01-02T03:04:05.000Z' AS exported_at FROM documents WHERE text <> ''""")
def backup(spark, sf_dir):
    """All documents as books, out to a backup and back; those without text have no sections."""
    from quire.plans.stream_queries import place_for

    docs = read(spark, sf_dir, "documents").withColumn("id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    meta, contents = docs.select("id", "n_chars"), docs.filter("text <> ''").select("id", F.array(F.struct(F.col("source").alias("title"), "text")).alias("sections"))
    place = place_for(spark, "backup")
    B.export_backup(meta, contents, place, settings='{"rate":1.5}', app_version="1", exported_at="2024-01-02T03:04:05.000Z")

    def save(books):
        books.write.parquet(f"{place}/restored")
        return spark.read.parquet(f"{place}/restored")

    got = B.restore_backup(spark, place, "id string, n_chars long, sections array<struct<title: string, text: string>>", save)
    return got.books.select("id", "n_chars", F.length(F.get("sections", F.lit(0)).text).alias("chars"), F.lit(got.restored).cast("long").alias("restored"), F.lit(got.skipped).cast("long").alias("skipped"), F.lit(got.settings).alias("settings"), F.lit(got.exported_at).alias("exported_at"))


@query("b41_h05_candidates", """SELECT p_partkey, name, CASE WHEN regexp_matches(name, 'zipvoice') THEN 0 WHEN regexp_matches(name, 'aishell') THEN 5 WHEN regexp_matches(name, 'kokoro') THEN 4 WHEN regexp_matches(name, 'vits|matcha|melo') THEN 3 ELSE 2 END AS score,
  regexp_matches(name, 'tts|text-to-speech') AND regexp_matches(name, 'wasm|web-assembly|webassembly') AND regexp_matches(name, 'zh|chinese|aishell|melo|kokoro|cantonese|zipvoice') AS candidate
FROM (SELECT p_partkey, lower(p_name) || CASE p_partkey % 5 WHEN 0 THEN '-tts-wasm-aishell' WHEN 1 THEN '-tts-webassembly-zipvoice' WHEN 2 THEN '-kokoro' WHEN 3 THEN '-text-to-speech-wasm-zh' ELSE '' END AS name FROM part)""")
def candidates(spark, sf_dir):
    suffix = R.lookup((F.col("p_partkey") % 5).cast("string"), {"0": "-tts-wasm-aishell", "1": "-tts-webassembly-zipvoice", "2": "-kokoro", "3": "-text-to-speech-wasm-zh"}, F.lit(""))
    parts = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_name"), suffix).alias("name"))
    return parts.select("p_partkey", "name", R.score_space_name(F.col("name")).alias("score"), R.is_candidate_space(F.col("name")).alias("candidate"))


@query("b42_speed", f"SELECT doc_id, round(CASE WHEN doc_id % 4 = 0 THEN 88.5 ELSE (CASE WHEN starts_with({S.language('text')}, 'zh') THEN 200.0 ELSE 65.0 END) / least(greatest((doc_id % 9) / 2.0, 0.5), 3.0) END, 6) AS ms_per_char FROM documents")
def speed(spark, sf_dir):
    ewma = F.when(F.col("doc_id") % 4 == 0, 88.5)
    return read(spark, sf_dir, "documents").select("doc_id", F.round(R.speech_ms_per_char(ewma, F.col("text"), F.col("doc_id") % 9 / 2.0), 6).alias("ms_per_char"))


@query("b35_k11_sleep_timer", f"""SELECT event_id, round(CASE WHEN e.ends_ms IS NULL OR e.ends_ms - t >= 60000 THEN 1.0 ELSE least(greatest((e.ends_ms - t) / 60000.0, 0.15), 1.0) END, 6) AS volume
FROM (SELECT event_id, epoch_ms(ts) AS t, CASE WHEN user_id % 3 > 0 THEN max(epoch_ms(ts)) OVER (PARTITION BY user_id) - (user_id % 5) * 3600000 END AS ends_ms FROM events) AS e WHERE ends_ms IS NULL OR t < ends_ms""")
def sleep_timer(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    timers = e.filter("user_id % 3 > 0").groupBy("user_id").agg((F.max("ts_ms") - F.first("user_id") % 5 * 3600000).alias("ends_ms"))
    return P.apply_sleep_timer(e, timers, "user_id").select("event_id", F.round("volume", 6).alias("volume"))


@query("c10_valid_timing", f"SELECT event_id, round({_MS} / (event_id % 60)::DOUBLE, 6) AS ms_per_char FROM events WHERE {_MS} > 0 AND event_id % 60 > 0 AND {_MS} / (event_id % 60)::DOUBLE BETWEEN 20 AND 1200")
def timing(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("chars", F.col("event_id") % 60)
    return P.valid_timing(e, "ms", "chars").select("event_id", F.round("ms_per_char", 6).alias("ms_per_char"))


@query("g07_ewma", """WITH RECURSIVE e AS (SELECT user_id, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, v AS a FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, r.a * 0.6 + e.v * 0.4 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, round(arg_max(a, i), 6) AS ewma FROM r GROUP BY 1""")
def ewma(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("v", F.col("value").cast("double"))
    return P.ewma(e, "user_id", "ts", "event_id", value="v").withColumn("ewma", F.round("ewma", 6))


@query("g06_rolling_eta", f"""WITH e AS (SELECT *, {_MS} AS ms FROM events), w AS (SELECT event_id, user_id, row_number() OVER o AS done, count(*) OVER (PARTITION BY user_id) + 20 AS total, avg(ms) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS avg_ms FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, done, round(avg_ms, 6) AS avg_ms, CASE WHEN floor(avg_ms * (total - done) + 0.5) >= 3000 THEN CAST(floor(avg_ms * (total - done) + 0.5) AS BIGINT) END AS eta_ms FROM w""")
def eta(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("total", F.count("*").over(W.partitionBy("user_id")) + 20)
    return P.rolling_eta(e, "user_id", "ts", "event_id", total=F.col("total"), duration="ms").select("event_id", "done", F.round("avg_ms", 6).alias("avg_ms"), "eta_ms")


@query("g08_percents", """SELECT event_id, CAST(floor(least(greatest(s + 1, 1), n) / n::DOUBLE * 100 + 0.5) AS BIGINT) AS shelf_percent, round((s + CASE WHEN pn > 1 THEN p / (pn - 1)::DOUBLE ELSE 0 END) / n * 100, 6) AS reading_percent, round(CASE WHEN tn > 0 THEN t / greatest(1, tn - 1)::DOUBLE * 100 ELSE 0 END, 6) AS speech_percent
FROM (SELECT event_id, event_id % 11 AS s, greatest(1, event_id % 17) AS n, event_id % 5 AS p, event_id % 6 AS pn, event_id % 13 AS t, event_id % 14 AS tn FROM events)""")
def percents(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id")
    for name, m in (("s", 11), ("n", 17), ("p", 5), ("pn", 6), ("t", 13), ("tn", 14)):
        e = e.withColumn(name, F.col("event_id") % m)
    return P.percents(e, "s", "n", "p", "pn", "t", "tn").select("event_id", "shelf_percent", F.round("reading_percent", 6).alias("reading_percent"), F.round("speech_percent", 6).alias("speech_percent"))


@query("f12_speech_position", f"""WITH {S.LINES} SELECT doc_id, round(greatest(1.0, sum(length(line)) * 150.0 / 1000), 6) AS duration_s, round(least(greatest(coalesce(sum(length(line)) FILTER (line_no < doc_id % 6), 0) * 150.0 / 1000, 0.0), greatest(1.0, sum(length(line)) * 150.0 / 1000)), 6) AS position_s FROM ln GROUP BY 1""")
def speech_position(spark, sf_dir):
    from quire.operators.lines import explode_lines

    lines = explode_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    out = P.speech_position(lines, "doc_id", F.col("doc_id") % 6, order="line_no", text="line")
    return out.select("doc_id", F.round("duration_s", 6).alias("duration_s"), F.round("position_s", 6).alias("position_s"))


@query("e07_position_at", f"""WITH {S.LINES}, b AS (SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ln),
p AS (SELECT event_id, event_id % 1000 AS doc_id, {_MS} % 3000 AS place, CAST(event_id % 3 AS INTEGER) AS cur FROM events)
SELECT event_id, greatest(cur, max(line_no) FILTER (start <= place)) AS sentence_no FROM p LEFT JOIN b USING (doc_id) GROUP BY event_id, cur""")
def position_at(spark, sf_dir):
    """Probes of the places that the SQL names; ``e07_all_documents`` has all documents and whole texts."""
    probes = _events(spark, sf_dir).select("event_id", (F.col("event_id") % 1000).alias("doc_id"), (F.col("ms") % 3000).alias("at"), (F.col("event_id") % 3).cast("int").alias("cur"))
    return P.position_at(_line_starts(spark, sf_dir), probes, "doc_id", "at", "cur").select("event_id", "sentence_no")


@query("e07_all_documents")
def position_anywhere(spark, sf_dir):
    """Event ids are dealt over all document ids, and hashed to a place in the whole text."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    ids = docs.agg(F.min("doc_id").alias("low"), (F.max("doc_id") - F.min("doc_id") + 1).alias("span"))
    dealt = read(spark, sf_dir, "events", "event_id").crossJoin(F.broadcast(ids)).select("event_id", (F.col("low") + F.pmod("event_id", "span")).alias("doc_id"), (F.col("event_id") % 3).cast("int").alias("cur"))  # one row
    at = F.pmod(F.xxhash64("event_id"), F.coalesce("n", F.lit(0)) + 1)
    probes = dealt.join(docs, "doc_id", "left").select("event_id", "doc_id", at.alias("at"), "cur")
    return P.position_at(_line_starts(spark, sf_dir), probes, "doc_id", "at", "cur").select("event_id", "doc_id", "at", "sentence_no")


def _line_starts(spark, sf_dir):
    from quire.operators.lines import explode_lines

    lines = explode_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.select("doc_id", F.col("line_no").alias("sentence_no"), before.alias("start"))


@query("e08_restore_position", """SELECT user_id, least(greatest(s, 0), greatest(n - 1, 0)) AS section_index, least(greatest(t, 0), greatest(m - 1, 0)) AS sentence_index FROM
(SELECT user_id, arg_max(event_id % 50, event_id) AS s, arg_max(event_id % 30, event_id) AS t, user_id % 9 AS n, user_id % 25 AS m FROM events GROUP BY user_id)""")
def restore(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    newest = B.latest_per_key(e.select("user_id", "event_id"), "user_id", order=[F.desc("event_id")]).select("user_id", (F.col("event_id") % 50).alias("section_index"), (F.col("event_id") % 30).alias("sentence_index"))
    sections = e.select("user_id").distinct().select("user_id", (F.col("user_id") % 9).alias("section_count"), (F.col("user_id") % 25).alias("sentence_count"))
    return P.restore_position(newest, sections, "user_id").select("user_id", "section_index", "sentence_index")


@query("g10_h01_h02_shelf", """SELECT user_id AS id, max(ts) AS last_opened_at, arg_max(event_type, (ts, event_id)) AS progress, row_number() OVER (ORDER BY max(ts) DESC, user_id) = 1 AS latest FROM events GROUP BY user_id""")
def shelf(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    newest = B.latest_per_key(e, "user_id", order=[F.desc("ts"), F.desc("event_id")]).select(F.col("user_id").alias("id"), F.col("ts").alias("last_opened_at"), F.col("event_type").alias("progress"))
    latest = B.latest_book(newest).select("id", F.lit(True).alias("latest"))
    return B.shelf(newest.join(F.broadcast(latest), "id", "left").withColumn("latest", F.coalesce("latest", F.lit(False))))  # one row


_DAY = "CAST(date_trunc('day', ts) AS TIMESTAMP)"


@query("a15_e03_e04_cache", f"""WITH c AS (SELECT * FROM (SELECT 'f' || user_id AS file_key, CASE WHEN event_id % 2 = 0 THEN 'eng' ELSE 'deu' END AS lang, event_id % 20 AS page_number, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS text, ts, event_id FROM events) WHERE text IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_key, lang, page_number ORDER BY ts DESC, text DESC) = 1),
p AS (SELECT DISTINCT 'f' || user_id AS file_key, event_id % 25 AS page_number FROM events)
SELECT p.file_key, p.page_number, c.text IS NOT NULL AS cache_hit, c.text AS cache_text, c.text IS NULL AND page_number % 3 = 0 AS to_recognise FROM p LEFT JOIN (SELECT * FROM c WHERE lang = 'eng') AS c USING (file_key, page_number)""")
def cache(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    key = F.concat(F.lit("f"), F.col("user_id").cast("string"))
    rows = e.select(key.alias("file_key"), F.when(F.col("event_id") % 2 == 0, "eng").otherwise("deu").alias("lang"), (F.col("event_id") % 20).alias("page_number"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("text"), F.col("ts").alias("updated_at"))
    cached = B.save_cache(rows.limit(0), rows)
    pages = e.select(key.alias("file_key"), (F.col("event_id") % 25).alias("page_number")).distinct().withColumn("needs_ocr", F.col("page_number") % 3 == 0)
    todo = B.pages_to_recognise(pages, cached, "eng").select("file_key", "page_number", F.lit(True).alias("to_recognise"))
    found = B.lookup_cache(pages, cached, "eng").join(todo, ["file_key", "page_number"], "left")
    return found.select("file_key", "page_number", "cache_hit", "cache_text", F.coalesce("to_recognise", F.lit(False)).alias("to_recognise"))


@query("k08_prune_cache", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 12 DAYS")
def prune(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    return B.prune_cache(e.withColumnRenamed("ts", "updated_at").join(F.broadcast(now)), F.col("now"), 12).select("event_id")  # one row


@query("k09_superseded", "SELECT event_id FROM (SELECT event_id, event_id // 100 % 7 AS gen, max(event_id // 100 % 7) OVER (PARTITION BY user_id) AS newest FROM events) WHERE gen = newest")
def superseded(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("gen", F.floor(F.col("event_id") / 100) % 7)
    return P.drop_superseded(e, "user_id").select("event_id")


@query("k07_debounce", """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER o < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, min(ts) AS start, arg_max(event_id, (ts, event_id)) AS saved, count(*) AS n FROM s GROUP BY user_id, run""")
def debounce(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return P.debounce(e, "user_id", "6 hours", value=F.col("event_id"), by=F.struct("ts", "event_id"))


@query("k10_resume", "SELECT w.user_id, w.last_section, a.event_id FROM (SELECT user_id, max(event_id % 50) AS last_section FROM events WHERE event_id % 50 < 40 GROUP BY 1) AS w JOIN (SELECT user_id, event_id % 50 AS section_no, event_id FROM events) AS a ON a.user_id = w.user_id AND a.section_no = w.last_section + 1")
def resume(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_id").withColumn("section_no", F.col("event_id") % 50)
    waiting = e.filter("section_no < 40").groupBy("user_id").agg(F.max("section_no").alias("last_section"))
    return P.resume_after_append(waiting, e, "user_id").select("user_id", "last_section", "event_id")


@query("k12_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed(spark, sf_dir):
    from quire.streaming.imports import windowed_counts

    return windowed_counts(read(spark, sf_dir, "events"), "1 day", by="event_type")


@query("g11_contiguous_prefix", "WITH p AS (SELECT DISTINCT user_id, event_id % 40 + 1 AS page_number FROM events WHERE event_id % 37 <> 5), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY page_number) AS i FROM p) SELECT user_id, page_number FROM n WHERE i = page_number")
def prefix(spark, sf_dir):
    from quire.operators.pages import contiguous_prefix

    pages = read(spark, sf_dir, "events").filter("event_id % 37 <> 5").select("user_id", (F.col("event_id") % 40 + 1).alias("page_number")).distinct()
    return contiguous_prefix(pages, "user_id").select("user_id", "page_number")


@query("f06_page_summary", "SELECT user_id, count(*) AS pages, count(*) FILTER (event_type = 'click') AS ocr_pages, count(*) FILTER (event_id % 4 = 0) AS cached_pages, min(event_id) AS first_page, max(event_id) AS last_page, bool_or(value > 50) AS any_text FROM events GROUP BY 1")
def page_summary(spark, sf_dir):
    from quire.operators.pages import page_summary as f

    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("page_number"), (F.col("event_type") == "click").alias("ocr_used"), (F.col("event_id") % 4 == 0).alias("from_cache"), (F.col("value") > 50).alias("has_text"))
    return f(e, "user_id")


@query("k01_k02_first_publish", """WITH t AS (SELECT conv_id, turn, length(text) AS chars, row_number() OVER w AS page_number, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY page_number) AS so_far FROM t), f AS (SELECT conv_id, min(page_number) AS first FROM c WHERE page_number >= 1 AND total - page_number >= 1 AND so_far >= 300 GROUP BY 1)
SELECT c.conv_id, c.page_number, coalesce(CASE WHEN page_number <= first THEN 0 ELSE (page_number - first - 1) // 2 + 1 END, 0) AS batch_no FROM c LEFT JOIN f USING (conv_id)""")
def first_publish(spark, sf_dir):
    from quire.operators.pages import publish_batches

    pages = read(spark, sf_dir, "conversations").withColumn("page_number", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role")))
    return publish_batches(pages, "conv_id", min_pages=1, min_remaining=1, min_chars=300, batch=2).select("conv_id", "page_number", "batch_no")


_ATTEMPT = f"({S.meaningful('text')} * 2 + turn % 40 - {S.symbols('text', 'candidate')} * 120)"


@query("f14_best_candidate", f"SELECT conv_id, turn, round({_ATTEMPT}, 6) AS score, {S.meaningful('text')} < 20 AS retry FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY {_ATTEMPT} DESC, turn, role) = 1)")
def best_candidate(spark, sf_dir):
    from quire.operators.pages import best_candidate as f

    rows = read(spark, sf_dir, "conversations").withColumn("confidence", F.col("turn") % 40)
    return f(rows, "conv_id", order=["turn", "role"]).select("conv_id", "turn", F.round("score", 6).alias("score"), "retry")


@query("h06_first_events", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 8")
def first_events(spark, sf_dir):
    return B.first_n(read(spark, sf_dir, "events", "user_id", "event_id", "ts"), "user_id", order=[F.col("ts"), F.col("event_id")], n=8).select("user_id", "event_id")
