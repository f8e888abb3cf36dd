"""Reading progress, timing and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import reading as R

# They must equal the source application's for equal results.
MS_PER_CHAR, SLOWEST, FASTEST, LEARNING, GAP = 150.0, 1200, 20, 0.4, "1200 milliseconds"


def chars_before(sentences: DataFrame, *keys: str, order: str = "sentence_no", text: str = "sentence") -> DataFrame:
    """Adds the characters of all earlier sentences."""
    earlier = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return sentences.withColumn("chars_before", F.coalesce(F.sum(F.length(text)).over(earlier), F.lit(0)))


def valid_timing(events: DataFrame, elapsed: str = "elapsed_ms", chars: str = "chars", lo: float = FASTEST, hi: float = SLOWEST) -> DataFrame:
    """Events with a believable pace, which is added as ``ms_per_char``."""
    pace = F.col(elapsed) / F.col(chars)
    return events.filter((F.col(elapsed) > 0) & (F.col(chars) > 0)).withColumn("ms_per_char", pace).filter((F.col("ms_per_char") >= lo) & (F.col("ms_per_char") <= hi))


def ewma(events: DataFrame, key: str, *order: str, value: str = "ms_per_char", alpha: float = LEARNING) -> DataFrame:
    """``key, ewma``: exponentially weighted mean in order; the first value is the seed."""
    values = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    rolled = F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x["__v"]).otherwise(a * (1 - alpha) + x["__v"] * alpha))
    return events.groupBy(key).agg(rolled.alias("ewma"))


def rolling_eta(events: DataFrame, key: str, *order: str, total: Column, duration: str = "duration_ms", n: int = 8) -> DataFrame:
    """Adds ``done``, the mean of the last ``n`` durations, and the time left where it is worth showing."""
    line = W.partitionBy(key).orderBy(*order)
    staged = events.withColumn("done", F.row_number().over(line)).withColumn("avg_ms", F.avg(duration).over(line.rowsBetween(-(n - 1), 0)))
    left = R.js_round(F.col("avg_ms") * (total - F.col("done")))
    return staged.withColumn("eta_ms", F.when(left >= 3000, left))


def percents(df: DataFrame, section: str, sections: str, paragraph: str, paragraphs: str, sentence: str, sentences: str) -> DataFrame:
    """Adds three percentages that are not the same: of the shelf, of reading, of speech."""
    s, n, p, pn, t, tn = map(F.col, (section, sections, paragraph, paragraphs, sentence, sentences))
    n1 = F.greatest(F.lit(1), n)
    shelf = R.js_round(R.clamp(s + 1, F.lit(1), n1) / n1 * 100)
    within = F.when(pn > 1, p / (pn - 1)).otherwise(0.0)
    speech = F.when(tn > 0, t / F.greatest(F.lit(1), tn - 1) * 100).otherwise(0.0)
    return df.withColumn("shelf_percent", shelf).withColumn("reading_percent", (s + within) / n1 * 100).withColumn("speech_percent", speech)


def speech_position(sentences: DataFrame, key: str, current: Column, ms_per_char: float = MS_PER_CHAR, order: str = "sentence_no", text: str = "sentence") -> DataFrame:
    """``key, duration_s, position_s`` of the sentence that is being read."""
    n = F.length(text)
    total, before = F.sum(n), F.sum(F.when(F.col(order) < current, n).otherwise(0))
    duration = F.greatest(F.lit(1.0), total * ms_per_char / 1000)
    return sentences.groupBy(key).agg(duration.alias("duration_s"), R.clamp(before * ms_per_char / 1000, F.lit(0.0), duration).alias("position_s"))


def position_at(boundaries: DataFrame, probes: DataFrame, key: str, at: str, current: str | None = None) -> DataFrame:
    """Adds to each probe the last sentence that starts at or before ``at``; never before ``current``.

    Joined on the unit; boundaries of a unit are few and bounded by its length.
    """
    grouped = boundaries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "sentence_no"))).alias("__b"))
    passed = F.filter("__b", lambda x: x.start <= F.col(at))
    found = F.coalesce(F.element_at(F.when(F.size(passed) > 0, passed), -1).sentence_no, F.get("__b", F.lit(0)).sentence_no)
    joined = probes.join(grouped, key, "left")
    return joined.withColumn("sentence_no", F.greatest(F.col(current), found) if current else found).drop("__b")


def restore_position(progress: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Progress clamped to the sections and sentences that exist: ``sections`` has ``key, section_count, sentence_count``."""
    joined = progress.join(sections, key)
    section = R.clamp(F.coalesce("section_index", F.lit(0)), F.lit(0), F.greatest(F.col("section_count") - 1, F.lit(0)))
    sentence = R.clamp(F.coalesce("sentence_index", F.lit(0)), F.lit(0), F.greatest(F.col("sentence_count") - 1, F.lit(0)))
    return joined.withColumn("section_index", section).withColumn("sentence_index", sentence)


def debounce(events: DataFrame, key: str, gap: str = GAP, ts: str = "ts", value: Column | None = None, by: Column | None = None) -> DataFrame:
    """``key, start, saved, n``: of each run of updates closer than ``gap`` the last value, in order of ``by``, is saved."""
    value, by = (F.col("value") if value is None else value), (F.col(ts) if by is None else by)
    runs = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.max_by(value, by).alias("saved"), F.count("*").alias("n"))
    return runs.select(key, F.col("w.start").alias("start"), "saved", "n")


def saves(updates: DataFrame, key: str = "book_id", gap: str = GAP, ts: str = "ts", seq: str = "seq", immediate: str = "immediate") -> DataFrame:
    """``key, seq, saved_ms, cause``: updates that nothing follows for ``gap``, and immediate ones at once, which end a wait before them."""
    line = W.partitionBy(key).orderBy("__ms", seq)
    wait = F.expr(f"unix_millis(timestamp_millis(0) + INTERVAL {gap})")
    staged = updates.withColumn("__ms", F.unix_millis(ts)).withColumn("__next", F.lead("__ms").over(line))
    paused = F.col("__next").isNull() | (F.col("__next") - F.col("__ms") >= wait)
    cause = F.when(F.col(immediate), "chapter").when(paused, "pause")
    at = F.when(F.col(immediate), F.col("__ms")).otherwise(F.col("__ms") + wait)
    return staged.select(key, seq, at.alias("saved_ms"), cause.alias("cause")).filter("cause IS NOT NULL")


def apply_sleep_timer(events: DataFrame, timers: DataFrame, key: str, ts_ms: str = "ts_ms", ends_ms: str = "ends_ms") -> DataFrame:
    """Events before their timer ends, with the volume of the last minute; events without a timer stay."""
    joined = events.join(timers, key, "left").filter(F.col(ends_ms).isNull() | (F.col(ts_ms) < F.col(ends_ms)))
    return joined.withColumn("volume", R.fade_volume(F.col(ts_ms), F.col(ends_ms)))


def drop_superseded(results: DataFrame, key: str, gen: str = "gen") -> DataFrame:
    """Results of each key's newest run."""
    newest = results.groupBy(key).agg(F.max(gen).alias(gen))
    return results.join(newest, [key, gen], "left_semi")


def resume_after_append(waiting: DataFrame, appended: DataFrame, key: str, within: str | None = None, ts: str = "ts") -> DataFrame:
    """Readers that wait at the end of a book, at the section that came next: ``waiting`` has ``last_section``.

    With ``within``, ``waiting`` (with ``ts``) keeps the readers for whom none came in that time: ``section_no`` and
    ``resumed_at`` are null then.
    """
    if within is None:
        return waiting.join(appended.withColumn("last_section", F.col("section_no") - 1), [key, "last_section"])
    came = appended.select(key, "section_no", F.col(ts).alias("resumed_at"), (F.col("section_no") - 1).alias("last_section")).alias("a")
    w = waiting.alias("w")
    match = (F.col(f"w.{key}") == F.col(f"a.{key}")) & (F.col("w.last_section") == F.col("a.last_section"))
    near = F.expr(f"a.resumed_at >= w.{ts} AND a.resumed_at <= w.{ts} + INTERVAL {within}")
    return w.join(came, match & near, "left").select("w.*", "a.section_no", "a.resumed_at")
