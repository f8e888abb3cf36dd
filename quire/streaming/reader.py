"""Streams of the reader's loop: saves that wait for a pause, newest runs, cached pages, readers that wait for more.

Each equals its batch operator on rows that come in any order within the watermark. Start the first three inside
``typed_state``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quire.operators.library import CACHE_DAYS
from quire.operators.progress import GAP
from quire.streaming.state import Alarm, milliseconds, timed


class _Saves(StatefulProcessor):
    """Updates of a book that may still be followed by another; the timer is moved by what comes.

    What is held is one value, read and written once for all rows of a batch: a call to the store costs far more than a row.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ms array<long>, seq array<long>, immediate array<boolean>")
        self.alarm = Alarm(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = {(ms, seq): immediate for ms, seq, immediate in zip(*(self.held.get() or ((), (), ())), strict=True)}
        first = None
        for r in rows:
            if (r.ms, r.seq) not in held:
                held[r.ms, r.seq] = r.immediate
                if r.immediate:
                    yield Row(book_id=key[0], seq=r.seq, saved_ms=r.ms, cause="chapter")
                first = r.ms if first is None else min(first, r.ms)
        if first is not None:
            self._hold([(ms, seq, immediate) for (ms, seq), immediate in held.items()])
            self.alarm.by(first + self.gap)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.alarm.off()
        held, now = sorted(zip(*self.held.get(), strict=True)), timerValues.getCurrentWatermarkInMs()
        done = 0
        for (ms, seq, immediate), after in zip(held, [*held[1:], None], strict=True):
            if ms + self.gap > now:
                self.alarm.by(ms + self.gap)
                break
            if not immediate and (after is None or after[0] - ms >= self.gap):
                yield Row(book_id=key[0], seq=seq, saved_ms=ms + self.gap, cause="pause")
            done += 1
        self._hold(held[done:])

    def _hold(self, rows: list[tuple]) -> None:
        if rows:
            self.held.update(tuple(map(list, zip(*rows, strict=True))))
        else:
            self.held.clear()


def saves(updates: DataFrame, gap: str = GAP, watermark: str = "10 seconds") -> DataFrame:
    """``book_id, seq, saved_ms, cause`` of the updates (``book_id, ts, seq, immediate``) that are saved.

    An update is saved when nothing follows for ``gap``; an immediate one, such as a change of chapter, as it comes, and
    what waited before it is not saved any more. Rows that repeat an update change nothing while it is held.
    """
    rows = timed(updates.select("book_id", F.col("seq").cast("long").alias("seq"), "immediate", "ts"), "ts", watermark)
    kind = dict(updates.dtypes)["book_id"]
    return rows.groupBy("book_id").transformWithState(_Saves(milliseconds(gap)), f"book_id {kind}, seq long, saved_ms long, cause string", "append", "eventTime")


class _Newest(StatefulProcessor):
    """The highest run of a key, and results of it that a newer one may still replace: one value, as in ``_Saves``."""

    def __init__(self, wait: int, remember: int) -> None:
        self.wait, self.remember = wait, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "gen long, latest long")
        self.held = handle.getValueState("held", "result array<long>, ms array<long>")
        self.alarm = Alarm(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        top, latest = self.top.get() or (None, 0)
        held, first = self._held(), None
        for r in rows:
            if top is not None and r.gen < top:
                continue
            if top is None or r.gen > top:
                top = r.gen
                held, first = {}, None
            held[r.result] = r.ms
            first = r.ms if first is None else min(first, r.ms)
            latest = max(latest, r.ms)
        if first is not None:
            self.top.update((top, latest))
            self._hold(held)
            self.alarm.by(first + self.wait)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.alarm.off()
        (top, latest), now = self.top.get(), timerValues.getCurrentWatermarkInMs()
        rest = {}
        for result, ms in sorted(self._held().items()):
            if ms + self.wait <= now:
                yield Row(doc_id=key[0], gen=top, result=result)
            else:
                rest[result] = ms
        self._hold(rest)
        if rest:
            self.alarm.by(min(rest.values()) + self.wait)
        if latest + self.wait + self.remember <= now:
            self.top.clear()
        else:
            self.alarm.by(latest + self.wait + self.remember)

    def _held(self) -> dict[int, int]:
        return dict(zip(*(self.held.get() or ((), ())), strict=True))

    def _hold(self, held: dict[int, int]) -> None:
        if held:
            self.held.update((list(held), list(held.values())))
        else:
            self.held.clear()


def newest_runs(results: DataFrame, wait: str = "1 hour", remember: str = "1 day", watermark: str = "10 minutes") -> DataFrame:
    """``doc_id, gen, result`` of each document's newest run, from ``doc_id, gen, result, ts``.

    Results of older runs are dropped as they come; those that came before are dropped if the newer run comes
    within ``wait`` of event time. A run is remembered for ``remember`` after its last result.
    """
    rows = timed(results.select("doc_id", F.col("gen").cast("long").alias("gen"), F.col("result").cast("long").alias("result"), "ts"), "ts", watermark)
    kind = dict(results.dtypes)["doc_id"]
    return rows.groupBy("doc_id").transformWithState(_Newest(milliseconds(wait), milliseconds(remember)), f"doc_id {kind}, gen long, result long", "append", "eventTime")


class _Cache(StatefulProcessor):
    """Texts of pages, each with a lifetime."""

    def __init__(self, lifetime: int) -> None:
        self.lifetime = lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page_number int", "text string, updated long", ttlDurationMs=self.lifetime)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        # Each page is read and written once for all rows of a batch: a call to the store costs far more than a row.
        pages, written = {}, set()
        for n, text, ms in sorted(((r.page_number, r.text, r.ms) for r in rows), key=lambda r: (r[2], r[1] is None)):
            if n not in pages:
                pages[n] = self.pages.getValue((n,))
            found = pages[n]
            if text is not None:
                if found is None or found[1] <= ms:
                    pages[n] = (text, ms)
                    written.add(n)
            else:
                hit = found is not None and found[1] > ms - self.lifetime
                yield Row(file_key=key[0], lang=key[1], page_number=n, ms=ms, cache_hit=hit, cache_text=found[0] if hit else None)
        for n in written:
            self.pages.updateValue((n,), pages[n])


def cached_pages(rows: DataFrame, lifetime: str = f"{CACHE_DAYS} days") -> DataFrame:
    """Lookups answered from the pages that came before: ``rows`` are ``file_key, lang, page_number, text, ts``, a null text asks for the page.

    The store lets go of a page ``lifetime`` after it was written, without a scan; a page that is as old by event time is no
    hit either. An empty text is one. Rows without key, language or page number take no part. A store by the clock makes
    batches without data as long as the query runs: one that is to end by itself needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    whole = rows.filter("file_key IS NOT NULL AND file_key <> '' AND lang IS NOT NULL AND page_number IS NOT NULL")
    asked = whole.select("file_key", "lang", F.col("page_number").cast("int").alias("page_number"), "text", F.unix_millis("ts").alias("ms"))
    return asked.groupBy("file_key", "lang").transformWithState(_Cache(milliseconds(lifetime)), "file_key string, lang string, page_number int, ms long, cache_hit boolean, cache_text string", "append", "processingTime")


def resumed_readers(waiting: DataFrame, appended: DataFrame, within: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """``waiting`` (``book_id, last_section, ts`` and more) with ``resumed_at`` and ``section_no`` of the next section, if it comes ``within``; else null, once the watermark is past that.

    Either side may come first. The join keeps a row as long as the other side can still bring its match.
    """
    w = waiting.withWatermark("ts", watermark).alias("w")
    a = appended.select(F.col("book_id").alias("__book"), F.col("section_no"), F.col("ts").alias("resumed_at")).withWatermark("resumed_at", watermark).alias("a")
    match = F.expr(f"w.book_id = a.__book AND w.last_section + 1 = a.section_no AND a.resumed_at >= w.ts AND a.resumed_at <= w.ts + INTERVAL {within}")
    return w.join(a, match, "left_outer").select("w.*", "a.section_no", "a.resumed_at")
