"""Streams of pages, progress and timing; each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quire.operators import pages as P
from quire.operators.progress import LEARNING
from quire.streaming.state import Alarm, milliseconds, timed

#: What a text may hold and still be blank.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def windowed_counts(df: DataFrame, window: str, slide: str | None = None, by: str | None = None, watermark: str = "10 minutes", ts: str = "ts", session: bool = False) -> DataFrame:
    """``start[, by], n``: events per window of event time, or per session that a gap of ``window`` ends; late events beyond the watermark are dropped when ``df`` is a stream."""
    held = df.withWatermark(ts, watermark) if df.isStreaming else df
    keys = [(F.session_window(ts, window) if session else F.window(ts, window, slide or window)).alias("w"), *([by] if by else [])]
    return held.groupBy(*keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *([by] if by else []), "n")


class _Release(StatefulProcessor):
    """Pages of a document that wait for an earlier one, and how far it has come."""

    def __init__(self, limits: dict[str, int], wait: int | None, remember: int) -> None:
        self.limits, self.wait, self.remember = limits, wait, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "page_number int", "total int, text string, ms long, failed boolean")
        self.at = handle.getValueState("at", "next_page int, chars long, blank boolean, first int, began long, latest long, ended boolean")
        self.alarm = Alarm(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        at = self.at.get() or (1, 0, True, 0, 0, 0, False)
        if at[-1]:  # a replay
            return
        latest = at[5]
        for r in rows:
            if r.page_number >= at[0] and not self.waiting.containsKey((r.page_number,)):
                self.waiting.updateValue((r.page_number,), (r.total, r.text, r.ms, r.failed))
                latest = max(latest, r.ms)
        yield from self._release(key[0], (*at[:5], latest, False), gaps=False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        at = self.at.get()
        self.alarm.off()
        if at[-1]:
            self.at.clear()
        elif at[5] + self.wait > timerValues.getCurrentWatermarkInMs():
            self.alarm.by(at[5] + self.wait)
        else:
            yield from self._release(key[0], at, gaps=True)

    def _release(self, doc_id: str, at: tuple, gaps: bool) -> Iterator[Row]:
        next_page, chars, blank, first, began, latest, _ = at
        m, error = self.limits, None
        order = iter(sorted(k[0] for k in self.waiting.keys())) if gaps else None
        while error is None:
            page = next(order, None) if gaps else next_page
            found = None if page is None else self.waiting.getValue((page,))
            if found is None:
                break
            self.waiting.removeKey((page,))
            total, text, ms, failed = found
            if failed:
                error = "failed"
                break
            text = text or ""
            chars, blank, next_page, began = chars + len(text), blank and not text.strip(BLANKS), page + 1, began or ms
            late = total >= m["force_pages"] or ms - began >= m["after_ms"]
            if not first and late and page >= m["min_pages"] and total - page >= m["min_remaining"] and chars >= m["min_chars"]:
                first = page
            yield Row(doc_id=doc_id, page_number=page, text=text, batch_no=0 if not first or page <= first else (page - first - 1) // m["batch"] + 1, error=None)
            if page >= total:
                error = "empty" if blank else ""
        if gaps and error is None:
            error = "gap"
        if error:
            yield Row(doc_id=doc_id, page_number=None, text=None, batch_no=None, error=error)
        self.at.update((next_page, chars, blank, first, began, latest, error is not None))
        if error is not None:
            self.waiting.clear()
            self.alarm.to(latest + self.remember)
        elif self.wait is not None:
            self.alarm.by(latest + self.wait)


def release_in_order(pages: DataFrame, min_pages: int = P.MIN_PAGES, min_remaining: int = P.MIN_REMAINING, min_chars: int = P.MIN_CHARS, after_ms: int = P.AFTER_MS, force_pages: int = P.FORCE_PAGES, batch: int = P.BATCH_PAGES, wait: str | None = None, remember: str = "1 day", watermark: str = "10 minutes") -> DataFrame:
    """Pages (``doc_id, page_number, total, text, ts``, perhaps ``failed``) released without gaps, each with the batch that publishes it.

    The first publication waits for pages, characters, what remains, and for ``after_ms`` of event time unless
    the document has ``force_pages``. A document ends with its last page: a row without page says ``empty`` if all its
    pages were blank. It ends too with a page that ``failed``, as the row says; what was released before stays. With
    ``wait`` a document ends when the watermark is so far past its latest page: what waits behind a gap is released in
    order, and a row says ``gap``. Of a page that comes twice the first counts; pages of a document that has ended
    change nothing, for ``remember`` of event time.

    State per document: a row for each page that waits, a row of counters, one timer. Start the query inside ``typed_state``.
    """
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in pages.columns else F.lit(False)
    rows = timed(pages.select("doc_id", "page_number", "total", "text", "ts", failed.alias("failed")), "ts", watermark)
    limits = {"min_pages": min_pages, "min_remaining": min_remaining, "min_chars": min_chars, "after_ms": after_ms, "force_pages": force_pages, "batch": batch}
    step = _Release(limits, None if wait is None else milliseconds(wait), milliseconds(remember))
    return rows.groupBy("doc_id").transformWithState(step, f"doc_id {dict(pages.dtypes)['doc_id']}, page_number int, text string, batch_no int, error string", "append", "eventTime")


def ewma_stream(events: DataFrame, alpha: float = LEARNING) -> DataFrame:
    """``key, ewma`` after every micro-batch of ``key, ts, ms_per_char``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        for v in pd.concat(list(batches)).sort_values("ts")["ms_per_char"]:
            mean = float(v) if mean is None else mean * (1 - alpha) + float(v) * alpha
        state.update((mean,))
        yield pd.DataFrame({"key": [key[0]], "ewma": [mean]})

    return events.select("key", "ts", "ms_per_char").groupBy("key").applyInPandasWithState(step, "key string, ewma double", "ewma double", "update", GroupStateTimeout.NoTimeout)
