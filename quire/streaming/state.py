"""What streams with typed state have in common."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep state variables: their store is set, and the session's own set back behind them."""
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, own) if own else spark.conf.unset(PROVIDER)


def milliseconds(span: str) -> int:
    """``"10 minutes"`` as a number."""
    number, unit = span.split()
    return int(float(number) * MS[unit.rstrip("s")])


def timed(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    """``df`` with a watermark on ``ts``, and the time as ``ms``."""
    return df.withWatermark(ts, watermark).withColumn("ms", F.unix_millis(ts))


class Alarm:
    """One timer of a key: it only ever moves to an earlier time, until it has rung."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.at = handle, handle.getValueState("alarm", "at long")

    def by(self, ms: int) -> None:
        set_ = self.at.get()
        if set_ is None or ms < set_[0]:
            if set_ is not None:
                self.handle.deleteTimer(set_[0])
            self.handle.registerTimer(ms)
            self.at.update((ms,))

    def to(self, ms: int) -> None:
        """Move to any time."""
        self.off()
        self.by(ms)

    def off(self) -> None:
        if (set_ := self.at.get()) is not None:
            self.handle.deleteTimer(set_[0])
            self.at.clear()
