"""The newest progress of every book, kept by a stream in a folder of Parquet.

``d-<n>`` holds what micro-batch n brought, ``c-<n>`` the newest rows of all batches up to n. A folder counts once its
writer has left ``_SUCCESS`` in it, so readers never see half of one, and a batch that is replayed writes the same folder
again or, if it was compacted already, nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import library as B

#: Batches between two compactions, and compacted folders that stay for readers that have listed them.
COMPACT_EVERY, COMPACTED_KEPT = 10, 2
NEWEST = ["updated_at", "seq"]


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the whole folders by kind, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"c": [], "d": []}
    for status in fs.listStatus(place) if fs.exists(place) else []:
        kind, _, number = status.getPath().getName().partition("-")
        if kind in found and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    return {k: sorted(v) for k, v in found.items()}


def _parts(path: str, found: dict[str, list[int]]) -> list[str]:
    base = found["c"][-1] if found["c"] else -1
    return [f"{path}/c-{base}"] * (base >= 0) + [f"{path}/d-{n}" for n in found["d"] if n > base]


def newest(df: DataFrame) -> DataFrame:
    return B.latest_per_key(df, "book_id", order=[F.desc(c) for c in NEWEST])


def read_progress(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest row of each book: the last compacted folder and the batches since."""
    parts = _parts(path, _folders(spark, path))
    rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return newest(rows)


def merge_batch(batch: DataFrame, number: int, path: str, compact_every: int = COMPACT_EVERY) -> None:
    """Take micro-batch ``number`` in; again if it is replayed, with the same result."""
    spark = batch.sparkSession
    found = _folders(spark, path)
    if found["c"] and number <= found["c"][-1]:
        return
    newest(batch).write.mode("overwrite").parquet(f"{path}/d-{number}")
    if (number + 1) % compact_every:
        return
    parts = _parts(path, _folders(spark, path))
    newest(spark.read.schema(batch.schema).parquet(*parts)).write.mode("overwrite").parquet(f"{path}/c-{number}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # What the compacted folder before last covers is not read any more.
    kept = _folders(spark, path)["c"][-COMPACTED_KEPT:]
    old = kept[0] if len(kept) == COMPACTED_KEPT else -1
    for kind, numbers in _folders(spark, path).items():
        for n in numbers:
            if n < old or (kind == "d" and n == old):
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}-{n}"), True)


def upsert_progress(stream: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY, available_now: bool = True) -> StreamingQuery:
    """Keep the newest progress of each book (``book_id, updated_at, seq`` and more) in ``path``, of metadata only."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, path, compact_every)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
