"""Places of rows in their group's order, without a group in one task; CRC-32 in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.decontaminate import checked
from quire.llm.store import keep


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df``, kept as Parquet, with ``pos`` (from 0, by ``order`` with null first) and ``size`` of its ``group``, a column without null.

    Rows are dealt by ranges of group and order, so a group of any size spreads over tasks; a row's place is its place
    within its task plus what the tasks before it hold of its group. ``order`` must name all that tells rows apart: rows
    equal in it stand in any order, and a salt spreads them too.
    """
    dealt = df.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(group, *order, "__salt").sortWithinPartitions(group, *order, "__salt")
    placed = keep(dealt.drop("__salt").withColumn("__row", F.monotonically_increasing_id()), name)
    task = F.shiftright("__row", 33).alias("__task")
    line = W.partitionBy(group).orderBy("__task")
    parts = placed.groupBy(group, task).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("__first")
    parts = keep(parts.select(group, "__task", before.alias("__shift"), F.sum("__n").over(W.partitionBy(group)).alias("size")), f"{name}-parts")
    return placed.withColumn("__task", task).join(checked(parts), [group, "__task"]).withColumn("pos", F.col("__row") + F.col("__shift")).drop("__row", "__task", "__shift")


def crc32(c: Column) -> Column:
    """Unsigned CRC-32 of a number as decimal text."""
    return F.crc32(c.cast("string"))


def crc32_sql(e: str) -> str:
    """The same in DuckDB's SQL."""
    step = "lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    codes = f"list_transform(string_split(CAST({e} AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), {step})))"
