"""Greedy left folds over the elements of a row's array.

Flags of each element are computed once, natively; the fold itself carries only small values and
returns the places where a new group starts. These are carried in runs of ``RUN``, so that no long
list is copied for each of its elements, and no text is copied at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


#: Starts in a run.
RUN = 64


def elements(texts: Column, alone: bool = True, **more: Callable[[Column, Column], Column]) -> Column:
    """Array of structs with each text's ``t, len, strong, space``, ``standalone, colon`` if ``alone``, and ``more``.

    ``space``: whether a blank joins it to the text before it. ``more`` gets (text, text before).
    """

    def one(x: Column, before: Column) -> Column:
        flags = {"t": x, "len": F.length(x), "strong": T.has_strong_ending(x), "space": T.needs_space(before, x)}
        if alone:
            flags |= {"standalone": T.is_standalone(x), "colon": T.has(x, T.STANDALONE[0])}
        flags |= {name: f(x, before) for name, f in more.items()}
        return F.struct(*(c.alias(name) for name, c in flags.items()))

    before = F.concat(F.array(F.lit("")), F.slice(texts, 1, F.greatest(F.size(texts) - 1, F.lit(0))))
    return F.zip_with(texts, F.when(F.size(texts) > 0, before).otherwise(F.array().cast("array<string>")), one)


def starts(items: Column, init: dict[str, Column], new: Callable[[Column, Column], Column], step: Callable[[Column, Column, Column], dict[str, Column]]) -> Column:
    """Numbers (from 1) of the elements that start a group.

    ``new(state, x)`` decides; ``step(state, x, is_new)`` gives the next state. The first element always starts.
    """
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("i"), none.alias("at"), F.array().cast("array<array<int>>").alias("before"), *(c.alias(k) for k, c in init.items()))

    def merge(s: Column, x: Column) -> Column:
        is_new = (s.i == 0) | new(s, x)
        full = is_new & (F.size(s["at"]) >= RUN)
        at = F.when(full, F.array(s.i + 1)).when(is_new, F.array_append(s["at"], s.i + 1)).otherwise(s["at"])
        before = F.when(full, F.array_append(s["before"], s["at"])).otherwise(s["before"])
        return F.struct((s.i + 1).alias("i"), at.alias("at"), before.alias("before"), *(c.alias(k) for k, c in step(s, x, is_new).items()))

    return F.aggregate(items, zero, merge, lambda s: F.concat(F.flatten(s["before"]), s["at"]))


def groups(items: Column, at: Column) -> Column:
    """The elements cut at the starts: array of arrays."""
    return F.transform(at, lambda s, i: F.slice(items, s, F.coalesce(F.get(at, i + 1), F.size(items) + 1) - s))


def joined(group: Column) -> Column:
    """Text of a group, blanks where the elements ask for them."""
    return F.array_join(F.transform(group, lambda x, i: F.concat(F.when((i > 0) & x.space, " ").otherwise(""), x.t)), "")




def gathered_init() -> dict[str, Column]:
    return {"len": F.lit(0), "strong": F.lit(False), "alone": F.lit(False)}


def gathered(s: Column, x: Column, is_new: Column) -> dict[str, Column]:
    """Next state: a joined text stands alone only by a colon tail of its last element."""
    return {"len": F.when(is_new, x.len).otherwise(s.len + F.when(x.space, 1).otherwise(0) + x.len), "strong": x.strong, "alone": F.when(is_new, x.standalone).otherwise(x.colon)}


def fold(df: DataFrame, column: str, out: str, new: Callable[[Column, Column], Column], **more: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds ``out``: the texts of an array column, joined while ``new(state, x)`` is false.

    Each step is a column of its own: an expression inside a lambda would be computed for every element.
    """
    staged = df.withColumn("__items", elements(F.col(column), **more))
    staged = staged.withColumn("__at", starts(F.col("__items"), gathered_init(), new, gathered))
    # Made by a generator, so that no filter on it is pushed below and computed anew from the staged columns.
    made = F.explode(F.array(F.transform(groups(F.col("__items"), F.col("__at")), joined))).alias(out)
    return staged.select(*(c for c in df.columns if c != out), made)
