"""Layout items, page rasters and audio clips."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import reading as R
from quire.functions import text as T
from quire.operators import folds
from quire.operators.segments import exploded

# They must equal the source application's for equal results.
LINE_TOLERANCE, INK_SHARE, PADDING, LEAST_CROP, MOST_CROP = 2.5, 0.06, 0.025, 0.25, 0.96


def items_to_lines(items: DataFrame, *key: str, line_tol: float = LINE_TOLERANCE) -> DataFrame:
    """``key, line_no, line`` from positioned items: from top to bottom, grouped around the first item's height, left to right.

    One array per page: pages hold a bounded number of items.
    """
    real = items.filter(T.js_trim(F.col("str")) != "")
    pages = real.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "item_no", "str"))).alias("__items"))

    def new(s: Column, x: Column) -> Column:
        return F.abs(x.down - s.anchor) > line_tol

    at = folds.starts(F.col("__items"), {"anchor": F.lit(0.0)}, new, lambda s, x, is_new: {"anchor": F.when(is_new, x.down).otherwise(s.anchor)})
    pages = pages.withColumn("__at", at)
    lines = F.transform(folds.groups(F.col("__items"), F.col("__at")), lambda g: F.transform(F.array_sort(F.transform(g, lambda i: F.struct(i.x, i.item_no, i.str.alias("str")))), lambda i: i.str))
    rows = exploded(pages.withColumn("__lines", lines), "__lines", "line_no", "__parts", *key)
    rows = rows.withColumn("__e", folds.elements(F.col("__parts")))
    return rows.select(*key, "line_no", folds.joined(F.col("__e")).alias("line"))


def ink_crop(pixels: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, x0, x1, y0, y1, useful``: the box around rows and columns with ink, padded.

    ``pixels``: key, y, x, r, g, b. One aggregation with grouping sets gives both projections.
    """
    dark = 255 - R.gray_contrast(F.col("r"), F.col("g"), F.col("b"))
    shaded = pixels.select(key, "y", "x", dark.alias("dark"))
    both = shaded.groupingSets([[F.col(key), F.col("y")], [F.col(key), F.col("x")]], F.col(key), F.col("y"), F.col("x")).agg(F.sum("dark").alias("ink"))
    most = both.groupBy(key).agg(F.max(F.when(F.col("y").isNotNull(), F.col("ink"))).alias("row_max"), F.max(F.when(F.col("x").isNotNull(), F.col("ink"))).alias("column_max"), F.max("y").alias("h"), F.max("x").alias("w"))
    inked = both.join(most, key)
    rows, columns = F.col("ink") > F.col("row_max") * INK_SHARE, F.col("ink") > F.col("column_max") * INK_SHARE
    box = inked.groupBy(key, "h", "w").agg(F.min(F.when(rows, F.col("y"))).alias("top"), F.max(F.when(rows, F.col("y"))).alias("bottom"), F.min(F.when(columns, F.col("x"))).alias("left"), F.max(F.when(columns, F.col("x"))).alias("right"))
    pad_x, pad_y = F.ceil((F.col("w") + 1) * PADDING), F.ceil((F.col("h") + 1) * PADDING)
    cut = box.select(key, "h", "w", F.greatest(F.col("left") - pad_x, F.lit(0)).alias("x0"), F.least(F.col("right") + pad_x, F.col("w")).alias("x1"), F.greatest(F.col("top") - pad_y, F.lit(0)).alias("y0"), F.least(F.col("bottom") + pad_y, F.col("h")).alias("y1"))
    share = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) / ((F.col("w") + 1) * (F.col("h") + 1))
    return cut.select(key, "x0", "x1", "y0", "y1", ((share > LEAST_CROP) & (share < MOST_CROP)).alias("useful"))


def clip_stats(clips: DataFrame) -> DataFrame:
    """``clip_id, rms, seconds`` of ``clip_id, sample_rate, samples``."""
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return clips.select("clip_id", F.sqrt(energy / F.greatest(F.size("samples"), F.lit(1))).alias("rms"), (F.size("samples") / F.col("sample_rate")).alias("seconds"))


# Frame, hop, searched frequencies, least correlation and loudness of the source application's estimate.
FRAME, HOP, LOWEST_HZ, HIGHEST_HZ, LEAST_CORRELATION, GATE = 0.04, 0.02, 80, 400, 0.5, 0.2


def _pitch(samples: np.ndarray, rate: int) -> tuple[float, float]:
    """Median pitch of the voiced frames, and their share."""
    frame, hop, shortest, longest = int(rate * FRAME), max(1, int(rate * HOP)), max(1, rate // HIGHEST_HZ), rate // LOWEST_HZ
    starts = np.arange(0, max(0, len(samples) - frame - longest), hop)
    if not len(starts) or not frame:
        return 0.0, 0.0
    gate, found = max(1e-5, GATE * np.sqrt(np.mean(samples * samples))), []
    for at in starts:
        part = samples[at : at + frame + longest]
        part = part - part[:frame].mean()
        energy = part[:frame] @ part[:frame]
        if np.sqrt(energy / frame) < gate:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(part, frame)[shortest : longest + 1]
        r = windows @ part[:frame] / np.sqrt(energy * (windows * windows).sum(axis=1) + 1e-12)
        if r.max() > LEAST_CORRELATION:
            found.append(rate / (shortest + int(r.argmax())))
    return (sorted(found)[len(found) // 2] if found else 0.0), len(found) / len(starts)


def pitch(clips: DataFrame) -> DataFrame:
    """``clip_id, pitch, voiced`` of ``clip_id, sample_rate, samples``: normalised cross-correlation of frames; 0 where no frame is voiced."""

    @F.arrow_udf("pitch double, voiced double")
    def estimated(rate: pa.Array, samples: pa.Array) -> pa.Array:
        both = [_pitch(np.array(s if s is not None else [], np.float64), r or 0) for r, s in zip(rate.to_pylist(), (x.values.to_numpy() if x.is_valid else None for x in samples), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in both], pa.float64()) for i in (0, 1)], ["pitch", "voiced"])

    return clips.select("clip_id", estimated(F.col("sample_rate"), F.col("samples")).alias("p")).select("clip_id", "p.pitch", "p.voiced")


#: Least loudness, the pitch that parts low from high voices, and how many of each.
LEAST_RMS, HIGH_HZ, SPEAKERS = 0.01, 165, 2


def pick_speakers(rows: DataFrame, *keys: str, order: str = "sid") -> DataFrame:
    """``keys, id, sid``: of each group of ``keys, sid, pitch, rms`` the two lowest and two highest voices; without any pitch four evenly spaced ones."""
    loud = rows.filter(F.col("rms") >= LEAST_RMS)
    group = W.partitionBy(*keys, "__high")
    pitched = loud.filter("pitch > 0").withColumn("__high", F.col("pitch") >= HIGH_HZ)
    up = F.row_number().over(group.orderBy("pitch", order))
    down = F.row_number().over(group.orderBy(F.desc("pitch"), F.desc(order)))
    ranked = pitched.withColumn("__n", F.when(F.col("__high"), down).otherwise(up)).filter(F.col("__n") <= SPEAKERS)
    chosen = ranked.select(*keys, F.concat(F.when(F.col("__high"), "female-").otherwise("male-"), F.col("__n").cast("string")).alias("id"), order)
    numbered = loud.join(pitched.select(*keys).distinct(), list(keys), "left_anti").withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).withColumn("__of", F.count("*").over(W.partitionBy(*keys)))
    n = F.col("__of")
    places = F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(n / 3), F.floor(n * 2 / 3), n - 1))
    spaced = numbered.withColumn("__p", F.array_position(places, F.col("__i").cast("long"))).filter("__p > 0")
    return chosen.unionByName(spaced.select(*keys, F.concat(F.lit("voice-"), F.col("__p").cast("string")).alias("id"), order))
