"""Queries over items, pixels and clips made of line items and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import reading as R
from quire.operators import media as M
from quire.plans import registry as S
from quire.plans.registry import query, read

_CHANNEL = "least(255, greatest(0, floor((v + 0.5) * {0})))"


@query("f10_d24_clip_stats", "SELECT vec_id AS clip_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding)), 6) AS rms, round(len(embedding) / 16000.0, 6) AS seconds, CAST(floor((len(embedding) - 16) / 8.0) + 1 AS INTEGER) AS frames FROM embeddings")
def clips(spark, sf_dir):
    from quire.operators.segments import audio_frames

    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.lit(16000).alias("sample_rate"), F.col("embedding").alias("samples"))
    frames = audio_frames(rows, frame=0.001, hop=0.0005).groupBy("clip_id").agg(F.count("*").cast("int").alias("frames"))
    return M.clip_stats(rows).join(frames, "clip_id").select("clip_id", F.round("rms", 6).alias("rms"), F.round("seconds", 6).alias("seconds"), "frames")


@query("b39_gray", f"SELECT vec_id, CAST(g.i - 1 AS INTEGER) AS i, round(least(greatest(({_CHANNEL.format(255)} * 0.299 + {_CHANNEL.format(200)} * 0.587 + {_CHANNEL.format(150)} * 0.114 - 128) * 1.12 + 128, 0.0), 255.0), 6) AS gray FROM (SELECT vec_id, g.i, CAST(embedding[g.i] AS DOUBLE) AS v FROM embeddings, unnest(generate_series(1, len(embedding))) AS g(i)) AS g")
def gray(spark, sf_dir):
    v = F.col("v").cast("double")
    channel = lambda n: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 0.5) * n)))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rows.select("vec_id", "i", F.round(R.gray_contrast(channel(255), channel(200), channel(150)), 6).alias("gray"))


@query("f09_ink_crop", """WITH p AS (SELECT vec_id, (g.i - 1) // 8 AS y, (g.i - 1) % 8 AS x, CASE WHEN (g.i - 1) // 8 BETWEEN vec_id % 4 AND vec_id % 4 + 3 AND (g.i - 1) % 8 BETWEEN vec_id % 3 AND vec_id % 3 + 4 THEN 40 + g.i ELSE 255 END AS r FROM embeddings, unnest(generate_series(1, len(embedding))) AS g(i)),
d AS (SELECT *, 255 - least(greatest((r * 0.299 + r * 0.587 + r * 0.114 - 128) * 1.12 + 128, 0.0), 255.0) AS dark FROM p),
ys AS (SELECT vec_id, y, sum(dark) AS ink, max(sum(dark)) OVER (PARTITION BY vec_id) AS most FROM d GROUP BY 1, 2), xs AS (SELECT vec_id, x, sum(dark) AS ink, max(sum(dark)) OVER (PARTITION BY vec_id) AS most FROM d GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT vec_id, min(y) FILTER (ink > most * 0.06) AS top, max(y) FILTER (ink > most * 0.06) AS bottom, max(y) AS h FROM ys GROUP BY 1) JOIN (SELECT vec_id, min(x) FILTER (ink > most * 0.06) AS l, max(x) FILTER (ink > most * 0.06) AS r, max(x) AS w FROM xs GROUP BY 1) USING (vec_id)),
c AS (SELECT vec_id, h, w, greatest(l - 1, 0) AS x0, least(r + 1, w) AS x1, greatest(top - 1, 0) AS y0, least(bottom + 1, h) AS y1 FROM b)
SELECT vec_id, x0, x1, y0, y1, (x1 - x0 + 1) * (y1 - y0 + 1) / ((w + 1) * (h + 1))::DOUBLE > 0.25 AND (x1 - x0 + 1) * (y1 - y0 + 1) / ((w + 1) * (h + 1))::DOUBLE < 0.96 AS useful FROM c""")
def crop(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    y, x, n = F.floor(F.col("i") / 8), F.col("i") % 8, F.col("vec_id")
    ink = y.between(n % 4, n % 4 + 3) & x.between(n % 3, n % 3 + 4)
    r = F.when(ink, 41 + F.col("i")).otherwise(255)
    return M.ink_crop(rows.select("vec_id", y.alias("y"), x.alias("x"), r.alias("r"), r.alias("g"), r.alias("b")), "vec_id")


@query("d01_items_to_lines", f"""WITH RECURSIVE i AS (SELECT l_orderkey AS k, l_returnflag || l_linestatus || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '章' ELSE '' END AS s, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y, l_linenumber AS no FROM lineitem),
e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y DESC, x, no, s) AS i FROM i),
f AS (SELECT k, i, y AS anchor, 0 AS g FROM e WHERE i = 1 UNION ALL SELECT e.k, e.i, CASE WHEN abs(e.y - f.anchor) > 2.5 THEN e.y ELSE f.anchor END, f.g + CASE WHEN abs(e.y - f.anchor) > 2.5 THEN 1 ELSE 0 END FROM f JOIN e ON e.k = f.k AND e.i = f.i + 1),
l AS (SELECT f.k, f.g, e.s, row_number() OVER (PARTITION BY f.k, f.g ORDER BY x, no, s) AS n, lag(e.s) OVER (PARTITION BY f.k, f.g ORDER BY x, no, s) AS b FROM f JOIN e USING (k, i))
SELECT k AS l_orderkey, g AS line_no, string_agg(CASE WHEN n > 1 AND {S.needs_space('b', 's')} THEN ' ' ELSE '' END || s, '' ORDER BY n) AS line FROM l GROUP BY 1, 2""")
def items(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    rows = rows.select("l_orderkey", F.col("l_linenumber").alias("item_no"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "章").otherwise("")).alias("str"), (F.col("l_partkey") % 50).cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    return M.items_to_lines(rows, "l_orderkey")


@query("f11_pitch")
def pitch(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.lit(800).alias("sample_rate"), F.col("embedding").alias("samples"))
    return M.pitch(rows)


@query(
    "g12_speakers",
    """WITH r AS (SELECT vec_id % 20 AS pack, vec_id AS sid, CASE WHEN vec_id % 20 < 3 THEN 0.0 ELSE floor(abs(CAST(embedding[1] AS DOUBLE)) * 1000) END AS pitch, abs(CAST(embedding[2] AS DOUBLE)) AS rms FROM embeddings),
l AS (SELECT * FROM r WHERE rms >= 0.01),
p AS (SELECT pack, sid, pitch >= 165 AS high, CASE WHEN pitch >= 165 THEN row_number() OVER (PARTITION BY pack, pitch >= 165 ORDER BY pitch DESC, sid DESC) ELSE row_number() OVER (PARTITION BY pack, pitch >= 165 ORDER BY pitch, sid) END AS n FROM l WHERE pitch > 0),
s AS (SELECT pack, sid, row_number() OVER (PARTITION BY pack ORDER BY sid) - 1 AS i, count(*) OVER (PARTITION BY pack) AS m FROM l WHERE pack NOT IN (SELECT pack FROM p)),
q AS (SELECT pack, sid, CASE WHEN i = 0 THEN 1 WHEN i = m // 3 THEN 2 WHEN i = m * 2 // 3 THEN 3 WHEN i = m - 1 THEN 4 END AS n FROM s)
SELECT pack, CASE WHEN high THEN 'female-' ELSE 'male-' END || n AS id, sid FROM p WHERE n <= 2 UNION ALL SELECT pack, 'voice-' || n, sid FROM q WHERE n IS NOT NULL""",
)
def speakers(spark, sf_dir):
    pitch = F.when(F.col("vec_id") % 20 < 3, 0.0).otherwise(F.floor(F.abs(F.col("embedding")[0].cast("double")) * 1000).cast("double"))
    rows = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("pack"), F.col("vec_id").alias("sid"), pitch.alias("pitch"), F.abs(F.col("embedding")[1].cast("double")).alias("rms"))
    return M.pick_speakers(rows, "pack")
