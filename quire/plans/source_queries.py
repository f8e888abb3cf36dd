"""Queries over packs, bridges, settings and old layouts, made of the columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import library as B
from quire.operators import pages as P
from quire.plans import registry as S
from quire.plans.registry import query, read
from quire.sources import voices as V


@query("a08_migrated", """SELECT o_custkey AS id, CAST(CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE count(*) END AS INTEGER) AS section_count, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE sum(o_orderkey) END::BIGINT AS moved FROM orders GROUP BY o_custkey""")
def migrated(spark, sf_dir):
    """Customers as books of the old layout, their orders as sections inside; some have none."""
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    books = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct("o_orderkey")).alias("s"))  # the orders of one customer
    old = books.select("id", F.when(F.col("id") % 5 != 0, F.col("s")).alias("sections"))
    meta, contents = B.migrate_inline(old)
    moved = F.aggregate("sections", F.lit(0).cast("long"), lambda a, x: a + x["o_orderkey"])
    return meta.join(contents, "id", "left").select("id", "section_count", F.coalesce(moved, F.lit(0).cast("long")).alias("moved"))


@query("a11_bridge_voices", """SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'en-US' ELSE 'l' || c_nationkey END AS lang, 'bridge://' || replace(url_encode(c_name), '+', '%20') AS voice_uri, TRUE AS is_local, 'bridge' AS source FROM customer WHERE c_custkey % 7 <> 0""")
def bridge_voices(spark, sf_dir):
    """A list of one voice for each customer; some without name or language."""
    n = F.col("c_custkey")
    voice = F.struct(F.when(n % 7 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(n % 3 != 0, F.concat(F.lit("l"), F.col("c_nationkey").cast("string"))).alias("lang"))
    lists = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_name").select(F.to_json(F.array(voice)).alias("json"))
    got = V.normalize_bridge_voices(lists)
    return got.select(F.regexp_extract("name", "([0-9]+)$", 1).cast("long").alias("c_custkey"), "name", "lang", "voice_uri", "is_local", "source")


_FAULTS = ["", "format", "version", "engine", "id", "entry", "voices", "voice", "json", "size", "files"]
_CODES = ["", "bad_format", "bad_version", "bad_engine", "bad_id", "missing_entry", "no_voices", "bad_voice", "bad_format", "too_large", "too_many_files"]


def _packs(spark, sf_dir):
    """A pack for each customer with one fault or none."""
    n = F.col("c_custkey")
    fault = F.element_at(F.array(*map(F.lit, _FAULTS)), (n % len(_FAULTS) + 1).cast("int"))
    bad = lambda name, wrong, right: F.when(fault == name, wrong).otherwise(right)
    text = n.cast("string")
    voice = lambda i: F.struct(F.lit(f"v{i}").alias("id"), bad("voice", "", F.concat(F.col("c_name"), F.lit(f" {i}"))).alias("name"), F.when(F.lit(i) == 1, "de-DE").alias("lang"))
    voices = F.when(fault != "voices", F.array(voice(0), voice(1))).otherwise(F.array().cast("array<struct<id:string,name:string,lang:string>>"))
    manifest = F.struct(bad("format", "other", "pack").alias("format"), bad("version", 2, 1).alias("version"), bad("id", F.concat(F.lit("no "), text), F.concat(F.lit("p-"), text)).alias("id"), F.lit("L").alias("label"), bad("engine", "x", "e").alias("engine"), bad("entry", "z.js", "x.js").alias("entry"), voices.alias("voices"))
    packs = read(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", bad("json", "broken", F.to_json(manifest)).alias("json"), F.array_repeat(F.lit("x.js"), bad("files", 201, 1)).alias("file_names"), bad("size", V.MAX_BYTES + 1, 10).alias("total_bytes"))
    return V.validate_manifests(packs, ["pack"], ["e"])


_CODE = "CASE c_custkey % " + str(len(_CODES)) + " " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES) if c) + " END"


@query("a12_packs", f"SELECT c_custkey, {_CODE} AS error_code FROM customer")
def packs(spark, sf_dir):
    return _packs(spark, sf_dir).select("c_custkey", "error_code")


@query("a13_pack_voices", f"SELECT 'p-' || c_custkey AS pack, CAST(i AS INTEGER) AS ord, c_name || ' ' || i AS name, CASE i WHEN 1 THEN 'de-DE' ELSE 'zh-CN' END AS lang, 'pack:p-' || c_custkey || ':v' || i AS voice_uri, FALSE AS is_default, TRUE AS is_local, 'neural-pack' AS source FROM customer CROSS JOIN range(2) AS t(i) WHERE {_CODE} IS NULL")
def pack_voices(spark, sf_dir):
    return V.pack_voices(_packs(spark, sf_dir))


@query("a14_settings", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'dark' ELSE 'light' END AS tone, CASE event_id % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'always' ELSE 'auto' END AS ocr, CASE WHEN event_id % 7 IN (0, 6) THEN 1.0 ELSE least(greatest((event_id % 7) * 7 / 10.0, 0.5), 3.0) END::DOUBLE AS rate,
  least(greatest(CASE WHEN event_id % 150 = 0 THEN 100 ELSE event_id % 150 END, 85), 140)::DOUBLE AS font_scale, event_id % 3 <> 1 AS keep_screen_on FROM events""")
def settings(spark, sf_dir):
    """Settings with values that are fine, out of range, unknown, missing or no number."""
    n = F.col("event_id")
    tone = F.when(F.col("event_type") == "view", "dark").when(F.col("event_type") == "click", "pink")
    rate = F.when(n % 7 == 6, "fast").otherwise((n % 7 * 7 / 10).cast("string"))
    keep = F.when(n % 3 == 1, "false").when(n % 3 == 2, "true")
    json = F.to_json(F.struct(tone.alias("tone"), F.when(n % 4 == 0, "off").when(n % 4 == 1, "always").when(n % 4 == 2, "never").alias("ocr"), rate.alias("rate"), (n % 150).cast("string").alias("fontScale"), keep.alias("keepScreenOn")))
    return B.parse_settings(read(spark, sf_dir, "events", "event_id", "event_type").withColumn("json", json)).select("event_id", "settings.*")


_CJK, _LATIN = S.count("t", "[一-龥]"), S.count("t", "[A-Za-z]")


@query("f08_languages", f"""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN repeat('字', CAST(length(text) * (conv_id % 5) // 4 AS INTEGER)) ELSE '' END || text AS t FROM conversations),
n AS (SELECT conv_id, turn, {S.meaningful('t')} AS m, {_CJK} AS cjk, {_LATIN} AS latin FROM c)
SELECT conv_id, arg_min(CASE WHEN cjk >= (cjk + latin) * 0.85 THEN 'chi_sim' WHEN cjk >= (cjk + latin) * 0.4 THEN 'chi_sim+eng' WHEN latin >= (cjk + latin) * 0.95 THEN 'eng' ELSE 'eng+chi_sim' END, turn) AS language FROM n WHERE m >= 60 AND cjk + latin > 0 GROUP BY conv_id""")
def languages(spark, sf_dir):
    """Conversations as documents, turns as pages; a third of them with Chinese characters before their text."""
    more = F.when(F.col("conv_id") % 3 == 0, F.repeat(F.lit("字"), F.floor(F.length("text") * (F.col("conv_id") % 5) / 4).cast("int"))).otherwise("")
    pages = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", F.col("turn").alias("page_number"), F.concat(more, F.col("text")).alias("text"))
    return P.narrow_language(pages, "conv_id").select("conv_id", "language")
