"""Voice sources: lists from a bridge, and manifests of voice packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# They must equal the source application's for equal results.
MANIFEST_VERSION, MAX_FILES, MAX_BYTES, DEFAULT_BRIDGE_LANG, DEFAULT_PACK_LANG = 1, 200, 800 * 1024 * 1024, "en-US", "zh-CN"
MANIFEST = "format string, version int, id string, label string, engine string, entry string, voices array<struct<id:string,name:string,lang:string>>"


def normalize_bridge_voices(df: DataFrame, json: str = "json") -> DataFrame:
    """``name, lang, voice_uri, is_local, source`` of every named voice in a JSON list."""
    v = df.select(F.explode(F.from_json(json, "array<struct<name:string,lang:string>>")).alias("v")).select("v.*")
    named = v.filter(T.js_trim(F.coalesce("name", F.lit(""))) != "")
    lang = F.when(F.coalesce("lang", F.lit("")) != "", F.col("lang")).otherwise(DEFAULT_BRIDGE_LANG)
    uri = F.concat(F.lit("bridge://"), F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20")))
    return named.select("name", lang.alias("lang"), uri.alias("voice_uri"), F.lit(True).alias("is_local"), F.lit("bridge").alias("source"))


def _first_error(*rules: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for bad, code in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(True)), code).otherwise(out)
    return out


def validate_manifests(df: DataFrame, formats: list[str], engines: list[str], json: str = "json", files: str = "file_names", size: str = "total_bytes") -> DataFrame:
    """Adds ``manifest`` and ``error_code``: the first rule that a pack breaks, or null."""
    m = F.from_json(json, MANIFEST)
    ok = lambda c: F.coalesce(c, F.lit("")) != ""
    staged = df.withColumn("manifest", m)
    m = F.col("manifest")
    rules = [
        (F.size(files) > MAX_FILES, "too_many_files"),
        (F.col(size) > MAX_BYTES, "too_large"),
        (~m.format.isin(formats), "bad_format"),
        (m.version != MANIFEST_VERSION, "bad_version"),
        (~m.engine.isin(engines), "bad_engine"),
        (~m.id.rlike(r"\A[A-Za-z0-9_-]{1,64}\z"), "bad_id"),
        (~F.array_contains(F.col(files), m.entry), "missing_entry"),
        (F.size(m.voices) < 1, "no_voices"),
        (~F.forall(m.voices, lambda v: ok(v.id) & ok(v["name"])), "bad_voice"),
    ]
    return staged.withColumn("error_code", _first_error(*rules))


def pack_voices(manifests: DataFrame, prefix: str = "pack:") -> DataFrame:
    """One catalog row per voice of the packs without an error."""
    rows = manifests.filter("error_code IS NULL").select(F.col("manifest.id").alias("pack"), F.posexplode("manifest.voices").alias("ord", "v"))
    lang = F.when(F.coalesce("v.lang", F.lit("")) != "", F.col("v.lang")).otherwise(DEFAULT_PACK_LANG)
    return rows.select("pack", "ord", F.col("v.name").alias("name"), lang.alias("lang"), F.concat(F.lit(prefix), "pack", F.lit(":"), F.col("v.id")).alias("voice_uri"), F.lit(False).alias("is_default"), F.lit(True).alias("is_local"), F.lit("neural-pack").alias("source"))
