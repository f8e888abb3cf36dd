"""Voice catalogs: merging, ranking, quotas and fallbacks. ``voices``: catalog, ord, name, lang, voice_uri, is_default, is_local, source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import reading as R

MAX_VISIBLE, EXTRA_BUCKETS = 14, 8


def rank_voices(voices: DataFrame) -> DataFrame:
    """Adds ``bucket, score`` and ``place``: by score, then language and name in binary order."""
    scored = voices.withColumn("bucket", R.voice_bucket(F.col("lang"))).withColumn("score", R.score_voice(F.col("lang"), F.col("name"), F.col("is_default"), F.col("is_local"), F.col("source")))
    return scored.withColumn("place", F.row_number().over(W.partitionBy("catalog").orderBy(F.desc("score"), F.concat_ws("-", "lang", "name"), "voice_uri")))


def prefer_local(voices: DataFrame) -> DataFrame:
    """Local voices; all of a catalog that has none."""
    any_local = F.max(F.col("is_local").cast("int")).over(W.partitionBy("catalog"))
    return voices.withColumn("__any", any_local).filter(F.col("is_local") | (F.col("__any") == 0)).drop("__any")


def merge_catalogs(voices: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One row per voice over all sources, the source with the smallest priority first; then local ones."""
    rank = R.lookup(F.col("source"), {k: str(v) for k, v in priority.items()}, F.lit("9"))
    key = R.canonical_voice_key(F.col("lang"), F.col("name"), F.col("voice_uri"))
    n = F.row_number().over(W.partitionBy("catalog", "__key").orderBy("__rank", "ord"))
    first = voices.withColumn("__key", key).withColumn("__rank", rank).withColumn("__n", n).filter("__n = 1").drop("__key", "__rank", "__n")
    return prefer_local(first)


def quota_top_k(voices: DataFrame, selected_uri: str | None = None, cap: int = MAX_VISIBLE) -> DataFrame:
    """Voices to show: all of a small catalog; else the selected one, the priority buckets up to their limits, then the rest."""
    ranked = rank_voices(voices).filter("bucket <> ''")
    total = F.count("*").over(W.partitionBy("catalog"))
    chosen = F.coalesce(F.col("voice_uri") == F.lit(selected_uri), F.lit(False))
    n = F.row_number().over(W.partitionBy("catalog", "bucket", "__key").orderBy(F.desc("__chosen"), "place"))
    once = ranked.withColumn("__total", total).withColumn("__chosen", chosen).withColumn("__key", R.voice_name_key(F.col("name"))).withColumn("__n", n).filter("__n = 1")
    limit = F.lit(1)
    for bucket, most in R.BUCKET_LIMITS.items():
        limit = F.when(F.col("bucket") == bucket, most).otherwise(limit)
    order = F.lit(len(R.PRIORITY_BUCKETS))
    for i, bucket in enumerate(R.PRIORITY_BUCKETS):
        order = F.when(F.col("bucket") == bucket, i).otherwise(order)
    within = F.row_number().over(W.partitionBy("catalog", "bucket").orderBy(F.desc("__chosen"), "place"))
    few = once.withColumn("__within", within).filter((F.col("__total") <= cap) | (F.col("__within") <= limit))
    overall = F.row_number().over(W.partitionBy("catalog").orderBy(F.desc("__chosen"), order, "place"))
    return few.withColumn("shown", F.when(F.col("__total") <= cap, F.col("place")).otherwise(overall)).filter(F.col("shown") <= cap).drop("__total", "__chosen", "__key", "__n", "__within")


#: Per rule, best first: the kind of voices and what they are looked up by.
_RULES = [("preferred", "target"), ("default", "target"), ("any", "target"), ("default", "base"), ("any", "base"), ("default", "all"), ("any", "all")]
_FAILED = [("bridge", "failed"), ("any", "failed")]


def _candidates(asked: DataFrame, voices: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``asked`` (distinct: catalog, target[, failed]) with ``found``: by rule the best two voices of the catalog, in order.

    Two, since one of them may be the voice that failed. The voices are grouped by what a rule looks
    for before they meet what is asked, so no voice is paired with another.
    """
    # What is looked up: a bucket behind "=", the start of one behind "^", or all.
    wanted = {"target": F.concat(F.lit("="), "target"), "base": F.concat(F.lit("^"), F.substring_index("target", "-", 1)), "all": F.lit("*")}
    if "failed" in asked.columns:
        wanted["failed"] = F.concat(F.lit("="), "failed")
    looks = [F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("kind"), wanted[by].alias("look")) for i, (kind, by) in enumerate(rules)]
    cases = asked.withColumn("x", F.explode(F.array(*looks))).select(*asked.columns, "x.*")
    bucket, low = F.col("bucket"), F.lower("name")
    preferred = (bucket == "zh-cn") & reduce(lambda a, b: a | b, [low.contains(x) for x in R.PREFERRED_CHINESE])
    kinds = F.array(F.lit("any"), F.when(F.col("is_default"), "default"), F.when(F.col("source") == "bridge", "bridge"), F.when(preferred, "preferred"))
    starts = F.transform(F.sequence(F.lit(0), F.length("bucket")), lambda n: F.concat(F.lit("^"), F.substring(bucket, F.lit(1), n)))
    looks = F.concat(F.array(F.lit("*"), F.concat(F.lit("="), bucket)), starts)
    pool = voices.filter("voice_uri IS NOT NULL").withColumn("bucket", R.voice_bucket(F.col("lang"))).select("catalog", "ord", "voice_uri", F.explode(F.array_compact(kinds)).alias("kind"), looks.alias("looks"))
    pool = pool.select("catalog", "ord", "voice_uri", "kind", F.explode("looks").alias("look"))
    group = ["catalog", "kind", "look"]
    pool = pool.join(cases.select(*group).distinct(), group, "left_semi").groupBy(*group, "voice_uri").agg(F.min("ord").alias("ord"))
    n = F.row_number().over(W.partitionBy(*group).orderBy("ord", "voice_uri"))
    best = pool.withColumn("n", n).filter("n <= 2")
    return cases.join(best, group).groupBy(*asked.columns).agg(F.array_sort(F.collect_list(F.struct("rule", "ord", "voice_uri"))).alias("found"))


def resolve_voice(texts: DataFrame, voices: DataFrame, key: str, lang: str, selected: DataFrame | None) -> DataFrame:
    """``catalog, key, voice_uri`` for texts with their reader's catalog: null for the default; the selected voice if it speaks the language or is neural; else the best by rule.

    ``selected``: one ``voice_uri`` of each ``catalog``, or None where nobody has selected one.
    """
    asked = texts.select("catalog", key, R.voice_bucket(F.col(lang)).alias("target"))
    if selected is None:
        return asked.select("catalog", key, F.lit(None).cast("string").alias("voice_uri"))
    chosen = voices.join(selected.select("catalog", "voice_uri"), ["catalog", "voice_uri"]).select("catalog", "voice_uri", F.substring_index(R.voice_bucket(F.col("lang")), "-", 1).alias("b"), (F.col("source") == "neural-pack").alias("neural"))
    chosen = chosen.groupBy("catalog").agg(F.max("voice_uri").alias("selected"), F.coalesce(F.bool_or("neural"), F.lit(False)).alias("neural"), F.collect_set("b").alias("bases"))
    found = _candidates(asked.select("catalog", "target").distinct(), voices, _RULES)
    speaks = F.col("neural") | F.array_contains("bases", F.substring_index("target", "-", 1))
    best = F.when(speaks, F.col("selected")).otherwise(F.get("found", F.lit(0)).voice_uri)
    return asked.join(found, ["catalog", "target"], "left").join(chosen, "catalog", "left").select("catalog", key, best.alias("voice_uri"))


def fallback_voice(failures: DataFrame, voices: DataFrame, key: str) -> DataFrame:
    """``catalog, key, voice_uri, reason`` for failures ``catalog, key, failed_uri, failed_lang, lang``: another voice of the same bucket in the catalog, else its best one."""
    asked = failures.select("catalog", F.col(key).alias("__key"), "failed_uri", R.voice_bucket(F.col("failed_lang")).alias("failed"), R.voice_bucket(F.col("lang")).alias("target"))
    found = _candidates(asked.select("catalog", "failed", "target").distinct(), voices, [*_FAILED, *_RULES])
    other = F.get(F.filter("found", lambda x: x.voice_uri != F.col("failed_uri")), F.lit(0))
    rule = F.col("best").rule
    reason = F.when(rule == 0, "same language, bridge").when(rule == 1, "same language").when(rule > 1, "best available")
    best = asked.join(found, ["catalog", "failed", "target"], "left").withColumn("best", other)
    return best.select("catalog", F.col("__key").alias(key), F.col("best").voice_uri.alias("voice_uri"), reason.alias("reason"))


def bucket_summary(voices: DataFrame, *key: str, lang: str = "lang") -> DataFrame:
    bucket = R.voice_bucket(F.col(lang))
    return voices.groupBy(*key).agg(F.count_if(bucket.startswith("zh-")).alias("chinese"), F.count_if(bucket.startswith("en-")).alias("english"))


def label_lookup(df: DataFrame, labels: DataFrame, key: str, lang: str, default: str = "en") -> DataFrame:
    """Adds ``label``: in ``lang``, else in the default language, else the key itself. ``labels``: key, lang, label."""
    own = labels.filter(F.col("lang") == lang).select(F.col("key").alias(key), F.col("label").alias("__own"))
    other = labels.filter(F.col("lang") == default).select(F.col("key").alias(key), F.col("label").alias("__other"))
    return df.join(own, key, "left").join(other, key, "left").withColumn("label", F.coalesce("__own", "__other", F.col(key))).drop("__own", "__other")


def check_complete(files: DataFrame, patterns: list[str], *key: str, path: str = "path") -> DataFrame:
    """``key, complete``: whether every pattern is matched by a file of the key."""
    found = [F.bool_or(F.col(path).rlike(p)) for p in patterns]
    return files.groupBy(*key).agg(reduce(lambda a, b: a & b, found).alias("complete"))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates by score, the highest first, equal ones by id."""
    return candidates.orderBy(F.desc("score"), "id")
