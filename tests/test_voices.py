"""Voices by rule in every catalog, against trying every voice."""

import random

from quire.functions import reading as R
from quire.operators import catalog as C
from quire.plans import load

FOLDER = "/root/testdata/sf0.001"


def _brute(v, target, failed=None, failed_uri=None):
    base = target.split("-")[0]
    rules = [
        lambda x: target == "zh-cn" == x.bucket and any(p in x.name.lower() for p in R.PREFERRED_CHINESE),
        lambda x: x.is_default and x.bucket == target,
        lambda x: x.bucket == target,
        lambda x: x.is_default and x.bucket.startswith(base),
        lambda x: x.bucket.startswith(base),
        lambda x: x.is_default,
        lambda x: True,
    ]
    if failed is not None:
        rules = [lambda x: x.bucket == failed and x.source == "bridge", lambda x: x.bucket == failed, *rules]
    found = [(next(i for i, r in enumerate(rules) if r(x)), x.ord, x.voice_uri) for x in v if x.voice_uri != failed_uri]
    return min(found, default=(None, None, None))


def _catalogs(spark):
    rng = random.Random(5)
    langs = ["zh-CN", "zh-TW", "en-US", "en_GB", "fr-FR", "fr-CA", "fil-PH", "fi-FI", "", None, "ja-JP"]
    rows = [(c, n, rng.choice(["Xiaoxiao", "Anna", "Yunxi"]), rng.choice(langs), f"u{c}-{n}", rng.random() < 0.1, True, rng.choice(["bridge", "browser", "neural-pack"])) for c in range(12) for n in range([1, 2, 5, 30][c % 4])]
    voices = spark.createDataFrame(rows, "catalog int, ord int, name string, lang string, voice_uri string, is_default boolean, is_local boolean, source string")
    from pyspark.sql import functions as F

    return voices, langs, voices.withColumn("bucket", R.voice_bucket(F.col("lang"))).collect()


def test_fallback_and_resolved_voices_in_all_catalogs(spark):
    voices, langs, rows = _catalogs(spark)
    bucket = {r.lang: r.bucket for r in rows}
    asks = [(r.catalog, f"{r.voice_uri}/{t}", r.voice_uri, r.lang, t) for r in rows for t in ("fr-FR", "zh-CN", "fi-FI", "")]
    failures = spark.createDataFrame(asks, "catalog int, key string, failed_uri string, failed_lang string, lang string")
    got = {r.key: (r.voice_uri, r.reason) for r in C.fallback_voice(failures, voices, "key").collect()}
    assert len(got) == len(asks)
    for c, key, uri, failed, target in asks:
        rule, _, want = _brute([r for r in rows if r.catalog == c], bucket[target], bucket[failed], uri)
        assert got[key] == (want, None if rule is None else ["same language, bridge", "same language"][rule] if rule < 2 else "best available")
    texts = spark.createDataFrame([(c, f"{c}/{t}", t) for c in range(12) for t in langs], "catalog int, key string, lang string")
    chosen = {c: min(r.voice_uri for r in rows if r.catalog == c) for c in range(12)}
    resolved = {r.key: r.voice_uri for r in C.resolve_voice(texts, voices, "key", "lang", spark.createDataFrame([*chosen.items()], "catalog int, voice_uri string")).collect()}
    for c in range(12):
        own = next(r for r in rows if r.voice_uri == chosen[c])
        for t in langs:
            speaks = own.source == "neural-pack" or own.bucket.split("-")[0] == bucket[t].split("-")[0]
            assert resolved[f"{c}/{t}"] == (chosen[c] if speaks else _brute([r for r in rows if r.catalog == c], bucket[t])[2])


def test_registered_queries_search_all_catalogs(spark):
    queries = load().QUERIES
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet")
    assert queries["e10_all_catalogs"](spark, FOLDER).count() == customers.count()
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    found = queries["e09_all_catalogs"](spark, FOLDER).filter("voice_uri IS NOT NULL")
    assert found.count() == documents * customers.select("c_nationkey").distinct().count()


def test_one_catalog_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER.replace('0.001', '0.01')}/{t}.parquet')")
    for name in ("e09_resolved_voices", "e10_fallback_voices"):
        got = sorted(tuple(r) for r in load().QUERIES[name](spark, FOLDER.replace("0.001", "0.01")).collect())
        assert got == sorted(con.execute(load().ORACLE_SQL[name]).fetchall())
