"""Queries over voice catalogs made of the customers: one catalog per nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import reading as R
from quire.operators import catalog as C
from quire.plans import registry as S
from quire.plans.registry import q, query, read

_LANGS = ["zh-CN", "en-US", "en_GB", "en-AU", "zh-Hant-TW", "ja-JP", "fr-FR", "de-DE", "cmn-Hans", "", "ko-KR", "es-ES", "zh_HK"]
_NAMES = ["Microsoft Xiaoxiao Online (Natural) - Chinese (Mainland)", "Google US English", "Aria Neural", "Microsoft David Desktop - English (United States)", "Kyoko", "Yunxi (Natural)", "Apple Anna", "Offline Voice"]


def _case(e: str, values: list[str]) -> str:
    return f"CASE {e} % {len(values)} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


_VOICES = f"""v AS (SELECT c_nationkey AS catalog, c_custkey AS ord, {_case('c_custkey', _NAMES)} || ' ' || c_custkey % 17 AS name, {_case('c_custkey', _LANGS)} AS lang, 'uri:' || c_custkey AS voice_uri,
  c_custkey % 10 = 3 AS is_default, c_nationkey % 7 > 0 AND c_custkey % 3 > 0 AS is_local, CASE c_custkey % 5 WHEN 0 THEN 'bridge' WHEN 1 THEN 'neural-pack' ELSE 'browser' END AS source FROM customer)"""


def _voices(spark, sf_dir):
    n = F.col("c_custkey")
    pick = lambda values: R.lookup((n % len(values)).cast("string"), {str(i): v for i, v in enumerate(values)}, F.lit(None).cast("string"))
    return read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(
        F.col("c_nationkey").alias("catalog"),
        n.alias("ord"),
        F.concat(pick(_NAMES), F.lit(" "), (n % 17).cast("string")).alias("name"),
        pick(_LANGS).alias("lang"),
        F.concat(F.lit("uri:"), n.cast("string")).alias("voice_uri"),
        (n % 10 == 3).alias("is_default"),
        ((F.col("c_nationkey") % 7 > 0) & (n % 3 > 0)).alias("is_local"),
        F.when(n % 5 == 0, "bridge").when(n % 5 == 1, "neural-pack").otherwise("browser").alias("source"),
    )


def _bucket(e: str) -> str:
    c = f"lower(replace({S.trim(f"coalesce({e}, '')")}, '_', '-'))"
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'starts_with({c}, {q(s)})' for s in starts)} THEN {q(b)}" for b, starts in R.VOICE_BUCKETS.items()) + f" ELSE {c} END"


_NAME_KEY = S.steps("lower(coalesce(name, ''))", R.VOICE_NAME_KEY)
_CANON = S.steps(_NAME_KEY, R.CANONICAL_NAME)
_ORIGINAL = S.trim("CASE WHEN coalesce(name, '') = '' THEN 'Unnamed' ELSE name END")
_CLEAN = S.steps(_ORIGINAL, R.CLEAN_VOICE_NAME)
_LABEL = f"CASE bucket {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in R.BUCKET_LABELS.items())} ELSE CASE WHEN lang <> '' THEN lang ELSE '其他语音' END END"
_B = f"{_VOICES}, b AS (SELECT *, {_bucket('lang')} AS bucket FROM v)"


@query("b28_b30_voice_names", f"""WITH {_B} SELECT ord, bucket, string_split(bucket, '-')[1] AS base, {_NAME_KEY} AS name_key, bucket || ':' || CASE WHEN {_CANON} <> '' THEN {_CANON} ELSE voice_uri END AS canonical, CASE WHEN {_CLEAN} <> '' THEN {_CLEAN} ELSE {_ORIGINAL} END AS clean,
  {_LABEL} || ' · ' || CASE WHEN {_CLEAN} <> '' THEN {_CLEAN} ELSE {_ORIGINAL} END || CASE source WHEN 'neural-pack' THEN ' · 神经语音' WHEN 'bridge' THEN ' · Windows稳定' ELSE ' · 浏览器' END || CASE WHEN is_default THEN ' · 默认' ELSE '' END AS label FROM b""")
def names(spark, sf_dir):
    lang, name, uri = F.col("lang"), F.col("name"), F.col("voice_uri")
    return _voices(spark, sf_dir).select("ord", R.voice_bucket(lang).alias("bucket"), R.voice_base(lang).alias("base"), R.voice_name_key(name).alias("name_key"), R.canonical_voice_key(lang, name, uri).alias("canonical"), R.clean_voice_name(name).alias("clean"), R.voice_label(lang, name, F.col("source"), F.col("is_default")).alias("label"))


def _any(names: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(name), {q(x)})" for x in names) + ")"


_PRIORITY = "CASE bucket " + " ".join(f"WHEN {q(b)} THEN {130 - 8 * i}" for i, b in enumerate(R.PRIORITY_BUCKETS)) + " ELSE CASE WHEN string_split(bucket, '-')[1] = 'zh' THEN 32 ELSE 0 END END"
_PARTS = [("is_default", 18), ("is_local", 10), ("source = 'neural-pack'", 220), (f"bucket = 'zh-cn' AND {_any(R.PREFERRED_CHINESE)}", 40), (f"starts_with(bucket, 'en-') AND {_any(R.PREFERRED_ENGLISH)}", 22), ("contains(lower(name), 'natural')", 8), ("contains(lower(name), 'neural')", 6)]
_SCORE = f"({_PRIORITY}) + " + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in _PARTS)
_R = f"{_B}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY catalog ORDER BY score DESC, lang || '-' || name, voice_uri) AS INTEGER) AS place FROM (SELECT *, CAST({_SCORE} AS INTEGER) AS score FROM b))"


@query("h03_ranked_voices", f"WITH {_R} SELECT catalog, voice_uri, bucket, score, place FROM r")
def ranked(spark, sf_dir):
    return C.rank_voices(_voices(spark, sf_dir)).select("catalog", "voice_uri", "bucket", "score", "place")


_LIMIT = "CASE bucket " + " ".join(f"WHEN {q(b)} THEN {n}" for b, n in R.BUCKET_LIMITS.items()) + " ELSE 1 END"
_ORDER = "CASE bucket " + " ".join(f"WHEN {q(b)} THEN {i}" for i, b in enumerate(R.PRIORITY_BUCKETS)) + f" ELSE {len(R.PRIORITY_BUCKETS)} END"


@query("g09_quota_top_k", f"""WITH {_R}, o AS (SELECT *, count(*) OVER (PARTITION BY catalog) AS total, voice_uri = 'uri:7' AS chosen, row_number() OVER (PARTITION BY catalog, bucket, {_NAME_KEY} ORDER BY (voice_uri = 'uri:7') DESC, place) AS n FROM r WHERE bucket <> ''),
w AS (SELECT *, row_number() OVER (PARTITION BY catalog, bucket ORDER BY chosen DESC, place) AS within FROM o WHERE n = 1),
s AS (SELECT catalog, voice_uri, CASE WHEN total <= 14 THEN place ELSE row_number() OVER (PARTITION BY catalog ORDER BY chosen DESC, {_ORDER}, place) END AS shown FROM w WHERE total <= 14 OR within <= {_LIMIT})
SELECT catalog, voice_uri, CAST(shown AS INTEGER) AS shown FROM s WHERE shown <= 14""")
def quota(spark, sf_dir):
    return C.quota_top_k(_voices(spark, sf_dir), "uri:7").select("catalog", "voice_uri", "shown")


@query("c09_f15_i01_merged_catalogs", f"""WITH {_B}, k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY catalog, bucket || ':' || CASE WHEN {_CANON} <> '' THEN {_CANON} ELSE voice_uri END ORDER BY CASE source WHEN 'neural-pack' THEN 0 WHEN 'bridge' THEN 1 ELSE 2 END, ord) = 1)
SELECT catalog, voice_uri FROM (SELECT *, bool_or(is_local) OVER (PARTITION BY catalog) AS any_local FROM k) WHERE is_local OR NOT any_local""")
def merged(spark, sf_dir):
    return C.merge_catalogs(_voices(spark, sf_dir), {"neural-pack": 0, "bridge": 1, "browser": 2}).select("catalog", "voice_uri")


@query("f05_bucket_summary", f"WITH {_B} SELECT catalog, count(*) FILTER (starts_with(bucket, 'zh-')) AS chinese, count(*) FILTER (starts_with(bucket, 'en-')) AS english FROM b GROUP BY 1")
def summary(spark, sf_dir):
    return C.bucket_summary(_voices(spark, sf_dir), "catalog")


def _rule(target: str) -> list[str]:
    base = f"string_split({target}, '-')[1]"
    return [f"{target} = 'zh-cn' AND bucket = 'zh-cn' AND {_any(R.PREFERRED_CHINESE)}", f"is_default AND bucket = {target}", f"bucket = {target}", f"is_default AND starts_with(bucket, {base})", f"starts_with(bucket, {base})", "is_default", "true"]


def _first(rules: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {r} THEN {i}" for i, r in enumerate(rules)) + " END"


_DOC_LANG = "CASE lang WHEN 'en' THEN 'en-US' WHEN 'fr' THEN 'fr-FR' WHEN 'de' THEN 'de-DE' ELSE 'zh-CN' END"


@query("e09_resolved_voices", f"""WITH {_B}, p AS (SELECT * FROM b WHERE catalog = 3), d AS (SELECT doc_id, lower({_DOC_LANG}) AS target FROM documents), t AS (SELECT DISTINCT target FROM d),
m AS (SELECT target, voice_uri FROM t, p QUALIFY row_number() OVER (PARTITION BY target ORDER BY {_first(["voice_uri = (SELECT min(voice_uri) FROM p) AND (source = 'neural-pack' OR string_split(bucket, '-')[1] = string_split(target, '-')[1])", *_rule('target')])}, ord) = 1)
SELECT doc_id, voice_uri FROM d JOIN m USING (target)""")
def resolved(spark, sf_dir):
    """The readers of one catalog, as the SQL says; ``e09_all_catalogs`` has all."""
    docs = read(spark, sf_dir, "documents", "doc_id", "lang").withColumn("catalog", F.lit(3))
    return _resolved(docs, _voices(spark, sf_dir).filter("catalog = 3")).select("doc_id", "voice_uri")


@query("e09_all_catalogs")
def resolved_everywhere(spark, sf_dir):
    """Every document in every catalog."""
    docs = read(spark, sf_dir, "documents", "doc_id", "lang").crossJoin(F.broadcast(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("catalog"))))
    return _resolved(docs, _voices(spark, sf_dir))


def _resolved(docs, voices):
    lang = F.when(F.col("lang") == "en", "en-US").when(F.col("lang") == "fr", "fr-FR").when(F.col("lang") == "de", "de-DE").otherwise("zh-CN")
    chosen = voices.groupBy("catalog").agg(F.min("voice_uri").alias("voice_uri"))
    return C.resolve_voice(docs.withColumn("lang", lang), voices, "doc_id", "lang", chosen)


@query("e10_fallback_voices", f"""WITH {_B}, p AS (SELECT * FROM b WHERE catalog = 3), x AS (SELECT f.voice_uri AS failed_uri, f.bucket AS failed, v.* FROM p AS f JOIN p AS v ON v.voice_uri <> f.voice_uri)
SELECT failed_uri, voice_uri, CASE {_first(["bucket = failed AND source = 'bridge'", "bucket = failed", *_rule("'fr-fr'")])} WHEN 0 THEN 'same language, bridge' WHEN 1 THEN 'same language' ELSE 'best available' END AS reason
FROM x QUALIFY row_number() OVER (PARTITION BY failed_uri ORDER BY {_first(["bucket = failed AND source = 'bridge'", "bucket = failed", *_rule("'fr-fr'")])}, ord) = 1""")
def fallback(spark, sf_dir):
    """The failures of one catalog, as the SQL says; ``e10_all_catalogs`` has all."""
    return _fallbacks(_voices(spark, sf_dir).filter("catalog = 3")).select("failed_uri", "voice_uri", "reason")


@query("e10_all_catalogs")
def fallback_everywhere(spark, sf_dir):
    return _fallbacks(_voices(spark, sf_dir))


def _fallbacks(voices):
    failures = voices.select("catalog", F.col("voice_uri").alias("failed_uri"), F.col("lang").alias("failed_lang"), F.lit("fr-FR").alias("lang"), F.col("voice_uri").alias("key"))
    return C.fallback_voice(failures, voices, "key").withColumnRenamed("key", "failed_uri")


@query("e11_labels", "SELECT n_nationkey, n_name AS key, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'de:' || n_name END, CASE WHEN n_nationkey % 2 = 0 THEN 'en:' || n_name END, n_name) AS label FROM nation")
def label(spark, sf_dir):
    nations = read(spark, sf_dir, "nation", "n_nationkey", "n_name").withColumnRenamed("n_name", "key")
    own = nations.filter("n_nationkey % 3 = 0").select("key", F.lit("de").alias("lang"), F.concat(F.lit("de:"), "key").alias("label"))
    other = nations.filter("n_nationkey % 2 = 0").select("key", F.lit("en").alias("lang"), F.concat(F.lit("en:"), "key").alias("label"))
    return C.label_lookup(nations, own.unionByName(other), "key", "de").select("n_nationkey", "key", "label")


@query("e12_i04_complete_sets", r"SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, bool_or(regexp_matches(url, '/en/')) AND bool_or(regexp_matches(url, '/[a-z]{2}/[0-9]+\.html$')) AS complete FROM pages WHERE contains(url, '://') GROUP BY 1")
def complete(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "url").filter("contains(url, '://')").select(F.substring_index(F.substring_index("url", "://", -1), "/", 1).alias("host"), F.col("url").alias("path"))
    return C.check_complete(pages, ["/en/", r"/[a-z]{2}/[0-9]+\.html$"], "host")


@query("e05_e13_a07_library", """WITH old AS (SELECT o_custkey AS id, min(o_orderdate) AS added_at, count(*) AS section_count FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), inc AS (SELECT o_custkey AS id, count(*) AS section_count FROM orders WHERE o_orderkey % 5 = 1 GROUP BY 1)
SELECT id, coalesce(inc.section_count, old.section_count) AS section_count, coalesce(added_at, TIMESTAMP '2020-01-01') AS added_at, CASE WHEN inc.id IS NOT NULL THEN TIMESTAMP '2020-01-01' ELSE added_at END AS last_opened_at, CAST(coalesce(inc.section_count, CASE WHEN id % 3 > 0 THEN old.section_count ELSE 0 END) AS INTEGER) AS loaded FROM old FULL JOIN inc USING (id) WHERE id % 10 <> 0""")
def library(spark, sf_dir):
    from quire.operators import library as B

    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    meta = orders.filter("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.min(day).alias("added_at"), F.count("*").alias("section_count"))
    meta = meta.select("id", F.lit("t").alias("title"), "section_count", "added_at", F.col("added_at").alias("last_opened_at"), F.lit(None).cast("string").alias("progress"))
    incoming = orders.filter("o_orderkey % 5 = 1").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("section_count")).select("id", F.lit("t").alias("title"), "section_count", F.lit("p").alias("progress"))
    now = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    after = B.upsert_meta(meta, incoming, now)
    gone = after.filter("id % 10 = 0").select("id")
    sections = lambda rows: rows.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("sections"))  # noqa: E731  the orders of one customer
    contents = B.upsert_contents(sections(orders.filter("o_orderkey % 2 = 0 AND o_custkey % 3 > 0")), sections(orders.filter("o_orderkey % 5 = 1")))
    books = B.load_books(*B.delete_books(after, contents, gone))
    return books.select("id", "section_count", "added_at", "last_opened_at", F.size("sections").alias("loaded"))


@query("b31_voice_uris", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN NULL WHEN c_custkey % 4 = 3 THEN NULL ELSE 'p' || c_nationkey END AS pack, CASE WHEN c_custkey % 4 IN (1, 3) THEN NULL ELSE c_name || CASE WHEN c_custkey % 4 = 2 THEN ':' || c_custkey ELSE '' END END AS voice FROM customer""")
def voice_uris(spark, sf_dir):
    """Addresses of pack voices, with colons in the name too; of other voices; and without a voice."""
    n = F.col("c_custkey") % 4
    pack = F.concat(F.lit("pack:p"), F.col("c_nationkey").cast("string"))
    uri = F.when(n == 1, F.concat(F.lit("bridge:"), F.col("c_name"))).when(n == 3, pack).when(n == 2, F.concat(pack, F.lit(":"), F.col("c_name"), F.lit(":"), F.col("c_custkey").cast("string"))).otherwise(F.concat(pack, F.lit(":"), F.col("c_name")))
    parsed = R.parse_voice_uri(uri)
    return read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_name").select("c_custkey", parsed.pack.alias("pack"), parsed.voice.alias("voice"))
