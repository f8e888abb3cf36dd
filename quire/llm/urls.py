"""URL verdicts: host and path rules first, then a weighted vocabulary.

The vocabulary is matched by an Aho-Corasick automaton over host and path; a hit counts where no
letter touches it on either side. One strict term, or ``soft_limit`` distinct soft terms, block.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and is allowed;
repeated rows each get their own result.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.store import table

#: Host/path and verdict. The longest that fits wins.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: One of these is enough.
STRICT = "adult betting casino escort gambling hentai malware nude phishing porn porno poker roulette sex slots spam viagra warez webcam-girls xxx".split()
#: These need company.
SOFT = "ads bet bets bonus buy cheap click coupon crack credit deals dating discount download earn free hot jackpot keygen live loan lottery meds money pharmacy pills popup prize promo replica sale sexy torrent track tracker tracking webcam win winner".split()
SOFT_LIMIT = 2


@functools.lru_cache(4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for hard, terms in ((False, soft), (True, strict)):
        for t in terms:
            a.add_word(t, (t, hard))
    a.make_automaton()
    return a


def _hits(text: str, a) -> tuple[int, int]:
    """Distinct strict and soft terms in lower-cased text that no letter touches."""
    found = set()
    for end, (term, hard) in a.iter(text):
        start = end - len(term) + 1
        if not (start and text[start - 1].isalpha()) and not text[end + 1 : end + 2].isalpha():
            found.add((hard, term))
    strict = sum(hard for hard, _ in found)
    return strict, len(found) - strict


def vocabulary_hits(text: Column, strict: list[str] = STRICT, soft: list[str] = SOFT) -> Column:
    """``struct<strict,soft>``: how many distinct terms of each kind stand in ``text``."""
    terms = tuple(strict), tuple(soft)

    @F.arrow_udf("strict int, soft int")
    def counted(batch: pa.Array) -> pa.Array:
        a = automaton(*terms)
        both = [_hits((t or "").lower(), a) for t in batch.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in both], pa.int32()) for i in (0, 1)], ["strict", "soft"])

    return counted(text)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # the longest is asked first
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, rule).otherwise(out)
    return out


def judge(pages: DataFrame, url: str = "url", rules: dict[str, str] = RULES, soft_limit: int = SOFT_LIMIT) -> Column:
    """``struct<host,path,rule,strict,soft,verdict>`` for the url column of ``pages``."""
    host, path = split_url(pages[url])
    rule = matching_rule(host, path, rules)
    hits = vocabulary_hits(F.concat(host, path))
    by_rule = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))[rule]
    by_terms = F.when((hits.strict > 0) | (hits.soft >= soft_limit), "block").otherwise("allow")
    return F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"), hits.strict.alias("strict"), hits.soft.alias("soft"), F.coalesce(by_rule, by_terms).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", judge(pages).alias("j")).select("page_id", "j.host", "j.path", "j.rule", "j.verdict", "j.strict", "j.soft")


def _terms_sql(terms: list[str], text: str) -> str:
    one = " + ".join(rf"CAST(regexp_matches({text}, '(^|[^\pL]){t}([^\pL]|$)') AS INT)" for t in terms)
    return f"({one})"


OP2_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), r AS (
  SELECT *, lower(host || path) AS t, CASE
    {" ".join(f"WHEN ('.' || host) LIKE '%.{k.partition('/')[0]}' AND starts_with(path, '/{k.partition('/')[2]}') THEN '{k}'" for k in sorted(RULES, key=len, reverse=True))}
    END AS rule FROM p
), h AS (
  SELECT *, {_terms_sql(STRICT, 't')} AS strict, {_terms_sql(SOFT, 't')} AS soft FROM r
)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{k}' THEN '{v}'" for k, v in RULES.items())}
  WHEN strict > 0 OR soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, strict, soft
FROM h
"""
