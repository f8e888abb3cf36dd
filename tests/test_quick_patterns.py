"""Patterns written for Java's engine match what they matched, and hold no ranges within Latin-1."""

import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lines as L
from quire.operators import segments as G

CLASSES = [T.WS, f"[^{T.WS[1:-1]}]", f"[{T.CJK}]", T.TIGHT, T.CHAPTER_NUMBERS, *(f"[^{v}]" for v in T.SYMBOL_VARIANTS.values()), r"[)）】\]]", r"[\[(（【]", "[^\\n。！？!?.]", "[-*•●▪◦]", f"[^a-z0-9{T.CJK}]", "[А-Яа-яЁё]", "[^A-Za-z0-9_]", "[\"”’')\\]]"]


@pytest.fixture(scope="module")
def characters(spark):
    codes = spark.range(1, 0x10000).filter("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    return codes.union(spark.createDataFrame([("😀",), ("𝔸",)], "c string"))


@pytest.mark.parametrize("pattern", CLASSES + [f"(?i){c}" for c in CLASSES])
def test_same_characters(characters, pattern):
    assert T.quick(pattern) != pattern
    assert characters.filter(F.col("c").rlike(pattern) != F.col("c").rlike(T.quick(pattern))).count() == 0


def test_no_latin_ranges_are_left():
    patterns = [p for p, _ in G.SEGMENT_STEPS + T.CLEAN_HEADING] + G.KEEPS_PERIOD + T.STANDALONE + [T.HEADING, T.NOISE_LINE, T.TOC_LINE, L.MOJIBAKE]
    for p in patterns:
        assert not re.search(r"(?:A-Z|a-z|0-9)", T.quick(p)), p


def test_keys_and_counts(spark):
    texts = ["Page 12 İSTANBULK 3 4", "short", "", None, "第 3 章  航海 Storm—Ärger", "  a\r\n1 2\n\n\n3 bcdefg", "İİİİİİİİ", "abcdefg", "ABCDEFGH", "１２３ ＡＢＣ ſtraße"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    old = T.chain(F.lower(T.normalize_whitespace(t)), [("[0-9]+", "#"), (f"[^a-z#{T.CJK}]+", "")])
    assert df.filter(~T.line_key(t).eqNullSafe(F.when(F.length(old) >= 8, old).otherwise(""))).count() == 0
    assert df.filter(~T.section_key(t).eqNullSafe(F.regexp_replace(F.lower(T.clean_heading(t)), f"[^a-z0-9{T.CJK}]+", ""))).count() == 0
    assert df.filter(~T.count_meaningful(t).eqNullSafe(F.regexp_count(t, F.lit(f"[A-Za-z0-9{T.CJK}]")))).count() == 0
    compact = F.regexp_replace(t, T.WS, "")
    for variant, kept in T.SYMBOL_VARIANTS.items():
        ratio = F.regexp_count(compact, F.lit(f"[^{kept}]")) / F.greatest(F.length(compact), F.lit(1))
        assert df.filter(~T.symbol_ratio(t, variant).eqNullSafe(ratio)).count() == 0
