"""Repair of recognised text: broken words and lines, page numbers, repeated lines, punctuation.

Two shuffles on the key: lines that repeat are counted through a document, and blocks put back together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lines as L
from quire.operators import segments as G

# What is replaced before lines are compared, and behind the joining of lines.
HYPHEN = (rf"([A-Za-z])-{T.WS}*\n{T.WS}*([A-Za-z])", "$1$2")
BLANK_LINES = (r"\n{3,}", "\n\n")
BEFORE = [
    HYPHEN,
    (r"[ \t]+(?=\n|\z)", ""),
    (r"[|｜]{2,}", " "),
    (rf"(?<![A-Za-z0-9_])([A-Za-z]){T.WS}+([,.;:!?])(?=[A-Za-z0-9_])", "$1$2"),
    (rf"(?i)\n{T.WS}*(?:第{T.WS}*)?[0-9]{{1,4}}{T.WS}*(?:页|page)?{T.WS}*\n", "\n"),
]
AFTER = [
    (r"([^\n。！？!?.])\n(?=[^\n])", "$1 "),
    (r"[ \t]*([，。！？；：、,.!?;:])[ \t]*", "$1"),
    (r"[ \t]{2,}", " "),
    BLANK_LINES,
]


def repair_line_breaks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text``: each text repaired; empty where nothing is left. Null counts as empty; ``key`` is unique."""
    cleaned = T.chain(T.strip_intra_cjk_space(T.chain(T.normalize_line_breaks(F.coalesce(F.col(text), F.lit(""))), BEFORE)), [BLANK_LINES])
    kept = L.drop_repeated_lines(L.explode_lines(docs.select(key, cleaned.alias("t")), "t", key), key)
    whole = L.concat_ordered(kept, key, "line_no", "line", "\n").toDF(key, "text").withColumn("t", T.chain(F.col("text"), [HYPHEN, BLANK_LINES]))
    blocks = F.filter(F.transform(F.split("t", r"\n{2,}"), T.js_trim), lambda b: b != "")
    merged = G.merge_wrapped_lines(G.exploded(whole.withColumn("__b", blocks), "__b", "n", "block", key), "block", "parts")
    joined = L.concat_ordered(merged.withColumn("p", F.array_join("parts", "\n\n")), key, "n", "p", "\n\n").toDF(key, "text")
    repaired = joined.select(key, T.js_trim(T.chain(F.col("text"), AFTER)).alias("text"))
    return docs.select(key).join(repaired, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
