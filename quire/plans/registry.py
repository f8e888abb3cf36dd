"""Registered queries, their SQL, and small helpers to write that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under ``name``, with the SQL that returns the same rows."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


#: Columns of whole texts, on which much work is done for each row.
TEXTS = {"text", "html"}


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if TEXTS & set(df.columns) else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew if fewer tasks than the cluster runs at once would have rows: a file with one row group is one task.

    Rows are counted from the files' footers. A table of as many row groups as cores, as any large one is, is left as it lies.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    full = df.select(F.spark_partition_id().alias("task")).groupBy("task").count().limit(wanted).count()
    return df.repartition(wanted) if 0 < full < wanted else df


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(e: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(to)}, 'g')"


def steps(e: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, to in pairs:
        e = rr(e, pattern, to)
    return e


def has(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {q(pattern)})"


def count(e: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({e}, {q(pattern)})) AS INTEGER)"


def trim(e: str) -> str:
    return steps(e, T.TRIM)


def breaks(e: str) -> str:
    return steps(e, T.LINE_BREAKS)


def whitespace(e: str) -> str:
    return steps(e, [*T.WHITESPACE, *T.TRIM])


def readable(e: str) -> str:
    """Without the step for blanks between CJK characters, which the tables do not hold."""
    return steps(e, [*T.READABLE, *T.TRIM])


def heading(e: str) -> str:
    return steps(e, T.CLEAN_HEADING)


def line_key(e: str) -> str:
    k = steps(f"lower({whitespace(e)})", [("[0-9]+", "#"), (f"[^a-z#{T.CJK}]+", "")])
    return f"CASE WHEN length({k}) >= {T.MIN_LINE_KEY} THEN {k} ELSE '' END"


def meaningful(e: str) -> str:
    return count(e, f"[A-Za-z0-9{T.CJK}]")


def symbols(e: str, variant: str) -> str:
    compact = rr(e, T.WS)
    return f"({count(compact, f'[^{T.SYMBOL_VARIANTS[variant]}]')} / greatest(length({compact}), 1)::DOUBLE)"


def strong(e: str) -> str:
    return has(trim(e), T.STRONG_END)


def short_heading(e: str) -> str:
    t = trim(e)
    return f"({t} <> '' AND length({t}) <= {T.SHORT_HEADING_CHARS} AND ({has(t, T.HEADING)} OR {has(t, T.CAPITAL_HEADING)}))"


def hard_break(e: str) -> str:
    t = trim(e)
    return f"({t} = '' OR {short_heading(e)} OR {has(t, T.HARD_BREAK_LIST)} OR {has(t, T.HARD_BREAK_CN)} OR {has(t, T.HARD_BREAK_EN)})"


def standalone(e: str) -> str:
    return "(" + " OR ".join([has(trim(e), T.REFERENCE_HEADING), *(has(e, p) for p in T.STANDALONE)]) + ")"


def needs_space(a: str, b: str) -> str:
    return f"({has(trim(b), '^[A-Za-z0-9]')} AND {has(trim(a), T.SPACE_LEFT)})"


def language(e: str, english: str = "en-US", chinese: str = "zh-CN", default: str = "zh-CN") -> str:
    zh, latin, digits = count(e, f"[{T.CJK}]"), count(e, "[A-Za-z]"), count(e, "[0-9]")
    signal = f"({latin} + {count(e, '[A-Za-z]{2,}')} * 1.5 + CASE WHEN {latin} > 0 OR {zh} = 0 THEN {digits} * 1.25 ELSE {digits} * 0.15 END)"
    return f"""CASE WHEN {count(e, '[ぁ-ゟ゠-ヿ]')} > 0 THEN 'ja-JP' WHEN {count(e, '[가-힣]')} > 0 THEN 'ko-KR' WHEN {count(e, '[А-Яа-яЁё]')} > 0 THEN 'ru-RU'
      WHEN {signal} > 0 AND ({zh} = 0 OR {signal} >= {zh} * 1.35 OR ({latin} >= 2 AND {digits} >= 2 AND {signal} >= {zh} * 0.9)) THEN '{english}' WHEN {zh} > 0 THEN '{chinese}' ELSE '{default}' END"""


#: All lines of the documents, numbered from 0.
LINES = f"""ln AS (SELECT doc_id, CAST(g.i - 1 AS INTEGER) AS line_no, l[g.i] AS line, CAST(len(l) AS BIGINT) AS n_lines
  FROM (SELECT doc_id, string_split({breaks('text')}, chr(10)) AS l FROM documents) AS d, unnest(generate_series(1, len(l))) AS g(i))"""


def noise(line: str = "line", edge: str = "(line_no <= 2 OR line_no >= n_lines - 3)") -> str:
    t = whitespace(line)
    return f"""({t} <> '' AND ({has(t, T.NOISE_LINE)} OR ({edge} AND length({t}) <= 8 AND {meaningful(t)} <= 4) OR ({symbols(t, 'line')} > 0.5 AND {meaningful(t)} <= 6)))"""


def groups(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Replacement steps with Java's group marks turned into RE2's."""
    return [(p, t.replace("$1", "\\1").replace("$2", "\\2")) for p, t in pairs]


def gather(lists: str, new: str, flags: dict[str, str], name: str = "f", state: dict[str, tuple[str, str]] | None = None) -> str:
    """CTEs that fold the lists ``l`` of rows ``k`` in ``lists``: ``{name}(k, i, g, t, x...)`` with a group number for each element.

    ``new`` sees the state ``s.len, s.strong, s.alone`` and the element ``x`` with ``flags``. ``state`` adds fields: (first, next), ``n`` says whether the element is new.
    """
    more = state or {}
    own = {"len": "length(t)", "strong": strong("t"), "standalone": standalone("t"), "colon": has("t", T.STANDALONE[0]), "space": needs_space("b", "t")} | flags
    fields = ", ".join(f"{e} AS {k}" for k, e in own.items())
    grown = ", ".join(e for _, e in more.values())
    return f"""{name}_e AS (SELECT k, i, t, {fields} FROM (SELECT k, CAST(g.i AS INTEGER) AS i, l[g.i] AS t, CASE WHEN g.i > 1 THEN l[g.i - 1] ELSE '' END AS b FROM {lists}, unnest(generate_series(1, len(l))) AS g(i))),
{name} AS (SELECT k, i, 1 AS g, true AS n, len AS len, strong AS strong, standalone AS alone{"".join(f", {a} AS {k}" for k, (a, _) in more.items())} FROM {name}_e WHERE i = 1
  UNION ALL SELECT k, i, g + CASE WHEN n THEN 1 ELSE 0 END, n, CASE WHEN n THEN xlen ELSE slen + CASE WHEN xspace THEN 1 ELSE 0 END + xlen END, xstrong, CASE WHEN n THEN xstandalone ELSE xcolon END{", " + grown if grown else ""}
  FROM (SELECT x.k, x.i, s.g, s.len AS slen, x.len AS xlen, x.space AS xspace, x.strong AS xstrong, x.standalone AS xstandalone, x.colon AS xcolon, {new} AS n{"".join(f", s.{k} AS s{k}" for k in more)}{"".join(f", x.{k} AS x{k}" for k in flags)} FROM {name} AS s JOIN {name}_e AS x ON x.k = s.k AND x.i = s.i + 1)),
{name}_g AS (SELECT k, g, min(i) AS first, count(*) AS size, string_agg(CASE WHEN space AND NOT n THEN ' ' ELSE '' END || t, '' ORDER BY i) AS t FROM (SELECT k, i, g, n FROM {name}) JOIN (SELECT k, i, t, space FROM {name}_e) USING (k, i) GROUP BY k, g)"""
