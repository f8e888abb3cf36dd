"""Texts to segments, sentences, blocks and paragraphs; sentences to speech units.

Everything works on arrays inside a row, so no shuffle is needed: documents stay where they were read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import reading as R
from quire.functions import text as T
from quire.operators import folds
from quire.operators.lines import wrapped

# They must equal the source application's for equal results.
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|Mt|No|Nos|Fig|Figs|Eq|Eqs|Dept|Univ|Inc|Ltd|Co|Corp|vs|etc|MD|PhD"
NUMBERED = "ID|No|Ref|MRN|DOB|Tel|Fax|Vol"
MIN_PARAGRAPH, IDEAL_PARAGRAPH, MAX_PARAGRAPH, SHORT_FRAGMENT, SHORT_SENTENCE = 56, 148, 250, 34, 16
UNIT_IDEAL, UNIT_MAX, STICKY_CHARS, QUICK_POINTS = 240, 360, 20, 5

_WORD = "[A-Za-z0-9_]"
_INITIAL = (r"(\A|[^A-Za-z0-9_])([A-Z])\.", "$1$2\x02")
#: Periods that end no sentence become \x02, boundaries get a \x01 behind them.
SEGMENT_STEPS = [
    (rf"(?i)(\A|[^A-Za-z0-9_])({ABBREVIATIONS})\.", "$1$2\x02"),
    _INITIAL,
    _INITIAL,
    (rf"(?i)(\A|[^A-Za-z0-9_])((?:{NUMBERED})[ ]*[:#-]?[ ]*[A-Z0-9-]*)\.", "$1$2\x02"),
    (r"([0-9])\.([ ]*[0-9])", "$1\x02$2"),
    ("([。！？!?…；;])", "$1\x01"),
    (rf"\.([ ]*(?:[“”\"‘’'(\[]?[A-Z0-9{T.CJK}]))", ".\x01$1"),
    ("\x02", "."),
]
#: First and second letters of ``NUMBERED``.
_LEADS = ["".join(sorted({c for x in NUMBERED.split("|") for c in (x[i].lower(), x[i].upper())})) for i in (0, 1)]
#: The same for Java: what stands before a period is looked at from the period, where the steps above try every character. A period that
#: ends an abbreviation is no lead of the next one (``\G``: where the last match ended); looking back finds initials in a row at once.
#: A numbered abbreviation is looked for by its first two letters, and then back from these.
QUICK_STEPS = [
    (rf"\.(?<=(?:\A|[^A-Za-z0-9_](?!\G))(?i:{ABBREVIATIONS})\.)", "\x02"),
    (r"\.(?<=(?:\A|[^A-Za-z0-9_])[A-Z]\.)", "\x02"),
    (rf"(?=[{_LEADS[0]}][{_LEADS[1]}])(?<=(?:\A|[^A-Za-z0-9_](?!\G)))((?i:(?:{NUMBERED})[ ]*[:#-]?[ ]*[A-Z0-9-]*))\.", "$1\x02"),
    *SEGMENT_STEPS[4:],
]
#: Ends of text after which a period is not the sentence's.
KEEPS_PERIOD = [rf"(?i)(?:\A|[^A-Za-z0-9_])(?:{ABBREVIATIONS})\.\z", r"(?:\A|[^A-Za-z0-9_])[A-Z]\.\z", rf"(?i)(?:\A|[^A-Za-z0-9_])(?:{NUMBERED}){T.WS}*[:#-]?{T.WS}*[A-Z0-9-]*\.\z"]
#: The first two of them in one, and as many characters as hold the longest abbreviation, its period and more than one before.
_KEEPS_SHORT, _SHORT_END = rf"(?:\A|[^A-Za-z0-9_])(?:[A-Z]|(?i:{ABBREVIATIONS}))\.\z", max(map(len, ABBREVIATIONS.split("|"))) + 3
SHORT_WORD_PERIOD = r"(?:\A|[^A-Za-z0-9_])[A-Za-z]{1,3}\.\z"
CONTINUES = r"\A[a-z,;:)\]]"


def _non_empty(texts: Column) -> Column:
    return F.filter(texts, lambda x: x != "")


def segments(c: Column) -> Column:
    """Pieces between sentence boundaries, before any is merged."""
    # A readable text has two breaks in a row at most.
    t = F.replace(F.replace(T.normalize_readable(c), F.lit("\n\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    # No break of a line is left and no boundary lies inside a run of blanks, so white space is normalized before the split.
    return _non_empty(F.transform(F.split(T.chain(t, [*QUICK_STEPS, T.WHITESPACE[-1]]), "\x01"), T.js_trim))


def keeps_period(before: Column, x: Column) -> Column:
    """All ways to keep it are ends with a period; but for numbered ones they show in the last few characters."""
    end = F.substring(before, -_SHORT_END, _SHORT_END)
    digits = T.has(x, r"\A[0-9]") & T.has(end, r"[0-9]\.\z")
    word = T.has(x, r"\A[a-z]") & T.has(end, SHORT_WORD_PERIOD)
    return before.endswith(".") & (digits | word | T.has(end, _KEEPS_SHORT) | T.has(before, KEEPS_PERIOD[2]))


def merge_fragments(df: DataFrame, pieces: str, out: str, min_len: int = SHORT_FRAGMENT) -> DataFrame:
    """Sentences: a piece joins the one before it unless that one can end there."""

    def new(s: Column, x: Column) -> Column:
        return ~(x.keeps | ~s.strong | ((s.len < min_len) & ~s.alone) | x.continues)

    return folds.fold(df, pieces, out, new, keeps=lambda x, b: keeps_period(b, x), continues=lambda x, b: T.has(x, CONTINUES))


def sentences(df: DataFrame, text: str, out: str) -> DataFrame:
    return merge_fragments(df.withColumn("__pieces", segments(F.col(text))), "__pieces", out).drop("__pieces")


def merge_wrapped_lines(df: DataFrame, block: str, out: str) -> DataFrame:
    """Adds the paragraphs of one block: hard-wrapped lines are joined, hyphens at line ends dropped."""
    staged = df.withColumn("__lines", _non_empty(F.transform(F.split(block, "\n"), T.clean_display_text)))
    lines = F.col("__lines")
    n = F.size(lines)
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 48))
    soft = F.size(F.filter(lines, lambda x: ~T.has_strong_ending(x)))
    staged = staged.withColumn("__mode", wrapped(n, total / F.greatest(n, F.lit(1)), short, soft))
    cut = lambda x: T.replace(x, rf"-{T.WS}*\z", "")
    staged = staged.withColumn("__items", folds.elements(lines, cut=lambda x, b: cut(x), hard=lambda x, b: T.is_hard_break(x), blank=lambda x, b: T.needs_space(cut(b), x)))

    def new(s: Column, x: Column) -> Column:
        flowing = s.strong & (s.len >= 26) & (x.len >= 22)
        filled = s.strong & ((s.len >= MAX_PARAGRAPH) | ((s.len >= IDEAL_PARAGRAPH + 24) & (x.len >= MIN_PARAGRAPH)))
        return s.alone | x.standalone | x.hard | F.when(F.col("__mode"), filled).otherwise(flowing)

    def step(s: Column, x: Column, is_new: Column) -> dict[str, Column]:
        grown = s.len - s.tail + F.when(x.blank, 1).otherwise(0) + x.len
        return {"len": F.when(is_new, x.len).otherwise(grown), "strong": x.strong, "alone": F.when(is_new, x.standalone).otherwise(x.colon), "tail": x.len - F.length(x.cut)}

    staged = staged.withColumn("__at", folds.starts(F.col("__items"), folds.gathered_init() | {"tail": F.lit(0)}, new, step))
    text = lambda g: F.array_join(F.transform(g, lambda x, i: F.concat(F.when((i > 0) & x.blank, " ").otherwise(""), F.when(i < F.size(g) - 1, x.cut).otherwise(x.t))), "")
    return staged.withColumn(out, F.transform(folds.groups(F.col("__items"), F.col("__at")), lambda g: T.js_trim(text(g)))).drop("__lines", "__mode", "__items", "__at")


def paragraph_blocks(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """``keys, block_no, block``: the cleaned blocks of each text, numbered from 0 in its order (numbers may have gaps)."""
    rough = df.select(*keys, F.posexplode(F.split(T.clean_display_text(F.col(text)), "\n{2,}")).alias("__b", "__block"))
    parts = exploded(merge_wrapped_lines(rough, "__block", "__parts"), "__parts", "__p", "block", *keys, "__b")
    cleaned = parts.withColumn("block", T.clean_display_text(F.col("block"))).filter("block <> ''")
    return cleaned.select(*keys, (F.col("__b").cast("long") * 1_000_000 + F.col("__p")).alias("block_no"), "block")


def bucket_sentences(df: DataFrame, column: str, out: str, min_: int = MIN_PARAGRAPH, ideal: int = IDEAL_PARAGRAPH, max_: int = MAX_PARAGRAPH) -> DataFrame:
    """Adds paragraphs of readable length from the sentences of one block."""

    def new(s: Column, x: Column) -> Column:
        merged = s.len + F.when(x.space, 1).otherwise(0) + x.len
        return ~(((s.len < min_) | (x.len < SHORT_SENTENCE) | (merged <= ideal) | ~s.strong) & (merged <= max_))

    return folds.fold(df, column, out, new)


def merge_tiny_paragraphs(df: DataFrame, column: str, out: str, min_: int = MIN_PARAGRAPH, max_: int = MAX_PARAGRAPH) -> DataFrame:
    staged = df.withColumn("__clean", _non_empty(F.transform(F.col(column), T.clean_display_text)))
    return folds.fold(staged, "__clean", out, lambda s, x: ~((x.len < min_) & (s.len < max_) & ~x.standalone)).drop("__clean")


def split_paragraphs(df: DataFrame, *keys: str, text: str = "text", out: str = "paragraphs") -> DataFrame:
    """``keys, paragraphs``: the paragraphs of each text. One shuffle on the keys puts the blocks back together."""
    blocks = sentences(paragraph_blocks(df, *keys, text=text), "block", "__s")
    bucketed = bucket_sentences(blocks, "__s", "__p").withColumn("__p", F.when(F.size("__s") == 0, F.array("block")).otherwise(F.col("__p")))
    flat = bucketed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_no", "__p"))).alias("__all")).withColumn("__flat", F.flatten("__all.__p"))
    return merge_tiny_paragraphs(flat, "__flat", out).select(*keys, out)


def exploded(df: DataFrame, column: str, number: str, value: str, *keys: str) -> DataFrame:
    """``keys, number, value`` for the elements of an array.

    The outer form plus a filter behind it: for the plain form the optimizer would infer a filter on
    the array's size and push it, with all that computes the array, below the staged columns.
    """
    return df.select(*keys, F.posexplode_outer(column).alias(number, value)).filter(F.col(number).isNotNull())


def build_units(df: DataFrame, column: str, out: str = "units", ideal: int = UNIT_IDEAL, max_: int = UNIT_MAX, sticky: int = STICKY_CHARS) -> DataFrame:
    """Speech units ``array<struct<lang, text, first, size>>`` from an array of sentences: one language each, of bounded length."""
    items = folds.elements(F.col(column), alone=False, lang=lambda x, b: T.detect_lang(x))
    staged = df.withColumn("__items", items)

    def lang(s: Column, x: Column) -> Column:
        return F.when((s.i > 0) & (x.lang != s.lang) & (x.len <= sticky), s.lang).otherwise(x.lang)

    def new(s: Column, x: Column) -> Column:
        return (lang(s, x) != s.lang) | (s.len >= max_) | ((s.len >= ideal) & s.strong)

    def step(s: Column, x: Column, is_new: Column) -> dict[str, Column]:
        return {k: v for k, v in folds.gathered(s, x, is_new).items() if k != "alone"} | {"lang": lang(s, x)}

    at = folds.starts(F.col("__items"), {"len": F.lit(0), "strong": F.lit(False), "lang": F.lit("")}, new, step)
    staged = staged.withColumn("__at", at)
    unit = F.transform(folds.groups(F.col("__items"), F.col("__at")), lambda g, i: F.struct(folds.joined(g).alias("text"), (F.get(F.col("__at"), i) - 1).alias("first"), F.size(g).alias("size"), F.transform(g, lambda x: x.lang).alias("detected")))
    return staged.withColumn(out, unit).drop("__items", "__at")


def slice_unit(units: DataFrame, from_sentence: str) -> DataFrame:
    """``boundaries``: sentence numbers and character offsets of a unit's sentences (``sentences array<string>, first int``) from one of them on."""
    skip = F.greatest(F.col(from_sentence) - F.col("first"), F.lit(0))
    staged = units.withColumn("__skip", F.when(skip < F.size("sentences"), skip).otherwise(0))
    skip = F.col("__skip")
    staged = staged.withColumn("__items", folds.elements(F.slice("sentences", skip + 1, F.size("sentences")), alone=False))
    items = F.col("__items")
    zero = F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("at"))
    offsets = F.aggregate(items, zero, lambda s, x: F.struct((s.to + F.when((s.to > 0) & x.space, 1).otherwise(0) + x.len).alias("to"), F.array_append(s["at"], s.to + F.when((s.to > 0) & x.space, 1).otherwise(0)).alias("at")))["at"]
    staged = staged.withColumn("__offsets", offsets)
    return staged.withColumn("boundaries", F.transform("__offsets", lambda o, i: F.struct((F.col("first") + skip + i).alias("sentence_no"), o.alias("start")))).drop("__skip", "__items", "__offsets")


def sentence_map(paragraphs: DataFrame, *keys: str) -> DataFrame:
    """``paragraph_no, sentence_no, sentence, starts_at``: sentences numbered through a section, and the first of each paragraph."""
    rows = exploded(sentences(paragraphs, "text", "__s"), "__s", "n", "sentence", *keys, "paragraph_no")
    line = W.partitionBy(*keys).orderBy("paragraph_no", "n")
    numbered = rows.withColumn("sentence_no", F.row_number().over(line) - 1)
    return numbered.withColumn("starts_at", F.min("sentence_no").over(W.partitionBy(*keys, "paragraph_no"))).drop("n")


def quick_points(count: Column, n: int = QUICK_POINTS) -> Column:
    """Evenly spaced positions of a list of ``count``, at most ``n``."""
    few = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: R.js_round(s / (n - 1) * (count - 1)).cast("int")))
    return F.when(count <= n, few).otherwise(spread)


def audio_frames(clips: DataFrame, frame: float = 0.04, hop: float = 0.02) -> DataFrame:
    """``clip_id, frame_no, frame``: overlapping windows of each clip."""
    size, step = F.floor(F.col("sample_rate") * frame).cast("int"), F.greatest(F.floor(F.col("sample_rate") * hop).cast("int"), F.lit(1))
    last = F.size("samples") - size
    places = F.when(last >= 0, F.sequence(F.lit(0), last, step)).otherwise(F.array().cast("array<int>"))
    return clips.select("clip_id", "sample_rate", "samples", size.alias("n"), F.posexplode(places).alias("frame_no", "at")).select("clip_id", "sample_rate", "frame_no", F.slice("samples", F.col("at") + 1, F.col("n")).alias("frame"))


def units_of_sentences(df: DataFrame, units: str, *keys: str) -> DataFrame:
    """``keys, sentence_no, unit_no``: the unit of each sentence, from the array of ``build_units``, which leaves no sentence out.

    A unit and its sentences are in one row, so nothing is shuffled; ``unit_of_sentence`` is for tables of them.
    """
    members = exploded(df, units, "unit_no", "u", *keys).select(*keys, "unit_no", F.sequence("u.first", F.col("u.first") + F.col("u.size") - 1).alias("__of"))
    return members.select(*keys, F.explode("__of").alias("sentence_no"), "unit_no")


def unit_of_sentence(units: DataFrame, sentences: DataFrame, *keys: str) -> DataFrame:
    """``sentences`` (keys, sentence_no) with ``unit_no``: the first unit (keys, unit_no, first, size) that holds each, or null."""
    members = units.select(*keys, "unit_no", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("sentence_no"))
    return sentences.join(members.groupBy(*keys, "sentence_no").agg(F.min("unit_no").alias("unit_no")), [*keys, "sentence_no"], "left")
