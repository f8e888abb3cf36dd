"""Text cleaning, keys and predicates as Column expressions.

Patterns that need no lookaround are written so that Java's and RE2's regex engines read them alike,
so the SQL of the queries can share them. ``\\z`` is the end of the text; white space and trimming
follow JavaScript's wider set, and word boundaries are ASCII's.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the source application's for equal results.
WS = "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
CJK = "一-龥"
CHAPTER_UNITS = "[章节卷部篇回]"
CHAPTER_NUMBERS = "[一二三四五六七八九十百千万0-9]"
FRONT_MATTER = "(?:序章|序言|前言|引言|后记|尾声|番外)"
HEADING = rf"(?i)^(?:#{{1,6}}{WS}*[^\n]+|(?:chapter|part){WS}+[0-9]+[^\n]*|第{CHAPTER_NUMBERS}+{CHAPTER_UNITS}[^\n]*|{FRONT_MATTER}[^\n]*)\z"
PAGE_HEADING = rf"(?i)^(?:chapter|part){WS}+[0-9]+|^第{CHAPTER_NUMBERS}+{CHAPTER_UNITS}|^{FRONT_MATTER}"
CAPITAL_HEADING = rf"^[A-Z](?:[A-Z:&/-]|{WS}){{3,}}\z"
MAJOR_TITLE = rf"(?i)^(?:chapter|part|section){WS}+[0-9]+|^第[{CJK}0-9零一二三四五六七八九十百千万两〇]+{CHAPTER_UNITS}"
REFERENCE_HEADING = r"(?i)^(?:参考文献|references|bibliography)\z"
REFERENCE_SECTION = rf"(?is)(?:^|\n){WS}*(?:参考文献|references|bibliography){WS}*(?:\n|\z).*\z"
STRONG_CHARS, CLOSERS = "。！？!?…", "\"”’')]"
STRONG_END = r"[。！？!?…][\"”’')\]]*\z"
STRONG_END_DOT = r"[。！？!?….][\"”’')\]]*\z"
HARD_BREAK_LIST = rf"^(?:[-*•●▪◦]|(?:[0-9]+|[A-Za-z])[.)、]){WS}+"
HARD_BREAK_CN = rf"^(?:附录|摘要|结论|讨论|方法|结果|引言|致谢)(?:[:：]|{WS}|\z)"
HARD_BREAK_EN = r"(?i)^(?:appendix|abstract|introduction|methods?|results?|discussion|conclusion)(?:[^A-Za-z0-9_]|\z)"
NOISE_LINE = rf"(?i)^(?:(?:[-_~*•·|｜]|{WS})+|[0-9]{{1,4}}|page{WS}*[0-9]{{1,4}}|第{WS}*[0-9]{{1,4}}{WS}*页|[A-Z]?[0-9]{{1,3}}[A-Z]?|[A-Z]{{1,2}})\z"
BOILERPLATE_TITLE = r"(?i)^(?:版权(?:信息|页)?|版权所有|侵权必究|目录|contents?|catalog|出版信息|联系(?:方式|我们)?|about|封面|扉页)\z"
BOILERPLATE_LINE = r"(?i)(?:版权所有|侵权必究|出版社|出版|发行|电子版|客服(?:热线|电话|邮箱)?|热线|邮箱|网址|官网|官方|微信(?:公众号|号)?|微博|ISBN|CIP|service@|https?://|www\.|责任编辑|装帧|定价|印刷|联系电话|copyright)"
TOC_LINE = rf"(?i)(?:^{WS}*(?:第{CHAPTER_NUMBERS}+{CHAPTER_UNITS}[A-Za-z0-9_]|(?:chapter|part|contents?)(?:[^A-Za-z0-9_]|\z)))|(?:\.{{2,}}{WS}*[0-9]+{WS}*\z)|(?:{WS}+[0-9]+{WS}*\z)"
PAGE_ARTIFACT = rf"(?i)^(?:page{WS}*)?[0-9]{{1,4}}\z"
GENERIC_TITLE_WORD = r"(?i)^(?:section|chapter|part)(?:[^A-Za-z0-9_]|\z)"
GENERIC_TITLE_WORD_CN = rf"(?i)^(?:(?:正文|内容|片段|分段|章节|pdf{WS}*分段)[A-Za-z0-9_]|第{WS}*[0-9]+(?:{WS}*{CHAPTER_UNITS}[A-Za-z0-9_]|[^A-Za-z0-9_]|\z))"
SYMBOLS_ALLOWED_IN_LINES = rf"A-Za-z0-9{CJK}，。！？；：、,.!?;:'\"“”‘’/#-"
SHORT_HEADING_CHARS, MIN_LINE_KEY, REPEATED_LINE_CHARS = 42, 8, 90
PREVIEW_CHARS = 30

#: Chains of pattern and replacement that both engines read alike; replacements hold no groups.
LINE_BREAKS = [("\r\n", "\n"), ("\r", "\n")]
WHITESPACE = [*LINE_BREAKS, ("[ \t]+\n", "\n"), ("\n{3,}", "\n\n"), ("[ \t]{2,}", " ")]
READABLE = [*LINE_BREAKS, ("[\u00a0\u3000]", " "), ("[ \t]+\n", "\n"), ("\n{3,}", "\n\n"), ("[ \t]{2,}", " ")]
TRIM = [(rf"\A{WS}+", ""), (rf"{WS}+\z", "")]


_MEMBER = r"\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\.|[^\\]"
_CLASS = re.compile(r"\\.|\[(\^?)(\]?(?:\\.|[^\]\\])*)\]", re.S)
_RANGE = re.compile(rf"({_MEMBER})(?:-({_MEMBER}))?", re.S)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
#: Blanks beyond Latin-1; all but the last are Unicode's separators.
_WIDE_BLANKS = [(ord(a), ord(b or a)) for a, b in _RANGE.findall(WS[WS.index("\u1680") : -1])]


def _code(member: str) -> int | None:
    if len(member) == 1:
        return ord(member)
    if member[1] in "xu":
        return int(member[2:], 16)
    if member[1] in _ESCAPES:
        return ord(_ESCAPES[member[1]])
    return None if member[1].isalnum() else ord(member[1])


def _listed(match: re.Match) -> str:
    """A class with its Latin members listed and the others behind one test of their block."""
    if match.group(1) is None:
        return match.group()
    latin, wide = set(), []
    for first, last in _RANGE.findall(match.group(2)):
        a, b = _code(first), _code(last or first)
        if a is None or b is None or a < 256 <= b:
            return match.group()
        if b < 256:
            latin |= set(range(a, b + 1))
        else:
            wide.append((a, b))
    separators = ""
    if {0x20, 0xA0} <= latin and set(_WIDE_BLANKS) <= set(wide):
        wide = [x for x in wide if x not in _WIDE_BLANKS[:-1]]
        separators = r"\p{Z}"
    others = separators + "".join(f"\\u{a:04x}-\\u{b:04x}" if a < b else f"\\u{a:04x}" for a, b in wide)
    if separators or len(wide) > 1:
        others = rf"[\u0100-\uffff&&[{others}]]"
    return f"[{match.group(1)}{''.join(f'{chr(92)}x{c:02x}' for c in sorted(latin))}{others}]"


@cache
def quick(pattern: str) -> str:
    """A pattern that matches the same and costs Java less: it finds a listed Latin character by one look-up,
    while each range and each other member of a class is a call inside the call of the one before.
    """
    return _CLASS.sub(_listed, pattern)


def replace(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, quick(pattern), to)


def has(c: Column, pattern: str) -> Column:
    return c.rlike(quick(pattern))


def count(c: Column, char_class: str) -> Column:
    """How many characters are of a class; ``regexp_count`` would make a list of them."""
    return F.length(c) - F.length(replace(c, f"{char_class}+", ""))


#: Patterns of single characters, which are replaced without a regex.
_PLAIN = {"[\u00a0\u3000]": "\u00a0\u3000", "\x02": "\x02"}
#: A text that a pattern matches holds one of these: looking for them costs less.
_SIGNS = {"\n{3,}": ["\n\n\n"], "[ \t]+\n": [" \n", "\t"], "[ \t]{2,}": ["  ", "\t"]}


def chain(c: Column, steps: list[tuple[str, str]]) -> Column:
    """Replacements one after the other."""
    for pattern, to in steps:
        if pattern in _PLAIN:
            for x in _PLAIN[pattern]:
                c = F.replace(c, F.lit(x), F.lit(to))
        elif signs := _SIGNS.get(pattern):
            c = let(c, lambda x: F.when(reduce(Column.__or__, map(x.contains, signs)), replace(x, pattern, to)).otherwise(x))  # noqa: B023
        else:
            c = replace(c, pattern, to)
    return c


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is computed once: plain expressions are computed again wherever they stand behind a condition."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def normalize_line_breaks(c: Column) -> Column:
    for pattern, to in LINE_BREAKS:
        c = F.replace(c, F.lit(pattern), F.lit(to))
    return c


def normalize_whitespace(c: Column) -> Column:
    return js_trim(chain(normalize_line_breaks(c), WHITESPACE[len(LINE_BREAKS) :]))


#: A blank between two of these carries no meaning.
TIGHT = f"[{CJK}\u3040-\u30ff\u3001-\u303f\uff00-\uffef\u201c\u201d\u2018\u2019\u2026\u2014\u00b7]"


def strip_intra_cjk_space(c: Column) -> Column:
    return replace(c, rf"(?<={TIGHT})[ \t]+(?={TIGHT})", "")


def normalize_readable(c: Column) -> Column:
    return js_trim(strip_intra_cjk_space(chain(normalize_line_breaks(c), READABLE[len(LINE_BREAKS) :])))


_NUMBERS = r"[0-9]{1,3}(?:\s*[-,–]\s*[0-9]{1,3})*"
_SUPERS = "¹²³⁴⁵⁶⁷⁸⁹⁰0-9"
#: References in brackets, beside text, in superscript.
BRACKET_REFERENCES = rf"\[{_NUMBERS}\]|\({_NUMBERS}\)|（{_NUMBERS}）|【{_NUMBERS}】"
PAREN_REFERENCES = rf"[（(【\[]{WS}*[{_SUPERS}]{{1,3}}(?:{WS}*[-,–—]{WS}*[{_SUPERS}]{{1,3}})*{WS}*[）)】\]]"
CJK_REFERENCE = rf"(?<=[{CJK}])[0-9]{{1,2}}(?=(?:[，。；：、）》」』】\])]|\z))"
END_REFERENCE = rf"(?<=[{CJK}）】〉》」』])[{_SUPERS}]{{1,3}}(?=(?:[，。；：、,.!?！？;:）】〉》」』\"'”’]|{WS}|\z))"
SUPERSCRIPTS = "[⁰¹²³⁴⁵⁶⁷⁸⁹]+"


def strip_reference_artifacts(c: Column, keep_leading_numbers: bool = False) -> Column:
    c = chain(c, [*LINE_BREAKS, (rf"(?m)^{WS}*[0-9]{{1,3}}{WS}*$", "\n")])
    if not keep_leading_numbers:
        c = replace(c, rf"(\A|\n){WS}*(?:[0-9]{{1,2}}|[\[(（【][0-9]{{1,3}}[\])）】])(?=(?:{WS}|[\"“‘'（(【\[{CJK}A-Za-z]))", "$1")
    steps = [(BRACKET_REFERENCES, ""), (PAREN_REFERENCES, ""), (CJK_REFERENCE, ""), (END_REFERENCE, ""), (SUPERSCRIPTS, ""), ("[ \t]{2,}", " "), ("\n{3,}", "\n\n"), *TRIM]
    return chain(c, steps)


def clean_display_text(c: Column) -> Column:
    return normalize_readable(strip_reference_artifacts(c))


def cut_reference_section(c: Column) -> Column:
    return replace(c, REFERENCE_SECTION, "")


def sanitize_for_speech(c: Column) -> Column:
    c = chain(cut_reference_section(clean_display_text(c)), [(PAREN_REFERENCES, ""), (r"[—–―]+|\.{3,}|…+", "，"), (r"[()（）\[\]【】{}<>《》「」『』]", ""), ("[#*_~^`|]", "")])
    c = replace(c, rf"(\A|{WS})(?:[0-9]{{1,2}}|[\[(（【][0-9]{{1,3}}[\])）】])(?=(?:{WS}|\z))", "$1")
    return chain(c, [(END_REFERENCE, ""), (SUPERSCRIPTS, ""), (r"[;；:：/\\]+", "，"), ("，{2,}", "，"), ("[ \t]{2,}", " "), *TRIM])


CLEAN_HEADING = [(rf"^#+{WS}*", ""), (rf"{WS}+", " "), *TRIM]


def clean_heading(c: Column) -> Column:
    return chain(c, CLEAN_HEADING)


def lower_key(c: Column, kept: str) -> Column:
    """``c`` in small letters with a-z and ``kept`` alone. Only A-Z, the dotted I and the Kelvin sign become a-z, so the rest can go before."""
    return F.lower(F.replace(replace(c, f"[^A-Za-z\u0130\u212a{kept}]+", ""), F.lit("\u0130"), F.lit("i")))


def section_key(c: Column) -> Column:
    return lower_key(clean_heading(c), f"0-9{CJK}")


def line_key(c: Column, min_len: int = MIN_LINE_KEY) -> Column:
    """White space is no part of a key, and normalizing it joins no digits, so it needs no step here."""
    key = lower_key(replace(c, "[0-9]+", "#"), f"#{CJK}")
    return F.coalesce(replace(key, rf"\A.{{0,{min_len - 1}}}\z", ""), F.lit(""))


def count_meaningful(c: Column) -> Column:
    return count(c, f"[A-Za-z0-9{CJK}]")


#: What each variant does not count as a symbol.
SYMBOL_VARIANTS = {
    "line": SYMBOLS_ALLOWED_IN_LINES,
    "page": rf"A-Za-z0-9_{CJK}，。！？；：、,.!?;:'\"“”‘’-",
    "candidate": rf"A-Za-z0-9{CJK}，。！？；：、,.!?;:'\"“”‘’-",
}


def symbol_ratio(c: Column, variant: str = "line", compact: Column | None = None) -> Column:
    """``compact`` is the text without white space if that is known already."""
    compact = replace(c, f"{WS}+", "") if compact is None else compact
    symbols = F.length(replace(compact, f"[{SYMBOL_VARIANTS[variant]}]+", ""))
    return symbols / F.greatest(F.length(compact), F.lit(1))


def detect_lang(c: Column, default: str = "zh-CN", english: str = "en-US", chinese: str = "zh-CN") -> Column:
    """Language tag by the scripts that occur."""

    def judged(n: Column) -> Column:
        signal = n.latin + n.words * 1.5 + F.when((n.latin > 0) | (n.zh == 0), n.digits * 1.25).otherwise(n.digits * 0.15)
        is_english = (signal > 0) & ((n.zh == 0) | (signal >= n.zh * 1.35) | ((n.latin >= 2) & (n.digits >= 2) & (signal >= n.zh * 0.9)))
        return F.when(n.kana, "ja-JP").when(n.hangul, "ko-KR").when(n.cyrillic, "ru-RU").when(is_english, english).when(n.zh > 0, chinese).otherwise(default)

    counts = {"zh": count(c, f"[{CJK}]"), "latin": count(c, "[A-Za-z]"), "digits": count(c, "[0-9]"), "words": F.regexp_count(c, F.lit(quick("[A-Za-z]{2,}")))}
    scripts = {"kana": has(c, "[ぁ-ゟ゠-ヿ]"), "hangul": has(c, "[가-힣]"), "cyrillic": has(c, "[А-Яа-яЁё]")}
    return let(F.struct(*(x.alias(k) for k, x in (counts | scripts).items())), judged)


def has_strong_ending(c: Column, dot_is_strong: bool = False) -> Column:
    last = F.right(F.rtrim(js_trim(c), F.lit(CLOSERS)), F.lit(1))
    return last.isin(*(STRONG_CHARS + "." if dot_is_strong else STRONG_CHARS))


SPACE_LEFT = r"[A-Za-z0-9](?:[.!?;:,][\"”’')\]]*)?\z"


def needs_space(left: Column, right: Column) -> Column:
    def ends(t: Column) -> Column:
        return let(F.struct(t.alias("t"), F.rtrim(t, F.lit(CLOSERS)).alias("bare")), bare_ends)

    def bare_ends(x: Column) -> Column:
        alnum = lambda at: has(F.substring(x.bare, at, 1), "[A-Za-z0-9]")
        return ((x.bare == x.t) & alnum(-1)) | (F.right(x.bare, F.lit(1)).isin(*".!?;:,") & (F.length(x.bare) > 1) & alnum(-2))

    return has(F.left(js_trim(right), F.lit(1)), "[A-Za-z0-9]") & let(js_trim(left), ends)


def join_text(left: Column, right: Column) -> Column:
    return F.concat(left, F.when(needs_space(left, right), " ").otherwise(""), right)


def is_heading_line(c: Column) -> Column:
    return has(c, HEADING)


def _short_heading(t: Column) -> Column:
    return (t != "") & (F.length(t) <= SHORT_HEADING_CHARS) & (has(t, HEADING) | has(t, CAPITAL_HEADING))


def is_short_heading(c: Column) -> Column:
    return let(js_trim(c), _short_heading)


def is_hard_break(c: Column) -> Column:
    return let(js_trim(c), lambda t: (t == "") | _short_heading(t) | has(t, HARD_BREAK_LIST) | has(t, HARD_BREAK_CN) | has(t, HARD_BREAK_EN))


STANDALONE = [rf"[:：]{WS}*[^{WS[1:-1]}]+\z", r"(?i)^https?://", rf"^[^{WS[1:-1]}]+@[^{WS[1:-1]}]+\.[^{WS[1:-1]}]+\z", r"^\[?[0-9]{1,3}\]?\z"]


def is_standalone(c: Column) -> Column:
    out = has(js_trim(c), REFERENCE_HEADING)
    for p in STANDALONE:
        out = out | has(c, p)
    return out


def join_flowing(left: Column, right: Column) -> Column:
    """Text of two blocks: a paragraph break, or a bridge when the first stops mid-sentence."""
    a, b = js_trim(left), js_trim(right)
    parts = F.split(a, "\n")
    broken = has_strong_ending(a) | is_short_heading(F.element_at(parts, -1)) | is_heading_line(F.substring_index(b, "\n", 1))
    return F.when(a == "", b).when(b == "", a).when(broken, F.concat(a, F.lit("\n\n"), b)).otherwise(join_text(a, b))


def is_major_title(c: Column) -> Column:
    return has(clean_heading(c), MAJOR_TITLE)


def is_generic_title(c: Column) -> Column:
    t = clean_heading(F.coalesce(c, F.lit("")))
    return (t == "") | has(t, GENERIC_TITLE_WORD) | has(t, GENERIC_TITLE_WORD_CN)


def resolve_title(title: Column, preview_: Column, number: Column, fallback: Column | str = "正文") -> Column:
    t = clean_heading(F.coalesce(title, F.lit("")))
    fine = (t != "") & ~has(t, BOILERPLATE_TITLE) & ~is_generic_title(t)
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(fine, t).when(F.coalesce(preview_, F.lit("")) != "", preview_).otherwise(F.concat(fallback, F.lit(" · "), number.cast("string")))


def merge_source_hint(a: Column, b: Column) -> Column:
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when(x == "", y).when((y == "") | (x == y), x).otherwise(F.concat(x, F.lit(" · "), y))


def preview(sentence: Column, n: int = PREVIEW_CHARS) -> Column:
    t = normalize_whitespace(F.coalesce(sentence, F.lit("")))
    return F.when(F.length(t) > n, F.concat(js_trim(F.substring(t, 1, n)), F.lit("…"))).otherwise(t)
