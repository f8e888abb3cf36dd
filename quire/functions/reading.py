"""Paths, markup, voices, ids, labels and timing as Column expressions."""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# They must equal the source application's for equal results.
MIME_TYPES = {"pdf": "application/pdf", "epub": "application/epub+zip", "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown"}
FORMATS = {"txt": "TXT", "md": "TXT", "markdown": "TXT", "pdf": "PDF", "epub": "EPUB"}
HTML_BREAK_AFTER = "p|div|section|article|li|h1|h2|h3|h4|h5|h6|blockquote"
HTML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
VOICE_BUCKETS = {"zh-cn": ["zh-cn", "zh-sg", "zh-hans", "cmn-hans"], "zh-tw": ["zh-tw", "zh-hk", "zh-mo", "zh-hant", "cmn-hant"], "en-us": ["en-us"], "en-gb": ["en-gb"], "en-global": ["en-"]}
PRIORITY_BUCKETS = ["zh-cn", "en-us", "en-gb", "en-global", "zh-tw", "ja-jp", "ko-kr", "fr-fr", "de-de", "es-es", "it-it"]
BUCKET_LIMITS = {"zh-cn": 3, "en-us": 3, "en-gb": 3, "en-global": 2, "zh-tw": 2}
PREFERRED_CHINESE = ["xiaoxiao", "yunxi", "huihui", "xiaoyi", "xiaomeng", "xiaohan", "yunjian", "yunyang"]
PREFERRED_ENGLISH = ["aria", "jenny", "guy", "libby", "sonia", "ryan", "emma", "ava", "andrew", "sara", "zira", "david", "hazel"]
BUCKET_LABELS = {"zh-cn": "中文简体", "zh-tw": "中文繁体", "en-us": "English US", "en-gb": "English UK", "en-global": "English", "ja-jp": "日本語", "ko-kr": "한국어", "fr-fr": "Français", "de-de": "Deutsch", "es-es": "Español", "it-it": "Italiano"}
RATE_RANGE, FADE_MS, FADE_FLOOR, SPEECH_CHARS_LIMIT = (0.5, 3.0), 60_000, 0.15, 5000


def lookup(c: Column, values: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def strip_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]+\z", "")


def get_extension(c: Column) -> Column:
    return F.lower(F.substring_index(c, ".", -1))


def guess_mime(c: Column) -> Column:
    return lookup(get_extension(c), MIME_TYPES, F.lit("application/octet-stream"))


def book_format(c: Column) -> Column:
    """Format by extension; null for what is not read."""
    return lookup(get_extension(c), FORMATS, F.lit(None).cast("string"))


NORMAL_HREF = [(r"\\", "/"), (r"\A(?:\./)+", ""), (r"\A/", "")]


def normalize_href(c: Column) -> Column:
    return F.lower(T.js_trim(T.chain(F.substring_index(F.coalesce(c, F.lit("")), "#", 1), NORMAL_HREF)))


HTML_TO_TEXT = [
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style|noscript\b[^>]*>.*?</noscript|head\b[^>]*>.*?</head)\s*>", ""),
    (r"(?i)<br\b[^>]*>", "\n"),
    (rf"(?i)</(?:{HTML_BREAK_AFTER})\s*>", "\n"),
    (r"(?s)<[!/?a-zA-Z][^>]*>", ""),
]
#: Names of character references with what they stand for, the commonest first: a lookup goes through them in order.
REFERENCES = {n: html5[n] for n in [*(n for n in ("amp;", "quot;", "lt;", "gt;", "nbsp;", "copy;", "middot;", "amp")), *html5]}
#: Names that need no semicolon, longer ones before their beginnings.
BARE_REFERENCES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Numbers that stand for other characters than theirs: those of Windows-1252, and two more.
ODD_NUMBERS = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(128, 160)}
LAST_CODE_POINT, REFERENCE_NAME = 0x10FFFF, r"\A[^\t\n\f <&#;]{1,32};?"
REFERENCE_NUMBER = r"\A#(?:[0-9]+|[xX][0-9a-fA-F]+);?"


def _table(values: dict[str, str]) -> Column:
    """A map that the optimiser turns into a literal."""
    side = lambda texts: F.split(F.lit("\x01".join(texts)), "\x01")
    return F.map_from_arrays(side(values.keys()), side(values.values()))


def _number(c: Column) -> Column:
    """The character that a number refers to; nothing for one that is none."""
    kept = F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    none = ((c >= 1) & (c <= 8)) | (c == 11) | ((c >= 14) & (c <= 31)) | (c == 127) | ((c >= 0xFDD0) & (c <= 0xFDEF)) | (c % 65536 >= 0xFFFE)
    out = F.when((c > LAST_CODE_POINT) | ((c >= 0xD800) & (c <= 0xDFFF)), "\ufffd").when(none, "").otherwise(kept)
    odd = _table({str(k): v for k, v in ODD_NUMBERS.items()})
    return F.when((c <= 13) | ((c >= 128) & (c < 160)), F.coalesce(F.try_element_at(odd, c.cast("string")), out)).otherwise(out)


def _reference(x: Column) -> Column:
    """What stands behind an ampersand, with the reference at its start put in."""
    number = F.regexp_extract(x, REFERENCE_NUMBER, 0)
    digits = F.regexp_replace(F.regexp_extract(x, r"\A#[xX]?0*([0-9a-fA-F]*)", 1), r"\A\z", "0")
    base = F.when(F.lower(F.substring(number, 2, 1)) == "x", 16).otherwise(10)
    decimal = F.regexp_replace(F.regexp_extract(x, r"\A#0*([0-9]*)", 1), r"\A\z", "0")
    value = F.when(base == 16, F.when(F.length(digits) <= 8, F.conv(digits, 16, 10).cast("bigint"))).otherwise(F.when(F.length(decimal) <= 9, decimal.cast("bigint")))
    name = F.regexp_extract(x, REFERENCE_NAME, 0)
    bare = F.regexp_extract(x, rf"\A(?:{'|'.join(BARE_REFERENCES)})", 0)
    table = _table(REFERENCES)
    whole, start = F.try_element_at(table, name), F.try_element_at(table, bare)
    behind = lambda found: F.substring(x, F.length(found) + 1, F.length(x))
    named = F.coalesce(F.concat(whole, behind(name)), F.concat(start, behind(bare)), F.concat(F.lit("&"), x))
    plain = F.when(x.startswith("amp;"), F.concat(F.lit("&"), F.substring(x, F.lit(5), F.length(x))))  # most of them
    return plain.when(number != "", F.concat(_number(F.coalesce(value, F.lit(LAST_CODE_POINT + 1))), behind(number))).when(name != "", named).otherwise(F.concat(F.lit("&"), x))


def unescape(c: Column) -> Column:
    """Text with numeric and named character references put in, those without semicolon too."""
    pieces = F.split(c, "&", -1)
    whole = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _reference), ""))
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Text content of markup, with a line feed after block elements."""
    return unescape(T.chain(c, HTML_TO_TEXT))


def voice_bucket(lang: Column) -> Column:
    c = F.lower(F.replace(T.js_trim(F.coalesce(lang, F.lit(""))), F.lit("_"), F.lit("-")))
    out = c
    for bucket, starts in reversed(VOICE_BUCKETS.items()):
        out = F.when(reduce(lambda a, b: a | b, [c.startswith(s) for s in starts]), bucket).otherwise(out)
    return out


def voice_base(lang: Column) -> Column:
    return F.substring_index(voice_bucket(lang), "-", 1)


VOICE_NAME_KEY = [(r"\(natural\)|online|offline|multilingual|neural", ""), (f"[^a-z0-9{T.CJK}]+", "")]
CANONICAL_NAME = [(r"\Amicrosoft", ""), (r"desktop\z", ""), ("chinesesimplifiedprc|englishunitedstates|englishus", "")]


def voice_name_key(name: Column) -> Column:
    return T.chain(F.lower(F.coalesce(name, F.lit(""))), VOICE_NAME_KEY)


def canonical_voice_key(lang: Column, name: Column, uri: Column) -> Column:
    key = T.chain(voice_name_key(name), CANONICAL_NAME)
    return F.concat(voice_bucket(lang), F.lit(":"), F.when(key != "", key).otherwise(F.coalesce(uri, F.lit(""))))


_MARKET_WORDS = "simplified|traditional|english|chinese|natural|neural|online|offline|united|kingdom|prc|taiwan"
CLEAN_VOICE_NAME = [
    (rf"(?i)\A(?:Microsoft|Google|Apple|Android){T.WS}+", ""),
    (rf"(?i)\([^)]*(?:{_MARKET_WORDS})[^)]*\)", ""),
    (r"(?i)\b(?:Natural|Neural|Online|Offline|Multilingual|Desktop)\b", ""),
    (rf"(?i){T.WS}+-{T.WS}+(?:Chinese|English|Japanese|Korean|Français|Deutsch|Español|Italiano)[^\n]*\z", ""),
    (rf"{T.WS}{{2,}}", " "),
    *T.TRIM,
]


def clean_voice_name(name: Column) -> Column:
    original = T.js_trim(F.when(F.coalesce(name, F.lit("")) == "", "Unnamed").otherwise(name))
    cleaned = T.chain(original, CLEAN_VOICE_NAME)
    return F.when(cleaned != "", cleaned).otherwise(original)


def voice_label(lang: Column, name: Column, source: Column, is_default: Column) -> Column:
    label = lookup(voice_bucket(lang), BUCKET_LABELS, F.when(F.coalesce(lang, F.lit("")) != "", lang).otherwise("其他语音"))
    tag = F.when(source == "neural-pack", " · 神经语音").when(source == "bridge", " · Windows稳定").otherwise(" · 浏览器")
    return F.concat(label, F.lit(" · "), clean_voice_name(name), tag, F.when(is_default, " · 默认").otherwise(""))


def parse_voice_uri(c: Column, prefix: str = "pack:") -> Column:
    """``struct<pack,voice>`` of a pack voice; null for other voices."""
    rest = F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30))
    return F.when(F.instr(rest, ":") > 0, F.struct(F.substring_index(rest, ":", 1).alias("pack"), F.regexp_extract(rest, r"(?s)\A[^:]*:(.*)\z", 1).alias("voice")))


def _rolled(seed: Column, start: int, factor: int) -> Column:
    return F.aggregate(F.split(seed, ""), F.lit(start).cast("long"), lambda a, c: (a * factor + F.when(c == "", 0).otherwise(F.ascii(c))) % 4294967296)


def djb2_base36(seed: Column) -> Column:
    return F.lower(F.conv(_rolled(seed, 5381, 33).cast("string"), 10, 36))


def book_id(title: Column, format_: Column, chars: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("book-"), djb2_base36(F.concat_ws("::", text(title), text(format_), F.coalesce(chars, F.lit(0)).cast("string"))))


def cover_class(title: Column) -> Column:
    return F.concat(F.lit("library-cover-c"), (_rolled(F.coalesce(title, F.lit("")), 0, 31) % 6).cast("string"))


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def clamp(c: Column, lo: float | Column, hi: float | Column) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.least(F.greatest(c, lo), hi)


def map_range(c: Column, a: float, b: float, to_a: float, to_b: float) -> Column:
    return F.lit(to_a) + (c - a) / (b - a) * (to_b - to_a)


def approx_duration(ms: Column) -> Column:
    seconds = js_round(ms / 1000)
    minutes = js_round(seconds / 60)
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" 小时 "), (minutes % 60).cast("string"), F.lit(" 分钟"))
    return F.when(seconds < 60, F.concat(F.greatest(F.lit(1), seconds).cast("string"), F.lit(" 秒"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" 分钟"))).otherwise(hours)


def quick_point_label(point: Column, total: Column) -> Column:
    n = total.cast("string")
    percent = js_round(point / F.greatest(F.lit(1), total - 1) * 100)
    middle = F.concat(percent.cast("string"), F.lit("% · "), (point + 1).cast("string"), F.lit("/"), n)
    return F.when(point == 0, F.concat(F.lit("开头 1/"), n)).when(point == total - 1, F.concat(F.lit("结尾 "), n, F.lit("/"), n)).otherwise(middle)


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def section_label(number: Column, total: Column, title: Column, preview: Column, paragraphs: Column) -> Column:
    prefix = F.when(total > 1, F.concat(F.lit("第 "), (number + 1).cast("string"), F.lit(" 章"))).otherwise("正文")
    detail = F.when((F.coalesce(preview, F.lit("")) != "") & (preview != title), F.concat(F.lit(" · "), preview)).otherwise("")
    return F.concat(prefix, F.lit(" · "), title, detail, F.lit(" · "), paragraphs.cast("string"), F.lit(" 段"))


def fade_volume(now_ms: Column, ends_at_ms: Column) -> Column:
    left = ends_at_ms - now_ms
    return F.when(ends_at_ms.isNull() | (left >= FADE_MS), F.lit(1.0)).otherwise(clamp(left / FADE_MS, FADE_FLOOR, 1.0))


def speech_request(request: Column) -> Column:
    """``struct<text, voice, lang, rate, pitch, error_code>`` of a request in JSON: trimmed, with defaults for what is missing or zero."""
    r = F.from_json(request, "text string, voice string, lang string, rate string, pitch string")
    text = T.js_trim(F.coalesce(r.text, F.lit("")))
    number = lambda c: F.coalesce(F.nullif(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    lang = F.coalesce(F.nullif(T.js_trim(F.coalesce(r.lang, F.lit(""))), F.lit("")), F.lit("en-US"))
    voice = T.js_trim(F.coalesce(r.voice, F.lit("")))
    return F.struct(text.alias("text"), voice.alias("voice"), lang.alias("lang"), number(r.rate).alias("rate"), number(r.pitch).alias("pitch"), validate_request(r.text).alias("error_code"))


def validate_request(text: Column, limit: int = SPEECH_CHARS_LIMIT) -> Column:
    """Error code of a synthesis request, or null."""
    t = T.js_trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", "empty_text").when(F.length(t) > limit, "text_too_long")


def gray_contrast(r: Column, g: Column, b: Column) -> Column:
    luma = r * 0.299 + g * 0.587 + b * 0.114
    return clamp((luma - 128) * 1.12 + 128, 0.0, 255.0)


def speech_ms_per_char(ewma: Column, text: Column, rate: Column) -> Column:
    base = F.when(T.detect_lang(F.coalesce(text, F.lit(""))).startswith("zh"), 200.0).otherwise(65.0) / clamp(rate, *RATE_RANGE)
    return F.when(ewma > 0, ewma).otherwise(base)


def score_voice(lang: Column, name: Column, is_default: Column, is_local: Column, source: Column, locale: str = "zh-CN") -> Column:
    bucket, low = voice_bucket(lang), F.lower(F.coalesce(name, F.lit("")))
    any_of = lambda names: reduce(lambda a, b: a | b, [low.contains(x) for x in names])
    score = F.when(voice_base(lang) == locale.lower().split("-")[0], 32).otherwise(0)
    for i, b in enumerate(PRIORITY_BUCKETS):
        score = F.when(bucket == b, 130 - 8 * i).otherwise(score)
    parts = [(is_default, 18), (is_local, 10), (source == "neural-pack", 220), ((bucket == "zh-cn") & any_of(PREFERRED_CHINESE), 40), (bucket.startswith("en-") & any_of(PREFERRED_ENGLISH), 22), (low.contains("natural"), 8), (low.contains("neural"), 6)]
    return reduce(lambda s, p: s + F.when(p[0], p[1]).otherwise(0), parts, score)


def score_space_name(name: Column) -> Column:
    return F.when(name.rlike("zipvoice"), 0).when(name.rlike("aishell"), 5).when(name.rlike("kokoro"), 4).when(name.rlike("vits|matcha|melo"), 3).otherwise(2)


def is_candidate_space(name: Column) -> Column:
    return name.rlike("tts|text-to-speech") & name.rlike("wasm|web-assembly|webassembly") & name.rlike("zh|chinese|aishell|melo|kokoro|cantonese|zipvoice")
