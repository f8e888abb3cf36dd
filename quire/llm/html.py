"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text that stands in them outside links. From the best one the
page goes up to the ancestor that holds the article's other parts, and votes for its generalised path,
tags with their classes from the body down. Spark counts the votes of each host; pages are then read
again, and the text of the containers on all of the host's winning paths is kept.

Defined results: null and empty html has an empty text; a page on which no winning path occurs, or
whose containers there are empty, falls back to its own path; pages without a host vote
together as one; equal votes go to the path that sorts first; repeated rows each get their own text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.decontaminate import checked
from quire.llm.store import bound_batches, keep, table
from quire.llm.text import chunks, texts_of
from quire.llm.urls import split_url

#: A path wins with this share of its host's votes.
LEAST_SHARE = 0.2

#: Elements whose content is raw up to their own end tag.
RAW = "script style iframe title textarea noembed noframes xmp"
#: Elements that hold no text of the page.
SILENT = set("noscript template object svg math canvas audio video select datalist head".split())
#: What a head can hold; any other element ends it. A block inside these others ends them.
IN_HEAD, BROKEN_OFF = set("head base basefont bgsound link meta noscript template".split()), {"svg", "math", "select"}
#: Elements that are never part of an article.
OUTSIDE = set("nav footer aside form menu dialog button fieldset label legend output progress meter".split())
ROLES = set("navigation banner contentinfo search complementary dialog alert alertdialog menu menubar form".split())
#: Words of a class or id that name something outside the article.
NAMES_OUTSIDE = set(
    "ad ads adbox adslot advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer disqus dropdown footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination "
    "popup privacy promo promoted promotion recommended related reply replies respond responses rail search share sharing sidebar signup skip social sponsor sponsored sponsors "
    "subscribe subscription taboola teaser toolbar topbar widget widgets".split()
)
#: Words that say nothing beside those.
NAMES_PLAIN = set(
    "a an area articles bar block body bottom box btn button buttons center col column container content feed field foot form group head header heading home icon icons id inner input item items "
    "js large left line link links list logo main media medium menu message mobile module more news nav navigation new outer page panel post posts right row section site small "
    "stories story sub tab tabs text the title top ui unit view wrap wrapper".split()
)
#: Words that name the article itself; they overrule the others.
NAMES_INSIDE = set("article body content entry main post story text".split())
#: Elements that end a run of text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold text for the container around them.
LEAVES = set("p h1 h2 h3 h4 h5 h6 pre li dt dd blockquote figcaption caption ul ol dl summary center address".split())
#: An element that starts ends an open one of these.
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dd", {"dl"}), "dd": ("dt", {"dl"}), "tr": ("tr", {"table"}), "td": ("td", {"tr", "table"}), "th": ("th", {"tr", "table"})}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW.replace(' ', '|')})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?][^>]*>|<[/!?]?[a-z][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Container(NamedTuple):
    parent: int
    tag: str
    path: str


class Block(NamedTuple):
    container: int
    text: str
    linked: int


def _names(value: str) -> list[str]:
    """Words of a class or id."""
    return [x for x in re.split(r"[\W\d_]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if x]


def _all_outside(value: str) -> bool:
    """Whether a class or id has a word for something outside the article, and no word that says something else."""
    names = _names(value)
    return any(x in NAMES_OUTSIDE for x in names) and all(x in NAMES_OUTSIDE or x in NAMES_PLAIN or x in NAMES_INSIDE or len(x) == 1 for x in names)


def _outside(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if tag in OUTSIDE or tag in SILENT or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag == "header":
        return not inside_article
    if tag in ("html", "body", "main", "article"):
        return False
    values = [*attrs.get("class", "").split(), attrs.get("id", "")]
    names = {x for v in values for x in _names(v)}
    if not names & NAMES_OUTSIDE or (names & NAMES_INSIDE and not names & {"comment", "comments", "ad", "ads", "sidebar", "footer", "nav", "menu", "header", "related", "share"}):
        return False
    return any(map(_all_outside, values))


def _step(tag: str, attrs: dict[str, str]) -> str:
    """Tag and classes of one element, digits made alike."""
    classes = sorted(set(re.sub(r"\d+", "#", attrs.get("class", "")).lower().split()))
    return ".".join([tag, *classes])


def parse(html: str) -> tuple[list[Container], list[Block]]:
    """Containers and, in page order, the blocks of text outside boilerplate."""
    containers, blocks = [Container(-1, "body", "")], []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container, outside
    buffer: list[str] = []
    linked, in_link, articles, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
            if text and not stack[-1][2]:
                blocks.append(Block(stack[-1][1], text, linked))
            buffer.clear()
        linked = 0

    def close(tag: str, stop: set[str] = frozenset()) -> None:
        nonlocal articles
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                articles -= sum(x[0] in ("article", "main") for x in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            buffer.append(html[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = 0 if m["end"] else 1
        elif tag == "br":
            buffer.append(" ")
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            flush()
            stack.pop()
        if tag not in BLOCKS:
            # An inline element can be hidden or an advert too; inside one, all are kept track of.
            hidden = stack[-1][0] not in BLOCKS and len(stack) > 1
            if m["end"]:
                if hidden:
                    flush()
                    close(tag, BLOCKS)
            elif tag in VOID or (m["attrs"].endswith("/") and (tag in BROKEN_OFF or any(x[0] in ("svg", "math") for x in stack))):
                pass
            elif hidden:
                stack.append((tag, stack[-1][1], True))
            elif tag in SILENT or tag in OUTSIDE or (m["attrs"] and tag != "a" and re.search(r"class|id|hidden|role|style", m["attrs"])):
                attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m["attrs"])}
                if _outside(tag, attrs, articles > 0):
                    flush()
                    stack.append((tag, stack[-1][1], True))
            continue
        flush()
        if not m["end"] and tag != "option":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in BROKEN_OFF:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS - {"option"}:
                    break
        if m["end"]:
            close(tag, {"td", "th", "table"} - {tag} if tag != "body" and tag != "html" else frozenset())
            continue
        if tag in CLOSES:
            other, stop = CLOSES[tag]
            close("p", BLOCKS - {"p"})
            close(tag, stop)
            if other != tag:
                close(other, stop)
        elif stack[-1][0] == "p":
            stack.pop()
        if tag in VOID or tag in ("html", "body"):
            continue
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m["attrs"])} if m["attrs"] else {}
        _, inside, outside = stack[-1]
        if tag not in LEAVES:
            containers.append(Container(inside, tag, f"{containers[inside].path}>{_step(tag, attrs)}"))
            inside = len(containers) - 1
        stack.append((tag, inside, outside or _outside(tag, attrs, articles > 0)))
        articles += tag in ("article", "main")
    if at < len(html):
        buffer.append(html[at:])
    flush()
    return containers, blocks


def best(containers: list[Container], blocks: list[Block]) -> str | None:
    """Path of the container that scores best with the parts beside it, or None where there is no text."""
    scores = [0.0] * len(containers)
    for b in blocks:
        worth = max(0.0, len(b.text) - 2.0 * b.linked) + 1
        c, share = b.container, 1.0
        while c >= 0 and share > 0.1:
            scores[c] += worth * share
            c, share = containers[c].parent, share / 2
    if not any(scores):
        return None
    weight = {"article": 1.6, "main": 1.3}
    scores = [s * weight.get(c.tag, 1.0) * (1.25 if re.search(r"content|article|post|entry|story", c.path.rpartition(">")[2]) else 1.0) * (0.7 if not i else 1.0) for i, (s, c) in enumerate(zip(scores, containers, strict=True))]
    return _whole(containers, blocks, max(range(len(scores)), key=lambda i: (scores[i], -i)))


def _within(containers: list[Container], top: Callable[[int], bool]) -> list[bool]:
    """Which containers are, or are inside, one that is ``top``."""
    out = [False] * len(containers)
    for i, c in enumerate(containers):  # parents come before their children
        out[i] = top(i) or (c.parent >= 0 and out[c.parent])
    return out


def _whole(containers: list[Container], blocks: list[Block], at: int) -> str:
    """Path of the nearest ancestor of ``at``, or of itself, beside whose path no more text stands outside links.

    ``main`` holds all of the article, and so does an ``article`` that has no other beside it.
    """
    texts = {b.container for b in blocks if len(b.text) > 2 * b.linked}
    path = containers[at].path
    covered = _within(containers, lambda i: containers[i].path == path)
    while at > 0 and not all(covered[i] for i in texts):
        c = containers[at]
        if c.tag == "main" or (c.tag == "article" and sum(x.parent == c.parent and x.tag == "article" for x in containers) < 2):
            break
        at = up = c.parent
        inside = _within(containers, lambda i, up=up: i == up)
        if any(inside[i] and not covered[i] for i in texts):
            path = containers[at].path
            covered = _within(containers, lambda i, path=path: containers[i].path == path)
    return path


def extract(html: str, paths: list[str]) -> str:
    """Text of the containers on all of ``paths``, else of the page's best one.

    The page's own path goes before the others. A path that only leads to one before it stands for
    pages of another layout and is left out.
    """
    containers, blocks = parse(html)
    own = best(containers, blocks)
    filled = {b.container for b in blocks}
    kept: list[str] = []
    for path in sorted(paths, key=lambda p: p != own):
        on_path = _within(containers, lambda i, path=path: containers[i].path == path)
        if any(on_path[i] for i in filled) and not any(k.startswith(f"{path}>") for k in kept):
            kept.append(path)
    within = _within(containers, lambda i: containers[i].path in (kept or [own]))
    return "\n\n".join(b.text for b in blocks if within[b.container])


@F.arrow_udf(T.StringType())
def best_path(html: pa.Array) -> pa.Array:
    """Path that a page votes for."""
    return pa.array([best(*parse(t)) if t else None for run in chunks(html) for t in run], pa.string())


@F.arrow_udf(T.StringType())
def extracted(html: pa.Array, paths: pa.Array) -> pa.Array:
    """Text of each page by the winning paths of its host."""
    return pa.array([extract(t or "", p or []) for t, p in texts_of(html, paths)], pa.string())


def winning_paths(pages: DataFrame, html: str = "html", url: str = "url", least_share: float = LEAST_SHARE) -> DataFrame:
    """``host, paths``: each host's paths with at least ``least_share`` of its votes, best first."""
    votes = pages.select(split_url(pages[url])[0].alias("host"), best_path(pages[html]).alias("path")).groupBy("host", "path").count()
    # Pages without a path are left out here: a filter before would be pushed down, and every page parsed twice for it.
    cast = F.sum(F.when(F.col("path").isNotNull(), F.col("count"))).over(W.partitionBy("host"))
    shares = votes.withColumn("share", F.col("count") / cast).filter(F.col("path").isNotNull() & (F.col("share") >= least_share))
    return shares.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "path"))), lambda x: x.path).alias("paths"))


def with_main_text(pages: DataFrame, html: str = "html", url: str = "url", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text in column ``out``."""
    bound_batches(pages.sparkSession)
    winners = keep(winning_paths(pages, html, url).select(F.col("host").alias("__host"), F.col("paths").alias("__paths")), "winning_paths")
    hosted = pages.withColumn("__host", split_url(pages[url])[0])
    return hosted.join(checked(winners), "__host", "left").withColumn(out, extracted(F.col(html), F.col("__paths"))).drop("__host", "__paths")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
