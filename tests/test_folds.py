"""Folds over books against plain loops, on random books."""

import random
import re

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import sections as X

BOOKS = 200


def strong(text):
    return bool(re.search(r"[。！？!?…][\"”’')\]]*\Z", text))


def heading(line):
    """Known from how the texts below are made."""
    return line.startswith("Chapter ")


def flowed(parts):
    """Parts as running text: a break after a strong end and around headings, else a bridge."""
    out = ""
    for part in filter(None, (p.strip() for p in parts)):
        if not out:
            out = part
        elif strong(out) or (heading(out.split("\n")[-1]) and len(out.split("\n")[-1]) <= 42) or heading(part.split("\n")[0]):
            out += "\n\n" + part
        else:
            spaced = re.match(r"[A-Za-z0-9]", part) and re.search(r"[A-Za-z0-9](?:[.!?;:,][\"”’')\]]*)?\Z", out)
            out += (" " if spaced else "") + part
    return out


def body(rng, longest):
    n = rng.choice((1, 3)) if rng.random() < 0.1 else rng.randrange(5, longest)
    words = [rng.choice(("stone", "river", "lamp", "字", "path", "12", "雪")) for _ in range(n)]
    return " ".join(words) + rng.choice((".", "!", "?”", "", ",", "。", "…"))


def pages_of(rng):
    out = []
    for _ in range(rng.randrange(1, 26)):
        text = body(rng, rng.choice((40, 700)))
        head = f"Chapter {rng.randrange(1, 30)} {rng.choice(('Gate', 'A Road', ''))}".strip() if rng.random() < 0.12 else None
        text = "" if rng.random() < 0.06 else text
        out.append((head, f"{head}\n{text}".strip() if head else text, rng.random() < 0.3))
    return out


def test_sections_by_pages(spark):
    rng = random.Random(12)
    books = {b: pages_of(rng) for b in range(BOOKS)}
    rows = [(b, n, text, ocr) for b, pages in books.items() for n, (_, text, ocr) in enumerate(pages, 1)]
    rng.shuffle(rows)
    got = {}
    for r in X.split_sections_by_pages(spark.createDataFrame(rows, "doc_id int, page_number int, text string, ocr_used boolean")).collect():
        got.setdefault(r.doc_id, []).append((r.section_no, r.title, r.text, r.source_hint))
    for b, pages in books.items():
        groups = []
        for n, (head, text, ocr) in enumerate(pages, 1):
            if groups:
                so_far, many = flowed(t for _, _, t, _ in groups[-1]), len(groups[-1])
                full = len(so_far) > 5200 or many >= 7 or (strong(so_far) and (len(so_far) > 2600 or many >= 4))
            if not groups or head or full:
                groups.append([])
            groups[-1].append((n, head, text, ocr))
        want = []
        for g in groups:
            if whole := flowed(t for _, _, t, _ in g):
                scanned = sum(o for *_, o in g)
                want.append((len(want) + 1, g[0][1] or f"PDF 分段 {len(want) + 1}", whole, f"第 {g[0][0]} - {g[-1][0]} 页" + (f" · OCR {scanned} 页" if scanned else "")))
        assert sorted(got.get(b, [])) == want


TITLES = ["Chapter 3", "第十二章 起航", "桂花", "A long walk", "正文", "第3章", "", "序章", "Chapter 12 The Storm", "井水"]


def merged(rows, aggressive, generic, major):
    limit, out = 820 if aggressive else 360, []
    for title, text, hint in rows:
        if out:
            last = out[-1]
            small = len(last[1]) + len(text) <= 2200 and min(len(last[1]), len(text)) < limit
            if small and (aggressive or ((generic[last[0]] or generic[title]) and not (major[last[0]] and major[title]))):
                hints = last[2] if not hint or hint == last[2] else f"{last[2]} · {hint}" if last[2] else hint
                out[-1] = (title if generic[last[0]] and not generic[title] else last[0], flowed([last[1], text]), hints)
                continue
        out.append((title, text, hint))
    return out


def test_short_sections(spark):
    rng = random.Random(16)
    flags = {r.t: r for r in spark.createDataFrame([(t,) for t in TITLES], "t string").select("t", T.is_generic_title(F.col("t")).alias("generic"), T.is_major_title(F.col("t")).alias("major")).collect()}
    assert 2 <= sum(r.generic for r in flags.values()) < len(TITLES) and 1 <= sum(r.major for r in flags.values()) < len(TITLES)
    books = {b: [(rng.choice(TITLES), body(rng, rng.choice((20, 120, 500))), rng.choice(("a", "b", ""))) for _ in range(rng.randrange(121, 140) if b % 20 == 0 else rng.randrange(1, 30))] for b in range(BOOKS)}
    for kind, many in (("TXT", 120), ("EPUB", 60)):
        rows = [(b, n, *s) for b, sections in books.items() for n, s in enumerate(sections, 1)]
        rng.shuffle(rows)
        got = {}
        for r in X.merge_short_sections(spark.createDataFrame(rows, "doc_id int, section_no int, title string, text string, source_hint string"), format_=kind).collect():
            got.setdefault(r.doc_id, []).append((r.section_no, r.title, r.text, r.source_hint))
        for b, sections in books.items():
            want = merged(sections, len(sections) > many, {t: r.generic for t, r in flags.items()}, {t: r.major for t, r in flags.items()})
            assert sorted(got[b]) == [(n, *s) for n, s in enumerate(want, 1)]


def key_of(title):
    return re.sub(r"[^a-z0-9一-龥]", "", title.lower())


def test_merged_spine(spark):
    rng = random.Random(19)
    names = ["River", "The Gate", "桂花", "river!", ""]
    books = {b: [(rng.choice(names) if rng.random() < 0.5 else "", rng.choice(names), body(rng, rng.choice((30, 300, 900))) if rng.random() < 0.95 else "") for _ in range(rng.randrange(1, 30))] for b in range(BOOKS)}
    rows = [(b, n, toc or None, title, text) for b, items in books.items() for n, (toc, title, text) in enumerate(items)]
    rng.shuffle(rows)
    got = {}
    for r in X.merge_spine_sections(spark.createDataFrame(rows, "doc_id int, spine_index int, toc_title string, title string, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.section_no, r.title, r.text, r.source_hint))
    for b, items in books.items():
        groups = []
        for n, (toc, title, text) in enumerate(items):
            if not text:
                continue
            name = toc or title or f"章节 {max(1, len(groups))}"
            other = True
            if groups:
                g = groups[-1]
                length = len(flowed(g["texts"]))
                away = key_of(toc) != g["toc"] and length >= 780 if key_of(toc) else key_of(name) not in ("", g["called"]) and length >= 2600
                other = away or length >= 5400 or len(g["texts"]) >= 10
            if other:
                groups.append({"title": name, "toc": key_of(toc), "called": key_of(name), "texts": [text], "from": n, "to": n})
                continue
            if g["title"].startswith("章节 "):
                g.update(title=name, called=key_of(name) or g["called"], toc=key_of(toc) or g["toc"])
            g["texts"].append(text)
            g["to"] = n
        want = [(i, g["title"], flowed(g["texts"]), f"EPUB spine {g['from']}" + (f" - {g['to']}" if g["to"] != g["from"] else "")) for i, g in enumerate(groups, 1)]
        assert sorted(got.get(b, [])) == want
