"""Operators that judge each row alone: URL filter, BPE, HTML, licenses."""

import hashlib
import time

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import bpe, html, licenses, urls

TEXTS = ["Hello, world's  best\n\n day", "", None, "naïve 日本語 🙂🙂 \u0085 \u2028x", "a" * 5000, "don't 123  456   <|endoftext|>", "Hello, world's  best\n\n day"]


def _reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary()[0]), special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.digests(docs, *bpe.vocabulary()).collect()}
    want = _reference()
    for i, t in enumerate(TEXTS):
        ids = want.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), *bpe.vocabulary()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_codec_equals_tiktoken(text):
    c = bpe.codec(*bpe.vocabulary())
    import numpy as np

    ids = np.frombuffer(c.encode([text])[0], np.int32).tolist()
    assert ids == _reference_once().encode_ordinary(text)
    assert c.decode(ids).decode() == text
    assert "".join(c.decode_pieces(ids)) == text
    spans = c.spans(text)
    assert [i for i, _, _ in spans] == ids and all(0 <= a < b <= len(text) for _, a, b in spans)
    assert not text or (spans[0][1], spans[-1][2]) == (0, len(text))
    assert all(a == x or c.bytes[i][0] & 0xC0 == 0x80 for (i, a, _), (_, _, x) in zip(spans[1:], spans, strict=False))  # only a split character belongs to two


def test_codec_keeps_what_is_common(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    c = bpe.Codec(*bpe.vocabulary())
    for text in ("the cat sat on the mat", "x" * 60 + " the cat", "one two three four five six seven", ""):
        (n, ids, raw), _ = c.digests([text, "the cat"])
        want = _reference_once().encode_ordinary(text)
        assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()) and raw == hashlib.sha256(text.encode()).hexdigest()
        assert len(c.pieces) <= 10 and "x" * 60 not in c.pieces


_kept = []


def _reference_once():
    if not _kept:
        _kept.append(_reference())
    return _kept[0]


def test_bpe_spans_and_pieces(spark):
    docs = spark.createDataFrame([("é🙂 ok",), (None,)], "text string")
    path, pattern = bpe.vocabulary()
    rows = docs.select(bpe.encode_spans(F.col("text"), path, pattern).alias("s")).select("s", bpe.decode_pieces(F.col("s.id"), path, pattern).alias("p")).collect()
    assert "".join(rows[0].p) == "é🙂 ok" and rows[0].s[-1].stop == 5 and rows[1].p == []


URLS = ["http://x.org/a", "https://A.Example.org/es/1", "http://example.org/en/17?x", "http://q.com/fr/", "http://com/de/x", "nothing", None, "http://casino.example.net/", "http://free-bets.net/a", "http://freebets.net/", "http://cheap.net/buy-this", "", "http://x.org", "http://h#f://g/"]


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r.page_id: r.j for r in pages.select("page_id", urls.judge(pages).alias("j")).collect()}
    assert [got[i].verdict for i in range(len(URLS))] == ["allow", "block", "block", "allow", "block", "allow", "allow", "block", "block", "allow", "block", "allow", "allow", "allow"]
    assert [got[i].rule for i in range(6)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None]
    assert (got[1].host, got[1].path) == ("a.example.org", "/es/1") and (got[6].host, got[6].path) == ("", "")
    assert (got[12].host, got[12].path, got[12].rule) == ("x.org", "", None) and got[13].host == "h"


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><a href=x>Home</a></header><div id="cookie-notice">We use cookies</div>
<div class="wrap"><main><div class="post-{n}"><h1>Hello &amp; bye</h1><p>One <b>bold</b>text<p>Two <a href=q>link</a> and so on, at some length<br>here
<ul><li>a<li>b</ul><form><input>Mail me</form><div class="ad">buy</div></div><section id="comments"><p>nice post!</p></section></main>
<aside><p>Related things to read</p></aside></div><footer>c</footer><script>var x = "</p>";</script></body></html>"""


def test_html_main_text(spark):
    rows = [(i, f"http://h/{i}", PAGE.replace("{n}", str(i)), "t") for i in range(6)] + [(6, None, None, "t"), (7, "http://h/7", "", "t"), (8, "http://h/8", "<p>only this &copy; page", "t"), (8, "http://h/8", "<p>only this &copy; page", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, paths string")
    got = [(r.page_id, r.main_text) for r in html.with_main_text(pages).collect()]
    assert len(got) == len(rows)
    want = "Hello & bye\n\nOne boldtext\n\nTwo link and so on, at some length here\n\na\n\nb"
    assert {t for i, t in got if i < 6} == {want} and {t for i, t in got if i in (6, 7)} == {""} and {t for i, t in got if i == 8} == {"only this © page"}
    assert html.winning_paths(pages).filter("host = 'h'").first().paths[0] == ">div.wrap>main>div.post-#"
    assert html.with_main_text(pages.limit(0)).count() == 0


def test_html_fallback_and_broken_markup():
    assert html.extract("<article><p>a < b &am", []) == "a < b &am"
    assert html.extract("<div class='x'><p>text", [">article"]) == "text"
    assert html.extract("<!-- open <p>gone", []) == ""
    assert len(html.extract("<p>" + "word " * 200_000, [])) == 999_999


LICENSED = ["Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0. cc by", None, "", "plain text", "The MIT-License! mit license", "SPDX-License-Identifier: mpl-2.0", "GNU\nGeneral   Public License, version 3"]


def test_license_scan_against_counting(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(LICENSED)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.digests(docs).collect()}
    import re

    for i, t in enumerate(LICENSED):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = sorted((k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert got[0].labels == "apache,apache-2.0" and got[1].labels == "cc-by,cc-by-nc-4.0" and got[6].labels == "mpl-2.0" and "gpl-3.0" in got[7].labels and got[4].score == 0


def test_rules_are_hundreds_and_contained_ones_are_dropped():
    assert len(licenses.rules()) > 300 and len(licenses.FAMILIES) + len(licenses.SENTENCES) > 150
    found = licenses.scanner(()).detections(*[b"licensed under the gnu general public license version 2"] * 2)
    assert [r.label for r, _, _ in found] == ["gpl-2.0"]


FORMS = {
    "Apache-2.0": "apache-2.0",
    "under BSD-3-Clause.": "bsd-3-clause",
    "BSD 3-Clause": "bsd-3-clause",
    "GPLv2+": "gpl-2.0",
    "GPL v3 or LGPLv2.1+": "gpl-3.0,lgpl-2.1",
    "AGPLv3": "agpl-3.0",
    "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0",
    "SPDX-License-Identifier: (LGPL-2.1-or-later OR MPL-2.0)": "lgpl-2.1,mpl-2.0",
    "Apache-2.0.1": "",
    "GPLv20": "",
    "xGPLv2": "",
    "MPL-2.0-like": "",
}


@pytest.mark.parametrize("text", FORMS)
def test_short_forms(text):
    low = text.encode().translate(licenses.LOWER)
    words = b" " + b" ".join(text.encode().translate(licenses.LOWER_WORDS).split()) + b" "
    assert ",".join(sorted({r.label for r, _, _ in licenses.scanner(()).detections(low, words)})) == FORMS[text]


def test_blanks_take_time_in_proportion_and_spans_count_them():
    text = b"gpl" + b" " * 1_000_000 + b"licensed \t\n under the  mit\r\nlicense."
    began = time.time()
    found = licenses.scanner(()).detections(text, b" gpl licensed under the mit license ")
    assert [text[a:b].split() for _, a, b in found] == [b"licensed under the mit license".split()] and time.time() - began < 5


@pytest.mark.parametrize("text", ["mit license " * 3, ("x " * 50_000) + "mit license"])
def test_base_places(text):
    words = text.split()
    base = licenses.scanner(tuple(licenses.BASE_PHRASES.items())).base(b" " + " ".join(words).encode() + b" ")
    assert [w for _, w in base] == [i for i in range(len(words) - 1) if words[i : i + 2] == ["mit", "license"]]


def _text(n, word):
    return f"<p>{word * n}</p>"


def test_html_keeps_all_parts_of_an_article(spark):
    split = [
        f'<div class="content"><section class="intro">{_text(300, "a")}</section><section class="details">{_text(700, "b")}</section></div>',
        f'<article><div class="body"><section class="a">{_text(400, "a")}</section><section class="b">{_text(600, "b")}</section></div></article>',
        f'<div class="x"><div class="y"><section class="a">{_text(900, "a")}</section></div><section class="b">{_text(100, "b")}</section></div>',
    ]
    noise = '<nav>menu</nav>{}<div class="sidebar">more</div><div class="links"><a href="/x">a link that is long enough to count</a></div>'
    rows = [(k * 10 + i, f"http://h{k}/{i}", noise.format(x)) for k, x in enumerate(split) for i in range(3)]
    got = html.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 9 and all({"a", "b"} == set(r.main_text.replace("\n", "")) for r in got)


def test_html_combines_winning_paths():
    page = f'<div class="lead">{_text(50, "a")}</div><div class="story">{_text(90, "b")}</div><div class="other">{_text(20, "c")}</div>'
    assert set(html.extract(page, [">div.story", ">div.lead"])) == {"a", "b", "\n"}
    # The body is where pages of another layout keep their text.
    assert set(html.extract(page, [">div.story", ""])) == {"a", "b", "c", "\n"}
    inside = f'<article>{_text(90, "a")}</article><div class="y">{_text(9, "b")}</div>'
    assert set(html.extract(inside, [">article", ""])) == {"a"} and set(html.extract(inside, ["", ">article"])) == {"a"}


MARKUP = {
    '<span class="ad">x <span>y</span> leak</span> kept': ["kept"],
    '<head><script>var a = "<body x>";</script><title>t</title><body><p>one': ["one"],
    "<head><meta x><p>body": ["body"],
    "<p>one</p><select><option>a<p>two</p>": ["one", "two"],
    '<p class="share-of-market">m<div class="search-history">s</div><div class="ad-box">no</div>': ["m", "s"],
    '<article><div class="share-of-market">x</div><div class="share-buttons">no</div><b class="hidden">no</b> yes</article>': ["x", "yes"],
    "<svg><text>no</text><p>yes</p>": ["yes"],
    '<p>a<svg><path d="x"/><g></svg>b</p>': ["a", "b"],
    "<svg/><p>yes": ["yes"],
    "<script src=x />no</script><p>yes": ["yes"],
    "<object>no<p>no</p></object>yes": ["yes"],
    "<p>a<button>no <b>no</b></button> b": ["a", "b"],
    "<p>a <label>no</label><output>no</output>b</p><fieldset><legend>no</legend></fieldset>": ["a", "b"],
    '<div class="sidebar-content">no</div><div id="nav2"><p>no</p></div><p>yes': ["yes"],
}


@pytest.mark.parametrize("page", MARKUP)
def test_html_markup(page):
    assert [b.text for b in html.parse(page)[1]] == MARKUP[page]


def test_html_against_a_parser_of_its_own(spark):
    """The blocks of whole pages against the standard library's tag reader with a plain stack."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.blocks, self.buffer = [], [], ""

        def block(self):
            text = " ".join(self.buffer.split())
            if text and not any(hidden for _, hidden in self.open):
                self.blocks.append(text)
            self.buffer = ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.buffer += " "
            if tag in html.BLOCKS or tag in ("script", "style", "title"):
                self.block()
                if tag == "p" and self.open and self.open[-1][0] == "p":
                    self.open.pop()
                values = {k: v or "" for k, v in attrs}
                self.open.append((tag, tag in ("script", "style", "title") or html._outside(tag, values, any(x in ("main", "article") for x, _ in self.open))))

        def handle_endtag(self, tag):
            if tag in (x for x, _ in self.open):
                self.block()
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            self.buffer += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    same = 0
    for r in pages:
        plain = Plain()
        plain.feed(r.html or "")
        plain.block()
        same += sorted(" ".join(plain.blocks).split()) == sorted(" ".join(b.text for b in html.parse(r.html or "")[1]).split())
    assert same >= 0.98 * len(pages)


def _all_hits(text):
    """Every rule's matches behind its keyword, and what is left of them by comparing each with all before it."""
    import re

    words = b" " + b" ".join(text.encode().translate(licenses.LOWER_WORDS).split()) + b" "
    hits = []
    for r, p in licenses.scanner(()).rules:
        if b" ".join(r.keyword.translate(licenses.LOWER_WORDS).split()) in words:
            hits += [(r, m.start(), m.end()) for m in p.finditer(re.sub(rb"[\t\n\r\x0b\x0c]", b" ", text.encode()))]
    hits.sort(key=lambda h: (h[0].priority, h[1] - h[2], h[1], h[0].name))
    taken = []
    for r, a, b in hits:
        if not any(x <= a and b <= y for _, x, y in taken):
            taken.append((r, a, b))
    return sorted(taken, key=lambda h: (h[1], h[2]))


def test_detections_equal_comparing_all(spark):
    import random

    rng = random.Random(6)
    parts = ["licensed under the mit license", "the apache license, version 2.0", "gnu general public license version 3", "lesser general public license version 2.1", "all rights reserved", "spdx-license-identifier: mit", "license: bsd-3-clause", "either version 2 of the license, or (at your option) any later version", "creative commons attribution 4.0", "and so on", "this software is provided 'as-is', without any express or implied warranty"]
    for _ in range(60):
        text = rng.choice([" ", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        words = b" " + b" ".join(text.encode().translate(licenses.LOWER_WORDS).split()) + b" "
        assert licenses.scanner(()).detections(text.encode().translate(licenses.LOWER), words) == _all_hits(text)
    assert licenses.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_detections_take_time_in_proportion():
    import time

    def seconds(n):
        text = b"mit license all rights reserved " * n
        began = time.process_time()
        s = licenses.scanner(tuple(licenses.BASE_PHRASES.items()))
        assert len(s.detections(text, b" " + text)) >= 2 * n and len(s.base(b" " + text)) == n
        return time.process_time() - began

    seconds(100)
    assert seconds(50_000) < 40 * seconds(5_000)
