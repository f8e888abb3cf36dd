"""Line repair, merging of spine items, units of sentences, pitch and speakers."""

import math

from pyspark.sql import functions as F

from quire.operators import media as M
from quire.operators import sections as X
from quire.operators import segments as G
from quire.operators.repair import repair_line_breaks


def test_repair(spark):
    text = "The ferry car-\nried letters and par-\ncels to the far bank .\n\nRiver post number 12 of 30\nIt came each Monday at noon, even in the rain.\n\n 57 \n\nRiver post number 13 of 31\nNobody waited for it at night."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x")], "doc_id long, text string").withColumn("line", F.lit(1))
    got = {r.doc_id: r.text for r in repair_line_breaks(docs).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == got[3] == ""
    assert "carried letters and parcels to the far bank." in got[1] and "Nobody waited for it at night." in got[1]
    assert "57" not in got[1] and "River post" not in got[1] and "\n\n\n" not in got[1]
    assert repair_line_breaks(docs.limit(0)).count() == 0


def test_spine(spark):
    long, short = "a" * 800 + "。", "b" * 100 + "。"
    rows = [
        ("x", 0, "Start", "One", long), ("x", 1, "Other", "One", short), ("x", 2, "Next", "Two", short), ("x", 3, "", "", long * 4), ("x", 4, "Late", "", short),
        ("y", 0, None, None, "One\n" + short), ("y", 1, "Named", None, short), ("y", 2, "Empty", None, " "),
        *(("z", i, "Same", None, short) for i in range(12)),
    ]
    spine = spark.createDataFrame(rows, "doc_id string, spine_index int, title string, toc_title string, text string")
    got = {(r.doc_id, r.section_no): (r.title, r.source_hint) for r in X.merge_spine_sections(spine).collect()}
    assert got[("x", 1)] == ("One", "EPUB spine 0 - 1") and got[("x", 2)] == ("Two", "EPUB spine 2 - 3") and got[("x", 3)] == ("Late", "EPUB spine 4")
    assert got[("y", 1)] == ("Named", "EPUB spine 0 - 1") and got[("z", 1)] == ("Same", "EPUB spine 0 - 9") and got[("z", 2)] == ("Same", "EPUB spine 10 - 11")
    assert len(got) == 6


def test_units_of_sentences(spark):
    units = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 1)], "doc_id int, unit_no int, first int, size int")
    sentences = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 0)], "doc_id int, sentence_no int")
    got = {(r.doc_id, r.sentence_no): r.unit_no for r in G.unit_of_sentence(units, sentences, "doc_id").collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): None, (2, 0): None}


def test_pitch_and_speakers(spark):
    wave = lambda hz, n=4800: [0.2 * math.sin(2 * math.pi * hz * i / 16000) for i in range(n)]
    clips = spark.createDataFrame([(1, 16000, wave(200)), (2, 16000, [0.0] * 4800), (3, 16000, wave(100)), (4, 16000, []), (5, 16000, None)], "clip_id int, sample_rate int, samples array<float>")
    got = {r.clip_id: (r.pitch, r.voiced) for r in M.pitch(clips).collect()}
    assert abs(got[1][0] - 200) < 2 and got[1][1] == 1 and abs(got[3][0] - 100) < 2 and got[2] == got[4] == got[5] == (0, 0)
    rows = spark.createDataFrame([("p", i, float(x), 0.1) for i, x in enumerate([90, 300, 160, 120, 250, 164, 0])] + [("p", 9, 80.0, 0.0)] + [("q", i, 0.0, 0.1) for i in range(9)], "pack string, sid int, pitch double, rms double")
    picked = {(r.pack, r.id): r.sid for r in M.pick_speakers(rows, "pack").collect()}
    assert picked == {("p", "male-1"): 0, ("p", "male-2"): 3, ("p", "female-1"): 1, ("p", "female-2"): 4, ("q", "voice-1"): 0, ("q", "voice-2"): 3, ("q", "voice-3"): 6, ("q", "voice-4"): 8}


def test_sections_of_boilerplate_go(spark):
    """A raw section of rights and one of contents go; a book that would lose all keeps all."""
    body = "The ferry crossed the river twice a day, and the bell rang for it. " * 12
    rows = [
        (1, 1, "Copyright", "Copyright 2020 by the ferry house\nAll rights reserved.\nISBN 978-1-00-000000-0", "a"),
        (1, 2, "Chapter 1 The Ferry", body, "b"), (1, 3, "Chapter 2 The Bell", body, "c"),
        (2, 1, "Copyright", "Copyright 2020 by the ferry house\nAll rights reserved.", "a"),
    ]
    raw = spark.createDataFrame(rows, "doc_id int, section_no int, title string, text string, source_hint string")
    stats = X.section_line_stats(raw.select("doc_id", "section_no", F.explode(F.split("text", "\n")).alias("line")), "doc_id", "section_no")
    assert {(r.doc_id, r.section_no) for r in X.drop_sections(raw, stats).collect()} == {(1, 2), (1, 3), (2, 1)}
    final = X.normalize_sections(raw.filter("doc_id = 1")).orderBy("section_no").collect()
    assert [r.id for r in final] == [f"section-{i + 1}" for i in range(len(final))] and final and all(r.paragraphs and r.paragraph_count >= 1 and r.preview for r in final)
    assert "All rights" not in "".join(r.text for r in final) and sum(len(r.text) for r in final) > 1.5 * len(body)
