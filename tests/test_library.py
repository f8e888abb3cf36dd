"""Library tables, backups, settings and voice packs on small fixtures."""

import json
import re
import shutil

import pytest
from pyspark.sql import functions as F

from quire.operators import library as B
from quire.operators import pages as P
from quire.operators.catalog import rank_candidates
from quire.sources import books, voices

BOOK = "id string, title string, rate double, sections array<struct<title:string,text:string>>"


def test_migration_and_backup_round_trip(spark, tmp_path):
    old = spark.createDataFrame([("a", "A", 1.7, [("s", "t")]), ("b", "B", 1.0, None)], BOOK)
    meta, contents = B.migrate_inline(old)
    assert {(r.id, r.section_count) for r in meta.collect()} == {("a", 1), ("b", 0)} and "sections" not in meta.columns
    assert [r.id for r in contents.collect()] == ["a"]
    path = str(tmp_path / "b")
    assert B.export_backup(meta, contents, path, settings='{"tone":"dark"}', app_version="2.0") == 2
    saved = []
    got = B.restore_backup(spark, path, BOOK, lambda books: saved.extend(books.collect()) or books)
    assert [(r.id, r.rate, r.sections[0].text) for r in saved] == [("a", 1.7, "t")]
    assert (got.restored, got.skipped, got.settings) == (1, 1, '{"tone":"dark"}') and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z", got.exported_at)
    about = json.loads(next((tmp_path / "b" / "v1" / "manifest").glob("*.json")).read_text())
    assert about == {"format": B.BACKUP_FORMAT, "version": 1, "appVersion": "2.0", "exportedAt": got.exported_at, "settings": '{"tone":"dark"}', "books": 2}


def test_half_written_and_strange_backups(spark, tmp_path):
    """A version without manifest is not read, an older whole one is; another format is refused."""
    book = spark.createDataFrame([("a", "A", 1.0, [("s", "t")]), (None, "N", 1.0, [("s", "t")]), ("", "E", 1.0, [("s", "t")])], BOOK)
    meta, contents = B.migrate_inline(book)
    path, keep = str(tmp_path / "b"), lambda books: spark.createDataFrame(books.collect(), books.schema)
    with pytest.raises(ValueError, match="no whole backup"):
        B.restore_backup(spark, path, BOOK, keep)
    B.export_backup(meta, contents, path)
    B.export_backup(meta.limit(0), contents.limit(0), path)
    assert (B.restore_backup(spark, path, BOOK, keep).restored, B.restore_backup(spark, path, BOOK, keep, version=1).restored) == (0, 1)
    shutil.rmtree(tmp_path / "b" / "v2" / "manifest")
    got = B.restore_backup(spark, path, BOOK, keep)
    assert ([r.id for r in got.books.collect()], got.skipped, got.settings) == (["a"], 2, None)
    manifest = next((tmp_path / "b" / "v1" / "manifest").glob("*.json"))
    for crc in manifest.parent.glob(".*.crc"):
        crc.unlink()
    manifest.write_text(manifest.read_text().replace(B.BACKUP_FORMAT, "other"))
    with pytest.raises(ValueError, match="not a backup"):
        B.restore_backup(spark, path, BOOK, keep)


def test_missing_assets_and_candidates(spark):
    frame = lambda rows: spark.createDataFrame(rows, "name string, part int")
    got = B.missing_from(frame([("a", 1), ("a", 1), ("b", None), ("c", 2)]), frame([("a", 1), ("c", 2), ("c", 2), ("d", 1)]))
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1), ("b", None)]
    ranked = rank_candidates(spark.createDataFrame([("b", 2), ("c", 5), ("a", 2)], "id string, score int"))
    assert [r.id for r in ranked.collect()] == ["c", "a", "b"]


def test_settings(spark):
    rows = [('{"tone":"dark","rate":9,"fontScale":"50","keepScreenOn":false}',), ("nonsense",), ('{"tone":"pink","rate":"x"}',), (None,)]
    got = [tuple(r.settings) for r in B.parse_settings(spark.createDataFrame(rows, "json string")).collect()]
    assert got == [("dark", "auto", 3.0, 85.0, False)] + [("light", "auto", 1.0, 100.0, True)] * 3


def test_manifests_and_bridge(spark):
    good = {"format": "f", "version": 1, "id": "p-1", "label": "L", "engine": "e", "entry": "x.js", "voices": [{"id": "v", "name": "V"}]}
    cases = [(good, None), (good | {"version": 2}, "bad_version"), (good | {"id": "no spaces"}, "bad_id"), (good | {"entry": "y"}, "missing_entry"), (good | {"voices": []}, "no_voices"), (good | {"voices": [{"id": "v"}]}, "bad_voice")]
    df = spark.createDataFrame([(i, json.dumps(m), ["x.js"], 10) for i, (m, _) in enumerate(cases)] + [(6, "broken", ["x.js"], 10)], "n int, json string, file_names array<string>, total_bytes long")
    checked = voices.validate_manifests(df, ["f"], ["e"])
    assert [r.error_code for r in checked.orderBy("n").collect()] == [e for _, e in cases] + ["bad_format"]
    assert [(r.voice_uri, r.lang) for r in voices.pack_voices(checked).collect()] == [("pack:p-1:v", "zh-CN")]
    bridge = spark.createDataFrame([('[{"name":"A B"},{"name":""},{"name":"C","lang":"de-DE"}]',)], "json string")
    assert [(r.voice_uri, r.lang) for r in voices.normalize_bridge_voices(bridge).collect()] == [("bridge://A%20B", "en-US"), ("bridge://C", "de-DE")]


def test_read_books_and_formats(spark, tmp_path):
    for name in ("one.txt", "two.MD", "three.doc"):
        (tmp_path / name).write_text("line\n" + name)
    read = books.read_books(spark, [str(tmp_path / n) for n in ("one.txt", "two.MD", "three.doc")])
    assert {(r.title, r.format) for r in read.collect()} == {("one", "TXT"), ("two", "TXT"), ("three", None)}
    fine, bad = books.route_formats(read)
    assert fine.count() == 2 and bad.first().error == "unsupported: doc"


def test_narrow_language(spark):
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, "字" * 70), ("b", 1, "letters " * 20)], "doc_id string, page_number int, text string")
    assert {tuple(r) for r in P.narrow_language(pages, "doc_id").collect()} == {("a", "chi_sim"), ("b", "eng")}
    assert pages.select(books.file_key(F.col("text"))).first()[0].isalnum()
