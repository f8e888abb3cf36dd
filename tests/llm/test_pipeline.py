"""The pipeline over the small tables: each stage against what it says."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe
from quire.llm.store import keep

SMALL = "/root/testdata/sf0.001"
SPOILT = re.compile(r"&&&|\$\$\$|%%%|\*\*\*|###|!! ")


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10_000, "", "en", "s", 0), (10_001, "12 34", "en", "s", 5), (10_002, "the of and that is in the", "en", "s", 5), (10_002, "the of and that is in the", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(odd).withColumns({"language": F.lit("l"), "quality_score": F.lit(-1.0), "__row": F.lit(1), "whole": F.lit("w"), "node": F.lit("n"), "digest": F.lit(2), "kept": F.lit(False), "tags": F.create_map(F.lit("k"), F.lit("v"))})
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    now, kept = docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = keep(stage(spark, now, SMALL), f"stage-{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
            assert not out.filter("language <> 'l' OR quality_score <> -1 OR __row <> 1 OR whole <> 'w' OR node <> 'n' OR tags['k'] <> 'v' OR language IS NULL OR quality_score IS NULL OR node IS NULL").limit(1).count(), name
            kept.append({r.doc_id for r in out.select("doc_id").collect()})
        last, now = now, out
    assert not kept[0] & bad and len(kept[0] & good) >= 0.97 * len(good)
    assert 10_000 not in kept[1] and 10_001 not in kept[1] and len(kept[1]) >= len(kept[0]) - 5
    assert kept[3] <= kept[2] <= kept[1]
    twice = [r.doc_id for r in last.select("doc_id").collect()]
    assert len(twice) == len(set(twice))
    assert sorted(r.doc_id for r in now.collect()) == sorted(twice)
    assert now.columns == bpe.digests(docs, *bpe.vocabulary()).columns


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SMALL), "empty")
    assert docs.count() == 0


def test_all_texts_of_a_repeated_id_stay_unless_near(spark):
    """Whatever the order of rows: an id with two texts keeps both that have no near-duplicate, equal rows become one, maps are no hindrance."""
    same, other, alone = "one two three four five six", "another text that has words of its own", "quite alone with its words here"
    rows = [(1, same), (1, other), (2, same), (3, alone), (None, same), (3, alone), (4, "x " * 300_000)]
    seen = set()
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").withColumn("tags", F.create_map(F.lit("k"), F.col("text").substr(1, 3))).withColumn("node", F.lit("n"))
        out = corpus_pipeline.one_of_each_group(spark, docs, SMALL).collect()
        assert sorted(r.text[:40] for r in out) == sorted([same, same, other, alone, "x " * 20])
        assert (1, other) in {(r.doc_id, r.text) for r in out} and all(r.tags == {"k": r.text[:3]} and r.node == "n" for r in out)
        seen.add(frozenset((r.doc_id, r.text) for r in out))
    assert len(seen) == 1
