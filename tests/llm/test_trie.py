"""The prefix trie against a dictionary of whole prefixes."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [r[3:] for r in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {p: set() for p in members}
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(p[-1][1].replace("\x0b", " ").split()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * words
    text = lambda p: ",".join(map(str, sorted(ends.get(p, []))))
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha256(text(p).encode()).hexdigest()) for p, m in members.items()), key=repr)


def result(spark, rows, tmp_path, name="a"):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("words", F.lit("clash")).withColumn("length", F.create_map(F.lit(1), F.lit(2))).withColumn("d", F.lit(None).cast("string"))
    df.write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    got = trie.op12_prefix_trie(spark, f"{tmp_path}/{name}")
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    talk = lambda n, kinds=3: [(rng.choice(("user", "bot")), f"t {rng.randrange(kinds)}") for _ in range(n)]
    made = []
    for c in [*range(-45, 130), 5000]:
        turns = talk(rng.randrange(0, 9)) if c % 3 else [("user", "hot"), ("bot", "hot hot")] + talk(rng.randrange(0, 12), 2)
        if c % 11 == 0:
            turns = [("user", "the same  words\n")] * 7  # one conversation of many
        made += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    made += [(140, i, "user", f"deep {i}") for i in range(90)] + [(147, i, "user", f"deep {i}" if i < 80 else "end") for i in range(90)]  # deeper than a band
    made += [(None, 0, "user", "lost"), (141, None, None, None), (141, None, "", ""), (141, 3, "user", None), (161, 0, "user", "alone"), (142, 0, "user", "ü " * 200_000), (142, 1, None, "x"), (142, 1, "a", "y"), (142, 1, "a", "y")]
    return made


@pytest.mark.parametrize("band,shard,span,ends", [(64, 2048, 1024, 4096), (3, 4, 2, 2)])
def test_nodes_equal_brute_force(spark, rows, tmp_path, monkeypatch, band, shard, span, ends):
    """With small bands, shards and strings all that is cut must be joined again."""
    for name, value in (("BAND", band), ("SHARD", shard), ("SPAN", span), ("ENDS", ends)):
        monkeypatch.setattr(trie, name, value)
    assert result(spark, rows, tmp_path) == brute(rows)


def test_no_turns_and_no_conversations(spark, tmp_path):
    assert result(spark, [], tmp_path, "none") == []
    lost = next(c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)  # its only turn is before the third, its family has no first
    assert result(spark, [(lost, 0, "user", "x")], tmp_path, "turnless") == [(lost, 0, None, 1, 0, 1, 0, sha256(str(lost).encode()).hexdigest())]


@pytest.mark.parametrize("codes", [60, 20_000])
def test_double_array_holds_what_it_was_given(codes):
    """Codes that lie far apart too."""
    rng = np.random.default_rng(2)
    rows = np.unique(np.concatenate([np.pad(rng.integers(1, codes, (300, n)), ((0, 0), (0, 6 - n))) for n in range(1, 7)]), axis=0)
    rows = np.concatenate([rows, np.pad([[codes, 1], [codes, codes - 1], [codes, codes]], ((0, 0), (0, 4)))])
    base, check = trie.double_array(rows)
    states = {}
    for row in rows:
        state, path = 0, ()
        for code in row[row > 0]:
            path += (int(code),)
            assert check[base[state] + code] == state
            state = int(base[state] + code)
            assert states.setdefault(state, path) == path
    assert len(states) == (check >= 0).sum()
