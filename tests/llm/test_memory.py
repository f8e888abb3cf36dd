"""What a Python worker keeps from one operator to the next."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quire.llm import bpe, lm, neardup, text


def test_near_duplicates_let_the_caches_of_other_operators_go(monkeypatch):
    """A worker that scored languages before still held their model and cache while buckets were compared."""
    cleared = []
    monkeypatch.setattr(text, "_holder", ["language", lambda: cleared.append("language")])
    batch = pa.RecordBatch.from_pydict({"bucket": [1, 1, 2]})
    got = list(neardup._by_bucket(iter([batch, batch]), lambda t: iter(t.to_batches())))
    assert cleared == ["language"] and sum(b.num_rows for b in got) == 6
    list(neardup._by_bucket(iter([]), lambda t: iter(t.to_batches())))
    assert cleared == ["language"] and text._holder[0] == "neardup"


class Captured:
    """Stands for a table: keeps the function that is mapped over its batches."""

    def mapInArrow(self, f, schema):
        self.f = f
        return self

    def select(self, *columns):
        return self

    groupBy = agg = select


def test_ngrams_leave_python_in_small_batches_and_memory_goes_back(spark, monkeypatch):
    """A million rows left at a time: the JVM held them as a whole, and idle workers what counting them had taken."""
    codes, words, sizes = text.word_codes(["a b c d e f g h"] * 3 + ["i j k"], lm.END)
    packed = [x.tobytes() for x in (np.ones(4, np.uint8), sizes, words, codes.astype(np.uint16))]
    batch = pa.RecordBatch.from_pydict(dict(zip(lm.Chunk._fields, ([x] for x in packed), strict=True)))
    every, back = np.full(4096, 255, np.uint8), []
    monkeypatch.setattr(lm, "OUT_ROWS", 4, raising=False)
    monkeypatch.setattr(lm, "ROUNDS", 1)
    monkeypatch.setattr(lm, "give_back", lambda: back.append(True), raising=False)
    table = Captured()
    lm.gram_counts(table, SimpleNamespace(value=[every, every]), 1, 0)
    got = list(table.f(iter([batch])))
    assert sum(b.num_rows for b in got) == 11 and max(b.num_rows for b in got) == 4 and back
    assert sorted(c for b in got for c in b.column("c").to_pylist()) == [1] * 3 + [3] * 8


def test_encodings_of_new_matches_are_held_a_few_at_a_time(monkeypatch):
    """The encodings of all new matches of a million characters were held at once."""
    c = bpe.Codec(*bpe.vocabulary())
    texts = [" ".join(f"word{i * 7919}" for i in range(500))]
    whole, seen = c.encode(texts), []

    class Watched:
        def encode_batch_fast(self, new, **more):
            seen.append(len(new))
            return tokenizer.encode_batch_fast(new, **more)

    tokenizer, c.tokenizer = c.tokenizer, Watched()
    c.pieces.clear()
    monkeypatch.setattr(bpe, "NEW_MATCHES", 100, raising=False)
    assert c.encode(texts) == whole and len(seen) > 1 and max(seen) == 100


def test_freed_memory_goes_back_behind_each_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(text, "trim", lambda: calls.append(True), raising=False)
    assert [x for run in text.chunks(pa.array(["a", None, "b" * 9]), 5) for x in run] == ["a", "", "b" * 9] and calls == [True]
