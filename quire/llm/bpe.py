"""Byte-level BPE encoding and decoding over Arrow batches.

The merges are read off a rank file, handed to the ``tokenizers`` library, and every distinct
pattern match of a chunk of texts is encoded once. Ids, their character spans and the bytes they
decode to are plain columns.

Defined results: a null or empty text has no ids and decodes to empty bytes; null ids decode to
empty bytes; an id outside the table raises. Repeated rows each get their own result.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import batched
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.store import bound_batches, table
from quire.llm.text import chunks, give_back, hold

#: Distinct matches kept by a worker, and the longest match that is kept.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 48
#: Characters that are split and encoded at a time, and new matches whose encodings are held at a time.
RUN_CHARS, NEW_MATCHES = 250_000, 4_096


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``: merge by lower ranks until two are left."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Pool(NamedTuple):
    """Byte strings by number, end to end."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ``numbers`` in a row, and where each ends."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.start[numbers] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


def pool(strings: list[bytes]) -> Pool:
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    return Pool(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size)


class Codec:
    """Encoder and decoder of one rank file; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        shown = byte_characters()
        byte_of = {c: b for b, c in enumerate(shown)}
        name = lambda token: "".join(shown[b] for b in token)
        merges = [tuple(map(name, _last_merge(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        self.tokenizer = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall  # this library's \s is Unicode's White_Space, as the pattern means it
        self.pieces: dict[str, bytes] = {}  # ids as 32-bit integers
        vocabulary = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.bytes = [bytes(map(byte_of.__getitem__, shown_as)) for shown_as, _ in vocabulary]
        self.raw, self.decimal = pool(self.bytes), pool([b" %d" % i for i in range(len(self.bytes))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as packed 32-bit integers."""
        split = [self.split(t) for t in texts]
        distinct = set().union(*split)
        known = self.pieces
        new = list(distinct.difference(known))
        for some in batched(new, NEW_MATCHES):
            known.update(zip(some, (array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(list(some), add_special_tokens=False)), strict=True))
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for long in (p for p in new if len(p) > CACHE_CHARS):
            del known[long]
        if len(known) > CACHE_ENTRIES:  # what the last texts hold is common
            self.pieces = {p: known[p] for p in distinct if p in known}
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Each id with the characters that it touches: a character split over ids belongs to all of them."""
        out, at = [], 0
        pieces = self.split(text)
        for piece, e in zip(pieces, self.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
            out += [(i, at + a, at + b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]
            at += len(piece)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_pieces(self, ids) -> list[str]:
        """The text that each id completes: a split character comes with its last byte."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self.bytes[i]) for i in ids]
        if out:
            out[-1] += decoder.decode(b"", True)
        return out

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: how many ids, and the SHA-256 of the ids as text and of the bytes that they decode to."""
        packed = self.encode(texts)
        stop = np.cumsum([len(p) // 4 for p in packed])
        ids = np.frombuffer(b"".join(packed), np.int32)
        cuts = []
        for strings in (self.decimal, self.raw):
            data, ends = strings.join(ids)
            ends = np.concatenate(([0], ends))[stop]
            cuts.append((memoryview(data), ends.tolist()))
        (decimal, d_ends), (raw, r_ends) = cuts
        d = r = 0
        for p, d_end, r_end in zip(packed, d_ends, r_ends, strict=True):
            # Every decimal has a space in front; the first one's is no part of the text.
            yield len(p) // 4, hashlib.sha256(decimal[min(d + 1, d_end) : d_end]).hexdigest(), hashlib.sha256(raw[r:r_end]).hexdigest()
            d, r = d_end, r_end


@functools.lru_cache(1)
def _codec(path: str, pattern: str) -> Codec:
    made = Codec(path, pattern)
    give_back()
    return made


def codec(path: str, pattern: str) -> Codec:
    hold("bpe", _codec.cache_clear)
    return _codec(path, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of each text: ``array<int>``."""

    @F.arrow_udf("array<int>")
    def ids(batch: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        packed = [ids for run in chunks(batch, RUN_CHARS) for ids in c.encode(run)]
        at = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
        return pa.ListArray.from_arrays(at, np.frombuffer(b"".join(packed), np.int32))

    return ids(text)


def encode_spans(text: Column, path: str, pattern: str) -> Column:
    """Ids with the characters they touch: ``array<struct<id,start,stop>>``."""
    kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))

    @F.arrow_udf("array<struct<id:int,start:int,stop:int>>")
    def spans(batch: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        out = [[{"id": i, "start": a, "stop": b} for i, a, b in c.spans(t)] for run in chunks(batch, RUN_CHARS) for t in run]
        return pa.array(out, kind)

    return spans(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids stand for: ``binary``."""

    @F.arrow_udf("binary")
    def raw(batch: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        values, at = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_pylist()
        return pa.array([c.decode(values[a:b].tolist()) if ok else b"" for a, b, ok in zip(at, at[1:], batch.is_valid().to_pylist(), strict=False)], pa.binary())

    return raw(ids)


def decode_pieces(ids: Column, path: str, pattern: str) -> Column:
    """The text that each id completes: ``array<string>``."""

    @F.arrow_udf("array<string>")
    def texts(batch: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return pa.array([c.decode_pieces(ids or []) for ids in batch.to_pylist()], pa.list_(pa.string()))

    return texts(ids)


def digest(text: Column, path: str, pattern: str) -> Column:
    """``struct<n_tokens, ids_sha256, decoded_sha256>``: encode, decode the ids, and digest both."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(batch: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        rows = [x for run in chunks(batch, RUN_CHARS) for x in c.digests(run)]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digested(text)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode ``text``, decode the ids, and return counts and digests of both per row."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(key), digest(F.col(text), path, pattern).alias("d")).select(key, "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *vocabulary())
