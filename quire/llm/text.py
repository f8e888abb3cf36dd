"""Byte tables and chunking shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z to a-z, all other bytes kept.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every ASCII byte that is neither letter nor digit becomes a space.
LOWER_WORDS = bytes(b if b >= 128 else (LOWER[b] if chr(b).isalnum() else 32) for b in range(256))


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space, as UTF-8."""
    return text.encode().translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode().translate(LOWER_WORDS).split() if text else []


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(texts: list[str], end: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words between white space of all texts, ``end`` behind each text's: their places among the distinct ones, the hashes of these, and how many words each text has."""
    found = [space_words(t) for t in texts]
    if end is not None:
        for x in found:
            x.append(end)
    distinct = list(set().union(*found))
    place = dict(zip(distinct, range(len(distinct)), strict=True))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    codes = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int32, int(sizes.sum()))
    return codes, np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct)), sizes


#: Rows of a batch that are turned into Python strings at a time.
SLICE_ROWS = 256


def chunks(batch: pa.Array, chars: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of whole texts of about ``chars`` characters, in order; null becomes empty. What the work on them freed goes back to the system behind the last."""
    run, size = [], 0
    for at in range(0, len(batch), SLICE_ROWS):
        for t in batch.slice(at, SLICE_ROWS).to_pylist():
            run.append(t or "")
            size += len(run[-1])
            if size >= chars:
                yield run
                run, size = [], 0
    if run:
        yield run
    del run
    trim()


def texts_of(*batches: pa.Array) -> Iterator[tuple]:
    """Rows of parallel arrays as Python values, a slice at a time."""
    for at in range(0, len(batches[0]), SLICE_ROWS):
        yield from zip(*(b.slice(at, SLICE_ROWS).to_pylist() for b in batches), strict=True)


_holder: list = ["", None]


def hold(name: str, clear: Callable[[], None]) -> None:
    """Make ``name`` the one operator of this Python worker that keeps caches; the one before clears its own.

    Spark lends a worker to stage after stage, so the caches of all of them would add up.
    """
    if _holder[0] != name:
        if _holder[1]:
            _holder[1]()
        _holder[:] = [name, clear]
        give_back()


def give_back() -> None:
    """Return freed memory to the system: allocators keep it otherwise, and executors count it."""
    gc.collect()
    trim()


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def trim() -> None:
    """The same without a collection of cycles: cheap enough for every batch."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)
