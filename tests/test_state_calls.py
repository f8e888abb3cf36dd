"""How often streams call the store: by keys, pages and batches, not by rows."""

import random

import pytest
from pyspark.sql import Row

from quire.streaming import reader as R


class Store:
    """Variables of one key that count the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _variable(self, *_, **__):
        return Variable(self)

    getValueState = getMapState = _variable

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


class Variable:
    def __init__(self, store):
        self.store, self.value, self.map = store, None, {}

    def _called(self, out=None):
        self.store.calls += 1
        return out

    def get(self):
        return self._called(self.value)

    def update(self, value):
        self.value = self._called(value)

    def clear(self):
        self.value, self.map = self._called(), {}

    def containsKey(self, key):
        return self._called(key in self.map)

    def getValue(self, key):
        return self._called(self.map.get(key))

    def updateValue(self, key, value):
        self.map[key] = self._called(value)

    def removeKey(self, key):
        self.map.pop(self._called(key))

    def iterator(self):
        return iter(self._called(list(self.map.items())))


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


ROWS = 2_000


@pytest.mark.parametrize(
    "processor, row, rings",
    [
        (R._Saves(500), lambda i, ms: Row(ms=ms, seq=i, immediate=i % 5 == 0), True),
        (R._Newest(5_000, 10_000), lambda i, ms: Row(ms=ms, gen=i % 3, result=i), True),
        (R._Cache(5_000), lambda i, ms: Row(ms=ms, page_number=i % 4, text=None if i % 2 else "t"), False),
    ],
)
def test_calls_do_not_grow_with_the_rows_of_a_batch(processor, row, rings):
    rng = random.Random(3)
    store = Store()
    processor.init(store)
    rows = [row(i, rng.randrange(1_000_000)) for i in range(ROWS)]
    for half in (rows[: ROWS // 2], rows[ROWS // 2 :]):
        list(processor.handleInputRows(("k", "eng"), iter(half), Now(0)))
    if rings:
        assert len(store.timers) == 1 and list(processor.handleExpiredTimer(("k",), Now(500_000), None))
    assert store.calls < 50
