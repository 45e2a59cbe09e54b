"""Orders of names and places of strings, against their plain forms."""

import numpy as np
import pyarrow as pa
import pytest

from veilframe.llm.suffixes import order_of, starts_of


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000, 4097])
@pytest.mark.parametrize("spread", [1, 7, 1 << 12, 1 << 63])
def test_order_is_that_of_a_stable_sort(n, spread):
    rng = np.random.default_rng(n)
    for base in (0, 2**64 - 1 - spread):
        names = rng.integers(0, spread, n, dtype=np.uint64, endpoint=True) + np.uint64(base)
        assert (order_of(names) == np.argsort(names, kind="stable")).all()
    packed = np.zeros(n, np.dtype([("name", "<u8"), ("check", "<u4")]))
    packed["name"] = names
    assert (order_of(packed["name"]) == np.argsort(names, kind="stable")).all()


def test_places_of_ranges():
    rng = np.random.default_rng(3)
    for length in (1, 4, 30):
        sizes = rng.integers(0, 40, 12)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        lists = [None if rng.random() < 0.1 else [x for _ in range(rng.integers(0, 4)) for x in sorted(rng.integers(0, 40, 2).tolist())] for _ in sizes]
        lists = [own and [x for low, high in zip(own[::2], own[1::2]) if low <= size for x in (low, high)] for own, size in zip(lists, sizes)]
        want = {a + i for a, size, own in zip(bounds, sizes, lists) for low, high in zip((own or [])[::2], (own or [])[1::2]) for i in range(low, min(high, size - length) + 1)}
        ranges = pa.array([[9, 9], *lists], pa.list_(pa.int32())).slice(1)
        assert starts_of(ranges, bounds, length).tolist() == sorted(want)
