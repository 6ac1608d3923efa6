import hashlib

import numpy as np
import pytest
from lumengrid.operators import digests
from lumengrid.operators.decoders import hash_permutation


@pytest.mark.parametrize("keys", [["7"], [str(k * k) for k in range(300)], ["é" * k + str(k) for k in range(20)], ["x" * 90, "y"]])
def test_leading_bytes_and_their_order(keys, monkeypatch):
    monkeypatch.setattr(digests, "SLICE", 128)
    seeds = ["rel:true:3", "rel:half:c:11", "", "9", "10"]
    high = digests.leading(keys, seeds)
    exact = lambda i: hash_permutation(keys, seeds[i])
    assert [int(v) for v in high[1]] == [int.from_bytes(hashlib.md5(f"{seeds[1]}:{k}".encode()).digest()[:8], "big") for k in keys]
    for order, marks, i in zip(digests.ordered(high, exact), digests.among_first(high, len(keys) // 2, exact), range(5), strict=True):
        assert order.tolist() == exact(i).tolist() and sorted(np.flatnonzero(marks)) == sorted(exact(i)[: len(keys) // 2])


def test_equal_leading_bytes_are_told_apart_by_the_whole_digest():
    high = np.array([[5, 5, 1, 9]], np.uint64)
    exact = lambda i: np.array([2, 1, 0, 3])
    assert digests.ordered(high, exact).tolist() == [[2, 1, 0, 3]] and digests.among_first(high, 2, exact).tolist() == [[False, True, True, False]]
