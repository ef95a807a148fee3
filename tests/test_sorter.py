"""Rows in order, where only equal ones look at further columns."""

import numpy as np
import pytest

from phraseloom.operators import windows


@pytest.mark.parametrize("columns, values, n", [(1, 3, 50), (2, 2, 1), (5, 2, 2_000), (11, 3, 500), (10, 1 << 32, 300)])
def test_sorter_equals_lexsort(columns, values, n):
    rng = np.random.default_rng(5)
    key = [rng.integers(0, values, n, np.uint64).astype(np.uint32) for _ in range(columns)]
    order, same = windows.sorter()(key)
    rows = [tuple(int(k[i]) for k in key) for i in order]
    assert sorted(order.tolist()) == list(range(n)) and rows == sorted(rows) and same.tolist() == [a == b for a, b in zip(rows, rows[1:])]
