"""SimHash links beyond three bits."""

import numpy as np
import pytest

from docloom.llm import simhash_dedup


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5, 6, 7, 8, 24, 63])
def test_sliced_links_at_any_radius(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    for i in range(1, 150, 2):  # neighbours 0 to 9 bits apart
        a[i] = a[i - 1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, i // 2 % 10, replace=False)))
    first, last = np.zeros(150, np.int64), np.full(150, 150)
    got = {(int(x), int(y)) for i, j in simhash_dedup.sliced_links(a, first, last, radius) for x, y in zip(i, j)}
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if (int(a[i]) ^ int(a[j])).bit_count() <= radius}
