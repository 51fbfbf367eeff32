"""Parity bits rule no similar pair out."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tersely.llm import similar


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300), st.integers(0, 60), st.integers(0, 60), st.randoms())
def test_bits_differ_no_more_than_sets(items, gone, new, rng):
    x = np.unique(np.array(sorted(items), np.int64))
    y = np.unique(np.concatenate([x[min(gone, len(x) - 1) :], np.array([rng.randrange(-(2**63), 2**63) for _ in range(new)], np.int64)]))
    a, b = similar.parity(x), similar.parity(y)
    differ = len(np.setxor1d(x, y))
    assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= differ
    if similar.are_similar(len(x), x, len(y), y):
        assert similar.near_enough(np.array([len(x)]), np.array([len(y)]), a[None], b[None]).all()
