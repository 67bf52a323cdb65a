import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm.suffix_array import common_prefixes, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60) | st.lists(st.integers(1, 255), max_size=60))
def test_matches_sorting(values):
    t = np.array(values, np.int64)
    sa = suffix_array(t)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: values[i:])
    if len(t):
        room = len(t) - np.arange(len(t))
        got = common_prefixes(t, sa, room)
        for a, b in zip(sa, sa[1:]):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert got[b] == k


def test_long_inputs():
    rng = np.random.default_rng(1)
    for t in (np.full(3000, 7), rng.integers(1, 4, 5000), np.tile(rng.integers(1, 90, 700), 6), np.tile([1, 2], 2000)):
        raw = bytes(t.astype(np.uint8))
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: raw[i:])
