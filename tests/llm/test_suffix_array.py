import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from morsel.llm.suffix_array import common_prefixes, suffix_array


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_against_sorting(x):
    a = np.array(x, dtype=np.int64)
    want = sorted(range(len(x)), key=lambda i: x[i:])
    sa = suffix_array(a)
    assert sa.tolist() == want
    lcp = common_prefixes(a, sa)
    for r in range(1, len(x)):
        s, t = x[want[r - 1] :], x[want[r] :]
        k = 0
        while k < min(len(s), len(t)) and s[k] == t[k]:
            k += 1
        assert lcp[r] == k


def test_long_and_repetitive():
    rng = np.random.default_rng(2)
    for x in (np.zeros(3000, int), np.tile([1, 2, 1, 3], 500), rng.integers(0, 2, 3000), rng.integers(0, 10**9, 3000), np.arange(2000)[::-1]):
        b = x.tolist()
        assert suffix_array(x).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
