import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabveil.llm import suffixarray as x


def check(body):
    s = np.array([*[b + 1 for b in body], 0], np.int64)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    for small in (0, 1024):
        old, x.SMALL = x.SMALL, small
        got = x.suffix_array(s, int(s.max()) + 1)
        x.SMALL = old
        assert got.tolist() == want
    common = x.permuted_prefixes(s, got, 6)
    for a, b in zip(want, want[1:]):
        n = 0
        while n < 6 and a + n < len(s) and b + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert common[b] == n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_any(body):
    check(body)


def test_repetitive():
    for body in ([0] * 50, [0, 1] * 40, [1, 0, 2] * 30 + [1, 0], list(range(40)), list(range(40))[::-1], [2, 1, 0, 1] * 20):
        check(body)
