import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from depotlens.llm.gsaca import suffix_array


def naive(s):
    return sorted(range(len(s)), key=lambda i: list(s[i:]))


@settings(max_examples=1500, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=60)))
def test_small_alphabets(s):
    assert suffix_array(np.array(s, np.int64)).tolist() == naive(s)


def test_repetitive_and_long():
    rng = np.random.default_rng(1)
    for s in ([1] * 500, [1, 2] * 300, [2, 1] * 300 + [2], list(rng.integers(0, 2, 900)), list(rng.integers(0, 500, 2000)),
              list(range(400)), list(range(400, 0, -1)), [1, 1, 2, 1, 1, 2, 3] * 90):
        assert suffix_array(np.array(s, np.int64)).tolist() == naive(s)
    assert suffix_array(np.array([], np.int64)).tolist() == []
    fib = [1], [1, 2]
    for _ in range(12):
        fib = fib[1], fib[1] + fib[0]
    assert suffix_array(np.array(fib[1], np.int64)).tolist() == naive(fib[1])
