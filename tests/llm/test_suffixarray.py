import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelloom.llm.suffixarray import permuted_lcp, suffix_array, suffix_arrays


def brute_sa(x):
    return sorted(range(len(x)), key=lambda i: x[i:])


def lcp(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_small(x):
    sa = suffix_array(np.array(x, np.int64)).tolist()
    assert sa == brute_sa(x)
    if x:
        got = permuted_lcp(np.array(x, np.int64), np.array(sa), 100)
        for r in range(1, len(sa)):
            assert got[sa[r]] == lcp(x[sa[r] :], x[sa[r - 1] :])
        assert got[sa[0]] == 0


@pytest.mark.parametrize("text", [b"mississippi" * 40, b"a" * 300, b"abab" * 100, bytes(range(256)) * 3, b"banana\x00banana\x00" * 20])
def test_bytes(text):
    assert suffix_array(np.frombuffer(text, np.uint8).astype(np.int64)).tolist() == brute_sa(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=50), min_size=1, max_size=8))
def test_many(xs):
    begin = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    symbols = np.concatenate([np.array(x, np.int64) for x in xs])
    sa = suffix_arrays(symbols, begin)
    assert sa.tolist() == [b + i for b, x in zip(begin, xs) for i in brute_sa(x)]
    got = permuted_lcp(symbols, sa, 100, begin[:-1], begin)
    for b, x in zip(begin, xs):
        own = brute_sa(x)
        assert got[b + own[0]] == 0
        padded = lambda i: [v + 1 for v in x[i:]]
        for r in range(1, len(own)):
            assert got[b + own[r]] >= lcp(padded(own[r]), padded(own[r - 1]))


def test_many_names():
    rng = np.random.default_rng(4)
    words = [rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8).tobytes() for _ in range(3000)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 3000, n)) for n in (1, 40, 3000)]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    sa = suffix_arrays(np.frombuffer(b"".join(texts), np.uint8).astype(np.int64), begin)
    assert sa.tolist() == [b + i for b, x in zip(begin, texts) for i in brute_sa(x)]
