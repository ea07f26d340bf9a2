import numpy as np

from voxelloom.llm import textcore as tc


def thue_morse(k, a="a", b="b"):
    one, other = a, b
    for _ in range(k):
        one, other = one + other, other + one
    return one, other


def texts_of(parts):
    return tc.Texts(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))


def test_structured_words_differ():
    words = [w.encode() for k in range(1, 15) for w in thue_morse(k)]
    t = texts_of(words)
    for seed in (0, 1):
        assert len(np.unique(t.span_hashes(t.off[:-1], t.off[1:], seed))) == len(words)
    for k in (5, 9, 12):
        one, other = (np.array([7 if c == "a" else 8 for c in w], tc.U64) for w in thue_morse(k))
        assert tc.rolling(one, len(one))[0] != tc.rolling(other, len(other))[0]


def test_hashes_are_of_the_content():
    rng = np.random.default_rng(1)
    parts = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in list(range(1, 40)) + [120, 127, 128, 129, 300]]
    t = texts_of([b"xyz", *parts, b"y", *parts])
    h = t.span_hashes(t.off[:-1], t.off[1:])
    n = len(parts)
    assert (h[1 : n + 1] == h[n + 2 :]).all()
    assert len(np.unique(h)) == len({b"xyz", b"y", *parts})
    for length in (1, 3, 7, 8, 9, 16, 24, 31):
        g = t.gram_hashes(length)
        by = {}
        for i, x in enumerate(g.tolist()):
            assert by.setdefault(t.buf[i : i + length].tobytes(), x) == x
        assert len(set(by.values())) == len(by) and len(g) == len(t.buf) - length + 1
    x = rng.integers(0, 2, 400).astype(tc.U64)
    for length in (1, 2, 3, 5, 20, 50):
        r, by = tc.rolling(x, length), {}
        for i, v in enumerate(r.tolist()):
            assert by.setdefault(tuple(x[i : i + length]), v) == v
        assert len(set(by.values())) == len(by) and len(r) == 401 - length
        assert not (r == tc.rolling(x, length, 1)).any()


def test_pairs():
    keys, second, values = np.array([5, 3, 5, 5, 9], tc.U64), np.array([1, 0, 2, 1, 0], np.uint32), np.array([7, 8, 6, 3, 1])
    key, one, low, high = tc.extremes(keys, values, second)
    assert key.tolist() == [3, 5, 5, 9] and second[one].tolist() == [0, 1, 2, 0]
    assert low.tolist() == [8, 3, 6, 1] and high.tolist() == [8, 7, 6, 1]
    at, there = tc.find_pairs(key, second[one], np.array([5, 5, 5, 9, 4], tc.U64), np.array([2, 1, 3, 0, 0], np.uint32))
    assert there.tolist() == [True, True, False, True, False] and at[[0, 1, 3]].tolist() == [2, 1, 3]
