import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelloom.llm import textcore as tc
from voxelloom.llm.unigram import MODEL, DoubleArray, Encoder, decode, decode_ids, encode, op8_sentencepiece, segment_one, vocabulary


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """The public library and our vocabulary with the same pieces and scores.

    The kind of model, field 3 of the trainer's part, is set to unigram.  The pieces of
    markers alone score -1e9; the library adds in single precision and would lose all
    differences under 64 beside that, so they score -40,000 here, on both sides.
    """
    with open(MODEL, "rb") as f:
        data = f.read().replace(struct.pack("<f", -1e9), struct.pack("<f", -40_000.0))
    assert data.count(b"tok_v0\x18\x02") == 1
    path = tmp_path_factory.mktemp("model") / "even.model"
    path.write_bytes(data)
    return sentencepiece.SentencePieceProcessor(model_proto=data.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01")), str(path)


def ours(texts, model=MODEL):
    t = tc.Texts(np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])]).astype(np.int64))
    ids, off = Encoder(vocabulary(model)).encode(t)
    back = decode(vocabulary(model), ids, off)
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)], [back.text(i).decode() for i in range(len(texts))]


def test_against_library(spark, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["", " ", "  two  spaces ", "tab\tline\n\nend", "日本語のテキスト", "🦙🦙 llama \U0001f999", "x" * 500, "é" * 70, "<s> </s> <unk> <0x41>", "\x00\x01"]
    processor, path = library
    ids, back = ours(texts, path)
    assert back == texts
    assert ids == processor.encode(texts)
    for t, i in zip(texts[-9:], ids[-9:], strict=True):
        assert processor.decode(i) == t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" abcthe\né日\U0001f999ing")), max_size=90), min_size=1, max_size=8))
def test_any_text(texts):
    ids, back = ours(texts)
    assert back == texts
    v = vocabulary(MODEL)
    for t, i in zip(texts, ids, strict=True):
        if t:
            assert i == segment_one(v, ("▁" + t.replace(" ", "▁")).encode())


def test_trie():
    rng = np.random.default_rng(0)
    keys = {bytes(rng.integers(97, 101, rng.integers(1, 7)).tolist()): i for i in range(800)}
    trie = DoubleArray(keys)
    for k in [*keys, b"zz", b"abcdabcdabcd"]:
        node = 0
        for c in k:
            child = int(trie.base[node]) + c
            node = child if node >= 0 and trie.check[child] == node else -1
            if node < 0:
                break
        assert (trie.value[node] if node >= 0 else -1) == keys.get(k, -1)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "A b", None), (3, "A b", None), (None, "▁", None), (4, "word " * 60_000, None), (5, "z" * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0, r.n_ids, r.round_trip) for r in op8_sentencepiece(docs).collect()))
    assert [x[0] for x in got] == [0, 1, 2, 3, 3, 4, 5] and [x[2] for x in got] == [False] + [True] * 6
    assert got[1][1] == got[2][1] == 0
    back = {r.doc_id: r.text for r in decode_ids(encode(docs)).collect()}
    assert back[4] == rows[5][1] and back[3] == "A b" and back[1] == "" and back[None] == " "
    assert op8_sentencepiece(docs.limit(0)).collect() == []


def test_many_long_stretches():
    rng = np.random.default_rng(3)
    letters = "日本語のテキスト中文字é🦙abcthing"
    texts = ["".join(rng.choice(list(letters), rng.integers(30, 400))) for _ in range(120)]
    ids, back = ours(texts)
    v = vocabulary(MODEL)
    assert back == texts and ids == [segment_one(v, ("▁" + t).encode()) for t in texts]


def test_stretches_of_one_hash(monkeypatch):
    texts = ["one two", "two one  three", "éé 日本 one"]
    want = ours(texts)
    for few in (1, 2, 7):
        monkeypatch.setattr(tc.Texts, "span_hashes", lambda self, a, b, few=few: ((b - a) % few).astype(tc.U64))
        assert ours(texts) == want
    # Those of one run are kept for the next.
    encoder = Encoder(vocabulary(MODEL))
    for t, w in zip(texts, want[0], strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert encoder.encode(tc.Texts(raw, np.array([0, len(raw)])))[0].tolist() == w
