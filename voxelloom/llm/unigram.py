"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their log scores are read from a SentencePiece model file.  Spaces
become markers and one marker goes before the text.  As no piece has a marker
after another character, a token ends before each run of markers, so the best
segmentation of a text is that of its stretches "markers, then other characters".
Distinct stretches are segmented together, those of about one length at a time, one
array step for each place and depth in the trie, and kept for the texts that follow in
the task.  They are found again by hash, and their bytes compared.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import textcore as tc

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Less than the worst piece by so much scores a character that no piece is.
UNKNOWN_PENALTY = 10.0
#: Stretches segmented at once, and their number times the bytes of the longest; fewer than FEW are segmented one by one.
AT_ONCE, CELLS, FEW = 1 << 13, 1 << 20, 12
#: Stretches that a task keeps, and bytes of texts it takes at a time.
KEPT, RUN_BYTES = 1 << 18, 512 << 10


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind == 5:
            yield tag >> 3, data[at : at + 4]
            at += 4
        else:
            raise ValueError(f"wire type {kind}")


class DoubleArray:
    """Trie of byte strings: the child of node s by byte c is base[s] + c, if check of that is s; the root is 0."""

    def __init__(self, keys: dict[bytes, int]):
        items = sorted(keys)
        size = max(1024, 2 * sum(map(len, items)) + 1024)
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        low = 1  # no place below is free
        todo = [(0, 0, len(items), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(items[lo]) == depth:
                self.value[node] = keys[items[lo]]
                lo += 1
            if lo == hi:
                continue
            heads = [lo]
            for i in range(lo + 1, hi):
                if items[i][depth] != items[i - 1][depth]:
                    heads.append(i)
            codes = np.array([items[i][depth] for i in heads])
            while not free[low]:
                low += 1
            at = low
            while True:
                # Places for the first child among the next few hundred.
                span = at + np.flatnonzero(free[at : at + 512])
                span = span[span >= codes[0] + 1]
                fits = span[free[span[:, None] + (codes - codes[0])].all(axis=1)] if len(span) else span
                if len(fits):
                    base = int(fits[0] - codes[0])
                    break
                at += 512
            self.base[node] = base
            for code, a, b in zip(codes.tolist(), heads, [*heads[1:], hi], strict=True):
                self.check[base + code] = node
                free[base + code] = False
                todo.append((base + code, a, b, depth + 1))
        used = int(np.flatnonzero(~free)[-1]) + 257
        self.base, self.check, self.value = self.base[:used], self.check[:used], self.value[:used]


class Vocabulary:
    """Pieces, scores and types by id, with the trie of all pieces that text can match."""

    def __init__(self, pieces: list[tuple[str, float, int]], dummy_prefix: bool = True):
        self.pieces, self.dummy_prefix = [p for p, _, _ in pieces], dummy_prefix
        self.kind = np.array([k for _, _, k in pieces], np.int8)
        keys = {p.encode(): i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED)}
        if any(MARK in _unmarked(k) for k in keys):
            raise ValueError("a piece has a marker after another character")
        self.trie = DoubleArray(keys)
        score = np.array([s for _, s, _ in pieces], np.float64)
        normal = [s for _, s, k in pieces if k == NORMAL]
        for i, (p, _, k) in enumerate(pieces):
            if k == USER_DEFINED:
                score[i] = len(p.encode()) * max(normal, default=0.0) - 0.1
        self.score = score
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_PENALTY
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.byte = np.full(256, -1, np.int32)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte[int(p[1:-1], 16)] = i
        self.byte_fallback = bool((self.byte >= 0).all())
        # What each id decodes to.
        said = []
        for i, (p, _, k) in enumerate(pieces):
            said.append(bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.encode().replace(MARK, b" "))
        size = np.array([len(x) for x in said], np.int64)
        self.said, self.said_size = np.frombuffer(b"".join(said), np.uint8), size
        self.said_begin = np.cumsum(size) - size

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            data = f.read()
        pieces, dummy = [], True
        for number, value in _fields(data):
            if number == 1:
                parts = dict(_fields(value))
                pieces.append((parts[1].decode(), struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0, parts.get(3, NORMAL)))
            elif number == 3:
                spec = dict(_fields(value))
                dummy = bool(spec.get(3, 1))
                if spec.get(2, b"") or spec.get(4, 1):
                    raise ValueError("the model rewrites characters or drops white space; only whole texts are taken")
        return cls(pieces, dummy)


def _unmarked(key: bytes) -> bytes:
    while key.startswith(MARK):
        key = key[len(MARK) :]
    return key


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def _char_bytes(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def _ids(v: Vocabulary, piece: int, surface: bytes) -> list[int]:
    return v.byte[list(surface)].tolist() if piece < 0 and v.byte_fallback else [v.unknown if piece < 0 else piece]


def segment_one(v: Vocabulary, text: bytes) -> list[int]:
    """Best pieces of one stretch, place by place; of equal paths the one whose last piece is longest."""
    base, check, value, score = v.trie.base, v.trie.check, v.trie.value, v.score
    n = len(text)
    best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for s in range(n):
        if best[s] == -np.inf:
            continue
        width = int(_char_bytes(np.array(text[s])))
        node, single = 0, False
        for e in range(s, n):
            child = int(base[node]) + text[e]
            if check[child] != node:
                break
            node = child
            i = int(value[node])
            if i >= 0:
                single |= e + 1 - s == width
                if best[s] + score[i] > best[e + 1]:
                    best[e + 1], back[e + 1], piece[e + 1] = best[s] + score[i], s, i
        e = min(s + width, n)
        if not single and best[s] + v.unknown_score > best[e]:
            best[e], back[e], piece[e] = best[s] + v.unknown_score, s, -1
    out: list[list[int]] = []
    while n:
        out.append(_ids(v, piece[n], text[back[n] : n]))
        n = back[n]
    return [i for x in reversed(out) for i in x]


def segment_many(v: Vocabulary, texts: tc.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many stretches, end to end, and their offsets."""
    size = np.diff(texts.off)
    rows = np.argsort(size, kind="stable")
    order, counts, flats = [], [], []
    while len(rows):
        # The longest ones left: as many as have their places at once, none of them much shorter than the longest.
        longest = int(size[rows[-1]])
        n = min(AT_ONCE, max(1, CELLS // longest), len(rows) - int(np.searchsorted(size[rows], longest // 2)))
        if n < FEW:
            ids = [np.array(segment_one(v, texts.text(i)), np.int32) for i in rows[-n:]]
            flat, count = np.concatenate(ids), np.array([len(x) for x in ids])
        else:
            flat, count = _segment_together(v, texts, rows[-n:])
        order.append(rows[-n:])
        counts.append(count)
        flats.append(flat)
        rows = rows[:-n]
    if not order:
        return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
    place = np.empty(len(size), np.int64)
    place[np.concatenate(order)] = np.arange(len(size))
    count = np.concatenate(counts).astype(np.int64)
    begin = np.cumsum(count) - count
    return _gather(np.concatenate(flats), begin[place], count[place]), np.concatenate([[0], np.cumsum(count[place])])


def _segment_together(v: Vocabulary, texts: tc.Texts, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the stretches ``rows``, end to end, and their numbers."""
    length = np.diff(texts.off)[rows]
    longest, n = int(length.max()), len(rows)
    grid = np.zeros((longest + 1, n), np.uint8)
    row = np.repeat(np.arange(n), length)
    col = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    grid[col, row] = texts.buf[np.repeat(texts.off[rows], length) + col]
    base, check, value = v.trie.base, v.trie.check, v.trie.value
    best = np.full((longest + 1, n), -np.inf)
    back, piece = np.zeros((longest + 1, n), np.int32), np.full((longest + 1, n), -1, np.int32)
    best[0] = 0.0
    for s in range(longest):
        alive = np.flatnonzero((best[s] > -np.inf) & (length > s))
        if not len(alive):
            continue
        here = best[s]
        width = _char_bytes(grid[s, alive])
        single = np.zeros(n, bool)
        at, node = alive, np.zeros(len(alive), np.int32)
        for e in range(s, longest):
            child = base[node] + grid[e, at]
            on = (check[child] == node) & (length[at] > e)
            at, node = at[on], child[on]
            if not len(at):
                break
            i = value[node]
            is_piece = i >= 0
            to, i = at[is_piece], i[is_piece]
            single[to[_char_bytes(grid[s, to]) == e + 1 - s]] = True
            total = here[to] + v.score[i]
            better = total > best[e + 1, to]
            to = to[better]
            best[e + 1, to], back[e + 1, to], piece[e + 1, to] = total[better], s, i[better]
        missing = ~single[alive]
        to = alive[missing]
        e = np.minimum(s + width[missing], length[to])
        total = here[to] + v.unknown_score
        better = total > best[e, to]
        to, e = to[better], e[better]
        best[e, to], back[e, to], piece[e, to] = total[better], s, -1
    # Back along the best paths; pieces come out last first.
    at, to = length.copy(), np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    while len(to):
        end = at[to]
        start = back[end, to].astype(np.int64)
        found.append((to, start, end, piece[end, to]))
        at[to] = start
        to = to[start > 0]
    who, start, end, what = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, who))
    who, start, end, what = who[order], start[order], end[order], what[order]
    count = np.where((what < 0) & v.byte_fallback, end - start, 1)
    flat = np.repeat(np.where(what < 0, v.unknown, what), count).astype(np.int32)
    if v.byte_fallback and (what < 0).any():
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        unknown = np.repeat(what < 0, count)
        flat[unknown] = v.byte[grid[(np.repeat(start, count) + offset)[unknown], np.repeat(who, count)[unknown]]]
    total = np.bincount(who, weights=count, minlength=n).astype(np.int64)
    return flat, total


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = int(size.sum())
    return values[np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)] if total else values[:0]


class Encoder:
    """Encodes runs of texts, and keeps the stretches it has segmented."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.key, self.begin, self.size, self.ids = np.zeros(0, tc.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        # The stretches themselves.
        self.at, self.length, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def marked(self, texts: tc.Texts) -> tc.Texts:
        """Texts with one marker before each that isn't empty, and markers for spaces."""
        n = np.diff(texts.off)
        size = np.where(texts.buf == 0x20, 3, 1)
        first = texts.off[:-1][n > 0]
        before = np.zeros(len(size), np.int64)
        if self.v.dummy_prefix:
            before[first] = 3
        end = np.cumsum(size + before)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
        begin = end - size
        plain = texts.buf != 0x20
        out[begin[plain]] = texts.buf[plain]
        marks = np.concatenate([begin[~plain], begin[first] - 3] if self.v.dummy_prefix else [begin[~plain]])
        for i in range(3):
            out[marks + i] = MARK[i]
        total = np.concatenate([[0], end])
        return tc.Texts(out, total[texts.off])

    def encode(self, texts: tc.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the texts' offsets."""
        m = self.marked(texts)
        buf, n = m.buf, len(m.buf)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        lead = np.zeros(n, bool)
        lead[:-2] = (buf[:-2] == MARK[0]) & (buf[1:-1] == MARK[1]) & (buf[2:] == MARK[2])
        start = lead.copy()
        start[3:] &= ~lead[:-3]
        start[m.off[:-1][np.diff(m.off) > 0]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        length = end - begin
        key, one, which = np.unique(m.span_hashes(begin, end), return_index=True, return_inverse=True)
        if len(self.key) > KEPT:
            self.clear()
        at, there = tc.find(self.key, key)
        known = np.flatnonzero(there)
        if not (_same(buf, begin, length, buf, begin[one[which]], length[one[which]]) and _same(buf, begin[one[known]], length[one[known]], self.bytes, self.at[at[known]], self.length[at[known]])):
            # Different stretches of one hash: all are segmented for themselves.
            ids, off = segment_many(self.v, tc.Texts(buf, np.append(begin, n)))
            return ids, off[np.searchsorted(begin, m.off)]
        if not there.all():
            b, size = begin[one[~there]], length[one[~there]]
            stretch = tc.Texts(_gather(buf, b, size), np.concatenate([[0], np.cumsum(size)]))
            ids, off = segment_many(self.v, stretch)
            keys = np.concatenate([self.key, key[~there]])
            order = np.argsort(keys, kind="stable")
            self.key = keys[order]
            self.begin = np.concatenate([self.begin, off[:-1] + len(self.ids)])[order]
            self.size = np.concatenate([self.size, np.diff(off)])[order]
            self.at = np.concatenate([self.at, stretch.off[:-1] + len(self.bytes)])[order]
            self.length = np.concatenate([self.length, size])[order]
            self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, stretch.buf])
        at = np.searchsorted(self.key, key)[which]
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        return _gather(self.ids, self.begin[at], size), total[np.searchsorted(begin, m.off)]


def _same(a: np.ndarray, a_begin: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_begin: np.ndarray, b_size: np.ndarray) -> bool:
    """Whether all spans have the bytes of their counterparts."""
    if not np.array_equal(a_size, b_size):
        return False
    x, y = tc.by_eights(a), tc.by_eights(b)
    while len(a_size):
        differ = x[a_begin] ^ y[b_begin]
        if (differ & tc.FIRST[np.minimum(a_size, 8)]).any():
            return False
        on = a_size > 8
        a_begin, b_begin, a_size = a_begin[on] + 8, b_begin[on] + 8, a_size[on] - 8
    return True


def decode(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tc.Texts:
    """Texts of ids; the marker that encoding puts first goes, and bytes that are no UTF-8 stay as they are."""
    size = v.said_size[ids]
    buf = _gather(v.said, v.said_begin[ids], size)
    total = np.concatenate([[0], np.cumsum(size)])
    out = total[off]
    if not v.dummy_prefix or not len(buf):
        return tc.Texts(buf, out)
    begin = out[:-1]
    there = np.diff(out) > 0
    first = begin[there]
    first = first[buf[first] == 0x20]
    keep = np.ones(len(buf), bool)
    keep[first] = False
    lost = np.concatenate([[0], np.cumsum(~keep)])
    return tc.Texts(buf[keep], out - lost[out])


ENCODED = "doc_id long, ids array<int>, n_ids long, n_bytes_ids long, round_trip boolean, text_out string"
ENCODED_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("n_bytes_ids", pa.int64()), ("round_trip", pa.bool_()), ("text_out", pa.string())])


def _encoded(model, with_text: bool):
    def run(batches):
        v = model.value
        encoder = Encoder(v)
        for batch in batches:
            texts = tc.Texts.from_arrow(batch.column("text"))
            for lo, hi in texts.chunks(RUN_BYTES):
                part = texts.rows(lo, hi)
                ids, off = encoder.encode(part)
                said = decode(v, ids, off)
                byte = np.concatenate([[0], np.cumsum(v.kind[ids] == BYTE)])
                same = np.array_equal(said.off, part.off) and np.array_equal(said.buf, part.buf)
                same = np.ones(hi - lo, bool) if same else np.array([said.text(i) == part.text(i) for i in range(hi - lo)], bool)
                out = pa.array([said.text(i).decode("utf-8", "replace") for i in range(hi - lo)], pa.string()) if with_text else pa.nulls(hi - lo, pa.string())
                cols = [batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(off)), pa.array(np.diff(byte[off])), pa.array(same), out]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, ENCODED_ARROW, strict=True)], schema=ENCODED_ARROW)

    return run


def encode(docs: DataFrame, model: str = MODEL, with_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text, by unigram Viterbi with the model's pieces and scores.

    One row per input row: doc_id, ids, n_ids, n_bytes_ids (ids of single bytes, for
    characters that no piece has), round_trip (decoding gives the text's bytes
    again), text_out (the decoded text; null unless ``with_text``).

    ``model`` is read on the driver and broadcast; its size is that of a vocabulary.
    Of equally good segmentations the one whose last piece is longest is taken.  Null
    and empty texts have no ids.  A text with the marker character itself
    decodes to a space there, as in SentencePiece.  Very long texts are taken
    whole, and stretches without a space of any length.  Repeated rows give equal
    rows; other columns are ignored; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(model))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_encoded(held, with_text), ENCODED)


def _decoded(model):
    def run(batches):
        v = model.value
        for batch in batches:
            lists = batch.column("ids")
            off = np.concatenate([[0], np.cumsum([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()])]).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            said = decode(v, ids, off)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([said.text(i).decode("utf-8", "replace") for i in range(len(lists))], pa.string())], names=["doc_id", "text"])

    return run


def decode_ids(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null or empty ids give an empty text, broken UTF-8 the replacement character."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary(model))
    return rows.select("doc_id", "ids").mapInArrow(_decoded(held), "doc_id long, text string")


def op8_sentencepiece(docs: DataFrame) -> DataFrame:
    return encode(docs).drop("text_out")
