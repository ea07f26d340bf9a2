"""Removal of repeated byte strings with suffix arrays of shards.

Shards are cut by content, so that every two equal strings of ``length`` bytes
meet in one: a string goes where the smallest hash among its GRAM-byte pieces
(its anchor) sends it, and strings of one document that follow each other and
have one anchor travel as one segment.  Anchors of a single document are
dropped first, and equal segments travel once per block.  Of each shard's
distinct segments, but for those that are their anchor's only one, a suffix array
is induced; neighbours whose common prefix is ``length`` or more are copies of one
string, whose smallest doc_id goes back to the blocks.

An anchor that comes very often may stand beside very many different texts (where a
passage that a third of all documents have begins and ends).  Its strings aren't
gathered: each travels by itself, to where its own hash sends it.

Segments are told apart by 96 bits, those of their anchor and of their own hash: among
10^13 segments, two different ones would be taken for equal with probability below one
in a thousand.  Within a suffix array the bytes themselves are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import blocks as bl
from voxelloom.llm import textcore as tc
from voxelloom.llm.suffixarray import permuted_lcp, suffix_arrays

#: Bytes of an anchor, where strings are long enough.
GRAM = 24
#: Symbols that one suffix array takes at least before the next is begun; more only where one anchor has them.
SHARD = 1 << 12
#: Symbols of suffix arrays that are sorted side by side, and their number times the symbols of the longest.
TOGETHER, TABLE = 1 << 20, 1 << 24
#: Segments of one anchor that are gathered; the strings of one that comes more often travel by themselves.
HOT = 1 << 16
#: Bytes of texts taken at a time.
RUN_BYTES = 1 << 17
#: The first part of a segment's name has its anchor's upper bits above those of its own hash, so that ranges of names keep anchors whole.
ANCHOR_BITS = 32

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def gram_for(length: int) -> int:
    return min(GRAM, max(1, length // 2))


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of each ``width`` neighbours (len - width + 1 of them)."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


class _Segments:
    """Of a run of texts: all segments, as spans of the buffer, with their anchors."""

    def __init__(self, texts: tc.Texts, length: int):
        self.texts = texts
        gram = gram_for(length)
        width = length - gram + 1
        none = np.zeros(0, np.int64)
        self.anchor, self.start, self.end, self.doc = np.zeros(0, tc.U64), none, none, none
        if len(texts.buf) < length:
            return
        h = texts.gram_hashes(gram) | tc.U64(1)
        least = _slide(h, width, np.minimum)  # by start of the string
        for a, b in zip(texts.off[:-1], texts.off[1:], strict=True):
            least[max(a, b - length + 1) : b] = 0
        # Starts that follow each other and have one smallest hash; of one place of it, there are no more than ``width``.
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        count = np.diff(np.append(first, len(least)))
        on = least[first] > 0
        first, count = first[on], count[on]
        pieces = -(-count // width)
        within = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = np.repeat(first, pieces) + width * within
        self.end = np.minimum(self.start + width, np.repeat(first + count, pieces)) + length - 1
        # Smallest hashes are small; mixed again they spread evenly over the buckets.
        self.anchor = tc.mix(least[self.start] ^ tc.U64(0x94D049BB133111EB))
        self.doc = np.searchsorted(texts.off, self.start, "right") - 1

    def names(self, which) -> tuple[np.ndarray, np.ndarray]:
        """The two parts of the segments' names."""
        low = tc.U64((1 << (64 - ANCHOR_BITS)) - 1)
        own = self.texts.span_hashes(self.start[which], self.end[which])
        return (self.anchor[which] & ~low) | (own & low), (own >> tc.U64(32)).astype(np.uint32)

    def strings(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The strings of some segments: the two parts of their names, where they start, and their documents."""
        count = (self.end - self.start)[which] - length + 1
        start = _bytes_of(np.arange(len(self.texts.buf)), self.start[which], self.start[which] + count)
        low = tc.U64((1 << (64 - ANCHOR_BITS)) - 1)
        own = self.texts.span_hashes(start, start + length)
        return (self.texts.span_hashes(start, start + length, 1) & ~low) | (own & low), (own >> tc.U64(32)).astype(np.uint32), start, np.repeat(self.doc[which], count)


def _told_hot(shared: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted anchors that a block was told, and whether they are hot."""
    got = list(bl.received(shared)) if shared.num_rows else []
    if not got:
        return np.zeros(0, tc.U64), np.zeros(0, bool)
    anchor, hot = np.concatenate([h for _, h, _ in got]), np.concatenate([np.frombuffer(m, np.uint8) for _, _, m in got]).astype(bool)
    order = np.argsort(anchor)
    return anchor[order], hot[order]


def _key_buckets(keys: np.ndarray, n: int):
    """Buckets of sorted keys, cut between anchors."""
    edges = np.array([-(-(b << ANCHOR_BITS) // n) << (64 - ANCHOR_BITS) for b in range(n)], tc.U64)
    cut = np.append(np.searchsorted(keys, edges), len(keys))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), slice(int(cut[b]), int(cut[b + 1]))


def _shards(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Begins (and the end) of shards of sorted keys that keep anchors whole, of about SHARD symbols each."""
    begin = tc.runs(keys >> tc.U64(64 - ANCHOR_BITS))
    total = np.concatenate([[0], np.cumsum(size + 1)])
    return np.append(begin[tc.runs(total[begin] // SHARD)], len(keys))


def _together(symbols: np.ndarray):
    """Shards in groups to be sorted side by side; those with more symbols first, and fewer of them in a group."""
    order = np.argsort(-symbols, kind="stable")
    while len(order):
        n = max(1, min(int(TABLE // symbols[order[0]]), int(np.searchsorted(np.cumsum(symbols[order]), TOGETHER, "right"))))
        yield order[:n]
        order = order[n:]


def _bytes_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The spans' bytes, end to end."""
    size = end - start
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else size
    return buf[np.arange(int(size.sum())) + shift] if len(size) else buf[:0]


def _anchors(length: int, n: int):
    def run(table: pa.Table) -> pa.Table:
        texts, ids = tc.Texts.from_arrow(table.column("text")), table.column("doc_id").to_numpy()
        hashes, docs = [], []
        for lo, hi in texts.chunks(RUN_BYTES):
            s = _Segments(texts.rows(lo, hi), length)
            hashes.append(s.anchor)
            docs.append(ids[lo:hi][s.doc])
        return bl.letters(bl.tell_buckets(bl.block_of(table), np.concatenate(hashes), np.concatenate(docs), n))

    return run


def _segments(length: int, n: int):
    """Distinct segments of shared anchors: sizes, smallest and largest doc_id, bytes, by the anchor's bucket.

    A string of a hot anchor has size 0 and no bytes.  The hot anchors themselves go
    along, in a letter of the block to itself, whose bucket is negative.
    """

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        known, hot = _told_hot(shared)
        if not docs.num_rows or not len(known):
            return bl.letters([])
        texts, ids = tc.Texts.from_arrow(docs.column("text")), docs.column("doc_id").to_numpy()
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for lo, hi in texts.chunks(RUN_BYTES):
            s = _Segments(texts.rows(lo, hi), length)
            at, on = tc.find(known, s.anchor)
            on = np.flatnonzero(on)
            alone = hot[at[on]]
            which = on[~alone]
            rows = [(*s.names(which), s.start[which], (s.end - s.start)[which], s.doc[which])]
            if alone.any():
                key, second, start, doc = s.strings(on[alone], length)
                rows.append((key, second, start, np.zeros(len(key), np.int64), doc))
            for key, second, start, size, doc in rows:
                for part, x in zip(parts, (key, second, start + texts.off[lo], size, ids[lo:hi][doc]), strict=True):
                    part.append(x)
        key, second, start, size, doc = (np.concatenate(p) for p in parts)
        key, one, low, high = tc.extremes(key, doc, second)
        second, start, size = second[one], start[one], size[one]
        block, out, pressed = bl.block_of(docs), [], zstandard.ZstdCompressor(level=1)
        for b, s in _key_buckets(key, n):
            data = _bytes_of(texts.buf, start[s], start[s] + size[s])
            more = tc.transposed(second[s]) + tc.transposed(low[s]) + tc.transposed(high[s] - low[s]) + tc.transposed(size[s].astype(np.uint16)) + pressed.compress(data.tobytes())
            out.append((b, block, tc.pack(key[s]), more))
        if hot.any():
            out.append((-1 - block, block, tc.pack(known[hot]), b""))
        return bl.letters(out)

    return run


def _earliest(data: np.ndarray, start: np.ndarray, size: np.ndarray, least: np.ndarray, shard: np.ndarray, length: int) -> np.ndarray:
    """Of segments, end to end: for each string of ``length`` the smallest doc_id that has it in the segment's shard."""
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    # Each segment is followed by a separator, 0; bytes are 1 to 256.
    text = np.zeros(int(begin[-1]), np.uint16)
    inside = np.ones(len(text), bool)
    inside[begin[1:] - 1] = False
    text[inside] = _bytes_of(data, start, start + size).astype(np.uint16) + 1
    shards = np.append(begin[:-1][tc.runs(shard)], len(text))
    sa = suffix_arrays(text, shards)
    common = permuted_lcp(text, sa, length + int(size.max()) + 4, begin[:-1], shards)
    segment = np.repeat(np.arange(len(size)), size + 1)
    whole = (begin[1:] - 1)[segment] - np.arange(len(text)) >= length
    sa = sa[whole[sa]]
    new = common[sa] < length
    owner = shard[segment[sa]]
    new[1:] |= owner[1:] != owner[:-1]
    new[0] = True
    new = np.flatnonzero(new)
    string_min = np.empty(len(text), np.int64)
    string_min[sa] = np.repeat(np.minimum.reduceat(least[segment[sa]], new), np.diff(np.append(new, len(sa))))
    return string_min[whole]


def _sorted_shard(length: int):
    """Of a bucket: the smallest doc_id of each string, back to the blocks in which a larger one has it."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return table.select(bl.LETTER_ARROW.names)
        got, every = [], []
        for block, key, more in bl.received(table):
            m = len(key)
            second, low, beyond, size = (tc.restored(more[a * m : b * m], t) for a, b, t in ((0, 4, np.uint32), (4, 12, np.int64), (12, 20, np.int64), (20, 22, np.uint16)))
            got.append((block, key, second, low + beyond))
            every.append((key, second, low, size.astype(np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(more[22 * m :]), np.uint8)))
        key, second, low, size, data = (np.concatenate(x) for x in zip(*every, strict=True))
        del every
        start = np.cumsum(size) - size
        keys, one, least, _ = tc.extremes(key, low, second)
        second, start, size = second[one], start[one], size[one]
        windows = np.maximum(size - length + 1, 1)
        # Where an anchor has one segment, all that hold it have the same strings, and there is nothing to sort.
        whole = np.flatnonzero(size > 0)
        group = tc.runs(keys[whole] >> tc.U64(64 - ANCHOR_BITS))
        members = np.diff(np.append(group, len(whole)))
        value = np.repeat(least, windows)
        begin = np.cumsum(windows) - windows
        several = whole[np.repeat(members > 1, members)]
        if len(several):
            cut = _shards(keys[several], size[several])
            for shards in _together(np.add.reduceat(size[several] + 1, cut[:-1])):
                count = (cut[1:] - cut[:-1])[shards]
                at = several[_bytes_of(np.arange(len(several)), cut[shards], cut[shards] + count)]
                found = _earliest(data, start[at], size[at], least[at], np.repeat(np.arange(len(shards)), count), length)
                value[_bytes_of(np.arange(len(value)), begin[at], begin[at] + windows[at])] = found
        lowest = np.minimum.reduceat(value, begin)
        out = []
        for block, mine, mine_second, high in got:
            place = tc.find_pairs(keys, second, mine, mine_second)[0]
            on = lowest[place] < high
            if on.any():
                place = place[on]
                values = _bytes_of(value, begin[place], begin[place] + windows[place])
                out.append((bucket, block, tc.pack(mine[on]), tc.transposed(mine_second[on]) + tc.transposed(windows[place].astype(np.uint16)) + tc.transposed(values)))
        return bl.letters(out)

    return run


def _removed(length: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return OUT_ARROW.empty_table()
        every, hot = [], np.zeros(0, tc.U64)
        for bucket, (_, h, more) in zip(found.column("bucket").to_pylist(), bl.received(found), strict=True) if found.num_rows else ():
            m = len(h)
            if bucket < 0:
                hot = h
                continue
            every.append((h, tc.restored(more[: 4 * m], np.uint32), tc.restored(more[4 * m : 6 * m], np.uint16).astype(np.int64), tc.restored(more[6 * m :], np.int64)))
        none = np.zeros(0, np.int64)
        keys, second, count, values = (np.concatenate(x) for x in zip(*every, strict=True)) if every else (np.zeros(0, tc.U64), np.zeros(0, np.uint32), none, none)
        begin = np.cumsum(count) - count
        order = np.argsort(keys)
        keys, second, begin, count = keys[order], second[order], begin[order], count[order]
        rest = tc.U64(64 - ANCHOR_BITS)
        anchors = keys[tc.runs(keys >> rest)] >> rest
        texts, ids = tc.Texts.from_arrow(docs.column("text")), docs.column("doc_id").to_numpy()
        out: list[list] = [[], [], [], [], [], []]
        for lo, hi in texts.chunks(RUN_BYTES):
            part = texts.rows(lo, hi)
            mark = np.zeros(len(part.buf) + 1, np.int64)
            if len(keys):
                s = _Segments(part, length)
                alone = tc.find(hot, s.anchor)[1]
                held = np.flatnonzero(~alone & tc.find(anchors, s.anchor >> rest)[1])
                at, there = tc.find_pairs(keys, second, *s.names(held))
                at, start, doc = at[there], s.start[held[there]], ids[lo:hi][s.doc[held[there]]]
                if alone.any():
                    *names, string, own = s.strings(np.flatnonzero(alone), length)
                    more, there = tc.find_pairs(keys, second, *names)
                    at, start, doc = np.append(at, more[there]), np.append(start, string[there]), np.append(doc, ids[lo:hi][own[there]])
                least = _bytes_of(values, begin[at], begin[at] + count[at])
                place = _bytes_of(np.arange(len(part.buf)), start, start + count[at])
                hit = place[least < np.repeat(doc, count[at])]
                mark = np.bincount(hit, minlength=len(mark)) - np.bincount(hit + length, minlength=len(mark))
            gone = np.cumsum(mark)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[part.off[:-1][np.diff(part.off) > 0]] = gone[part.off[:-1][np.diff(part.off) > 0]]
            spans = np.concatenate([[0], np.cumsum(begins)])
            for i in range(hi - lo):
                a, b = part.off[i], part.off[i + 1]
                kept = part.buf[a:b][~gone[a:b]].tobytes() if total[b] > total[a] else part.text(i)
                for column, x in zip(out[1:], (int(b - a), int(total[b] - total[a]), int(spans[b] - spans[a]), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(x)
        out[0] = bl.shown_ids(docs)
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, OUT_ARROW, strict=True)], schema=OUT_ARROW)

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 50, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a document of smaller id.

    Texts are UTF-8 bytes; strings may overlap, never cross documents and are
    judged on the input.  One row per input row: doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept (remaining bytes, which need not be whole
    characters), kept_sha256.  Anchors that come over ``hot`` times aren't gathered.

    Null text is empty.  A text shorter than ``length`` keeps all; very long texts are
    read whole.  Rows with equal ids (ties, repeated rows) never remove each other's
    bytes; rows with a null id count as after all others.  Other columns are ignored.
    An empty table gives no rows.
    """
    if not 2 <= length <= 20_000:
        raise ValueError("length must be from 2 to 20,000")
    n = bl.bucket_count(docs.sparkSession)
    held = bl.in_blocks(docs, doc_id, text)
    blocks = lambda: held.groupBy("block")
    anchors = blocks().applyInArrow(_anchors(length, n), bl.LETTER)
    shared = anchors.groupBy("bucket").applyInArrow(bl.shared_hashes(hot), bl.LETTER)
    segments = blocks().cogroup(shared.groupBy("block")).applyInArrow(_segments(length, n), bl.LETTER)
    earliest = segments.groupBy("bucket").applyInArrow(_sorted_shard(length), bl.LETTER)
    return blocks().cogroup(earliest.groupBy("block")).applyInArrow(_removed(length), OUT)


def op2_suffix_array_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.length("kept").cast("long").alias("n_kept"))


OP2_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, base, len(h) // 2 AS n, substr(h, 2 * base + 1, 2098) AS p FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 1000)) AS base FROM d)),
windows AS (SELECT doc_id, base + j AS i, md5(substr(p, 2 * j + 1, 100)) AS k FROM (SELECT *, unnest(range(least(1000, n - 49 - base))) AS j FROM pieces)),
earlier AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE first < doc_id),
bytes AS (SELECT doc_id, substr(p, 2 * j + 1, 2) AS byte, base + j AS i FROM (SELECT *, unnest(range(least(1000, n - base))) AS j FROM pieces)),
judged AS (SELECT bytes.*, coalesce(bytes.i - max(earlier.i) OVER (PARTITION BY bytes.doc_id ORDER BY bytes.i) < 50, false) AS gone FROM bytes LEFT JOIN earlier ON earlier.doc_id = bytes.doc_id AND earlier.i = bytes.i),
marked AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM judged),
sums AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, CAST(len(coalesce(kept, '')) // 2 AS BIGINT) AS n_kept FROM d LEFT JOIN sums USING (doc_id)"""
