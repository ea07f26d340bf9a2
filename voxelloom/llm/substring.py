"""Substring deduplication over words with difference-cover anchors.

Two equal runs of ``window`` words may start at any places of their documents.
Only windows at places ``p`` with ``p mod PERIOD`` in a difference cover are
hashed: for every two starts i, j some shift d < PERIOD puts both i + d and
j + d on the cover, so every equal run of ``window`` words holds a common
anchor of ``window - PERIOD + 1`` words at the same offset.  Anchors found in
one document only are dropped; each other anchor is extended to both sides, to
all windows of the full length that hold it, and these are compared by 96 bits of
two independent hashes: among 10^13 windows, two different ones would be taken for
equal with probability below one in a thousand.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import blocks as bl
from voxelloom.llm import textcore as tc

#: A perfect difference set: every residue modulo 31 is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

OUT = "doc_id long, n_words long, n_removed long, n_spans long, kept_text string, kept_sha256 string"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """Period and cover: the large ones for long windows, every place for windows too short for them."""
    return (PERIOD, COVER) if window >= 2 * PERIOD - 12 else (1, (0,))


class _Words:
    """Word hashes of a run of texts, with the place of each word in its document."""

    def __init__(self, texts: tc.Texts):
        starts, ends, self.off = texts.words()
        self.hash = texts.span_hashes(starts, ends)
        self.doc = tc.owner(self.off)
        self.place = np.arange(len(self.hash)) - self.off[self.doc]
        self.left = self.off[self.doc + 1] - np.arange(len(self.hash)) if len(self.hash) else self.place

    def windows(self, length: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows within one document, and the windows' hashes."""
        h = tc.rolling(self.hash, length, seed)
        at = np.flatnonzero(self.left[: len(h)] >= length)
        return at, h[at]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, int]:
        period, cover = cover_for(window)
        length = window - period + 1
        at, h = self.windows(length)
        on = np.isin(self.place[at] % period, cover)
        return at[on], h[on], length


def _anchors(window: int, n: int):
    def run(table: pa.Table) -> pa.Table:
        texts, ids = tc.Texts.from_arrow(table.column("text")), table.column("doc_id").to_numpy()
        hashes, docs = [], []
        for lo, hi in texts.chunks():
            w = _Words(texts.rows(lo, hi))
            at, h, _ = w.anchors(window)
            hashes.append(h)
            docs.append(ids[lo:hi][w.doc[at]])
        return bl.letters(bl.tell_buckets(bl.block_of(table), np.concatenate(hashes), np.concatenate(docs), n))

    return run


def _windows(w: _Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, and the two parts of their names."""
    start, full = w.windows(window)
    return start, full, (w.windows(window, 1)[1] >> tc.U64(32)).astype(np.uint32)


def _extended(window: int, n: int):
    """Windows that hold a shared anchor: of each distinct one, the smallest and largest doc_id in the block."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        known = bl.all_received(shared)
        if not docs.num_rows or not len(known):
            return bl.letters([])
        texts, ids = tc.Texts.from_arrow(docs.column("text")), docs.column("doc_id").to_numpy()
        parts: list[list[np.ndarray]] = [[], [], []]
        for lo, hi in texts.chunks():
            w = _Words(texts.rows(lo, hi))
            at, h, length = w.anchors(window)
            at = at[tc.find(known, h)[1]]
            size = len(w.hash) + 1
            mark = np.bincount(np.maximum(at - (window - length), w.off[w.doc[at]]), minlength=size) - np.bincount(at + 1, minlength=size)
            start, full, second = _windows(w, window)
            on = np.cumsum(mark)[start] > 0
            for part, x in zip(parts, (full[on], second[on], ids[lo:hi][w.doc[start[on]]]), strict=True):
                part.append(x)
        h, second, d = (np.concatenate(x) for x in parts)
        h, one, low, high = tc.extremes(h, d, second)
        second, block = second[one], bl.block_of(docs)
        return bl.letters([(b, block, tc.pack(h[s]), tc.transposed(second[s]) + tc.transposed(low[s]) + tc.transposed(high[s] - low[s])) for b, s in tc.by_bucket(h, n)])

    return run


def _earliest(table: pa.Table) -> pa.Table:
    """Of a bucket: back to each block, the smallest doc_id of each window that a larger doc_id of the block has."""
    bucket = table.column("bucket")[0].as_py()
    got = []
    for block, h, more in bl.received(table):
        m = len(h)
        second, low, beyond = (tc.restored(more[a * m : b * m], t) for a, b, t in ((0, 4, np.uint32), (4, 12, np.int64), (12, 20, np.int64)))
        got.append((block, h, second, low, low + beyond))
    every, seconds, lows = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
    keys, one, least, _ = tc.extremes(every, lows, seconds)
    seconds = seconds[one]
    out = []
    for block, h, second, _, high in got:
        own = least[tc.find_pairs(keys, seconds, h, second)[0]]
        on = own < high
        if on.any():
            out.append((bucket, block, tc.pack(h[on]), tc.transposed(second[on]) + tc.transposed(own[on])))
    return bl.letters(out)


def _removed(window: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return OUT_ARROW.empty_table()
        got = list(bl.received(found)) if found.num_rows else []
        keys = np.concatenate([h for _, h, _ in got]) if got else np.zeros(0, tc.U64)
        seconds = np.concatenate([tc.restored(m[: 4 * len(h)], np.uint32) for _, h, m in got]) if got else np.zeros(0, np.uint32)
        least = np.concatenate([tc.restored(m[4 * len(h) :], np.int64) for _, h, m in got]) if got else np.zeros(0, np.int64)
        order = np.argsort(keys)
        keys, seconds, least = keys[order], seconds[order], least[order]
        texts, ids = tc.Texts.from_arrow(docs.column("text")), docs.column("doc_id").to_numpy()
        out: list[list] = [[], [], [], [], [], []]
        for lo, hi in texts.chunks():
            part = texts.rows(lo, hi)
            w = _Words(part)
            mark = np.zeros(len(w.hash) + 1, np.int32)
            if len(keys):
                start, full, second = _windows(w, window)
                at, there = tc.find_pairs(keys, seconds, full, second)
                there &= least[at] < ids[lo:hi][w.doc[start]]
                hit = start[there]
                mark[hit] += 1
                mark[hit + window] -= 1
            gone = np.cumsum(mark)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1] | (w.place[1:] == 0)
            spans = np.concatenate([[0], np.cumsum(begins)])
            for i in range(hi - lo):
                a, b = w.off[i], w.off[i + 1]
                words = part.text(i).split()
                if total[b] > total[a]:
                    words = compress(words, (~gone[a:b]).tolist())
                kept = b" ".join(words)
                for column, x in zip(out[1:], (int(b - a), int(total[b] - total[a]), int(spans[b] - spans[a]), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(x)
        out[0] = bl.shown_ids(docs)
        out[4] = pa.array(out[4], pa.binary()).cast(pa.string())
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, OUT_ARROW, strict=True)], schema=OUT_ARROW)

    return run


def remove_repeated_words(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every word covered by a run of ``window`` words that also starts in a document of smaller id.

    Runs are judged on the input, not on what is left, and never cross documents.
    One row per input row: doc_id, n_words, n_removed, n_spans (maximal removed
    runs), kept_text (kept words joined by one space), kept_sha256 of its UTF-8.

    Null text has no words. A text of fewer than ``window`` words keeps all; very
    long texts are read whole.  Rows with equal ids (ties, repeated rows) never remove
    each other's words; rows with a null id count as after all others.  Other columns
    are ignored.  An empty table gives no rows.
    """
    n = bl.bucket_count(docs.sparkSession)
    held = bl.in_blocks(docs, doc_id, text)
    blocks = lambda: held.groupBy("block")
    anchors = blocks().applyInArrow(_anchors(window, n), bl.LETTER)
    shared = anchors.groupBy("bucket").applyInArrow(bl.shared_hashes(), bl.LETTER)
    windows = blocks().cogroup(shared.groupBy("block")).applyInArrow(_extended(window, n), bl.LETTER)
    earliest = windows.groupBy("bucket").applyInArrow(_earliest, bl.LETTER)
    return blocks().cogroup(earliest.groupBy("block")).applyInArrow(_removed(window), OUT)


def op5_substring_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("n_spans"))


OP5_SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d)),
earlier AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE first < doc_id),
words AS (SELECT doc_id, w[i + 1] AS word, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d)),
judged AS (SELECT words.*, coalesce(words.i - max(earlier.i) OVER (PARTITION BY words.doc_id ORDER BY words.i) < 50, false) AS gone FROM words LEFT JOIN earlier ON earlier.doc_id = words.doc_id AND earlier.i = words.i),
marked AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM judged),
sums AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN sums USING (doc_id)"""
