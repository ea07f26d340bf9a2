"""N-gram language model in a log-frequency Bloom filter.

Counts of n-grams are quantised to levels, 1 + floor(log2(count)), and an n-gram
of level q is put into a Bloom filter q times, as (n-gram, 1) .. (n-gram, q).  A
count is read back by probing level 1, 2 .. until one is missing; errors are one
sided and halve in number with each level.  A level stands for the mean count that
n-grams of its order have there, so that over all n-grams of a level the counts read
back sum to the true ones.  Probabilities are smoothed by absolute discounting,

    P(w | h) = max(c(hw) - d, 0) / c(h) + b * P(w | h'),

down to the word's add-one probability, so a text costs a few probes a word.  The
discount d of an order is n1 / (n1 + 2 n2), of the exact numbers of its n-grams that
occur once and twice.  The weight b depends on the order and on the level of c(h): it is
what the discount takes from the contexts of that level, on average over all tokens of
the training texts, so over these the probabilities of all words sum to 1.  What a token
shows is a function of a few levels, so tokens are counted by these.

The filter is built in pieces by hash bucket, each sized for the n-grams it has.
Pieces of at most ``broadcast_bytes`` together are broadcast to the workers, and those
of one executor map the same files of it.  A larger filter stays where its pieces are: blocks of texts send their distinct
n-grams to the buckets' pieces and get the levels back.
"""

from __future__ import annotations

import math
import mmap
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import blocks as bl
from voxelloom.llm import textcore as tc
from voxelloom.llm.shared import saved

ORDER = 3
LEVELS = 65
#: Bits that a level of an n-gram sets, all in one 64-bit word, and bits of filter for each level: an error rate of about 1/50.
PROBES, BITS = 5, 10.0
#: A filter of up to this size is broadcast.
BROADCAST_BYTES = 256 << 20
#: Parts in which the driver gathers and broadcasts it.
PARTS = 16
#: Bytes before a part's numbers, so that they begin at a multiple of eight in its file, after the seven that pickle puts before many bytes.
PAD = 1
#: Bytes of texts whose n-grams are looked up together, each different one once.
RUN_BYTES = 1 << 20
#: Tokens that a task counts together before it passes them on.
RUN_TOKENS = 1 << 20
#: Bits of an n-gram's hash that are passed on.
NGRAM_BITS = 48
#: Stands for the end of a text; no word hashes to it but by chance.
END = tc.mix(np.array([0x5EED0E4D], tc.U64))[0]

COUNTS = "bucket int, kind int, hashes binary, counts binary"
COUNTS_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
PIECE = "bucket int, tokens long, types long, numbers array<long>, sums array<long>, twos array<long>, filter binary"
PIECE_ARROW = pa.schema([("bucket", pa.int32()), ("tokens", pa.int64()), ("types", pa.int64()), ("numbers", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("twos", pa.list_(pa.int64())), ("filter", pa.binary())])


def _tokens(texts: tc.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and the offsets of the texts."""
    lowered = texts.buf.copy()
    upper = (lowered >= 65) & (lowered <= 90)
    lowered[upper] += 32
    texts = tc.Texts(lowered, texts.off)
    starts, ends, off = texts.words()
    words = texts.span_hashes(starts, ends)
    out_off = off + np.arange(len(off))
    h = np.empty(len(words) + len(texts), tc.U64)
    last = np.zeros(len(h), bool)
    last[out_off[1:] - 1] = True
    h[last], h[~last] = END, words
    return h, out_off


def _ngrams(h: np.ndarray, off: np.ndarray, order: int, least: int = 2):
    """For orders ``least`` to ``order``: hashes of the n-grams within one text, and the place of each one's last token."""
    left, full = np.repeat(off[1:], np.diff(off)) - np.arange(len(h)), h
    for k in range(1, order + 1):
        if k > 1:
            full = tc.then(full[:-1], h[k - 1 :])
        if k >= least:
            at = np.flatnonzero(left[: len(full)] >= k)
            yield _cut(full[at]), at + k - 1


def _cut(value: np.ndarray) -> np.ndarray:
    return (value >> tc.U64(64 - NGRAM_BITS)) << tc.U64(64 - NGRAM_BITS)


def _summed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, tc.U64), np.zeros(0, np.int64))


def _count(order: int, n: int):
    """Counts of the n-grams of every order, in runs of texts, by hash bucket; a batch for each order, so that fewer wait in memory."""

    def letters(kind: int, part: list[np.ndarray]) -> pa.RecordBatch:
        value, count = _summed(part)
        part.clear()
        rows = [(b, kind, tc.pack(value[s]), tc.transposed(count[s].astype(np.uint32))) for b, s in tc.by_bucket(value, n)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(COUNTS_ARROW)], schema=COUNTS_ARROW)

    def run(batches):
        parts: list[list[np.ndarray]] = [[] for _ in range(order)]
        have = 0
        for batch in batches:
            texts = tc.Texts.from_arrow(batch.column("text"))
            for lo, hi in texts.chunks():
                h, off = _tokens(texts.rows(lo, hi))
                parts[0].append(h)
                for part, (value, _) in zip(parts[1:], _ngrams(h, off, order), strict=True):
                    part.append(value)
                have += len(h)
                if have >= RUN_TOKENS:
                    for kind, part in enumerate(parts, 1):
                        yield letters(kind, part)
                    have = 0
        if have:
            for kind, part in enumerate(parts, 1):
                yield letters(kind, part)
        del parts
        tc.release()

    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, tc.U64), np.zeros(0, np.int64)
    value, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(value)
    first = tc.runs(value[order])
    return value[order][first], np.add.reduceat(count[order], first)


def _places(value: np.ndarray, level: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each (n-gram, level), and the bits in it."""
    x = tc.mix(value + tc.U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    at = ((x >> tc.U64(32)) * np.asarray(words, tc.U64) >> tc.U64(32)).astype(np.int64)
    bits = np.zeros(len(x), tc.U64)
    for p in range(PROBES):
        bits |= tc.U64(1) << ((x >> tc.U64(6 * p)) & tc.U64(63))
    return at, bits


def level_of(count: np.ndarray) -> np.ndarray:
    return np.frexp(count.astype(np.float64))[1].astype(np.uint8)


def filter_piece(value: np.ndarray, count: np.ndarray, bits: float = BITS) -> np.ndarray:
    """The filter's words for these n-grams' levels."""
    level = level_of(count)
    out = np.zeros(max(1, math.ceil(level.sum() * bits / 64)), tc.U64)
    for q in range(1, int(level.max(initial=0)) + 1):
        at, added = _places(value[level >= q], q, len(out))
        np.bitwise_or.at(out, at, added)
    return out


def _piece(order: int, bits: float):
    """Of a bucket: its part of the filter, for each order and level the number of n-grams and the sum of their counts, and how many occur twice."""

    def run(table: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for kind, hashes, counts in zip(*(table.column(c).to_pylist() for c in ("kind", "hashes", "counts")), strict=True):
            by.setdefault(kind, []).append((tc.unpack(hashes), tc.restored(counts, np.uint32).astype(np.int64)))
        numbers, sums = np.zeros((2, order, LEVELS), np.int64)
        kinds, twos, tokens, types = [], [], 0, 0
        for k in range(1, order + 1):
            value, count = _merged(by.pop(k, []))
            level = level_of(count)
            numbers[k - 1] = np.bincount(level, minlength=LEVELS)
            sums[k - 1] = np.bincount(level, count, minlength=LEVELS).astype(np.int64)
            twos.append(int((count == 2).sum()))
            if k == 1:
                tokens, types = int(count.sum()), len(count)
            kinds.append((_cut(value), count))
        value, count = (np.concatenate(x) for x in zip(*kinds, strict=True))
        del kinds
        row = [table.column("bucket")[0].as_py(), tokens, types, numbers.ravel().tolist(), sums.ravel().tolist(), twos, filter_piece(value, count, bits).tobytes()]
        del value, count
        tc.release()
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, PIECE_ARROW, strict=True)], schema=PIECE_ARROW)

    return run


class Filter:
    """Pieces of buckets end to end, with each bucket's place and size in words."""

    def __init__(self, n: int, sizes: dict[int, int], data: bytes | bytearray | np.ndarray):
        self.n, self.data = n, data
        size = np.array([sizes.get(b, 0) // 8 for b in range(n)], np.int64)
        self.begin, self.size = np.cumsum(size) - size, size

    def levels(self, value: np.ndarray, most: np.ndarray | int = LEVELS) -> np.ndarray:
        """Levels of n-grams, up to ``most``; 0 for those that aren't there, or whose bucket has no piece here."""
        level = np.zeros(len(value), np.uint8)
        if not len(self.data) or not len(value):
            return level
        words = np.frombuffer(self.data, tc.U64)
        bucket = ((value >> tc.U64(32)) * tc.U64(self.n) >> tc.U64(32)).astype(np.int64)
        most = np.broadcast_to(np.asarray(most, np.uint8), len(value))
        left = np.flatnonzero((self.size[bucket] > 0) & (most > 0))
        if len(left) < len(value):
            value, bucket, most = value[left], bucket[left], most[left]
        size, begin, q = self.size[bucket], self.begin[bucket], 1
        while len(left):
            at, bits = _places(value, q, size)
            on = (words[at + begin] & bits) == bits
            level[left[on]] = q
            on &= most > q
            left, value, size, begin, most = left[on], value[on], size[on], begin[on], most[on]
            q += 1
        return level


def _pickled_at(head: bytes) -> tuple[int, int]:
    """Where the content of one pickled bytes object begins, and its length; 0, 0 if it is anything else."""
    at = 11 if head[2:3] == b"\x95" else 2  # after the protocol, and a frame
    width = {b"C": 1, b"B": 4, b"\x8e": 8}.get(head[at : at + 1], 0)
    start = at + 1 + width
    return (start, int.from_bytes(head[at + 1 : start], "little")) if width and head[:1] == b"\x80" else (0, 0)


def broadcast_numbers(held) -> np.ndarray:
    """The 64-bit numbers of a broadcast of PAD bytes and these.

    They are mapped from the file that Spark keeps of a broadcast for an executor's
    workers, so that these share one copy.  Where there is none (encrypted, or at the
    driver), or they aren't aligned there, as those of less than 64 KB, they are copied.
    """
    path, start, size = getattr(held, "_path", None), 0, 0
    if path is not None and getattr(held, "_sc", None) is None:
        with open(path, "rb") as f:
            start, size = _pickled_at(f.read(32))
            if size and (start + PAD) % 8 == 0 and start + size <= os.fstat(f.fileno()).st_size:
                return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), tc.U64, (size - PAD) // 8, start + PAD)
    return np.frombuffer(held.value[PAD:], tc.U64)


class Parts:
    """A whole filter as broadcast parts of ``step`` buckets each: the buckets' sizes in bytes, then their pieces."""

    def __init__(self, n: int, step: int, parts: list):
        self.n, self.step, self.parts = n, step, parts
        self.held: dict[int, Filter] = {}

    def __reduce__(self):
        return Parts, (self.n, self.step, self.parts)

    def part(self, i: int) -> Filter:
        if i not in self.held:
            numbers, lo = broadcast_numbers(self.parts[i]), i * self.step
            buckets = range(lo, min(lo + self.step, self.n))
            self.held[i] = Filter(self.n, dict(zip(buckets, numbers[: len(buckets)].tolist(), strict=True)), numbers[len(buckets) :])
        return self.held[i]

    def levels(self, value: np.ndarray, most: np.ndarray | int = LEVELS) -> np.ndarray:
        """Of sorted n-grams, which fall into one part after the other."""
        most = np.broadcast_to(np.asarray(most, np.uint8), len(value))
        cut = np.append(np.searchsorted(value, tc.bucket_edges(self.n)[:: self.step]), len(value))
        return np.concatenate([np.zeros(0, np.uint8), *[self.part(i).levels(value[a:b], most[a:b]) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]])


def looked_up(held, value: np.ndarray, most: np.ndarray | int = LEVELS) -> np.ndarray:
    """Levels of n-grams in any order: each different one is looked up once, in order of hash."""
    order = np.argsort(value)
    dealt = value[order]
    first = tc.runs(dealt)
    if not len(first):
        return np.zeros(0, np.uint8)
    most = np.maximum.reduceat(np.broadcast_to(np.asarray(most, np.uint8), len(value))[order], first)
    level = np.empty(len(value), np.uint8)
    level[order] = np.repeat(held.levels(dealt[first], most), np.diff(np.append(first, len(value))))
    return level


class Counts:
    """What the levels of each order stand for, the mean count of the n-grams there, and each order's discount."""

    def __init__(self, numbers: np.ndarray, sums: np.ndarray, twos: np.ndarray):
        plain = np.concatenate([[0.0], 1.5 * 2.0 ** np.arange(LEVELS - 1) - 0.5])
        self.table = np.where(numbers > 0, sums / np.maximum(numbers, 1), plain)
        ones = numbers[:, 1]
        self.discount = np.where(ones > 0, ones / np.maximum(ones + 2.0 * twos, 1), 0.5)

    def of(self, order: int, level: np.ndarray) -> np.ndarray:
        return self.table[order - 1][level]


class Model:
    """A trained model: order, numbers of tokens and types, what levels stand for, and the table of the filter's pieces with their sizes."""

    def __init__(self, order: int, tokens: int, types: int, counts: Counts, buckets: int, pieces: DataFrame, sizes: dict[int, int]):
        self.order, self.tokens, self.types, self.counts, self.buckets, self.pieces, self.sizes = order, tokens, types, counts, buckets, pieces, sizes

    def broadcast(self) -> Parts:
        """The filter at every worker, gathered and broadcast part by part, so that the driver holds one part at a time; its size is checked before."""
        spark, parts = self.pieces.sparkSession, []
        step = -(-self.buckets // PARTS)
        for lo in range(0, self.buckets, step):
            part = self.pieces.filter(F.col("bucket").between(lo, lo + step - 1)).select("bucket", "filter").toArrow().sort_by("bucket")
            sizes = np.array([self.sizes.get(b, 0) for b in range(lo, min(lo + step, self.buckets))], tc.U64)
            data = b"".join([bytes(PAD), sizes.tobytes(), *(piece.as_buffer() for piece in part.column("filter"))])
            parts.append(spark.sparkContext.broadcast(data))
            del part, data
        return Parts(self.buckets, step, parts)


def train(texts: DataFrame, order: int = ORDER, text: str = "text", bits: float = BITS) -> Model:
    """Counts all n-grams of orders 2 to ``order`` within texts, each ended by an end token.

    Null texts are empty and count one end.  Nothing is cut off or sampled.
    """
    n = 2 * bl.block_count(texts.sparkSession)
    rows = texts.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    pieces = saved(rows.mapInArrow(_count(order, n), COUNTS).groupBy("bucket").applyInArrow(_piece(order, bits), PIECE))
    sizes = pieces.select("bucket", "tokens", "types", "numbers", "sums", "twos", F.length("filter").alias("bytes")).toArrow().to_pydict()
    numbers, sums = (np.sum([np.zeros(order * LEVELS, np.int64), *sizes[c]], axis=0).reshape(order, LEVELS) for c in ("numbers", "sums"))
    twos = np.sum([np.zeros(order, np.int64), *sizes["twos"]], axis=0)
    return Model(order, sum(sizes["tokens"]), sum(sizes["types"]), Counts(numbers, sums, twos), n, pieces, dict(zip(sizes["bucket"], sizes["bytes"], strict=True)))


def _asked(order: int, n: int, least: int = 2):
    """The distinct n-grams of a block, by bucket."""

    def run(table: pa.Table) -> pa.Table:
        texts, parts = tc.Texts.from_arrow(table.column("text")), []
        for lo, hi in texts.chunks():
            h, off = _tokens(texts.rows(lo, hi))
            parts.append(np.unique(np.concatenate([value for value, _ in _ngrams(h, off, order, least)])))
        value, block = np.unique(np.concatenate(parts)), bl.block_of(table)
        return bl.letters([(b, block, tc.pack(value[s]), b"") for b, s in tc.by_bucket(value, n)])

    return run


def _answered(n: int):
    """Of a bucket: the levels of the n-grams that blocks ask for, back to them; letters of levels have negative buckets."""

    def run(asked: pa.Table, pieces: pa.Table) -> pa.Table:
        out = []
        for piece in pieces.column("filter").to_pylist()[:1]:
            held = Filter(n, {pieces.column("bucket")[0].as_py(): len(piece)}, piece)
            for block, value, _ in bl.received(asked):
                level = held.levels(value)
                if level.any():
                    out.append((-1 - pieces.column("bucket")[0].as_py(), block, tc.pack(value[level > 0]), level[level > 0].tobytes()))
        return bl.letters(out)

    return run


class _Answers:
    """Levels that came back to a block."""

    def __init__(self, table: pa.Table):
        got = list(bl.received(table))
        self.value = np.concatenate([h for _, h, _ in got]) if got else np.zeros(0, tc.U64)
        self.level = np.concatenate([np.frombuffer(m, np.uint8) for _, _, m in got]) if got else np.zeros(0, np.uint8)
        order = np.argsort(self.value)
        self.value, self.level = self.value[order], self.level[order]

    def levels(self, value: np.ndarray, most: np.ndarray | int = LEVELS) -> np.ndarray:
        at, there = tc.find(self.value, value)
        return np.minimum(np.where(there, self.level[at], 0), most).astype(np.uint8) if len(self.value) else np.zeros(len(value), np.uint8)


def _told(n: int):
    """Each distinct word of a block once, with its count in the block's training texts."""

    def run(table: pa.Table) -> pa.Table:
        texts = tc.Texts.from_arrow(table.column("text"))
        train = ~table.column("held_out").to_numpy(zero_copy_only=False)
        value, count = np.zeros(0, tc.U64), np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in texts.chunks():
            h, off = _tokens(texts.rows(lo, hi))
            weight = np.repeat(train[lo:hi], np.diff(off)).astype(np.int64)
            order = np.argsort(h)
            first = tc.runs(h[order])
            parts.append((h[order][first], np.add.reduceat(weight[order], first)))
        value, count = _merged(parts)
        block = bl.block_of(table)
        return bl.letters([(b, block, tc.pack(value[s]), tc.transposed(count[s].astype(np.uint32))) for b, s in tc.by_bucket(value, n)])

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Of a bucket: back to each block, the counts of its words over all blocks."""
    got = [(block, h, tc.restored(m, np.uint32).astype(np.int64)) for block, h, m in bl.received(table)]
    bucket = table.column("bucket")[0].as_py()
    value, count = _merged([(h, c) for _, h, c in got])
    return bl.letters([(bucket, block, tc.pack(h), tc.transposed(count[np.searchsorted(value, h)])) for block, h, _ in got])


def _bounded(held, value: np.ndarray, at: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Levels of n-grams by the place of their last token, no higher than those of the shorter ones in them, which most errors contradict."""
    most = np.minimum(below[at], below[at - 1])
    value, at, most = value[most > 0], at[most > 0], most[most > 0]
    level = np.zeros(len(below), np.uint8)
    level[at] = looked_up(held, value, most)
    return level


SEEN = "kind int, context int, level int, tokens long"
SEEN_ARROW = pa.schema([("kind", pa.int32()), ("context", pa.int32()), ("level", pa.int32()), ("tokens", pa.int64())])


class _Tally:
    """Tokens of training texts counted, for each order from 2 on, by the levels of h and hw."""

    def __init__(self, order: int):
        self.order, self.tokens = order, np.zeros((order - 1, LEVELS * LEVELS), np.int64)

    def add(self, texts: tc.Texts, held) -> None:
        for lo, hi in texts.chunks(RUN_BYTES):
            h, off = _tokens(texts.rows(lo, hi))
            below = looked_up(held, _cut(h))
            for k, (value, at) in enumerate(_ngrams(h, off, self.order)):
                level = _bounded(held, value, at, below)
                self.tokens[k] += np.bincount(below[at - 1].astype(np.int64) * LEVELS + level[at], minlength=LEVELS * LEVELS)
                below = level

    def columns(self) -> list[pa.Array]:
        kind, both = np.nonzero(self.tokens)
        return [pa.array(c, t) for c, t in ((kind, pa.int32()), (both // LEVELS, pa.int32()), (both % LEVELS, pa.int32()), (self.tokens[kind, both], pa.int64()))]


def _observed_where_they_are(order: int, parts: Parts):
    """Of a task's training texts, with a filter that all workers have."""

    def run(batches):
        tally = _Tally(order)
        for batch in batches:
            tally.add(tc.Texts.from_arrow(batch.column("text")), parts)
        yield pa.RecordBatch.from_arrays(tally.columns(), schema=SEEN_ARROW)
        tc.release()

    return run


def _observed(order: int):
    """Of a block of training texts, with the levels that came back to it."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tally = _Tally(order)
        if docs.num_rows:
            tally.add(tc.Texts.from_arrow(docs.column("text")), _Answers(answers))
        tc.release()
        return pa.Table.from_arrays(tally.columns(), schema=SEEN_ARROW)

    return run


def backoff_weights(seen: np.ndarray, counts: Counts, order: int) -> np.ndarray:
    """Weights of the shorter context by order and level of c(h), from training tokens by order and the levels of h and hw.

    Of a context's c(h) tokens the discount takes d for each different one.  An n-gram
    that occurs c times is 1 / c of a different one at each of its tokens, so the mean of
    d / c over a level's tokens is the share taken.  A level without tokens takes its
    neighbours'; without a context all goes to the shorter one.
    """
    out = np.ones((order - 1, LEVELS))
    for k in range(order - 1):
        times = seen[k, :, 1:].astype(float)
        taken = times @ (counts.discount[k + 1] / np.maximum(counts.table[k + 1, 1:], 1.0))
        n = times.sum(axis=1)
        known = np.flatnonzero(n[1:] > 0) + 1
        if len(known):
            out[k, 1:] = np.interp(np.arange(1, LEVELS), known, taken[known] / n[known])
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(order: int, tokens: int, types: int, counts: Counts, weights: np.ndarray, parts: Parts | None):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        out = of_block(docs, words) if docs.num_rows else SCORES_ARROW.empty_table()
        # A worker that waits for its next task holds nothing of the last block.
        tc.release()
        return out

    def of_block(docs: pa.Table, words: pa.Table) -> pa.Table:
        answer = np.array(words.column("bucket").to_pylist(), np.int64) < 0
        held = parts if parts is not None else _Answers(words.filter(pa.array(answer)))
        got = list(bl.received(words.filter(pa.array(~answer))))
        known = np.concatenate([h for _, h, _ in got])
        total = np.concatenate([tc.restored(m, np.int64) for _, _, m in got])
        place = np.argsort(known)
        known, total = known[place], total[place]
        texts = tc.Texts.from_arrow(docs.column("text"))
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for lo, hi in texts.chunks(RUN_BYTES):
            h, off = _tokens(texts.rows(lo, hi))
            count = total[np.searchsorted(known, h)]
            base = np.log10((count + 1.0) / (tokens + (types + 1.0)))
            p = (count + 1.0) / (tokens + types + 1.0)
            # Of the order before, by the place of its last token: count and level.
            context, below = count.astype(np.float64), level_of(count)
            for k, (value, at) in enumerate(_ngrams(h, off, order)):
                level = _bounded(held, value, at, below)
                read, back = counts.of(k + 2, level), weights[k][below[at - 1]]
                p[at] = np.minimum(1.0, np.maximum(read[at] - counts.discount[k + 1], 0.0) / np.maximum(context[at - 1], 1.0) + back * p[at])
                context, below = read, level
            cut = off[:-1]
            for col, x in zip(cols, (np.diff(off), np.add.reduceat((count > 0).astype(np.int64), cut), np.add.reduceat(base, cut), np.add.reduceat(np.log10(p), cut)), strict=True):
                col.append(x)
        done = [np.concatenate(c) for c in cols]
        return pa.Table.from_arrays([bl.shown_ids(docs), docs.column("held_out").combine_chunks(), *[pa.array(c, f.type) for c, f in zip(done, list(SCORES_ARROW)[2:], strict=True)]], schema=SCORES_ARROW)

    return run


def fit(model: Model, texts: DataFrame, parts: Parts | None = None, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights of shorter contexts from all training texts; without ``parts`` the filter is probed where its pieces are."""
    n, order = model.buckets, model.order
    rows = texts.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    if parts is not None:
        seen = rows.select("text").mapInArrow(_observed_where_they_are(order, parts), SEEN)
    else:
        few = bl.partitions(texts.sparkSession)
        held = rows.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(few)).cast("int").alias("block")).repartition(few, "block")
        asked = held.groupBy("block").applyInArrow(_asked(order, n, 1), bl.LETTER)
        answers = asked.groupBy("bucket").cogroup(model.pieces.select("bucket", "filter").groupBy("bucket")).applyInArrow(_answered(n), bl.LETTER)
        seen = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_observed(order), SEEN)
    tokens = np.zeros((order - 1, LEVELS, LEVELS), np.int64)
    for r in seen.groupBy("kind", "context", "level").agg(F.sum("tokens").alias("tokens")).collect():
        tokens[r.kind, r.context, r.level] = r.tokens
    return backoff_weights(tokens, model.counts, order)


def score(docs: DataFrame, held_out, order: int = ORDER, weights: np.ndarray | None = None, broadcast_bytes: int = BROADCAST_BYTES, bits: float = BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows for which ``held_out`` is not true and score all rows.

    Texts are lower-cased in A-Z only; tokens are runs without white space, then one
    end.  One row per input row: doc_id, held_out, n_tokens, n_known (tokens that
    training has), base_score (sum of log10 of add-one word probabilities, from
    exact counts over all training rows), score (log10 probability under the
    n-gram model), train_tokens, train_types.  ``weights`` are fitted unless given;
    ``bits`` of filter for each level of an n-gram set its error rate.

    Null and empty texts are one end token.  Where no row trains, every probability
    is that of an empty corpus.  Null ids are allowed; repeated rows are counted
    and scored each, and get equal results.  Very long texts are taken whole.  Other
    columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = bl.bucket_count(spark)
    flagged = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(flagged.filter(~F.col("held_out")), order, bits=bits)
    parts = model.broadcast() if sum(model.sizes.values()) <= broadcast_bytes else None
    if weights is None:
        weights = fit(model, flagged.filter(~F.col("held_out")), parts)
    held = flagged.withColumns({"doc_id": bl.known_id(F.col("doc_id")), "nameless": F.col("doc_id").isNull()}).withColumn("block", bl.block_number(spark)).repartition(bl.partitions(spark), "block")
    told = held.groupBy("block").applyInArrow(_told(n), bl.LETTER)
    answers = told.groupBy("bucket").applyInArrow(_totals, bl.LETTER)
    if parts is None:
        asked = held.groupBy("block").applyInArrow(_asked(order, model.buckets), bl.LETTER)
        answers = answers.unionByName(asked.groupBy("bucket").cogroup(model.pieces.select("bucket", "filter").groupBy("bucket")).applyInArrow(_answered(model.buckets), bl.LETTER))
    out = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(order, model.tokens, model.types, model.counts, weights, parts), SCORES)
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumn("train_types", F.lit(model.types).cast("long"))


def op1_lm_scoring(docs: DataFrame) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(docs, held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "train_types")
