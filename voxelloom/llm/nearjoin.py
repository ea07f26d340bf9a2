"""Self-join of documents on the Jaccard similarity of their word shingles.

Candidates come from bands of MinHash values.  Of each candidate pair the
signatures are compared a few values at a time; with a uniform prior and m of n
values equal, the similarity's posterior is Beta(m + 1, n - m + 1), and the pair
is dropped once its posterior probability of reaching the threshold falls below
a tolerance.  What survives is verified on the whole shingle sets.

Pairs are never rows.  Documents of one shingle set are one class.  Survivors
link classes into candidate components, as stars.  In a large band group all rows are
first compared with a few pivots; only rows that are not linked with most others
that way are compared with all, so a group of copies costs as much as it has rows.
Within a component all pairs of classes are verified by products of incidence matrices,
of which only each class's number of links and its place in the exact components leave
the task: that number is of pairs, and the products are as many.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm import blocks as bl
from voxelloom.llm import textcore as tc
from voxelloom.llm.components import components
from voxelloom.llm.shared import join_groups, saved

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values; the first BANDS * ROWS make the bands.  At similarity 0.8 no band in common has probability 5e-6.
VALUES, BANDS, ROWS = 128, 24, 4
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Classes in one verifying task; larger components are cut into pairs of blocks of this size.
GROUP = 2048
#: Groups of a few times LEAST rows or more are cut into blocks already, up to SPREAD of them, to be shared out among tasks.
LEAST, SPREAD = 256, 12
#: Classes of a band in one comparing task; larger groups are compared with PIVOTS of their rows first.
BAND_GROUP, PIVOTS = 512, 16
COLUMNS = 2048

SKETCH = "doc_id long, nameless boolean, text_hash long, node long, check long, n_shingles long, signature binary"
SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("nameless", pa.bool_()), ("text_hash", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("n_shingles", pa.int64()), ("signature", pa.binary())])


def shingles(texts: tc.Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their offsets.

    A text of fewer words than a shingle, but any, has one shingle: all its words.
    """
    starts, ends, off = texts.words()
    h = texts.span_hashes(starts, ends)
    doc = tc.owner(off)
    left = off[doc + 1] - np.arange(len(h)) if len(h) else doc
    full = tc.rolling(h, size)
    at = np.flatnonzero(left[: len(full)] >= size)
    docs, values = [doc[at]], [full[at]]
    count = np.diff(off)
    for short in range(1, size):
        which = np.flatnonzero(count == short)
        if len(which):
            values.append(tc.rolling(h, short)[off[which]])
            docs.append(which)
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int64)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, tc.U64)
    np.cumsum(values, out=total[1:], dtype=tc.U64)
    return total[off[1:]] - total[off[:-1]]


def set_keys(value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, the same for equal sets."""
    size = np.diff(off).astype(tc.U64)
    one = tc.mix(_sums(tc.mix(value + tc.U64(1)), off) + size)
    two = tc.mix(_sums(tc.mix(value ^ tc.U64(0xA5A5A5A5A5A5A5A5)), off) ^ size)
    return one.view(np.int64), two.view(np.int64)


@cache
def _seeds(values: int) -> tuple[np.ndarray, np.ndarray]:
    s = tc.mix(np.arange(1, 2 * values + 1, dtype=tc.U64) * tc.U64(0x9E3779B97F4A7C15))
    return s[:values].astype(np.uint32), s[values:].astype(np.uint32) | np.uint32(1)


def signatures(value: np.ndarray, off: np.ndarray, values: int = VALUES) -> np.ndarray:
    """MinHash values of each set (rows); an empty set's are all the largest value."""
    out = np.full((len(off) - 1, values), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        x = (value >> tc.U64(32)).astype(np.uint32)
        add, times = _seeds(values)
        for k in range(values):
            v = x ^ add[k]
            v *= times[k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v ^= v >> np.uint32(12)
            v *= np.uint32(0x297A2D39)
            v ^= v >> np.uint32(15)
            out[full, k] = np.minimum.reduceat(v, off[full])
    return out


def needed_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, values: int = VALUES, step: int = STEP) -> list[int]:
    """For n = step, 2 * step ..: the fewest matches with which a pair stays.

    P(Beta(m + 1, n - m + 1) >= t) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, values + 1, step):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out.append(m)
                break
        else:
            out.append(n)
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, needed: list[int], step: int = STEP) -> np.ndarray:
    """Which pairs of rows stay through all comparisons."""
    left = np.arange(len(a))
    match = np.zeros(len(a), np.int32)
    for k, least in enumerate(needed):
        part = slice(k * step, (k + 1) * step)
        match = match + (sig[a[left], part] == sig[b[left], part]).sum(axis=1)
        on = match >= least
        left, match = left[on], match[on]
        if not len(left):
            break
    return left


class _Roots:
    """Disjoint sets of small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def all(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


def _link(sig: np.ndarray, side: np.ndarray | None, needed: list[int]) -> np.ndarray:
    """Roots of the rows of one group under surviving pairs; with sides, only pairs across them are compared.

    Rows of one component need no comparing, so each round compares one row with
    all rows outside its component.
    """
    n = len(sig)
    root = np.arange(n)
    for i in range(n):
        other = np.flatnonzero((root != root[i]) & (np.arange(n) > i if side is None else side != side[i]))
        if len(other):
            hit = other[surviving(sig, np.full(len(other), i), other, needed)]
            if len(hit):
                merged = np.isin(root, np.append(root[hit], root[i]))
                root[merged] = root[merged].min()
        if not (root != root[0]).any():
            break
    return root


def _grouped(key: np.ndarray):
    """Row numbers of each group of equal keys."""
    order = np.argsort(key, kind="stable")
    first = tc.runs(key[order])
    return np.split(order, first[1:]) if len(first) else []


def _candidate_links(needed: list[int]):
    """Of many band groups: stars (a, b) of the rows that surviving pairs link."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        side = table.column("side").to_numpy()
        key = table.column("key").to_numpy()
        data = table.column("signature").combine_chunks()
        sig = np.frombuffer(b"".join(data.to_pylist()), np.uint32).reshape(len(node), -1)
        order = np.argsort(key, kind="stable")
        first = tc.runs(key[order])
        size = np.diff(np.append(first, len(order)))
        a, b = [], []
        # Small groups together: each row with the d-th row after it.
        small = np.repeat(size <= 64, size)
        within = np.arange(len(order)) - np.repeat(first, size)
        last = np.repeat(size, size)
        across = side >= 0
        for d in range(1, 64):
            at = np.flatnonzero(small & (within + d < last))
            if not len(at):
                break
            x, y = order[at], order[at + d]
            on = (node[x] != node[y]) & (~across[x] | (side[x] != side[y]))
            x, y = x[on], y[on]
            for lo in range(0, len(x), 200_000):
                kept = surviving(sig, x[lo : lo + 200_000], y[lo : lo + 200_000], needed) + lo
                a.append(node[x[kept]])
                b.append(node[y[kept]])
        for f, s in zip(first[size > 64], size[size > 64], strict=True):
            rows = order[f : f + s]
            root = _link(sig[rows], side[rows] if across[rows[0]] else None, needed)
            on = root != np.arange(len(rows))
            a.append(node[rows[on]])
            b.append(node[rows[root[on]]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def intersections(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sorted sets; a set with itself isn't counted whole."""
    every = sets + (others or [])
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    value, column, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    # What one set alone has is in no intersection.
    column = (np.cumsum(count > 1) - 1)[column]
    on = (count > 1)[np.searchsorted(value, np.concatenate(every))]
    owner, column = owner[on], column[on]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(others or sets)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, COLUMNS):
        s = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        m = np.zeros((len(every), min(COLUMNS, width - lo)), np.float32)
        m[owner[s], column[s] - lo] = 1
        out += m[: len(sets)] @ (m[len(sets) :] if others else m).T
    return out


def _verified(threshold: float):
    """Of many candidate components: each class's links and its root, by whole shingle sets."""

    def run(table: pa.Table) -> pa.Table:
        node, side, key = (table.column(c).to_numpy() for c in ("node", "side", "key"))
        data = table.column("shingles").to_pylist()
        nodes, roots, links = [], [], []
        for rows in _grouped(key):
            mine = np.unique(node[rows], return_index=True)[1]
            rows = rows[np.sort(mine)]
            sets = [tc.unpack(data[i]) for i in rows]
            size = np.array([len(s) for s in sets], np.float64)
            cross = side[rows[0]] >= 0
            if cross:
                left, right = np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == 1)
            else:
                left = right = np.arange(len(rows))
            if not len(left) or not len(right):
                continue
            both = intersections([sets[i] for i in left], [sets[i] for i in right] if cross else None)
            linked = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-6
            if not cross:
                np.fill_diagonal(linked, False)
            count = np.zeros(len(rows), np.int64)
            count[left] += linked.sum(axis=1)
            if cross:
                count[right] += linked.sum(axis=0)
            root = np.arange(len(rows))
            for i, row in enumerate(linked):
                hit = right[row]
                if len(hit):
                    merged = np.isin(root, np.append(root[hit], root[left[i]]))
                    root[merged] = root[merged].min()
            nodes.append(node[rows])
            roots.append(node[rows[root]])
            links.append(count)
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, roots, links)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "b", "links"), cols, strict=True)})

    return run


def _sketches(size: int, values: int):
    def run(batches):
        for batch in batches:
            texts, ids, hashes = tc.Texts.from_arrow(batch.column("text")), batch.column("doc_id"), batch.column("text_hash")
            for lo, hi in texts.chunks():
                value, off = shingles(texts.rows(lo, hi), size)
                one, two = set_keys(value, off)
                sig = signatures(value, off, values)
                cols = [ids.slice(lo, hi - lo), batch.column("nameless").slice(lo, hi - lo), hashes.slice(lo, hi - lo), pa.array(one), pa.array(two), pa.array(np.diff(off)), pa.array([r.tobytes() for r in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, SKETCH_ARROW, strict=True)], schema=SKETCH_ARROW)

    return run


SETS_ARROW = pa.schema([("node", pa.int64()), ("component", pa.int64()), ("members", pa.int64()), ("shingles", pa.binary())])


def _sets(size: int):
    """Shingle sets of the joined texts whose set is the class's."""

    def run(batches):
        for batch in batches:
            texts = tc.Texts.from_arrow(batch.column("text"))
            node = batch.column("node").to_numpy()
            for lo, hi in texts.chunks():
                value, off = shingles(texts.rows(lo, hi), size)
                same = np.flatnonzero(set_keys(value, off)[0] == node[lo:hi])
                cols = [batch.column(c).slice(lo, hi - lo).take(pa.array(same)) for c in ("node", "component", "members")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([tc.pack(value[off[i] : off[i + 1]]) for i in same], pa.binary())], schema=SETS_ARROW)

    return run


def _dealt(rows: DataFrame, group, count, item, most: int, n: int) -> DataFrame:
    """Rows with their comparing task: bucket, key and side.

    A small group is one task with side -1.  A larger one is cut into blocks of up to
    about ``most`` rows by hash, and each pair of blocks is a task, sides 0 and 1; a
    block with itself is one with side -1.
    """
    pieces = F.greatest(F.ceil(count / F.lit(most)), F.least(F.ceil(count / F.lit(min(most, LEAST))), F.lit(SPREAD))).cast("int")
    mine = F.pmod(F.xxhash64(item, F.lit(7)), F.col("pieces")).cast("int")
    return (
        rows.withColumn("pieces", pieces)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("key", F.when(F.col("pieces") == 1, group).otherwise(F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other"))))
        .withColumn("side", F.when(F.col("mine") == F.col("other"), F.lit(-1)).when(F.col("mine") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).cast("int"))
        .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
        .drop("pieces", "mine", "other")
    )


LINKED = "band long, in_band long, pivots array<struct<node: long, root: long, signature: binary>>"


def _pivots_linked(needed: list[int]):
    """Of each large group: its pivots with the smallest one that each is linked with."""

    def run(batches):
        for batch in batches:
            out = []
            for pivots in batch.column("pivots").to_pylist():
                sig = np.frombuffer(b"".join(p["signature"] for p in pivots), np.uint32).reshape(len(pivots), -1)
                root = _link(sig, None, needed)
                out.append([{"node": p["node"], "root": pivots[r]["node"], "signature": p["signature"]} for p, r in zip(pivots, root.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("band", "in_band")], pa.array(out, pa.list_(pa.struct([("node", pa.int64()), ("root", pa.int64()), ("signature", pa.binary())])))], names=["band", "in_band", "pivots"])

    return run


def _mates(needed: list[int]):
    """Of rows of large groups: the root of the first of their group's pivots with which the pair stays, or null."""

    def run(batches):
        for batch in batches:
            band, node = batch.column("band").to_numpy(), batch.column("node").to_numpy()
            mate, found = np.zeros(len(node), np.int64), np.zeros(len(node), bool)
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(len(node), -1) if len(node) else np.zeros((0, VALUES), np.uint32)
            for rows in _grouped(band):
                for p in batch.column("pivots")[int(rows[0])].as_py():
                    left = rows[~found[rows]]
                    if not len(left):
                        break
                    both = np.concatenate([sig[left], np.frombuffer(p["signature"], np.uint32)[None]])
                    hit = left[surviving(both, np.arange(len(left)), np.full(len(left), len(left)), needed)]
                    mate[hit], found[hit] = p["root"], True
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("band"), batch.column("in_band"), pa.array(mate, mask=~found)], names=["node", "band", "in_band", "mate"])

    return run


def _large_groups(rows: DataFrame, classes: DataFrame, needed: list[int], group: int, n: int, total: int) -> tuple[DataFrame, DataFrame]:
    """Of (node, band, in_band) of large groups: stars (a, b) with pivots, and the tasks of what pivots leave open.

    Rows linked with the same pivot as most others of their group need no comparing
    among each other; the other rows are compared with these and with one another.
    """
    signed = lambda df: df.join(classes.select("node", "signature").hint("merge"), "node")
    rank = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("node", F.lit(11)), "node"))
    picked = signed(rows.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).drop("rank"))
    # Up to PIVOTS in a list.
    pivots = picked.groupBy("band", "in_band").agg(F.sort_array(F.collect_list(F.struct("node", "signature"))).alias("pivots"))
    linked = saved(pivots.mapInArrow(_pivots_linked(needed), LINKED))
    placed = join_groups(signed(rows), linked.select("band", F.col("in_band").alias("n"), "pivots"), "band", "n", total, "node")
    mated = saved(placed.select("node", "band", "in_band", "signature", "pivots").mapInArrow(_mates(needed), "node long, band long, in_band long, mate long"))
    stars = mated.filter("mate IS NOT NULL").select(F.col("node").alias("a"), F.col("mate").alias("b"))
    roots = linked.select(F.explode("pivots").alias("p")).select(F.col("p.node").alias("a"), F.col("p.root").alias("b"))
    sizes = mated.filter("mate IS NOT NULL").groupBy("band", "mate").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "mate")).alias("main")).select("band", F.col("main.mate").alias("main"), F.col("main.n").alias("n_main"))
    every = linked.select("band", "in_band").join(main.hint("merge"), "band", "left").withColumn("n_main", F.coalesce("n_main", F.lit(0).cast("long"))).withColumn("n_other", F.col("in_band") - F.col("n_main")).filter("n_other > 0")
    open_rows = join_groups(mated.select("node", "band", "mate"), every, "band", "in_band", total, "node").filter("n_other IS NOT NULL")
    in_main = F.col("mate").eqNullSafe(F.col("main")) & F.col("main").isNotNull()
    others, mains = open_rows.filter(~in_main), open_rows.filter(in_main)
    among = _dealt(others, F.col("band"), F.col("n_other"), F.col("node"), group, n)
    # Each block of the other rows with each block of the main ones.
    block = lambda k: F.pmod(F.xxhash64("node", F.lit(13)), F.ceil(F.col(k) / F.lit(group))).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.ceil(F.col(k) / F.lit(group)).cast("int") - 1))
    across = others.filter("n_main > 0").withColumn("one", block("n_other")).withColumn("two", each("n_main")).withColumn("side", F.lit(0))
    across = across.unionByName(mains.withColumn("two", block("n_main")).withColumn("one", each("n_other")).withColumn("side", F.lit(1)))
    across = across.withColumn("key", F.xxhash64("band", "one", "two", F.lit(17))).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    columns = ["bucket", "key", "side", "node"]
    return stars.unionByName(roots), signed(among.select(*columns).unionByName(across.select(*columns)))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, tolerance: float = TOLERANCE, group: int = GROUP, band_group: int = BAND_GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents linked by Jaccard similarity of word shingles of ``threshold`` or more.

    One row per input row: doc_id, class_id (smallest doc_id of all documents it is
    linked with, over any number of links; its own if none), same_id (smallest
    doc_id with the same shingle set), n_same (documents with that set, itself
    included), n_links (other shingle sets within the threshold of its own),
    n_shingles, is_first (the row of its class with the smallest doc_id), text_hash.

    Words are runs without white space, unchanged.  A text of 1 to size - 1 words
    has one shingle; null and empty texts have none, equal one another only, and
    have no links.  Very long texts are read whole.  Repeated rows get equal results;
    null ids are after all others and come back as null; of different texts of one id
    the first is that of least hash.  Other columns are ignored.  An empty table gives
    no rows.

    A pair at the threshold is missed with probability below 1e-5 (no common band)
    plus the tolerance (dropped early); links that are found are exact.
    """
    n = 4 * bl.partitions(docs.sparkSession)
    ident = F.col(f"`{doc_id}`").cast("long")
    plain = docs.select(bl.known_id(ident).alias("doc_id"), ident.isNull().alias("nameless"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketches = saved(plain.mapInArrow(_sketches(size, VALUES), SKETCH))
    classes = saved(
        sketches.groupBy("node").agg(F.min(F.struct("doc_id", "nameless", "text_hash")).alias("same"), F.count(F.lit(1)).alias("n_same"), F.max("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"))
    )
    needed = needed_matches(threshold, tolerance)
    band = lambda b: F.xxhash64(F.substring("signature", 4 * ROWS * b + 1, 4 * ROWS), F.lit(b))
    keyed = classes.filter("n_shingles > 0").select("node", F.explode(F.array(*[band(b) for b in range(BANDS)])).alias("band"))
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("in_band")).filter("in_band > 1")
    grouped = saved(keyed.join(shared.hint("merge"), "band").select("node", "band", "in_band"))
    rows = grouped.filter(F.col("in_band") <= band_group)
    tasks = rows.join(classes.select("node", "signature").hint("merge"), "node").select(F.pmod(F.xxhash64("band"), F.lit(n)).cast("int").alias("bucket"), F.col("band").alias("key"), F.lit(-1).alias("side"), "node", "signature")
    large = grouped.filter(F.col("in_band") > band_group)
    total = large.count()
    if total:
        stars, left = _large_groups(large, classes, needed, band_group, n, total)
        found = tasks.unionByName(left.select(*tasks.columns)).groupBy("bucket").applyInArrow(_candidate_links(needed), "a long, b long").unionByName(stars)
    else:
        found = tasks.groupBy("bucket").applyInArrow(_candidate_links(needed), "a long, b long")
    component = saved(components(saved(found.distinct())))
    sizes = component.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    # A component or class may have a third of all rows.
    spread = join_groups(component, sizes, "label", "members", component.count(), "node")
    wanted = saved(spread.join(classes.select("node", "same").hint("merge"), "node").select("node", F.col("label").alias("component"), "members", "same.*"))
    texts = wanted.hint("merge").join(plain, ["doc_id", "nameless", "text_hash"]).select("node", "component", "members", "text")
    sets = texts.mapInArrow(_sets(size), "node long, component long, members long, shingles binary")
    tasks = _dealt(sets, F.col("component"), F.col("members"), F.col("node"), group, n).select("bucket", "key", "side", "node", "shingles")
    exact = saved(tasks.groupBy("bucket").applyInArrow(_verified(threshold), "a long, b long, links long"))
    links = exact.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    label = saved(components(exact.select("a", "b")))
    placed = saved(classes.select("node", "same", "n_same", "n_shingles").join(links.hint("merge"), "node", "left").join(label.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = placed.groupBy("label").agg(F.min("same").alias("first"), F.count(F.lit(1)).alias("n_label"))
    shown = lambda c: F.when(~F.col(f"{c}.nameless"), F.col(f"{c}.doc_id"))
    named = saved(join_groups(placed, least, "label", "n_label", placed.count(), "node").select("node", shown("same").alias("same_id"), "n_same", "n_shingles", shown("first").alias("class_id"), F.col("first.text_hash").alias("first_hash"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    total = named.agg(F.sum("n_same")).first()[0] or 0
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("first_hash"))
    rows = sketches.select(F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "text_hash", "node")
    return join_groups(rows, named, "node", "n_same", total, "doc_id", apart=F.lit(True)).select("doc_id", "class_id", "same_id", "n_same", "n_links", "n_shingles", first.alias("is_first"), "text_hash")


def first_rows(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each class the input row of smallest doc_id, as often as it is repeated; of different texts of one doc_id one.

    Null ids are after all others, null texts empty; very long texts are read whole; all
    columns are kept as they are; an empty table gives no rows.
    """
    first = near_classes(docs, threshold, size, doc_id=doc_id, text=text).filter("is_first").select(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash")).distinct()
    rows = docs.select(F.struct(docs["*"]).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("own_hash"))
    return rows.join(first.hint("merge"), F.col("own_id").eqNullSafe(F.col("first_id")) & (F.col("own_hash") == F.col("first_hash")), "left_semi").select("row.*")


def op9_ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    return near_classes(docs).drop("is_first", "text_hash")


OP9_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i:i + {SHINGLE - 1}], ' ') for i in range(1, len(w) - {SHINGLE - 2})])) END AS g FROM d),
c AS (SELECT md5(array_to_string(g, chr(10))) AS node, min(doc_id) AS same_id, count(*) AS n_same, any_value(g) AS g, CAST(any_value(len(g)) AS BIGINT) AS n FROM s GROUP BY 1),
x AS (SELECT node, n, unnest(g) AS shingle FROM c),
pairs AS (SELECT a.node AS a, b.node AS b, count(*) AS both_have, any_value(a.n + b.n) AS n FROM x a JOIN x b ON b.shingle = a.shingle AND b.node > a.node WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 5 * both_have >= 4 * (n - both_have)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT DISTINCT a AS node, a AS root FROM near UNION SELECT near.b, reached.root FROM reached JOIN near ON near.a = reached.node),
label AS (SELECT node, min(root) AS label FROM reached GROUP BY 1),
class AS (SELECT c.node, min(c.same_id) OVER (PARTITION BY coalesce(label, c.node)) AS class_id FROM c LEFT JOIN label USING (node))
SELECT s.doc_id, class_id, same_id, n_same, (SELECT count(*) FROM near WHERE near.a = c.node) AS n_links, c.n AS n_shingles
FROM s JOIN c ON c.node = md5(array_to_string(s.g, chr(10))) JOIN class ON class.node = c.node"""
