"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are turned by rotations that are learned so that the signs of their coordinates
lose little (iterative quantisation), and the signs are their codes.  A code is cut into
SUBSTRINGS, each of which is indexed.  If two codes differ in at most r bits, they differ
in at most r / SUBSTRINGS bits of one of them: a query asks each index for the values
within that distance, keeps the codes within r bits in whole, and ranks their vectors by
true distance.

An index is dealt into blocks, ranges of a substring's values with about equally many
rows; a value that very many vectors share is spread over several.  A query goes to the
blocks whose common leading bits don't rule it out.  A block's rows come before its
queries, which pass by in batches, so a task holds one block, however many ask.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm.shared import saved

BITS, SUBSTRINGS = 128, 4
NEAREST = 10
#: Different vectors that rotations and radius are fitted on at most, numbers in all of them, and how many of them ask for the radius.
SAMPLE, SAMPLE_NUMBERS, ASKING = 20_000, 1 << 22, 256
#: The radius reaches this share of the sample's true neighbours.
REACHED = 0.985
STEPS, SEED = 25, 7
#: Vectors of a block, about.
BLOCK = 20_000
#: Stands for a null id: after all others.
NO_ID = (1 << 63) - 1
_ROW = "block int, kind int, ids binary, code binary, vec binary"
_ROW_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("code", pa.binary()), ("vec", pa.binary())])
_HIT = "query_id long, query binary, vec_id long, score double"
_HIT_ARROW = pa.schema([("query_id", pa.int64()), ("query", pa.binary()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Binary vectors of one dimension as rows."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


class Model:
    """Rotations, the radius, and the edges of the blocks of each substring."""

    def __init__(self, sample: np.ndarray, total: int, blocks: int, bits: int = BITS, substrings: int = SUBSTRINGS, nearest: int = NEAREST):
        rng = np.random.default_rng(SEED)
        self.bits, self.substrings = bits, substrings
        self.mean = sample.mean(0)
        x = (sample - self.mean).astype(float)
        self.scale = float(np.abs(x).max()) or 1.0
        x /= self.scale
        _, _, axes = np.linalg.svd(x.T @ x if len(x) > x.shape[1] else x, full_matrices=False)
        parts = []
        while sum(p.shape[1] for p in parts) < bits:
            kept = axes[:bits].T
            parts.append(kept @ _learned(x @ kept, rng))
        self.rotation = np.concatenate(parts, 1)[:, :bits]
        codes = self.codes(sample)
        self.radius = self._radius(sample, codes, total, nearest)
        values = np.sort(codes.view(np.uint32), 0)
        self.edges = [values[np.arange(1, blocks) * len(values) // blocks, j] for j in range(substrings)]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """A row of bits / 8 bytes for each vector."""
        return np.packbits((vectors - self.mean) / self.scale @ self.rotation > 0, axis=1)

    def _radius(self, sample: np.ndarray, codes: np.ndarray, total: int, nearest: int) -> int:
        """Bits by which the nearest of the sample's vectors differ; of a sample of a tenth, the nearest tenth as many."""
        n = len(sample)
        if n < 2:
            return self.bits
        near = min(max(1, round(nearest * n / total)), n - 1)
        apart = []
        for i in range(0, n, -(-n // ASKING)):
            d = ((sample - sample[i]) ** 2).sum(1)
            d[i] = np.inf
            apart.append(differing(codes[np.argpartition(d, near - 1)[:near]], codes[i]))
        return int(np.quantile(np.concatenate(apart), REACHED, method="higher"))

    def blocks_of(self, codes: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The block of each code's substrings; values at an edge are dealt to the blocks that it parts, which may be many."""
        out = np.empty((len(codes), self.substrings), np.int32)
        for j, (edges, value) in enumerate(zip(self.edges, codes.view(np.uint32).T, strict=True)):
            low, high = np.searchsorted(edges, value, "left"), np.searchsorted(edges, value, "right")
            out[:, j] = j * (len(edges) + 1) + low + salt % (high - low + 1)
        return out

    def asked(self, code: np.ndarray, reach: list[int]) -> list[int]:
        """Blocks that may have a value within the reach of one of a code's substrings."""
        out = []
        for j, (edges, value) in enumerate(zip(self.edges, code.view(np.uint32), strict=True)):
            low, high = np.append(np.uint32(0), edges), np.append(edges, np.uint32(0xFFFFFFFF))
            free = np.frexp((low ^ high).astype(float))[1].astype(np.uint64)  # bits below the common leading ones
            least = np.bitwise_count((low ^ value).astype(np.uint64) >> free)
            out += (j * len(low) + np.flatnonzero(least.astype(np.int64) <= reach[j])).tolist()
        return out


def _learned(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix that turns rows near to corners of a cube."""
    turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(STEPS):
        u, _, v = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
        turn = (u @ v).T
    return turn


def differing(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(1, dtype=np.int64)


def reach_of(radius: int, substrings: int) -> list[int]:
    """By substring: codes within the radius are within one of these; -1 asks nothing."""
    t, more = divmod(radius, substrings)
    return [t if j <= more else t - 1 for j in range(substrings)]


def packed(rows: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, str]:
    """(vec_id, dim, vec) of rows whose vector counts, and the numbers' kind; of both zeros one stays."""
    element = rows.schema[vector].dataType.elementType.simpleString()
    kind, to = ("<f4", "float") if element == "float" else ("<f8", "double")

    def run(batches):
        for batch in batches:
            ids, lists = batch.column("vec_id"), batch.column("v")
            flat = lists.flatten()
            off = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
            values = flat.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # nulls become NaN
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            set_ = np.append(0, np.cumsum(values != 0))
            good = np.flatnonzero((bad[off[1:]] == bad[off[:-1]]) & (set_[off[1:]] > set_[off[:-1]]))
            data = np.ascontiguousarray(values, kind).tobytes()
            size = np.dtype(kind).itemsize
            # A row that repeats another of its batch stays behind: no more than one a batch travels.
            once = {(ids[i].as_py(), data[off[i] * size : off[i + 1] * size]): i for i in reversed(good.tolist())}
            at = np.array(list(once.values()), np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.diff(off)[at].astype(np.int32)), pa.array([v for _, v in once], pa.binary())], names=["vec_id", "dim", "vec"])

    v = F.col(f"`{vector}`").cast(f"array<{to}>")
    given = rows.select(F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v")).filter("v IS NOT NULL")
    return given.mapInArrow(run, "vec_id long, dim int, vec binary"), kind


def fitted(vectors: DataFrame, kind: str, total: int, dim: int, blocks: int, **options) -> Model:
    """A model of up to SAMPLE different vectors (fewer of many dimensions), those of least hash; about so many leave their tasks."""
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // max(dim, 1)))
    share = min(1.0, most / max(total, 1))
    draw = F.xxhash64("vec")
    drawn = vectors.filter(F.pmod(draw, F.lit(1 << 30)) < math.ceil(share * (1 << 30))).select("vec").distinct().orderBy(draw, "vec").limit(most)
    table = drawn.toArrow()
    return Model(_matrix(table.column("vec"), kind).astype(float), total, blocks, **options)


def _indexed(model: Model, kind: str):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = model.codes(_matrix(batch.column("vec"), kind).astype(float))
            salt = np.frombuffer(b"".join(hashlib.blake2b(v, digest_size=4).digest() for v in batch.column("vec").to_pylist()), np.uint32).astype(np.int64)
            block = model.blocks_of(codes, salt)
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            ids = pa.array([np.array(x, np.int64).tobytes() for x in batch.column("ids").to_pylist()], pa.binary())
            for j in range(model.substrings):
                yield pa.RecordBatch.from_arrays([pa.array(block[:, j]), pa.array(np.zeros(len(codes), np.int32)), ids, code, batch.column("vec")], schema=_ROW_ARROW)

    return run


def _asking(model: Model, kind: str, radius: int):
    reach = reach_of(radius, model.substrings)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = model.codes(_matrix(batch.column("vec"), kind).astype(float))
            blocks = [model.asked(c, reach) for c in codes]
            row = np.repeat(np.arange(len(codes)), [len(b) for b in blocks])
            ids = pa.array([np.int64(i).tobytes() for i in batch.column("vec_id").to_pylist()], pa.binary())
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            at = pa.array(row)
            block = np.fromiter((b for x in blocks for b in x), np.int32, len(row))
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.ones(len(row), np.int32)), ids.take(at), code.take(at), batch.column("vec").take(at)], schema=_ROW_ARROW)

    return run


class _Block:
    """The rows of one block, and what is near to a query among them."""

    def __init__(self, parts: list[pa.RecordBatch], kind: str, model: Model, nearest: int):
        table = pa.Table.from_batches(parts)
        self.vectors = _matrix(table.column("vec"), kind).astype(float)
        self.codes = _matrix(table.column("code"), "u1")
        self.values = np.ascontiguousarray(self.codes.view(np.uint32).T)
        ids = table.column("ids").to_pylist()
        self.first = np.append(0, np.cumsum([len(i) // 8 for i in ids]))
        self.ids = np.frombuffer(b"".join(ids), np.int64)
        self.sub = int(table.column("block")[0].as_py()) // (len(model.edges[0]) + 1)
        self.nearest = nearest

    def near(self, query_id: int, code: np.ndarray, vector: np.ndarray, radius: int, reach: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the nearest of the codes within the radius that no earlier substring gives."""
        value = code.view(np.uint32)
        at = np.flatnonzero(np.bitwise_count(self.values[self.sub] ^ value[self.sub]) <= max(reach[self.sub], 0))
        at = at[differing(self.codes[at], code) <= radius]
        for j in range(self.sub):
            at = at[np.bitwise_count(self.values[j][at] ^ value[j]).astype(np.int64) > reach[j]]
        apart = np.sqrt(((self.vectors[at] - vector) ** 2).sum(1))
        # A vector's least ids, one more than are asked for, as one may be the query's own.
        if len(at) > self.nearest + 1:
            near = apart <= np.partition(apart, self.nearest)[self.nearest]
            at, apart = at[near], apart[near]
        size = self.first[at + 1] - self.first[at]
        ids = self.ids[np.repeat(self.first[at] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
        apart = np.repeat(apart, size)
        order = np.lexsort((ids, apart))
        order = order[ids[order] != query_id][: self.nearest]
        return ids[order], apart[order]


def _searched(model: Model, kind: str, radius: int, nearest: int):
    reach = reach_of(radius, model.substrings)

    def run(batches):
        number, parts, held = None, [], None
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != number:
                    number, parts, held = blocks[a], [], None
                piece = batch.slice(a, b - a)
                if kinds[a] == 0:
                    parts.append(piece)
                    continue
                if parts:
                    held, parts = _Block(parts, kind, model, nearest), []
                if held is None:
                    continue
                found: list[list] = [[], [], [], []]
                for i, code, vec in zip(*(piece.column(c).to_pylist() for c in ("ids", "code", "vec")), strict=True):
                    query_id = int(np.frombuffer(i, np.int64)[0])
                    ids, apart = held.near(query_id, np.frombuffer(code, np.uint8), np.frombuffer(vec, kind).astype(float), radius, reach)
                    found[0] += [query_id] * len(ids)
                    found[1] += [hashlib.sha256(vec).digest()] * len(ids)
                    found[2] += ids.tolist()
                    found[3] += apart.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, _HIT_ARROW, strict=True)], schema=_HIT_ARROW)

    return run


def nearest_vectors(vectors: DataFrame, asks: Column, nearest: int = NEAREST, id_column: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """The ``nearest`` vectors of each row that ``asks``, of those found, by Euclidean distance: query_id, rank (from 1), vec_id, score.

    Rotations and radius are fitted on up to SAMPLE vectors; every row is indexed.  Codes
    within the radius are all found; a query that finds fewer than ``nearest`` asks again
    with twice the radius, at last with one that has every row, so only a table of fewer
    gives fewer.

    Vectors that are null, empty, zero or hold null or non-finite numbers take no part;
    where there are several dimensions, only those of the most frequent one do (of
    equally frequent ones the largest).  Ties go to the smaller id; rows without an id
    come after all others and have a null vec_id.  A row that repeats id and vector
    counts once; an id with several vectors asks with each, and no row of a query's own
    id is found.  Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    given, kind = packed(vectors.filter(F.col(f"`{vector}`").isNotNull()), id_column, vector)
    most = given.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if most is None:
        return empty
    given = given.filter(F.col("dim") == most.dim).select("vec_id", "vec")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, min(max(-(-most.n // BLOCK), -(-2 * partitions // SUBSTRINGS)), min(most.n, SAMPLE) // 8))
    model = fitted(given, kind, most.n, most.dim, blocks, nearest=nearest, **options)
    # A vector and its least ids: no more of one that very many rows have.
    least = given.withColumn("n", F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("n") <= nearest + 1)
    index = least.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).mapInArrow(_indexed(model, kind), _ROW)
    asked_ids, _ = packed(vectors.filter(asks & F.col(f"`{vector}`").isNotNull()), id_column, vector)
    todo = asked_ids.filter(F.col("dim") == most.dim).select("vec_id", "vec").distinct()
    radius, found = model.radius, None
    by_query = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    while True:
        rows = index.unionByName(todo.mapInArrow(_asking(model, kind, radius), _ROW)).repartition("block").sortWithinPartitions("block", "kind")
        hits = rows.mapInArrow(_searched(model, kind, radius, nearest), _HIT).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= nearest)
        hits = saved(hits)
        if radius >= model.bits:
            found = hits if found is None else found.unionByName(hits)
            break
        full = hits.filter(F.col("rank") == nearest).select(F.col("query_id").alias("vec_id"), "query")
        keyed = todo.withColumn("query", F.unhex(F.sha2("vec", 256)))
        short = saved(keyed.join(full, ["vec_id", "query"], "left_anti").select("vec_id", "vec"))
        if short.isEmpty():
            found = hits if found is None else found.unionByName(hits)
            break
        whole = hits.join(full.withColumnRenamed("vec_id", "query_id"), ["query_id", "query"], "left_semi")
        found = whole if found is None else found.unionByName(whole)
        todo, radius = short, min(model.bits, 2 * max(radius, 1))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op11_nearest_vectors(embeddings: DataFrame) -> DataFrame:
    return nearest_vectors(embeddings, F.col("vec_id") % 100 == 0)
