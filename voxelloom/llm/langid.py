"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of 1 to ORDER letters or blanks are hashed to FEATURES columns.  Document
frequencies are counted over all training texts.  The classifier is trained by
follow-the-regularised-leader with elastic-net penalties on a bounded, stratified
sample of labelled training texts (up to ``sample`` different texts), in one task, and
its temperature is set on a part of that sample kept aside.  As features enter relative
to a text's length, a text's scores are sums over its n-grams of one table's rows.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm import textcore as tc

ORDER, FEATURE_BITS = 3, 16
FEATURES = 1 << FEATURE_BITS
GAP = ORDER
#: Different labelled texts that the classifier is fitted on at most; every label gets an equal share, or all it has.
SAMPLE = 4000
#: More labels than this are an error: the model has a column for each.
MOST_LABELS = 1000
EPOCHS = 4
#: Learning rate, its offset, and the weights of the absolute and the squared penalty.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
#: Features are multiplied by so much, to be of the order of 1.
SCALE = 20.0
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all texts as code points, 0 for all else; offsets of the texts; places after texts.

    Each text is followed by as many zeros as an n-gram may reach beyond its start.
    """
    lowered = [t.lower() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) + GAP for t in lowered])]).astype(np.int64)
    points = np.frombuffer(("\n" * GAP).join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[~_letters()[points]] = 0
    return points, off, (off[1:, None] - np.arange(1, GAP + 1)).ravel()


def _grams(points: np.ndarray, gaps: np.ndarray, order: int):
    """Feature of the n-gram that starts at each place; in the gaps after texts that of blanks."""
    x, blank = np.zeros(len(points), np.uint32), np.zeros(1, np.uint32)
    final = lambda v, k: ((v ^ (v >> np.uint32(15)) ^ np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - FEATURE_BITS)
    for k in range(order):
        part = np.zeros(len(points), np.uint32)
        part[: len(points) - k] = points[k:]
        x = x * np.uint32(0x01000193) + part * np.uint32(0x9E3779B1)
        f = final(x, k).astype(np.int64)
        f[gaps] = final(blank, k)[0]
        yield f


def _runs(column, most: int = tc.CHUNK_BYTES):
    texts = [t or "" for t in column.to_pylist()]
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield lo, i + 1, texts[lo : i + 1]
            lo, size = i + 1, 0


def _frequencies(order: int):
    """Texts of a task that have each feature."""

    def run(batches):
        total = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for _, _, texts in _runs(batch.column("text")):
                points, off, gaps = characters(texts)
                doc = tc.owner(off) * FEATURES
                there = np.zeros(len(texts) * FEATURES, bool)
                for f in _grams(points, gaps, order):
                    there[doc + f] = True
                total += there.reshape(len(texts), FEATURES).sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["feature", "n"])

    return run


def _vectors(order: int):
    """Features of each text and their relative frequencies, all for one task."""

    def run(batches):
        for batch in batches:
            for lo, hi, texts in _runs(batch.column("text")):
                points, off, gaps = characters(texts)
                ids, values = [], []
                every = list(_grams(points, gaps, order))
                for i in range(hi - lo):
                    f, n = np.unique(np.concatenate([x[off[i] : off[i + 1]] for x in every]), return_counts=True)
                    ids.append(f.astype(np.int32).tobytes())
                    values.append((n / n.sum()).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(values, pa.binary()), pa.array(np.zeros(hi - lo, np.int32))], names=["label", "ids", "tf", "task"])

    return run


class Ftrl:
    """Follow-the-regularised-leader for multinomial logistic regression, one weight row a feature."""

    def __init__(self, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, ids: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(ids)
        g = x[:, None] * (softmax(x @ w) - (np.arange(w.shape[1]) == label))
        self.z[ids] += g - (np.sqrt(self.n[ids] + g * g) - np.sqrt(self.n[ids])) / self.alpha * w
        self.n[ids] += g * g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature at which the labels are likeliest, by golden section on its logarithm.

    Labels count as if each class had been seen once more, wrongly, so that a sample
    without an error doesn't make every score 1.
    """
    if not len(labels):
        return 1.0
    classes = logits.shape[1]
    target = np.full((len(labels), classes), 1.0 / (len(labels) + classes))
    target[np.arange(len(labels)), labels] += 1.0 - target.sum(axis=1)
    loss = lambda t: -(target * np.log(np.maximum(softmax(logits / math.exp(t)), 1e-300))).sum(axis=1).mean()
    lo, hi, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


class Model:
    """Labels, the table of idf * weight by feature, the bias and the temperature."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, heat: float, order: int):
        self.labels, self.table, self.bias, self.heat, self.order = labels, table, bias, heat, order

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        points, off, gaps = characters(texts)
        total = np.zeros((len(texts), len(self.labels)))
        for f in _grams(points, gaps, self.order):
            total += np.add.reduceat(self.table[f], off[:-1], axis=0)
        size = np.diff(off)
        p = softmax((total / (self.order * size)[:, None] + self.bias) / self.heat)
        known = np.add.reduceat((points > 0).astype(np.int64), off[:-1]) > 0
        best = p.argmax(axis=1)
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(texts)), best], 0.0)


FITTED = "weights binary, bias binary, heat double"
FITTED_ARROW = pa.schema([("weights", pa.binary()), ("bias", pa.binary()), ("heat", pa.float64())])


def _fitted(labels: list[str], idf: np.ndarray):
    """Weights, bias and temperature from the sample's vectors, which are all in one task."""

    def run(table: pa.Table) -> pa.Table:
        place = {c: i for i, c in enumerate(labels)}
        vectors = []
        for c, ids, tf in zip(*(table.column(n) for n in ("label", "ids", "tf")), strict=True):
            i = np.frombuffer(ids.as_buffer(), np.int32)
            vectors.append((np.append(i, np.int32(FEATURES)), np.append(np.frombuffer(tf.as_buffer(), np.float32) * idf[i] * SCALE, 1.0), place[c.as_py()]))
        # The order of training doesn't depend on how rows were dealt out.
        vectors.sort(key=lambda v: (zlib.crc32(v[0].tobytes()), zlib.crc32(v[1].tobytes()), v[2]))
        w, heat = fitted(vectors, len(labels))
        out = [(w[:FEATURES] * idf[:, None] * SCALE).astype(np.float32).tobytes()], [w[FEATURES].tobytes()], [heat]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, FITTED_ARROW, strict=True)], schema=FITTED_ARROW)

    return run


def fitted(vectors: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, float]:
    """Weights, the bias last, and the temperature: every fifth of (features, values, class) is kept aside for it."""
    aside, fit = vectors[::5], [v for i, v in enumerate(vectors) if i % 5] or vectors
    model = Ftrl(classes)
    for _ in range(EPOCHS):
        for ids, x, c in fit:
            model.learn(ids, x, c)
    w = model.weights()
    logits = np.array([x @ w[ids] for ids, x, _ in aside])
    return w, temperature(logits, np.array([c for _, _, c in aside]))


#: Texts of a label that are ranked for the draw, as a multiple of those drawn.
MARGIN = 4
DRAWS = 1 << 30


def drawn_texts(labelled: DataFrame, each: int, different: dict[str, int] | None = None) -> DataFrame:
    """(label, text) of up to ``each`` different texts of each label, those of least hash, one row each.

    ``different`` says about how many different texts each label has: of more than
    ``MARGIN`` times what is drawn, only that many are ranked.  Copies of a text count
    once however many there are.
    """
    hashed = labelled.withColumn("hash", F.xxhash64("text", F.lit(6))).withColumn("draw", F.pmod("hash", F.lit(DRAWS)))
    if different:
        most = F.create_map(*[x for c, n in different.items() for x in (F.lit(c), F.lit(min(DRAWS, MARGIN * each * DRAWS // max(n, 1))))])
        hashed = hashed.filter(F.col("draw") < most[F.col("label")])
    rank = F.row_number().over(Window.partitionBy("label").orderBy("draw", "hash"))
    picks = hashed.select("label", "draw", "hash").distinct().withColumn("rank", rank).filter(F.col("rank") <= each).select("label", "hash")
    # Up to ``each`` rows a label.
    return hashed.join(F.broadcast(picks), ["label", "hash"]).groupBy("label", "hash").agg(F.min("text").alias("text")).select("label", "text")


def train(docs: DataFrame, usable: Column, sample: int = SAMPLE, order: int = ORDER, text: str = "text", label: str = "lang") -> Model | None:
    """A model from the rows where ``usable`` holds and text and label aren't null; None where there is no such row."""
    if not 1 <= order <= GAP:
        raise ValueError(f"n-grams of 1 to {GAP} characters are counted")
    rows = docs.filter(usable).select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("label"))
    labelled = rows.filter("text IS NOT NULL AND label IS NOT NULL")
    found = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("different")).limit(MOST_LABELS + 1).collect()
    counts = {r.label: r.n for r in found}
    if not counts:
        return None
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    labels = sorted(counts)
    df = np.zeros(FEATURES)
    for r in labelled.select("text").mapInArrow(_frequencies(order), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow().to_batches():
        df[r.column("feature").to_numpy()] = r.column("n").to_numpy()
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    vectors = drawn_texts(labelled, max(1, sample // len(labels)), {r.label: r.different for r in found}).mapInArrow(_vectors(order), "label string, ids binary, tf binary, task int")
    got = vectors.groupBy("task").applyInArrow(_fitted(labels, idf), FITTED).first()
    return Model(labels, np.frombuffer(got.weights, np.float32).reshape(FEATURES, -1), np.frombuffer(got.bias, np.float64), got.heat, order)


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def _predicted(held):
    def run(batches):
        for batch in batches:
            for lo, hi, texts in _runs(batch.column("text")):
                lang, score = held.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(lo, hi - lo) for n in batch.schema.names if n != "text"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*[n for n in batch.schema.names if n != "text"], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Language of every whole text, learned from the labelled rows for which ``held_out`` isn't true.

    One row per input row: doc_id, held_out, lang_pred, score (calibrated
    probability, 0 to 1).  A text that is null or has no letter is ``und`` with
    score 0; so is every text where no row has both text and label to learn from.
    Of equally likely languages the first by code point is taken.  Only the text enters
    a prediction.  Very long texts are read whole; repeated rows get equal results;
    other columns are ignored; an empty table gives no rows.
    """
    flag = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), flag.alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    model = train(docs, ~flag, sample, text=text, label=label)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), PREDICTED)


def _judged(held, text: str):
    def run(batches):
        for batch in batches:
            for lo, hi, texts in _runs(batch.column("row").field(text)):
                lang, score = held.value.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def identified_rows(docs: DataFrame, least_score: float, sample: int = SAMPLE, text: str = "text", label: str = "lang") -> DataFrame:
    """The input rows whose text has a letter and a language of ``least_score`` or more, learned from all labelled rows.

    Where no row has both text and label, all texts with a letter stay.  Null texts go;
    of repeated rows all stay or none; very long texts are read whole; all columns are
    kept as they are; an empty table gives no rows.
    """
    model = train(docs, F.lit(True), sample, text=text, label=label)
    if model is None:
        return docs.filter(F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    rows = docs.select(F.struct(docs["*"]).alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_judged(held, text), schema).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")


def held_out_quarter(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op6_language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, held_out_quarter())
