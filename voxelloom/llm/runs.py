"""Periodic runs: stretches of words that repeat with a fixed lag, at least ``exponent`` times.

A run of period q and length L has L - q words in a row that equal the word q further
on.  How many such words a text has at each lag is counted exactly: frequent words by
autocorrelation (a Fourier transform each, one inverse for their sum), rare ones by the
differences of their places.  Only lags with enough of them are searched for islands,
and what known runs of a divisor of the lag explain doesn't count: such a run and one of
the lag itself share fewer words than the lag, so no pair of equal words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.textcore import crc32_sql

LEAST_WORDS, EXPONENT = 24, 3
#: Aligned stretches are compared word by word so often before those that remain are extended one by one.
ROUNDS = 12
OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Edit = Callable[[int | None, list[bytes]], list[bytes]]


def lag_counts(words: np.ndarray, most: int) -> np.ndarray:
    """At each lag of 0 to ``most`` (0 stays 0): how many words equal the one so much further on."""
    n = len(words)
    out = np.zeros(most + 1, np.int64)
    size = 1 << max(n + most - 1, 1).bit_length()
    freq = np.bincount(words)
    # A word costs about the square of its frequency by differences, and a transform otherwise.
    heavy = np.flatnonzero(freq > max(math.sqrt(size * math.log2(size) / 2), 16))
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            spectrum = np.fft.rfft(words == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        out[0] = 0
    is_heavy = np.zeros(len(freq), bool)
    is_heavy[heavy] = True
    place = np.flatnonzero(~is_heavy[words])
    place = place[np.argsort(words[place], kind="stable")]
    word = words[place]
    begin, k = np.arange(len(place)), 0
    while len(begin):
        k += 1
        begin = begin[: np.searchsorted(begin, len(place) - k)]
        begin = begin[word[begin] == word[begin + k]]
        apart = place[begin + k] - place[begin]
        near = apart <= most
        begin, apart = begin[near], apart[near]
        out += np.bincount(apart, minlength=most + 1)
    return out


def _extent(words: np.ndarray, lag: int, at: int, end: int) -> tuple[int, int]:
    """From where and to where words in a row equal those ``lag`` further on, around one that does; ``end`` is the last place's."""
    lo, hi, step = at, at, 64
    while hi < end:
        to = min(hi + step, end)
        differ = words[hi:to] != words[hi + lag : to + lag]
        if differ.any():
            hi += int(differ.argmax())
            break
        hi, step = to, 2 * step
    step = 64
    while lo > 0:
        to = max(lo - step, 0)
        differ = (words[to:lo] != words[to + lag : lo + lag])[::-1]
        if differ.any():
            lo -= int(differ.argmax())
            break
        lo, step = to, 2 * step
    return lo, hi


def islands(words: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches (from, to) of ``least`` or more places whose word equals that ``lag`` further on.

    Each holds one aligned stretch of half the length, so only these are looked at.
    """
    end, size = len(words) - lag, (least + 1) // 2
    at = np.arange(end // size) * size
    for k in range(min(size, ROUNDS)):
        at = at[words[at + k] == words[at + k + lag]]
        if not len(at):
            return []
    out, past = [], -1
    for i in at.tolist():
        if i >= past:
            lo, past = _extent(words, lag, i, end)
            if past - lo >= least:
                out.append((lo, past))
    return out


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def found_runs(words: np.ndarray, least_words: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of words, given as small numbers; by start, then period."""
    n = len(words)
    most = n // exponent
    if n < least_words or most < 1:
        return []
    lags = np.arange(most + 1)
    needed = np.maximum(least_words - lags, (exponent - 1) * lags)
    left, out = lag_counts(words, most), []
    for q in np.flatnonzero(left >= needed).tolist():
        if q == 0 or left[q] < needed[q]:
            continue
        for lo, hi in islands(words, q, int(needed[q])):
            stretch = words[lo : hi + q]
            if any(np.array_equal(stretch[: -(q // p)], stretch[q // p :]) for p in _prime_factors(q)):
                continue  # it has a smaller period
            out.append((lo, hi + q - lo, q))
            explained = np.arange(2 * q, min(hi + q - lo - 1, most) + 1, q)
            left[explained] -= hi + q - lo - explained
    return sorted(out, key=lambda r: (r[0], r[2]))


def _numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _documents(least_words: int, exponent: int, edit: Edit | None):
    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = text.as_py().split()
                if edit is not None:
                    words = edit(doc, words)
                runs = found_runs(_numbered(words), least_words, exponent) if len(words) >= least_words else []
                kept = words
                if runs:
                    covered = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in runs:
                        covered[start + period] += 1
                        covered[start + length] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(covered)[:-1] == 0)]
                for column, x in zip(rows, (doc, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(kept)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(_RUN)), pa.array(rows[3], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed_text"])

    return run


def word_runs(docs: DataFrame, least_words: int = LEAST_WORDS, exponent: int = EXPONENT, edit: Edit | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of each document's words, and its text without their repeats.

    A run is a stretch with smallest period q, ``least_words`` and ``exponent * q`` words
    long or longer, that no neighbouring word extends keeping that period.  One row per
    input row: doc_id, n_words, runs (by start, then period), collapsed_text (words that
    no run has after its first q words, joined by one space).  ``edit`` changes a
    document's words before, by its id.

    Words are what ASCII white space parts.  Null and empty texts have no words and no
    runs; of runs that overlap each is told; very long texts are read whole; a null id
    is kept; repeated rows get equal results; other columns are ignored; an empty table
    gives no rows.  Rows don't meet: there is no shuffle, and a task holds a batch.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_documents(least_words, exponent, edit), OUT)


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """A document in ten, by its id's checksum, repeats a stretch of its words to its end; one without an id doesn't."""
    if doc is None or not words:
        return words
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(len(words) - a)]


def op13_periodic_runs(docs: DataFrame) -> DataFrame:
    found = word_runs(docs, edit=planted)
    # The first of runs by start and period whose exponent no other exceeds.
    best = F.aggregate("runs", F.element_at("runs", 1), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("*", F.when(F.size("runs") > 0, best).alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}") for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


OP13_SQL = rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
e AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 3 + (h // 10) % 8 AS times FROM (SELECT *, len(w) AS n FROM d)),
words AS (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // times) END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM e)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i WHERE {EXPONENT} * (y.i - x.i) <= x.n),
lags AS (SELECT doc_id, q FROM pairs GROUP BY 1, 2 HAVING count(*) >= greatest({LEAST_WORDS} - q, {EXPONENT - 1} * q)),
islands AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS same FROM pairs JOIN lags USING (doc_id, q))
  GROUP BY doc_id, q, same HAVING count(*) + q >= greatest({LEAST_WORDS}, {EXPONENT} * q)),
runs AS (SELECT * FROM islands a WHERE NOT EXISTS (SELECT 1 FROM islands b WHERE b.doc_id = a.doc_id AND b.q < a.q AND a.q % b.q = 0 AND b.s <= a.s AND b.s + b.n >= a.s + a.n)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
best AS (SELECT * FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.doc_id = a.doc_id AND (b.n * a.q > a.n * b.q OR b.n * a.q = a.n * b.q AND (b.s < a.s OR b.s = a.s AND b.q < a.q)))),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY 1)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, CAST(e.n AS BIGINT) AS n_words
FROM e LEFT JOIN best USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)"""
