"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text's terms are its words, weighted by how often they come.  For each sample k
and term x of weight S, hashes of (x, k) give r and c of the gamma distribution
Gamma(2, 1) and b uniform; with t = floor(ln S / r + b) the term's rank is
ln c - r * (t - b + 1), and the term of least rank is sampled.  Two texts sample
the same term at the same t with probability sum(min(S, S')) / sum(max(S, S')), their
generalised Jaccard similarity, and then and only then have the same least rank,
so the least ranks themselves make the signature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm.shared import saved

SAMPLES = 48
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of a signature that stand for one sample.
WIDTH = 4
NO_ID = (1 << 63) - 1
#: Which of two texts a term's weight is of.
FIRST, SECOND, BOTH = 1, 2, 3
#: Rows that repeat a text are told out in lists of up to so many.
RUN = 4096


def _uniforms(h: Column) -> tuple[Column, Column]:
    """Two numbers between 0 and 1 from the halves of a hash."""
    part = lambda x: (x.cast("double") + 0.5) * (2.0**-32)
    return part(F.shiftrightunsigned(h, 32)), part(h.bitwiseAND(F.lit(0xFFFFFFFF)))


def rank(term: Column, log_weight: Column, k: int) -> Column:
    """Rank of a term, whose hash and logarithm of weight these are, in sample k."""
    h = F.xxhash64(term, F.lit(k))
    u1, u2 = _uniforms(h)
    v1, v2 = _uniforms(F.xxhash64(h))
    b, _ = _uniforms(F.xxhash64(h, term))
    minus_r = F.ln(u1 * u2)
    return F.ln(-F.ln(v1 * v2)) + minus_r * (F.floor(b - log_weight / minus_r).cast("double") - b + 1.0)


def _signature(names: list[str]) -> Column:
    """Hashes of the least ranks, as bytes; none where there was no term."""
    parts = [F.lpad(F.hex(F.shiftrightunsigned(F.xxhash64(n), 32)), 2 * WIDTH, "0") for n in names]
    return F.unhex(F.when(F.col(names[0]).isNull(), F.lit("")).otherwise(F.concat(*parts)))


def likeness(one: Column, two: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in common; 1 for two texts without a word, 0 if one has none."""
    part = lambda c, k: F.substring(c, WIDTH * k + 1, WIDTH)
    same = reduce(lambda a, b: a + b, [F.when(part(one, k) == part(two, k), 1.0).otherwise(0.0) for k in range(samples)])
    none = lambda c: F.length(c) == 0
    return F.when(none(one) | none(two), F.when(one == two, 1.0).otherwise(0.0)).otherwise(same / float(samples))


def _words(text: Column) -> Column:
    return F.split(text, SPACE)


def signatures(rows: DataFrame, key: list[str], pieces: list[tuple[Column, bool, bool]], samples: int = SAMPLES) -> DataFrame:
    """(key, fingerprint, edited_fingerprint) of two texts that share pieces.

    A piece is whole words, with whether they are in the first and in the second
    text.  Where rows are already dealt by ``key``, no shuffle is needed.
    """
    flags = F.array(*[F.struct(p.alias("piece"), F.lit(int(a)).alias("a"), F.lit(int(b)).alias("b")) for p, a, b in pieces])
    parts = rows.select(*key, F.explode(flags).alias("p")).select(*key, F.explode(_words(F.col("p.piece"))).alias("w"), "p.a", "p.b").filter("w <> ''")
    terms = parts.groupBy(*key, F.xxhash64("w").alias("term")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # Ranks are most of the work: a term that both texts have equally often is ranked once for both.
    side = lambda n, which: F.struct(F.ln(F.col(n).cast("double")).alias("log_weight"), F.lit(which).alias("side"))
    a, b = F.col("a"), F.col("b")
    sides = F.when(a == b, F.array(side("a", BOTH))).when(b == 0, F.array(side("a", FIRST))).when(a == 0, F.array(side("b", SECOND))).otherwise(F.array(side("a", FIRST), side("b", SECOND)))
    ranked = terms.select(*key, "term", F.explode(sides).alias("s")).select(*key, "term", "s.log_weight", "s.side")
    least = ranked.groupBy(*key, "side").agg(*[F.min(rank(F.col("term"), F.col("log_weight"), k)).alias(f"r{k}") for k in range(samples)])
    # Three rows a key at most.
    done = least.groupBy(*key).agg(*[F.min(F.when(F.col("side") != apart, F.col(f"r{k}"))).alias(f"{s}{k}") for k in range(samples) for s, apart in (("la", SECOND), ("lb", FIRST))])
    return done.select(*key, _signature([f"la{k}" for k in range(samples)]).alias("fingerprint"), _signature([f"lb{k}" for k in range(samples)]).alias("edited_fingerprint"))


def following(ids: DataFrame) -> DataFrame:
    """Distinct (doc_id, h, n) with their number of rows and (next_id, next_h): the next in order of doc_id and h, after the last the first.

    Rows are dealt by ranges; what follows a range's last row is the first row of the
    next range that has one.
    """
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(ids.groupBy("doc_id", "h", "n").agg(F.count(F.lit(1)).alias("copies")).repartitionByRange(n, "doc_id", "h").withColumn("range", F.spark_partition_id()))
    order = Window.orderBy("range")
    firsts = dealt.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    # As many rows as ranges.
    after = firsts.select("range", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("after"))
    here = F.lead(F.struct("doc_id", "h")).over(Window.partitionBy("range").orderBy("doc_id", "h"))
    return dealt.withColumn("here", here).join(F.broadcast(after), "range").withColumn("next", F.coalesce("here", "after")).select("doc_id", "h", "n", "copies", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by as many
    first ones, or all, of the next document's, in ascending order of doc_id; the
    first follows the last.  One row per input row: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, next_id.

    Null text is empty.  Texts without a word have the empty fingerprint.  A null
    doc_id comes last.  Rows that repeat a doc_id and text count as one document and
    get equal rows; different texts of one doc_id follow each other by hash.  Very long
    texts are read whole.  A single document is its own next.  Other columns are ignored; an empty table
    gives no rows.
    """
    parts = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ident = F.col(f"`{doc_id}`").cast("long")
    plain = docs.select(F.coalesce(ident, F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), ident.isNull().cast("long").alias("nameless"))
    # The last bit tells a null id from the largest one.
    plain = plain.withColumn("h", F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("nameless"))).drop("nameless")
    pairs = saved(following(plain.select("doc_id", "h", F.char_length("text").cast("long").alias("n"))))
    # Small partitions: the table of a partition's words is to stay in memory.
    held = plain.repartition(parts, "doc_id", "h")
    wanted = pairs.select(F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"), F.col("doc_id").alias("for_id"), F.col("h").alias("for_h"), F.expr("n div 2").cast("int").alias("half"))
    # Joins sort by the same columns, so this needs no sort of its own.
    one = held.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("doc_id"))).filter("again = 1").drop("again")
    heads = wanted.repartition(parts, "doc_id", "h").hint("merge").join(one, ["doc_id", "h"]).select(F.col("for_id").alias("doc_id"), F.col("for_h").alias("h"), "half", F.expr("substring(text, 1, half)").alias("head"))
    edits = (
        heads.repartition(parts, "doc_id", "h").hint("merge").join(one, ["doc_id", "h"])
        .withColumn("left", F.expr("substring(text, 1, char_length(text) - half)"))
        # Whole words at the start, which both texts have; the last word of the left part may go on differently.
        .withColumn("cut", F.char_length("left") - F.char_length(F.substring_index(F.translate("left", "\t\n\x0b\x0c\r", "     "), " ", -1)))
        .select("doc_id", "h", "text", F.concat("left", "head").alias("edited"), "cut")
    )
    both = edits.withColumn("edited_sha256", F.sha2("edited", 256))
    pieces = [(F.expr("substring(text, 1, cut)"), True, True), (F.expr("substring(text, cut + 1, char_length(text))"), True, False), (F.expr("substring(edited, cut + 1, char_length(edited))"), False, True)]
    prints = signatures(both, ["doc_id", "h"], pieces, samples)
    shas = both.select("doc_id", "h", "edited_sha256")
    none = F.unhex(F.lit(""))
    mine, other = F.coalesce("fingerprint", none), F.coalesce("edited_fingerprint", none)
    known = saved(shas.join(prints, ["doc_id", "h"], "left").select("doc_id", "h", F.unhex("edited_sha256").alias("sha"), mine.alias("fingerprint"), other.alias("edited_fingerprint"), likeness(mine, other, samples).alias("near_edited")))
    after = known.select(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"), F.col("fingerprint").alias("next_fingerprint"))
    whole = pairs.join(known, ["doc_id", "h"]).join(after, ["next_id", "next_h"])
    runs = whole.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {RUN}"))))
    rows = runs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("run") * RUN))))
    show = lambda c, h: F.when(F.col(h).bitwiseAND(F.lit(1)) == 0, F.col(c)).alias(c)
    return rows.select(
        show("doc_id", "h"),
        F.col("n").alias("n_chars"),
        F.lower(F.hex("sha")).alias("edited_sha256"),
        F.hex("fingerprint").alias("fingerprint"),
        F.hex("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited",
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
        show("next_id", "next_h"),
    )


def op7_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
