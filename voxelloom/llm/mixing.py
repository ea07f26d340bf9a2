"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source documents are range
partitioned by key (the hash is uniform, so even key ranges are even ranges of
rows, whatever the source's share of all rows), prefix sums of sizes are taken
within a range and over the ranges' totals, and the source is cut where the sum
reaches its budget.  A budget beyond the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm.shared import saved
from voxelloom.operators.prefix import prefix_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of the key that name a range: 16 ** 3 of them in each source at most.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Targets of (source, source_size): weights, by code point of the source and null last, share ``share`` of all sizes.

    No target exceeds ``most`` times its source's size; the excess is shared again
    by weight until none does.  That is the level L with sum(min(cap, L * weight))
    equal to the whole: with sources in order of cap / weight, those before some
    place stop at their caps, and prefix sums give L for each place.  Ranks and sums are
    distributed, so there may be as many sources as hosts.
    """
    named = sizes.select("source", "source_size", F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless"))
    ranked = prefix_sums(named, ["nameless", "name"], {"order": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("order") % len(weights) + 1).cast("int"))
    capped = ranked.withColumns({"weight": weight, "cap": F.lit(float(most)) * F.col("source_size")}).withColumn("ratio", F.col("cap") / F.col("weight"))
    placed = prefix_sums(capped, ["ratio", "nameless", "name"], {"capped_before": F.col("cap"), "weight_before": F.col("weight")})
    whole, every = placed.agg(F.lit(float(share)) * F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(whole).cast("double") - F.col("capped_before")) / (F.lit(every).cast("double") - F.col("weight_before"))
    # The level holds from the first place where it doesn't exceed the ratio; if there is none, all stop at their caps.
    first = placed.withColumn("level", level).filter("level <= ratio").agg(F.min(F.struct("ratio", "level")).alias("first")).first().first
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first.level) * F.col("weight"))
    return placed.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many words the mix takes from each document.

    One row per input row: doc_id, source, size (words), source_size, target (of
    its source), taken, epochs (whole takes), part (words of a last, partial take).
    A source's whole words budget is the floor of its target, met to the word: the
    document at the cut gives its first ``part`` words.

    Null text has no words and takes part with size 0; a null source is a source of
    its own; a source without words has target 0.  Very long texts are counted whole.
    Different texts of one doc_id follow each other by size and hash; rows that repeat a
    doc_id and text are told apart by nothing, so which of them the cut falls on is
    open, but not the totals.  Other columns are ignored.  An empty table gives no rows.
    """
    return _mixed(docs, share, most, weights, seed, doc_id, text, source, whole=False)


def _mixed(docs: DataFrame, share: float, most: float, weights: tuple[float, ...], seed: str, doc_id: str, text: str, source: str, whole: bool) -> DataFrame:
    name = F.col(f"`{source}`").cast("string")
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        name.alias("source"),
        # Never null, to deal rows by.
        F.coalesce(name, F.lit("")).alias("name"),
        name.isNull().alias("nameless"),
        word_count(F.col(f"`{text}`").cast("string")).alias("size"),
        F.xxhash64(F.col(f"`{text}`").cast("string")).alias("hash"),
        *[F.struct(docs["*"]).alias("row")] * whole,
    )
    keyed = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("hash").cast("string"), F.lit(":"), F.col("size").cast("string")))))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    part = ["name", "nameless", "range"]
    # Up to 16 ** RANGE_DIGITS rows a source, of which the texts are counted once.
    ranges = saved(keyed.groupBy(*part).agg(F.sum("size").alias("range_size")))
    known = F.when(~F.col("nameless"), F.col("name"))
    targets = source_targets(ranges.groupBy("name", "nameless").agg(F.sum("range_size").alias("source_size")).select(known.alias("source"), "source_size"), share, most, weights)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless"), "source_size", "target")
    before_range = Window.partitionBy("name", "nameless").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(before_range), F.lit(0))).join(targets, ["name", "nameless"]).select(*part, "start", "source_size", "target")
    within = Window.partitionBy(*part).orderBy("key", "doc_id", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    return (
        placed.join(plan, part)
        .withColumn("epochs", epochs)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("inside"))).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs", "part", *["row"] * whole)
    )


def mixed_rows(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: input rows as often as it takes them whole, and the document at each source's cut with its first words.

    The cut document's words are joined by one space; a column n_chars, if there is
    one, is its new number of characters.  Documents without words, null texts among
    them, go with the whole epochs of their source.  All columns are kept as they are.
    """
    rows = _mixed(docs, share, most, weights, seed, doc_id, text, source, whole=True)
    whole = F.col("epochs") + (F.col("part") >= F.col("size")).cast("int") * (F.col("size") > 0).cast("int")
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    pieces = F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.when(cut, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    dealt = rows.withColumn("is_cut", F.explode(pieces))
    words = F.filter(F.split(F.col("row")[text], r"[\x20\x09-\x0D]+"), lambda w: w != "")
    shorter = F.when(F.col("is_cut"), F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")).otherwise(F.col("row")[text])
    out = dealt.withColumn("new_text", shorter)
    columns = []
    for c in docs.columns:
        kind = docs.schema[c].dataType
        old = F.col("row")[c]
        columns.append((F.col("new_text") if c == text else F.when(F.col("is_cut"), F.char_length("new_text").cast(kind)).otherwise(old) if c == "n_chars" else old).alias(c))
    return out.select(*columns)


def op3_mix_sources(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS capped,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
  1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS whole FROM w),
l AS (SELECT (whole - capped) / weights AS held FROM r WHERE (whole - capped) / weights <= ratio ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM l) = 0 THEN cap ELSE least(cap, (SELECT held FROM l) * weight) END AS target FROM w),
p AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d),
j AS (SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM j
"""
