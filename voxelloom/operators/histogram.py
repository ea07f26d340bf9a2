"""Histograms with given edges, and edges that equalise histograms."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.functions.pointwise import bin_index, bin_index_of
from voxelloom.operators.prefix import prefix_sums
from voxelloom.plans.saving import saved

#: Distinct values of one group that a single task may hold; beyond, edges are found step by step over the whole table.
MOST_VALUES = 5_000_000


def histogram(rows: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """(keys, bin, n) with empty bins: n edges make n + 1 right-closed bins."""
    counts = rows.select(*keys, bin_index(F.col(value), edges).cast("int").alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    return _with_empty(counts, keys, len(edges) + 1)


def histogram_by_spec(rows: DataFrame, keys: list[str], spec: DataFrame, value: str = "value") -> DataFrame:
    """(keys, hist_idx, bin, n) without empty bins; ``spec`` has (hist_idx, edges), one row a histogram, and is broadcast."""
    binned = rows.join(F.broadcast(spec.select("hist_idx", "edges")), "hist_idx").select(*keys, "hist_idx", bin_index_of(F.col(value), F.col("edges")).cast("int").alias("bin"))
    return binned.groupBy(*keys, "hist_idx", "bin").agg(F.count(F.lit(1)).alias("n"))


def _with_empty(counts: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """Empty bins from one row a key with the counts of its bins, without a join."""
    whole = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))
    return whole.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"), "by_bin").select(*keys, "bin", F.coalesce(F.col("by_bin")[F.col("bin")], F.lit(0)).cast("long").alias("n"))


def frequencies(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts over their sum; NaN where that is 0."""
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy())
    return counts.withColumn("total", total).select(*keys, "bin", F.when(F.col("total") > 0, F.col("n") / F.when(F.col("total") > 0, F.col("total"))).otherwise(F.lit(float("nan"))).alias("freq"))


def csv_line(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line): each histogram's counts, in order of bins, as one line of comma-separated numbers."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"].cast("string"))
    return counts.groupBy(*keys).agg(F.array_join(cells, ",").alias("line"))


def value_counts(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def equalised_edges(values: list[float], counts: list[int], n_bins: int, on_overflow: str = "error") -> list[float]:
    """n_bins - 1 edges of sorted distinct values, each ``counts`` times.

    Each step goes the even share on, and what former steps were short or over by,
    spread over those to come.  Within a run of equal values the nearer end counts,
    the end of a tie only where nothing is to be made up for.
    """
    past, total = [], 0
    for c in counts:
        total += c
        past.append(total)
    if total < n_bins:
        raise ValueError(f"{total} values can't make {n_bins} bins")
    share = total // n_bins
    surplus, deficit, at, out = total - share * n_bins, 0, 0, []
    for k in range(n_bins - 1):
        step, left = share, n_bins - k
        if surplus:
            more = max(1, surplus // left)
            step, surplus = step + more, surplus - more
        elif deficit:
            less = min(max(1, deficit // left), step)
            step, deficit = step - less, deficit - less
        at += step
        if at >= total:
            if on_overflow == "truncate":
                break
            raise ValueError("too many equal values for so many bins")
        run = bisect_right(past, at)
        low, high = past[run] - counts[run], past[run]
        if at > low:
            back, on = at - low, high - at
            if high == total:
                at = low
            elif back < on or back == on and deficit > 0:
                at = low
                surplus, deficit = (back - deficit, 0) if back > deficit else (surplus, deficit - back)
            else:
                at, run = high, run + 1
                deficit, surplus = (on - surplus, 0) if on > surplus else (deficit, surplus - on)
        out.append(values[run])
    return out


def determine_edges(rows: DataFrame, n_bins: int, group: str = "hist_idx", value: str = "value", on_overflow: str = "error") -> DataFrame:
    """(group, edge_idx, edge) of edges that equalise each group's histogram.

    Equal values are counted before the shuffle.  A group of up to MOST_VALUES distinct
    values is folded in one task; if one has more, all are walked together, one
    lookup by rank for each edge.
    """
    # Kept: what the rows come from runs once.
    return edges_of_counts(saved(rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))), n_bins, group, value, on_overflow)


def edges_of_counts(counts: DataFrame, n_bins: int, group: str = "hist_idx", value: str = "value", on_overflow: str = "error") -> DataFrame:
    """The same of values that are counted already: (group, value, n), each value once."""
    most = counts.groupBy(group).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    if most > MOST_VALUES:
        return walked_edges(counts, n_bins, group, value, on_overflow)
    kind = counts.schema[group].dataType.simpleString()

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(value)
        edges = equalised_edges(frame[value].tolist(), frame["n"].tolist(), n_bins, on_overflow)
        return pd.DataFrame({group: frame[group].iloc[0], "edge_idx": range(len(edges)), "edge": edges}).astype({"edge_idx": "int32", "edge": "float64"})

    return counts.groupBy(group).applyInPandas(fold, f"`{group}` {kind}, edge_idx int, edge double")


def ranked_runs(counts: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, lo, hi, next, range): each distinct value's ranks, by prefix sums over ranges of values and within them."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(n, group, value).withColumn("range", F.spark_partition_id())

    dealt = saved(dealt)
    starts = dealt.groupBy(group, "range").agg(F.sum("n").alias("range_n"), F.min(value).alias("range_first"))
    by_range = Window.partitionBy(group).orderBy("range")
    starts = starts.withColumns({"start": F.coalesce(F.sum("range_n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "after": F.lead("range_first").over(by_range)})
    within = Window.partitionBy(group, "range").orderBy(value)
    inside = dealt.withColumns({"upto": F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)), "next_here": F.lead(value).over(within)})
    return inside.join(starts.select(group, "range", "start", "after"), [group, "range"]).select(group, F.col(value).alias("value"), (F.col("start") + F.col("upto") - F.col("n")).alias("lo"), (F.col("start") + F.col("upto")).alias("hi"), F.coalesce("next_here", "after").alias("next"), "range")


def walked_edges(counts: DataFrame, n_bins: int, group: str, value: str, on_overflow: str = "error") -> DataFrame:
    """The same edges without gathering a group: each edge looks for the run at each group's rank.

    Runs are kept by range, of which there are as many as shuffle partitions; their
    ranks say which range has an edge, and only that one is read.
    """

    spark = counts.sparkSession
    runs = saved(ranked_runs(counts, group, value), "range")
    ends: dict = {}
    for r in runs.groupBy(group, "range").agg(F.max("hi").alias("end")).collect():
        ends.setdefault(r[group], []).append((r.end, r["range"]))
    ends = {g: sorted(x) for g, x in ends.items()}
    state = {g: {"n": x[-1][0], "at": 0, "sur": x[-1][0] % n_bins, "def": 0, "edges": []} for g, x in ends.items()}
    for g, s in state.items():
        if s["n"] < n_bins:
            raise ValueError(f"{s['n']} values of {g} can't make {n_bins} bins")
    kind = counts.schema[group].dataType.simpleString()
    for k in range(n_bins - 1):
        for s in state.values():
            share, left = s["n"] // n_bins, n_bins - k
            if s["sur"]:
                more = max(1, s["sur"] // left)
                s["at"], s["sur"] = s["at"] + share + more, s["sur"] - more
            elif s["def"]:
                less = min(max(1, s["def"] // left), share)
                s["at"], s["def"] = s["at"] + share - less, s["def"] - less
            else:
                s["at"] += share
            if s["at"] >= s["n"] and on_overflow != "truncate":
                raise ValueError("too many equal values for so many bins")
        asked = spark.createDataFrame([(g, s["at"]) for g, s in state.items() if s["at"] < s["n"]], f"`{group}` {kind}, at long")
        ranges = {ends[g][bisect_right(ends[g], (s["at"], float("inf")))][1] for g, s in state.items() if s["at"] < s["n"]}
        for r in runs.filter(F.col("range").isin(sorted(ranges))).join(F.broadcast(asked), group).filter("lo <= at AND at < hi").collect():
            s = state[r[group]]
            at, edge = s["at"], r["value"]
            if at > r["lo"]:
                back, on = at - r["lo"], r["hi"] - at
                if r["hi"] == s["n"]:
                    s["at"] = r["lo"]
                elif back < on or back == on and s["def"] > 0:
                    s["at"] = r["lo"]
                    s["sur"], s["def"] = (back - s["def"], 0) if back > s["def"] else (s["sur"], s["def"] - back)
                else:
                    s["at"], edge = r["hi"], r["next"]
                    s["def"], s["sur"] = (on - s["sur"], 0) if on > s["sur"] else (s["def"], s["sur"] - on)
            s["edges"].append(float(edge))
    return spark.createDataFrame([(g, i, e) for g, s in state.items() for i, e in enumerate(s["edges"])], f"`{group}` {kind}, edge_idx int, edge double")


def distinct_edges(rows: DataFrame, n_bins: int, value: str) -> DataFrame:
    """Edges of values without ties: the first value of each n-tile but the first, found by its rank."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, [value], {"lo": F.col("n")})
    total = counts.agg(F.sum("n").alias("total"))
    share, rest = F.expr(f"total div {n_bins}"), F.col("total") % n_bins
    wanted = total.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_bins - 1)))).withColumn("rank", F.col("k") * share + F.least(F.col("k"), rest))
    # As many ranks as edges.
    found = ranked.join(F.broadcast(wanted), (F.col("lo") <= F.col("rank")) & (F.col("rank") < F.col("lo") + F.col("n")))
    return found.select((F.col("k") - 1).cast("int").alias("edge_idx"), F.col(value).alias("edge"))
