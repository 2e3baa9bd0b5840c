"""The row before, in chains of any length.

A plain ``lag() over (partition by key order by moment)`` puts the whole chain of one key into one task.
Here rows of keys with more than a threshold are range-partitioned by key and order first. The ranges are
quantiles of the rows themselves, with ties broken by the whole order, so a slice is of even size however the
moments lie. Each slice is linked by itself, and only the first and last row of each slice meet once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A chain of more rows is sliced.
HOT_ROWS = 50_000
#: At most so many keys are told to all tasks: the threshold rises with the number of rows, so more can't exist.
MAX_HOT_KEYS = 10_000
#: Slices of all long chains together, each of about a fourth of the threshold; with this many keys at most there can't be more.
MAX_SLICES = 4 * MAX_HOT_KEYS


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> tuple[list, int]:
    """The keys with more rows than a threshold, with _n, and that threshold: hot_rows, or more in tables so large that over MAX_HOT_KEYS keys could pass it."""
    limit = max(hot_rows, df.count() // MAX_HOT_KEYS)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).collect(), limit  # at most MAX_HOT_KEYS rows, by the limit


def linked(
    df: DataFrame,
    keys: list[str],
    moment: str,
    ties: list[str],
    values: list[str],
    source: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    backwards: bool = False,
    kept: Column | None = None,
) -> DataFrame:
    """df with _prev, the struct of values in the row before, null in a chain's first row.

    Chains are by keys, in the order of moment, then ties, nulls first; backwards: from the end, so _prev is the row after.
    source: a cheaper table with the same rows' keys, to count from. kept: a condition on df and _prev; rows that fail it
    don't come out. Null keys form a chain of their own. Rows of a long chain that are alike in the whole order may come
    in any order, as in a window.
    """
    order = [F.col(c).desc_nulls_last() if backwards else F.col(c).asc_nulls_first() for c in [moment, *ties]]
    before = F.lag(F.struct(*values))
    only = (lambda d: d) if kept is None else (lambda d: d.filter(kept))
    hot, limit = hot_keys(df if source is None else source, keys, hot_rows)
    if not hot:
        return only(df.withColumn("_prev", before.over(Window.partitionBy(*keys).orderBy(*order))))
    shape = ", ".join(f"_h{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    few = F.broadcast(df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in hot], shape))
    on = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)]
    cold = df.join(few, on, "left_anti").withColumn("_prev", before.over(Window.partitionBy(*keys).orderBy(*order)))
    many = min(sum(-(-4 * r["_n"] // limit) for r in hot), MAX_SLICES)
    warm = df.join(few, on, "left_semi").repartitionByRange(many, *(F.col(k).asc_nulls_first() for k in keys), *order).withColumn("_slice", F.spark_partition_id())
    own = Window.partitionBy(*keys, "_slice").orderBy(*order)
    warm = warm.withColumn("_prev", before.over(own)).withColumn("_edge", F.col("_prev").isNull() | F.lead(F.lit(1)).over(own).isNull())
    if kept is not None:
        warm = warm.filter(F.col("_edge") | kept)
    lane = F.when(F.col("_edge"), F.lit(-1)).otherwise(F.col("_slice"))  # the edges of one key meet in one task: two of each slice
    across = before.over(Window.partitionBy(*keys, lane).orderBy(*order))
    warm = warm.withColumn("_prev", F.coalesce("_prev", F.when(F.col("_edge"), across))).drop("_edge", "_slice")
    return only(cold).unionByName(only(warm))


def join_hot(rows: DataFrame, small: DataFrame, keys: list[str], spread: str, hot_rows: int = HOT_ROWS, how: str = "left") -> DataFrame:
    """rows joined with small, which has few rows for each of keys; rows of keys with many rows are dealt out by spread over lanes, and small's are copied to each.

    Never a broadcast: small has no bound, and its size on disk, by which it would be chosen, says little about that in memory.
    """
    small = small.hint("merge")
    hot, limit = hot_keys(rows, keys, hot_rows)
    if not hot:
        return rows.join(small, keys, how)
    shape = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    lanes = [(*(r[k] for k in keys), -(-r["_n"] // limit)) for r in hot]
    few = F.broadcast(rows.sparkSession.createDataFrame(lanes, f"{shape}, _lanes int"))
    dealt = rows.join(few, keys, "left").withColumn("_lane", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_lanes")), F.lit(0)).cast("int")).drop("_lanes")
    copied = small.join(few, keys, "left").withColumn("_lane", F.explode(F.sequence(F.lit(0), F.coalesce("_lanes", F.lit(1)) - 1))).drop("_lanes").hint("merge")
    return dealt.join(copied, [*keys, "_lane"], how).drop("_lane")
