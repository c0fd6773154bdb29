"""Results for every key when a few keys hold most rows (problem 2).

Value-frequency compression: rows are first grouped by (key, value), so a hot key is spread over all
tasks by its values and repeated rows shrink to one weighted value before the second grouping by key.
The second grouping only has aggregates with a map-side partial (sums, counts, max_by), so at most one
row a key and task is shuffled, whatever the key's share of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.tables import cut


def weighted_values(df: DataFrame, key: str | Column, value: str | Column) -> DataFrame:
    """``key_value, counterpart, weight``: each distinct pair with the number of rows that hold it.

    Rows with a null key are left out; a null value is a value of its own (null) with its weight. Other
    columns of ``df``, whatever their names, are ignored. An empty table gives no rows.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return (
        df.select(as_column(key).alias("key_value"), as_column(value).alias("counterpart"))
        .filter(F.col("key_value").isNotNull())
        .groupBy("key_value", "counterpart")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def key_profiles(weighted: DataFrame, percentiles: tuple[float, ...] = ()) -> DataFrame:
    """One row a key: ``n_rows``, exact ``n_distinct`` of non-null values, ``mode_value``, ``mode_rows``.

    Ties of the mode go to the smallest value; it is null if all values are. ``percentiles`` adds
    ``weight_percentiles``, exact over the rows held by each value, from a second compression: the
    number of values of each weight, of which there are few (distinct weights of n rows: at most the
    square root of 2n), so no group of values is ever gathered.
    """
    held = F.col("counterpart").isNotNull()
    out = weighted.groupBy("key_value").agg(
        F.sum("weight").alias("n_rows"),
        F.count("counterpart").alias("n_distinct"),
        # min of (-weight, value): the largest weight, then the smallest value
        F.min(F.when(held, F.struct((-F.col("weight")).alias("w"), F.col("counterpart").alias("v")))).alias("m"),
    )
    out = out.select("key_value", "n_rows", "n_distinct", F.col("m.v").alias("mode_value"), (-F.col("m.w")).alias("mode_rows"))
    if percentiles:
        spread = (
            weighted.filter(held).groupBy("key_value", "weight").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("key_value").agg(F.percentile("weight", list(percentiles), F.col("n")).alias("weight_percentiles"))
        )
        out = out.join(spread, "key_value", "left")
    return out


def hot_keys(profiles: DataFrame, share: float = 0.02) -> DataFrame:
    """The profiles of the keys that hold at least ``share`` of all rows with a key.

    The total is the sum over the profiles: one row, so its broadcast has a proven bound.
    """
    total = profiles.agg(F.sum("n_rows").alias("all_rows"))
    return profiles.join(F.broadcast(total), F.col("n_rows") >= F.lit(share) * F.col("all_rows"), "inner")


def value_percentiles(weighted: DataFrame, percentiles: tuple[float, ...]) -> DataFrame:
    """``key_value, p..``: exact percentiles of each key's numeric values, interpolated between neighbours; null without a value.

    Weighted values are sorted by (key, value) into ranges, so a hot key lies on many of them; a range knows how many rows its
    key has before it, and only the values at the asked places are gathered (two a percentile and key).
    """
    held = weighted.filter(F.col("counterpart").isNotNull()).select("key_value", F.col("counterpart").cast("double").alias("v"), "weight")
    ranged = cut(held.repartitionByRange("key_value", "v").withColumn("range", F.spark_partition_id()))
    # a row for each key and range
    sums = ranged.groupBy("key_value", "range").agg(F.sum("weight").alias("rows"))
    before = Window.partitionBy("key_value").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key_value", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy("key_value")).alias("n"))
    within = Window.partitionBy("key_value", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("weight").over(within), F.lit(0))).join(starts, ["key_value", "range"]).withColumn("first", F.col("start") + F.col("inside"))
    name = lambda p: f"p{round(100 * p):02d}"
    value_at = lambda place: F.max(F.when((F.col("first") <= place) & (place < F.col("first") + F.col("weight")), F.col("v")))
    places = {p: (F.col("n") - 1) * F.lit(p) for p in percentiles}
    both = [c for p, x in places.items() for c in (value_at(F.floor(x)).alias("lo_" + name(p)), value_at(F.ceil(x)).alias("hi_" + name(p)), F.max(x - F.floor(x)).alias("part_" + name(p)))]
    found = placed.groupBy("key_value").agg(*both)
    mixed = [(F.col("lo_" + name(p)) + (F.col("hi_" + name(p)) - F.col("lo_" + name(p))) * F.col("part_" + name(p))).alias(name(p)) for p in percentiles]
    return weighted.select("key_value").distinct().join(found.select("key_value", *mixed), "key_value", "left")
