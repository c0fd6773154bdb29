"""A sample that reruns, partitionings and growth leave as it is (problem 3).

Consistent weighted Poisson sampling: an id is chosen when its hash, a number in [0, 1), is below
weight x constant. The hash depends on the seed and the id alone. The weight of an id is the largest
that any of its records ever had, so its inclusion probability never falls: records that come later
may add ids and never remove one.

A record passes by itself or not at all, and an id is chosen exactly if its heaviest record passes.
So the test runs in the scan, before any shuffle, and only chosen records are grouped.

Cases: a null id is never chosen (it names no record); an empty id is an id. A null, NaN or
non-positive weight counts as ``least``. Weights with weight x constant >= 1 are always chosen. Ties
don't exist: each id is judged alone. Repeated rows change nothing. An empty table gives an empty sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 52


def unit_hash(id_column: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:id); the same in any engine."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    text = F.concat(F.lit(f"{seed}:"), c.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double") / F.lit(float(1 << BITS))


def positive(weight: Column, least: float = 1.0) -> Column:
    w = weight.cast("double")
    return F.when(w.isNotNull() & ~F.isnan(w) & (w > 0), w).otherwise(F.lit(least))


def merge_state(state: DataFrame | None, records: DataFrame, id_column: str, weight: Column, least: float = 1.0) -> DataFrame:
    """``id, max_weight``: the running maxima after ``records``. Store this table between runs.

    Map-side maxima come first, so a hot id costs one row a task.
    """
    new = records.select(F.col(id_column).alias("id"), positive(weight, least).alias("max_weight")).filter(F.col("id").isNotNull())
    both = new if state is None else new.unionByName(state.select("id", "max_weight"))
    return both.groupBy("id").agg(F.max("max_weight").alias("max_weight"))


def select(state: DataFrame, constant: float, seed: int = 0) -> DataFrame:
    """The chosen ids of a stored state."""
    return state.filter(unit_hash("id", seed) < F.col("max_weight") * F.lit(constant))


def sample_ids(records: DataFrame, id_column: str, weight: Column, constant: float, seed: int = 0, least: float = 1.0, state: DataFrame | None = None) -> DataFrame:
    """``id, max_weight`` of the chosen ids: equal to ``select(merge_state(...))``, filtered before the shuffle."""
    new = records.select(F.col(id_column).alias("id"), positive(weight, least).alias("max_weight"))
    both = new if state is None else new.unionByName(state.select("id", "max_weight"))
    passed = both.filter(F.col("id").isNotNull() & (unit_hash("id", seed) < F.col("max_weight") * F.lit(constant)))
    return passed.groupBy("id").agg(F.max("max_weight").alias("max_weight"))


def sample_rows(records: DataFrame, id_column: str, weight: Column, constant: float, seed: int = 0, least: float = 1.0) -> DataFrame:
    """All records of the chosen ids, none of the others, with all their columns."""
    ids = sample_ids(records, id_column, weight, constant, seed, least).select(F.col("id").alias("__chosen_id"))
    return records.join(ids, F.col(id_column) == F.col("__chosen_id"), "left_semi")
