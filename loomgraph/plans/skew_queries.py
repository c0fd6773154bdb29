"""Queries of problem 2, over the whole of import_bindings and structural_edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.skew import hot_keys, key_profiles, weighted_values
from loomgraph.sources.tables import load

PAIRS = (("import_bindings", "module_spec", "local_symbol_id"), ("structural_edges", "to_id", "from_id"))
SHARE = 0.02


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        hot_keys(key_profiles(weighted_values(load(spark, sf_dir, table), key, value)), SHARE).select(F.lit(table).alias("table_name"), "key_value")
        for table, key, value in PAIRS
    ]
    return parts[0].unionByName(parts[1])


def p2_key_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        key_profiles(weighted_values(load(spark, sf_dir, table), key, value), (0.5, 0.99)).select(
            F.lit(table).alias("table_name"), "key_value", "n_rows", "n_distinct", "mode_value", "mode_rows",
            F.col("weight_percentiles")[0].alias("weight_p50"), F.col("weight_percentiles")[1].alias("weight_p99"),
        )
        for table, key, value in PAIRS
    ]
    return parts[0].unionByName(parts[1])


QUERIES = {"p2_found": p2_found, "p2_key_profiles": p2_key_profiles}

_FOUND = """SELECT '{t}' AS table_name, {k} AS key_value FROM {t} WHERE {k} IS NOT NULL GROUP BY {k}
HAVING count(*) >= 0.02 * (SELECT count(*) FROM {t} WHERE {k} IS NOT NULL)"""
_PROFILE = """SELECT '{t}' AS table_name, key_value, sum(w)::BIGINT AS n_rows, count(v) AS n_distinct,
  first(v ORDER BY w DESC, v) FILTER (v IS NOT NULL) AS mode_value, max(w) FILTER (v IS NOT NULL) AS mode_rows,
  quantile_cont(w, 0.5) FILTER (v IS NOT NULL) AS weight_p50, quantile_cont(w, 0.99) FILTER (v IS NOT NULL) AS weight_p99
FROM (SELECT {k} AS key_value, {v} AS v, count(*) AS w FROM {t} WHERE {k} IS NOT NULL GROUP BY 1, 2) GROUP BY key_value"""

SQL = {
    "p2_found": "\nUNION ALL\n".join(_FOUND.format(t=t, k=k) for t, k, _ in PAIRS),
    "p2_key_profiles": "\nUNION ALL\n".join(_PROFILE.format(t=t, k=k, v=v) for t, k, v in PAIRS),
}
