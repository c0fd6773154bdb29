"""Queries of problem 4, over the newest version of every file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.docpairs import documentation, pairs
from loomgraph.sources.tables import load


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts, symbols = load(spark, sf_dir, "check_contexts"), load(spark, sf_dir, "symbols")
    return documentation(contexts, symbols).select("symbol_id").distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(load(spark, sf_dir, "check_contexts"), load(spark, sf_dir, "symbols"))


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}
SQL: dict[str, str] = {}
