"""Queries of problem 1, over all contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.handwritten import library_sources, not_by_hand, train
from loomgraph.sources.tables import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_by_hand(load(spark, sf_dir, "check_contexts"), load(spark, sf_dir, "known_libs")).select("context_id")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each found context is not hand-written."""
    return not_by_hand(load(spark, sf_dir, "check_contexts"), load(spark, sf_dir, "known_libs"))


def p1_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the classifiers do on the repositories held out of fitting."""
    model = train(load(spark, sf_dir, "check_contexts"), library_sources(load(spark, sf_dir, "known_libs")))
    return spark.createDataFrame(model.report, "classifier string, held_positives int, held_others int, recall double, proposed_share double")


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons, "p1_validation": p1_validation}
SQL: dict[str, str] = {}
