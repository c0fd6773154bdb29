"""Queries of problem 5, over all contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.syntax.files import diagnosis, is_invalid
from loomgraph.sources.tables import load


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = load(spark, sf_dir, "check_contexts").select("context_id", "file_path", "source")
    return contexts.filter(is_invalid(F.col("file_path"), F.col("source"))).select("context_id").distinct()


def p5_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost, cause and place of the repairs of each invalid context."""
    contexts = load(spark, sf_dir, "check_contexts").select("context_id", "file_path", "source")
    bad = contexts.filter(is_invalid(F.col("file_path"), F.col("source")))
    # repairs take far longer than parsing, and few files need them: they are dealt evenly to all cores
    bad = bad.repartition(4 * spark.sparkContext.defaultParallelism)
    found = bad.withColumn("d", diagnosis(F.col("file_path"), F.col("source")))
    return found.select("context_id", "file_path", "d.cost", "d.cause", F.round("d.edits_at", 4).alias("edits_at")).distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, invalid files and their share per repository and target_language (nulls are groups of their own)."""
    contexts = load(spark, sf_dir, "check_contexts").select("context_id", "repo", "target_language", is_invalid(F.col("file_path"), F.col("source")).alias("bad"))
    return (
        contexts.distinct().groupBy("repo", "target_language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("bad")).alias("n_invalid"))
        .withColumn("invalid_share", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )


QUERIES = {"p5_found": p5_found, "p5_repairs": p5_repairs, "p5_rates": p5_rates}
SQL: dict[str, str] = {}
