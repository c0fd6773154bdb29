"""Queries of problem 8, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.reading import levels
from loomgraph.sources.tables import load


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(load(spark, sf_dir, "documents"), load(spark, sf_dir, "reading_samples"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = levels(load(spark, sf_dir, "documents"), load(spark, sf_dir, "reading_samples"), with_ranks=False)
    return found.filter((F.col("lang") == "en") & (F.col("band") == 4)).select("doc_id").distinct()


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and words by language and band."""
    return p8_levels(spark, sf_dir).groupBy("lang", "band").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_words").alias("n_words"), F.round(F.avg("coverage_rank"), 2).alias("mean_coverage_rank"))


def p8_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given bands against those that readers gave."""
    labels = load(spark, sf_dir, "reading_labels").groupBy("doc_id").agg(F.round(F.avg("band")).cast("int").alias("reader_band"))
    found = levels(load(spark, sf_dir, "documents"), load(spark, sf_dir, "reading_samples"), with_ranks=False)
    return found.join(labels, "doc_id").groupBy("reader_band", "band").count().withColumnRenamed("count", "n_documents")


QUERIES = {"p8_found": p8_found, "p8_levels": p8_levels, "p8_profile": p8_profile, "p8_validation": p8_validation}
SQL: dict[str, str] = {}
