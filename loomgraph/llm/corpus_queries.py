"""Queries of problems 6 and 7, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.mixing import mix, shares
from loomgraph.llm.packing import fill_documents, summary
from loomgraph.llm.tokens import tokenizer_path
from loomgraph.sources.tables import load


#: The domains of the sources in the tables.
DOMAINS = {
    "issue_thread": "discussion", "review_comment": "discussion", "forum_archive": "discussion",
    "rule_docs": "reference", "api_reference": "reference", "design_note": "reference",
    "readme": "guides", "tutorial": "guides", "changelog": "records",
}
#: Beyond the total at which all targets are met: sources run short.
SCARCE = 3.0


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "pack_limits"), tokenizer_path(spark))


def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(p6_packed(spark, sf_dir))


def p6_costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers by kind if a container's cost grows with the square of its capacity, as attention does, besides a fixed one."""
    return summary(fill_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "pack_limits"), tokenizer_path(spark), cost=lambda c: 64 + c + c * c / 2048))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), tokenizer_path(spark), domains=DOMAINS)


def p7_scarce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached at a total for which sources are short, so that budgets are handed to siblings, then to those of the parent."""
    mixed = mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), tokenizer_path(spark), domains=DOMAINS, scale=SCARCE)
    return shares(mixed, load(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(p7_mix(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


QUERIES = {"p6_packed": p6_packed, "p6_summary": p6_summary, "p6_costed": p6_costed, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_scarce": p7_scarce}
SQL: dict[str, str] = {}
