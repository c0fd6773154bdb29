"""Graph queries over all edges, with no bound of quantity or depth: of the order graph, and of the project's own modules and calls.

The queries of ``graph_queries`` bound edges and depth so that recursive SQL can follow; these have no SQL and are
tested against brute force.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import export, graph, rules
from loomgraph.plans import fact_queries, graph_queries
from loomgraph.sources.tables import cut


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph_queries.nodes(spark, sf_dir), cut(graph_queries.edges(spark, sf_dir, None))


def modules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All known files and the edges between them."""
    e = cut(fact_queries.module_edges(spark, sf_dir))
    return fact_queries.files(spark, sf_dir).select(F.col("file").alias("id")).union(_ends(e)).distinct(), e


def calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All functions and methods, and the calls between symbols."""
    e = cut(fact_queries.call_edges(spark, sf_dir))
    own = fact_queries.symbols(spark, sf_dir).filter(F.col("kind").isin("function", "method")).select("id")
    return own.union(_ends(e)).distinct(), e


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = graph.cycles(graph.components(edges))
    return c.select("cycle", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, cycle`` by the rounds that larger graphs take, no rest finished in one task."""
    return graph.components(edges, 0)


def cycle_ranking(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.cycles(graph.components(edges)).orderBy(F.desc("size"), "cycle").limit(20).select("cycle", "size")


def impact(nodes: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    return graph.reach(edges, graph_queries.seeds(None, None, edges), direction)


def longest_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.longest_from(graph.condensed(edges, cut(graph.components(edges)))).filter("length > 0")


def shortest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node's length to each seed that it reaches, searched from the two seeds."""
    ends = cut(graph_queries.seeds(None, None, edges).select(F.col("id").alias("src")))
    pairs = ends.crossJoin(_ends(edges).select(F.col("id").alias("dst")))
    found = graph.shortest_lengths(graph.reversed_edges(edges), pairs, None)
    return found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length")


GRAPHS = {"parts": parts, "modules": modules, "calls": calls}
OPERATORS = {
    "gr_edges": lambda n, e: e, "gr_degrees": lambda n, e: graph.degrees(e), "gr_instability": lambda n, e: graph.instability(e), "gr_entry_points": graph.entry_points,
    "gr_cycles": cycles, "gr_cycle_members_coloured": coloured, "gr_cycle_histogram": lambda n, e: graph.size_histogram(graph.components(e)), "tk_cycle_ranking": cycle_ranking,
    "gr_dead_modules": graph.dead_modules, "gr_layering": lambda n, e: graph.layers(n, e),
    "gr_impact_up": partial(impact, direction="up"), "gr_impact_down": partial(impact, direction="down"), "gr_undirected_reach": partial(impact, direction="both"),
    "gr_topological_levels": lambda n, e: graph.topological_levels(e, n), "gr_longest_chain": longest_chain, "gr_shortest_lengths": shortest,
    "ru_no_cycles": lambda n, e: rules.no_cycles(graph.components(e)).select("rule_id", "file", "message"), "ru_dead_module": lambda n, e: rules.dead_module(n, e).select("rule_id", "file"),
    **{f"sk_export_{form}": partial(export.lines, form=form) for form in ("dot", "mermaid", "graphml", "text")},
}


def _on(operator, of):
    return lambda spark, sf_dir: operator(*of(spark, sf_dir))


QUERIES = {f"{name}_all_{of}": _on(operator, take) for name, operator in OPERATORS.items() for of, take in GRAPHS.items()}
SQL: dict[str, str] = {}
