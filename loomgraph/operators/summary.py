"""Compound results: architecture summary, impact, profiles, cycle membership, ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph
from loomgraph.sources.tables import cut


def architecture(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: modules, edges, entry points, cycles, modules in cycles, largest cycle and longest chain."""
    edges, members = cut(edges), cut(members)
    sizes = members.groupBy("cycle").count()
    one = lambda df, **aggs: df.agg(*[c.alias(n) for n, c in aggs.items()])
    parts = [
        one(nodes, modules=F.count(F.lit(1))), one(edges, edges=F.count(F.lit(1))), one(graph.entry_points(nodes, edges), entries=F.count(F.lit(1))),
        one(sizes, cycles=F.count(F.lit(1)), in_cycles=F.coalesce(F.sum("count"), F.lit(0)), largest_cycle=F.coalesce(F.max("count"), F.lit(0))),
        one(graph.longest_from(graph.condensed(edges, members)), longest_chain=F.coalesce(F.max("length"), F.lit(0))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # each is one row
    return out


def impact(edges: DataFrame, nodes: DataFrame, members: DataFrame, seeds: DataFrame, direction: str = "up", depth: int | None = None) -> DataFrame:
    """``id, depth, fan_in, fan_out, entry, cycle``: a search with each module's metrics; cycles only if the search holds all of them."""
    found = cut(graph.reach(edges, seeds, direction, depth))
    whole = members.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))
    inside = members.join(found.select("id"), "id", "left_semi").groupBy("cycle").agg(F.count(F.lit(1)).alias("m")).join(whole, "cycle").filter("n = m").select("cycle")
    cycles = members.join(inside, "cycle", "left_semi")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.join(graph.degrees(edges), "id", "left").join(cycles, "id", "left").select("id", "depth", zero("fan_in").alias("fan_in"), zero("fan_out").alias("fan_out"), (zero("fan_in") == 0).alias("entry"), "cycle")


def profiles(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """``id, fan_in, fan_out, entry, in_cycle`` of every module."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return nodes.select("id").join(graph.degrees(edges), "id", "left").join(members, "id", "left").select("id", zero("fan_in").alias("fan_in"), zero("fan_out").alias("fan_out"), (zero("fan_in") == 0).alias("entry"), F.col("cycle").isNotNull().alias("in_cycle"))


def without_tests(nodes: DataFrame) -> DataFrame:
    """Modules that aren't tests by their path."""
    return nodes.filter(~F.col("id").rlike(r"(?:^|/)(?:tests?|__tests__|spec)/|\.(?:test|spec)\.[a-z]+$|(?:^|/)test_[^/]*\.py$"))


def filter_edges(edges: DataFrame, kinds: list[str] | None = None, package: DataFrame | None = None) -> DataFrame:
    """Edges of the kinds, and with ``package`` (``id, package``) only those that cross packages."""
    out = edges if kinds is None else edges.filter(F.col("kind").isin(kinds))
    if package is not None:
        a, b = package.select(F.col("id").alias("src"), F.col("package").alias("_a")), package.select(F.col("id").alias("dst"), F.col("package").alias("_b"))
        out = out.join(a, "src").join(b, "dst").filter(F.col("_a") != F.col("_b")).drop("_a", "_b")
    return out


def search(modules: DataFrame, symbols: DataFrame, query: str, limit: int = 20, bonus: int = 20) -> DataFrame:
    """Modules and exported symbols by score, symbols with a bonus and before modules of the same score."""
    s = symbols.filter(F.col("flags").bitwiseAND(1) != 0).select(F.lit(0).alias("sort"), F.lit("symbol").alias("what"), F.col("file").alias("path"), "name", (T.search_score([F.col("name"), F.col("file")], query) + bonus).alias("score"))
    m = modules.select(F.lit(1).alias("sort"), F.lit("module").alias("what"), F.col("file").alias("path"), F.lit("").alias("name"), T.search_score([F.col("file")], query).alias("score"))
    return s.unionByName(m).filter(F.col("score").isNotNull()).orderBy(F.desc("score"), "sort", "path", "name").limit(limit).select("what", "path", "name", "score")
