"""Directed graphs as DataFrames: ``edges(src, dst)`` without self-loops, ``nodes(id)``.

Iterations join a frontier to the edges and are cut by checkpoints, so plans don't grow and lost executors
cost a round at most. Nothing is gathered to the driver but counts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.tables import cut

#: A rest of at most so many edges, counted, is finished in one task; more goes on in rounds.
SMALL_EDGES = 1_000_000
#: Rounds of trimming before components are coloured.
TRIM_ROUNDS = 4
#: Levels of a search after which what was seen is written as one table, so plans stay short.
MERGE_LEVELS = 16


def module_graph(bindings: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` of bindings and imports (``src, dst``) whose target is a known file other than the source."""
    both = bindings.select("src", "dst").unionByName(imports.select("src", "dst"))
    return both.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).join(files.select(F.col("file").alias("dst")).distinct(), "dst", "left_semi").distinct().select("src", "dst")


def edge_info(bindings: DataFrame, imports: DataFrame) -> DataFrame:
    """``src, dst, binding_count, kind`` per edge; the kind is the strongest of its bindings, side_effect if none."""
    rank = F.when(F.col("style") == "dynamic", 3).when(F.col("style") == "cjs", 2).when(F.col("style") == "side_effect", 0).otherwise(1)
    b = bindings.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("binding_count"), F.max(rank).alias("rank"))
    out = b.join(imports.select("src", "dst").distinct(), ["src", "dst"], "full_outer")
    kinds = F.array(*[F.lit(x) for x in ("side_effect", "static", "cjs", "dynamic")])
    return out.select("src", "dst", F.coalesce("binding_count", F.lit(0)).alias("binding_count"), kinds[F.coalesce("rank", F.lit(0))].alias("kind"))


def degrees(edges: DataFrame) -> DataFrame:
    """``id, fan_in, fan_out`` of every node with an edge, in one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def instability(edges: DataFrame) -> DataFrame:
    """Ce / (Ca + Ce) to six places; isolated nodes are left out."""
    return degrees(edges).select("id", F.round(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 6).alias("instability"))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges to walk: ``down`` (importees), ``up`` (importers) or ``both``."""
    if direction == "down":
        return edges.select("src", "dst")
    return reversed_edges(edges) if direction == "up" else edges.select("src", "dst").unionByName(reversed_edges(edges)).distinct()


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "down", depth: int | None = None) -> DataFrame:
    """``id, depth`` of every node reached, seeds at depth 0. A negative depth counts as 0."""
    walk = cut(directed(edges, direction))
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, level = seen, 0
    while depth is None or level < max(0, depth):
        level += 1
        step = frontier.join(walk, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % MERGE_LEVELS == 0:
            seen = cut(seen)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between given nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def dead_modules(nodes: DataFrame, edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Nodes that no entry reaches. Unknown entries are ignored; none given (or none known) means those without importers."""
    start = entry_points(nodes, edges)
    if entries is not None:
        known = nodes.join(entries.select("id"), "id", "left_semi")
        start = start if entries.isEmpty() else known
    return nodes.join(reach(edges, start).select("id"), "id", "left_anti")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, layer``: distance from the entry points; nodes not reached get the last layer plus one."""
    found = reach(edges, entry_points(nodes, edges))
    last = found.agg((F.coalesce(F.max("depth"), F.lit(-1)) + 1).alias("rest"))
    return nodes.join(found, "id", "left").crossJoin(F.broadcast(last)).select("id", F.coalesce("depth", "rest").alias("layer"))


def _trim(edges: DataFrame) -> DataFrame:
    """Edges whose both ends may lie on a cycle: those between nodes that have edges in and out, for a few rounds."""
    n = edges.count()
    for _ in range(TRIM_ROUNDS if n else 0):
        edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = edges.count()
        if m == n:
            break
        n = m
    return edges


def _strong(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The component number of each of n nodes: Tarjan's search with its own stack."""
    order = np.argsort(src, kind="stable")
    targets, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, of = [-1] * n, [0] * n, [-1] * n
    count = parts = 0
    open_: list[int] = []
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, first[root])]
        index[root] = low[root] = count
        count += 1
        open_.append(root)
        while work:
            v, k = work.pop()
            if k < first[v + 1]:
                work.append((v, k + 1))
                w = targets[k]
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    open_.append(w)
                    work.append((w, first[w]))
                elif of[w] < 0:
                    low[v] = min(low[v], index[w])
                continue
            if low[v] == index[v]:
                while True:
                    w = open_.pop()
                    of[w] = parts
                    if w == v:
                        break
                parts += 1
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return np.array(of)


def _small_components(edges: DataFrame) -> DataFrame:
    """``id, cycle`` of a counted, small graph, in one task on an executor."""
    schema = T.StructType([T.StructField("id", edges.schema["src"].dataType), T.StructField("cycle", edges.schema["src"].dataType)])

    def run(parts):
        rows = pd.concat(list(parts) or [pd.DataFrame({"src": [], "dst": []})])
        if rows.empty:
            return
        codes, names = pd.factorize(pd.concat([rows.src, rows.dst]), sort=True)
        of = _strong(codes[: len(rows)], codes[len(rows) :], len(names))
        out = pd.DataFrame({"id": names, "part": of})
        # names are sorted, so the first of a component is its least
        out["cycle"] = out.groupby("part")["id"].transform("first")
        yield out[out.groupby("part")["id"].transform("size") > 1][["id", "cycle"]]

    return edges.repartition(1).mapInPandas(run, schema)


def components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """``id, cycle`` of the nodes on cycles: strongly connected components of two or more, named by their least node.

    Trimming, then colouring: every node takes the least node that reaches it; of a colour's nodes, those that
    reach that node back within the colour are a component. Components are removed and the rest is coloured anew,
    until no more than ``small`` (``SMALL_EDGES``) edges are left, which one task finishes.
    """
    left = _trim(cut(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()))
    found: DataFrame | None = None
    while not left.isEmpty():
        if left.count() <= (SMALL_EDGES if small is None else small):
            rest = _small_components(left)
            found = rest if found is None else found.unionByName(rest)
            break
        color = left.select(F.col("src").alias("id")).distinct().withColumn("color", F.col("id"))
        color = cut(color)
        while True:
            pushed = color.join(left, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("pushed"))
            new = cut(color.join(pushed, "id", "left").select("id", F.least("color", F.coalesce("pushed", "color")).alias("color"), F.col("color").alias("old")))
            changed = new.filter(F.col("color") != F.col("old"))
            color = new.select("id", "color")
            if changed.isEmpty():
                break
        same = cut(
            left.join(color.select(F.col("id").alias("src"), F.col("color").alias("c1")), "src")
            .join(color.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst").filter(F.col("c1") == F.col("c2")).select("src", "dst")
        )
        back = reach(same, color.filter(F.col("id") == F.col("color")).select("id"), "up").select("id")
        part = cut(color.join(back, "id", "left_semi").select("id", F.col("color").alias("cycle")))
        found = part if found is None else cut(found.unionByName(part))
        rest = left.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
        left = _trim(cut(rest))
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("cycle")).limit(0)
    sized = found.join(found.groupBy("cycle").count().filter("count > 1").select("cycle"), "cycle", "left_semi")
    return sized.select("id", "cycle")


def cycles(members: DataFrame) -> DataFrame:
    """``cycle, size, members`` (sorted); a cycle's list is as long as the cycle."""
    return members.groupBy("cycle").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("id")).alias("members"))


def size_histogram(members: DataFrame) -> DataFrame:
    return members.groupBy("cycle").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_cycles"))


def condensed(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between components, each named by its least node."""
    end = lambda c: members.select(F.col("id").alias(c), F.col("cycle").alias(c + "_cycle"))
    joined = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    return joined.select(F.coalesce("src_cycle", "src").alias("src"), F.coalesce("dst_cycle", "dst").alias("dst")).filter(F.col("src") != F.col("dst")).distinct()


def longest_from(edges: DataFrame) -> DataFrame:
    """``id, length``: the longest chain of edges that starts at each node of an acyclic graph with an edge.

    Sinks are peeled off: a node whose last edge goes in round k has a chain of k edges. Edges retire with the nodes they lead
    to, so all rounds together read each edge about once.
    """
    left = cut(edges.select("src", "dst").distinct())
    sources = lambda df: df.select(F.col("src").alias("id")).distinct()
    found, k = cut(left.select(F.col("dst").alias("id")).distinct().join(sources(left), "id", "left_anti").withColumn("length", F.lit(0))), 0
    parts = [found]
    while not found.isEmpty():
        k += 1
        rest = cut(left.join(found.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
        found = cut(sources(left).join(sources(rest), "id", "left_anti").withColumn("length", F.lit(k)))
        left = rest
        parts.append(found)
        if len(parts) > MERGE_LEVELS:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def longest_chain(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``place, id``: the nodes of the longest chain of components (named by their least node), of several the least by its nodes in order.

    From the longest lengths downwards each step goes to the least successor whose length is one less, so no path is ever stored.
    """
    flat = cut(condensed(edges, members))
    lengths = cut(longest_from(flat))
    top = lengths.agg(F.max("length")).first()[0]
    if top is None:
        return edges.select(F.lit(0).alias("place"), F.col("src").alias("id")).limit(0)
    at = lengths.filter(F.col("length") == top).agg(F.min("id").alias("id"))
    steps = [at.select(F.lit(0).alias("place"), "id")]
    for k in range(1, top + 1):
        near = flat.join(at.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        at = cut(near.join(lengths.filter(F.col("length") == top - k), "id", "left_semi").agg(F.min("id").alias("id")))  # one row
        steps.append(at.select(F.lit(k).alias("place"), "id"))
    return reduce(DataFrame.unionByName, steps)


def dependency_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, level, place``: dependencies first, the nodes freed together in their order; those in or behind cycles (level null) come last."""
    from loomgraph.operators.export import placed

    return placed(topological_levels(edges, nodes), [F.coalesce("level", F.lit(1 << 30)), F.col("id")], "place")


def cycle_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """``size, members, change``: cycles (``id, cycle``) that only one side has; a cycle is its set of members."""
    return diff(cycles(base), cycles(current), ["size", "members"])


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, level``: dependencies first; level 0 imports nothing, any other node is one above its highest dependency. Nodes in or behind cycles have none (null)."""
    left, level = cut(edges.select("src", "dst").distinct()), 0
    rest = cut(nodes.select("id").distinct())
    out: DataFrame | None = None
    while True:
        free = cut(rest.join(left.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
        if free.isEmpty():
            break
        done = free.withColumn("level", F.lit(level))
        out = done if out is None else cut(out.unionByName(done))
        rest = cut(rest.join(free, "id", "left_anti"))
        left = cut(left.join(free.select(F.col("id").alias("dst")), "dst", "left_anti"))
        level += 1
    rest = rest.withColumn("level", F.lit(None).cast("int"))
    return rest if out is None else out.unionByName(rest)


def shortest_lengths(edges: DataFrame, pairs: DataFrame, most: int | None) -> DataFrame:
    """``src, dst, length`` of the asked pairs, up to ``most`` edges if given; a node reaches itself by 0."""
    edges = cut(edges.select("src", "dst"))
    asked = pairs.select("src", "dst").distinct()
    seen = cut(asked.select("src").distinct().select("src", F.col("src").alias("at"), F.lit(0).alias("length")))
    frontier, k = seen, 0
    while most is None or k < most:
        k += 1
        step = frontier.select(F.col("src").alias("origin"), "at").join(edges, F.col("at") == F.col("src")).select(F.col("origin").alias("src"), F.col("dst").alias("at")).distinct()
        frontier = cut(step.join(seen.select("src", "at"), ["src", "at"], "left_anti").withColumn("length", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return asked.join(seen.select("src", F.col("at").alias("dst"), "length"), ["src", "dst"])


def simple_paths(edges: DataFrame, pairs: DataFrame, most_edges: int, best: int = 5) -> DataFrame:
    """``src, dst, path, length, place``: the ``best`` simple paths of each pair with at most ``most_edges`` edges, shortest first, then by their nodes.

    Nodes that can't reach the pair's end in the edges left are dropped in each round, so paths grow toward it only.
    """
    edges = cut(edges.select("src", "dst"))
    asked = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    # back[k]: (b, at) such that b is k or fewer edges away
    back = cut(asked.select("b", F.col("b").alias("at")).distinct())
    near = [back]
    for _ in range(most_edges):
        grown = back.join(edges, F.col("at") == F.col("dst")).select("b", F.col("src").alias("at"))
        back = cut(back.unionByName(grown).distinct())
        near.append(back)
    paths = asked.join(near[most_edges].select("b", F.col("at").alias("a")), ["a", "b"], "left_semi").select("a", "b", F.col("a").alias("at"), F.array("a").alias("path"))
    done = paths.filter(F.col("at") == F.col("b"))
    for k in range(1, most_edges + 1):
        grown = paths.filter(F.col("at") != F.col("b")).join(edges, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        grown = grown.select("a", "b", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        paths = cut(grown.join(near[most_edges - k], ["b", "at"], "left_semi").select("a", "b", "at", "path"))
        done = done.unionByName(paths.filter(F.col("at") == F.col("b")))
    order = Window.partitionBy("a", "b").orderBy(F.size("path"), "path")
    ranked = done.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= best)
    return ranked.select(F.col("a").alias("src"), F.col("b").alias("dst"), "path", (F.size("path") - 1).alias("length"), "place")


def diff(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one side has, with ``change`` added or removed; sets, so repeats count once."""
    b, c = base.select(*keys).distinct(), current.select(*keys).distinct()
    return c.join(b, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(c, keys, "left_anti").withColumn("change", F.lit("removed")))


def canonical_ids(links: DataFrame, most_rounds: int = 30) -> DataFrame:
    """``id, canonical``: the end of each chain of ``id -> next`` links (one a node), by pointer doubling; a loop ends at its least node."""
    at = cut(links.filter(F.col("next").isNotNull() & (F.col("next") != F.col("id"))).groupBy("id").agg(F.min("next").alias("canonical")).withColumn("least", F.least("id", "canonical")))
    for _ in range(most_rounds):
        far = at.select(F.col("id").alias("canonical"), F.col("canonical").alias("further"), F.col("least").alias("least2"))
        new = cut(at.join(far, "canonical", "left").select("id", F.coalesce("further", "canonical").alias("canonical"), F.least("least", F.coalesce("least2", "least")).alias("least"), F.col("further").isNotNull().alias("moved")))
        at = new.select("id", "canonical", "least")
        if not new.filter("moved").isEmpty() and _ < most_rounds - 1:
            continue
        break
    # what still points at a node with a link lies on a loop
    looped = at.join(at.select(F.col("id").alias("canonical")), "canonical", "left_semi").select("id", F.lit(True).alias("loop"))
    return at.join(looped, "id", "left").select("id", F.when(F.col("loop"), F.col("least")).otherwise(F.col("canonical")).alias("canonical"))
