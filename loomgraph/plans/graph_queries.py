"""Graph queries over a dependency graph taken from orders: consecutive parts of an order, by least quantity."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import export, graph, relations, rules
from loomgraph.sources.tables import cut, load


def edges(spark: SparkSession, sf_dir: str, quantity: int | None, acyclic: bool = False, before: bool | None = None) -> DataFrame:
    """``src, dst``: parts that follow each other in an order, both taken at least ``quantity`` times, if one is given."""
    items = load(spark, sf_dir, "lineitem")
    if quantity is not None:
        items = items.filter(F.col("l_quantity") >= quantity)
    if before is not None:
        day = F.lit("1998-05-24").cast("timestamp_ntz")
        items = items.filter(F.col("l_shipdate") < day if before else F.col("l_shipdate") >= day)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = items.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return pairs.filter((F.col("src") < F.col("dst")) if acyclic else (F.col("src") != F.col("dst"))).distinct()


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def _g(quantity: int, acyclic: bool = False, where: str = "", name: str = "g") -> str:
    return (
        f"{name} AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem "
        f"WHERE l_quantity >= {quantity}{where}) WHERE src {'<' if acyclic else '<>'} dst)"
    )


_N = "n AS (SELECT p_partkey AS id FROM part)"
_REACH = "r AS (SELECT src AS a, dst AS b FROM {g} UNION SELECT r.a, {g}.dst FROM r JOIN {g} ON {g}.src = r.b)"
_SCC = "m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"
_BFS = "bfs AS (SELECT id, 0 AS depth FROM seed UNION SELECT walk.dst, depth + 1 FROM bfs JOIN walk ON walk.src = bfs.id WHERE depth < {most}), d AS (SELECT id, min(depth) AS depth FROM bfs GROUP BY id)"


def fan_top(spark, sf_dir, incoming: bool):
    d = graph.degrees(edges(spark, sf_dir, 25))
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    m = "fan_in" if incoming else "fan_out"
    return d.select("id", F.col(m).alias("fan")).join(p, "id").orderBy(F.desc("fan"), "id").limit(20)


def seeds(spark, sf_dir, e):
    """The two parts with the most importers, then the least id."""
    return e.groupBy(F.col("dst").alias("id")).count().orderBy(F.desc("count"), "id").limit(2).select("id")


_SEED = "seed AS (SELECT dst AS id FROM g GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 2)"


def impact(spark, sf_dir, direction: str, depth: int):
    e = cut(edges(spark, sf_dir, 46))
    return graph.reach(e, seeds(spark, sf_dir, e), direction, depth)


def impact_subgraph(spark, sf_dir):
    e = cut(edges(spark, sf_dir, 46))
    return graph.induced(e, graph.reach(e, seeds(spark, sf_dir, e), "both", 2))


def dead(spark, sf_dir):
    e = cut(edges(spark, sf_dir, 46))
    return graph.dead_modules(nodes(spark, sf_dir), e)


def layering(spark, sf_dir):
    e = cut(edges(spark, sf_dir, 46))
    return graph.layers(nodes(spark, sf_dir), e)


def members(spark, sf_dir):
    return graph.components(edges(spark, sf_dir, 44))


def cycle_list(spark, sf_dir):
    c = graph.cycles(members(spark, sf_dir))
    return c.select("cycle", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def cycle_ranking(spark, sf_dir):
    return graph.cycles(members(spark, sf_dir)).orderBy(F.desc("size"), "cycle").limit(20).select("cycle", "size")


def longest_chain(spark, sf_dir):
    m = cut(graph.components(edges(spark, sf_dir, 46)))
    c = graph.longest_from(graph.condensed(edges(spark, sf_dir, 46), m))
    return c.filter("length > 0")


def shortest(spark, sf_dir):
    e = cut(edges(spark, sf_dir, 46))
    ends = seeds(spark, sf_dir, e).select(F.col("id").alias("dst"))
    up = graph.reach(e, seeds(spark, sf_dir, e), "up", 4).select(F.col("id").alias("src"))
    return graph.shortest_lengths(e, up.join(F.broadcast(ends), F.lit(True)), 4)


def paths(spark, sf_dir):
    e = cut(edges(spark, sf_dir, 44))
    ends = seeds(spark, sf_dir, e).select(F.col("id").alias("dst"))
    near = graph.reach(e, seeds(spark, sf_dir, e), "up", 2).filter("depth = 2").select(F.col("id").alias("src"))
    found = graph.simple_paths(e, near.join(F.broadcast(ends), F.lit(True)), 3, 5)
    return found.select("src", "dst", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length", "place")


def snapshot_diff(spark, sf_dir):
    return graph.diff(edges(spark, sf_dir, 44, before=True), edges(spark, sf_dir, 44, before=False), ["src", "dst"])


def diff_nodes(spark, sf_dir):
    ends = lambda e: e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.diff(ends(edges(spark, sf_dir, 44, before=True)), ends(edges(spark, sf_dir, 44, before=False)), ["id"])


def layer_rule(spark, sf_dir):
    layer = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("layer"))
    kinds = [("ECONOMY", "STANDARD"), ("PROMO", "ECONOMY"), ("SMALL", "LARGE")]
    return rules.no_layer_violation(edges(spark, sf_dir, 44), layer, kinds).select("rule_id", "file", "message")


def package_rule(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    package = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("package"))
    return rules.no_cross_package_internal(edges(spark, sf_dir, 44), package, p.filter("p_size <= 25").select(F.col("p_partkey").alias("id"))).select("rule_id", "file", "message")


def dependency_metrics(spark, sf_dir):
    """Node metrics of the module graph: degrees, whether an entry, size, package."""
    e = edges(spark, sf_dir, 25)
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("package"), F.col("p_size").alias("loc"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return p.join(graph.degrees(e), "id", "left").select("id", "package", "loc", zero("fan_in").alias("fan_in"), zero("fan_out").alias("fan_out"), (zero("fan_in") == 0).alias("entry"))


def package_rollup(spark, sf_dir):
    m = dependency_metrics(spark, sf_dir)
    return m.groupBy("package").agg(F.count(F.lit(1)).alias("modules"), F.sum("loc").alias("loc"), F.count_if(F.col("entry")).alias("entries"), F.max("fan_in").alias("max_fan_in"))


def package_edges(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("package"))
    a, b = p.select(F.col("id").alias("src"), F.col("package").alias("from")), p.select(F.col("id").alias("dst"), F.col("package").alias("to"))
    j = edges(spark, sf_dir, 25).join(a, "src").join(b, "dst").filter(F.col("from") != F.col("to"))
    return j.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_files"))


def hotspots(spark, sf_dir):
    """Complexity times importers, the five largest."""
    m = dependency_metrics(spark, sf_dir)
    return m.withColumn("score", F.col("loc") * F.col("fan_in")).filter("score > 0").orderBy(F.desc("score"), F.desc("loc"), F.desc("fan_in"), "id").limit(5).select("id", "score", "loc", "fan_in")


def top_fan_related(spark, sf_dir):
    return relations.top_related(edges(spark, sf_dir, 25), "dst", "src", 12)


def graph_export(spark, sf_dir, form: str):
    e = edges(spark, sf_dir, 46)
    return export.lines(nodes(spark, sf_dir), e, form)


def relational_division(spark, sf_dir):
    """Suppliers that ship every part of the set asked for."""
    need = load(spark, sf_dir, "part").filter("p_size = 50 and p_type = 'ECONOMY'").select("p_partkey").orderBy("p_partkey").limit(2)
    need = cut(need)
    has = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("p_partkey")).distinct()
    n = need.agg(F.count(F.lit(1)).alias("n_needed"))
    return has.join(F.broadcast(need), "p_partkey").groupBy("supplier").agg(F.count(F.lit(1)).alias("n_met")).join(F.broadcast(n), F.col("n_met") == F.col("n_needed")).select("supplier", "n_met")


QUERIES = {
    "gr_edges": partial(edges, quantity=44), "gr_degrees": lambda s, d: graph.degrees(edges(s, d, 25)),
    "tk_fan_in_top20": partial(fan_top, incoming=True), "tk_fan_out_top20": partial(fan_top, incoming=False),
    "gr_instability": lambda s, d: graph.instability(edges(s, d, 25)), "gr_entry_points": lambda s, d: graph.entry_points(nodes(s, d), edges(s, d, 44)),
    "gr_impact_up": partial(impact, direction="up", depth=3), "gr_impact_down": partial(impact, direction="down", depth=3), "gr_undirected_reach": partial(impact, direction="both", depth=2),
    "gr_impact_subgraph": impact_subgraph, "gr_dead_modules": dead, "gr_layering": layering,
    "gr_cycles": cycle_list, "gr_cycle_histogram": lambda s, d: graph.size_histogram(members(s, d)), "tk_cycle_ranking": cycle_ranking,
    "gr_topological_levels": lambda s, d: graph.topological_levels(edges(s, d, 46, acyclic=True), nodes(s, d)).filter("level > 0"),
    "gr_longest_chain": longest_chain, "gr_shortest_lengths": shortest, "gr_simple_paths": paths,
    "st_graph_diff": snapshot_diff, "st_node_diff": diff_nodes, "ru_no_layer_violation": layer_rule, "ru_cross_package": package_rule,
    "ru_max_fan_in": lambda s, d: rules.max_fan(edges(s, d, 25), True, 12).select("rule_id", "file", "message"),
    "ru_max_fan_out": lambda s, d: rules.max_fan(edges(s, d, 25), False, 12).select("rule_id", "file", "message"),
    "ru_entry_allowlist": lambda s, d: rules.entry_point_allowlist(nodes(s, d), edges(s, d, 25), F.col("id") % 2 == 0).select("rule_id", "file"),
    "ru_dead_module": lambda s, d: rules.dead_module(nodes(s, d), cut(edges(s, d, 46))).select("rule_id", "file"),
    "ru_no_cycles": lambda s, d: rules.no_cycles(members(s, d)).select("rule_id", "file", "message"),
    "ru_max_cycle_size": lambda s, d: rules.max_cycle_size(members(s, d), 3).select("rule_id", "file", "message"),
    "ag_dependency_metrics": dependency_metrics, "ag_package_rollup": package_rollup, "ag_package_edges": package_edges, "tk_hotspots": hotspots, "tk_max_fan_related": top_fan_related,
    "sk_export_dot": partial(graph_export, form="dot"), "sk_export_mermaid": partial(graph_export, form="mermaid"), "sk_export_graphml": partial(graph_export, form="graphml"), "sk_export_text": partial(graph_export, form="text"),
    "jn_relational_division": relational_division,
}

_DEG = "deg AS (SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM g UNION ALL SELECT src, 0, 1 FROM g) GROUP BY id)"
_METRICS = f"WITH {_g(25)}, {_DEG}, m AS (SELECT p_partkey AS id, p_brand AS package, p_size AS loc, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) = 0 AS entry FROM part LEFT JOIN deg ON deg.id = p_partkey)"
_WALK = {"down": "SELECT src, dst FROM g", "up": "SELECT dst AS src, src AS dst FROM g", "both": "SELECT src, dst FROM g UNION SELECT dst, src FROM g"}
_impact = lambda way, most, q=46: f"WITH RECURSIVE {_g(q)}, {_SEED}, walk AS ({_WALK[way]}), {_BFS.format(most=most)}"
_ENTRY = f"WITH RECURSIVE {_g(46)}, {_N}, seed AS (SELECT id FROM n WHERE id NOT IN (SELECT dst FROM g)), walk AS (SELECT src, dst FROM g), {_BFS.format(most=200)}"
_CYC = f"WITH RECURSIVE {_g(44)}, {_REACH.format(g='g')}, {_SCC}"
_NODES = "SELECT p_partkey::VARCHAR AS id, row_number() OVER (ORDER BY p_partkey::VARCHAR) - 1 AS n FROM part"
_EXPORT = f"WITH {_g(46)}, ids AS ({_NODES}), e AS (SELECT a.n AS a, b.n AS b, src, dst FROM g JOIN ids a ON a.id = src::VARCHAR JOIN ids b ON b.id = dst::VARCHAR) SELECT 0 AS section, {{node}} AS line FROM ids UNION ALL SELECT 1, {{edge}} FROM e"
_SPLIT = " AND l_shipdate {op} TIMESTAMP '1998-05-24'"

SQL = {
    "gr_edges": f"WITH {_g(44)} SELECT * FROM g",
    "gr_degrees": f"WITH {_g(25)}, {_DEG} SELECT * FROM deg",
    "tk_fan_in_top20": f"WITH {_g(25)}, {_DEG} SELECT id, fan_in AS fan, p_name FROM deg JOIN part ON p_partkey = id ORDER BY fan_in DESC, id LIMIT 20",
    "tk_fan_out_top20": f"WITH {_g(25)}, {_DEG} SELECT id, fan_out AS fan, p_name FROM deg JOIN part ON p_partkey = id ORDER BY fan_out DESC, id LIMIT 20",
    "gr_instability": f"WITH {_g(25)}, {_DEG} SELECT id, round(fan_out / (fan_in + fan_out), 6) AS instability FROM deg",
    "gr_entry_points": f"WITH {_g(44)} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT dst FROM g)",
    "gr_impact_up": _impact("up", 3) + " SELECT * FROM d",
    "gr_impact_down": _impact("down", 3) + " SELECT * FROM d",
    "gr_undirected_reach": _impact("both", 2) + " SELECT * FROM d",
    "gr_impact_subgraph": _impact("both", 2) + " SELECT src, dst FROM g WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)",
    "gr_dead_modules": _ENTRY + " SELECT id FROM n WHERE id NOT IN (SELECT id FROM d)",
    "gr_layering": _ENTRY + " SELECT n.id, coalesce(depth, (SELECT max(depth) FROM d) + 1) AS layer FROM n LEFT JOIN d ON d.id = n.id",
    "gr_cycles": _CYC + " SELECT cycle, count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM m GROUP BY cycle",
    "gr_cycle_histogram": _CYC + " SELECT size, count(*) AS n_cycles FROM (SELECT cycle, count(*) AS size FROM m GROUP BY cycle) GROUP BY size",
    "tk_cycle_ranking": _CYC + " SELECT cycle, count(*) AS size FROM m GROUP BY cycle ORDER BY size DESC, cycle LIMIT 20",
    "gr_topological_levels": f"WITH RECURSIVE {_g(46, True)}, c AS (SELECT src AS id, dst AS at, 1 AS level FROM g UNION SELECT c.id, g.dst, level + 1 FROM c JOIN g ON g.src = c.at) SELECT id, max(level) AS level FROM c GROUP BY id",
    "gr_longest_chain": f"WITH RECURSIVE {_g(46)}, {_REACH.format(g='g')}, {_SCC}, k AS (SELECT DISTINCT coalesce(a.cycle, src) AS src, coalesce(b.cycle, dst) AS dst FROM g LEFT JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst WHERE coalesce(a.cycle, src) <> coalesce(b.cycle, dst)), "
    "c AS (SELECT src AS id, dst AS at, 1 AS length FROM k UNION SELECT c.id, k.dst, length + 1 FROM c JOIN k ON k.src = c.at) SELECT id, max(length) AS length FROM c GROUP BY id",
    "gr_shortest_lengths": f"WITH RECURSIVE {_g(46)}, {_SEED}, f AS (SELECT id AS dst, id AS src, 0 AS length FROM seed UNION SELECT f.dst, g.src, length + 1 FROM f JOIN g ON g.dst = f.src WHERE length < 4) SELECT src, dst, min(length) AS length FROM f GROUP BY src, dst",
    "gr_simple_paths": f"WITH RECURSIVE {_g(44)}, {_SEED}, walk AS (SELECT dst AS src, src AS dst FROM g), {_BFS.format(most=2)}, "
    "p AS (SELECT d.id AS src, seed.id AS dst, d.id AS at, [d.id] AS path FROM d, seed WHERE depth = 2 UNION ALL SELECT p.src, p.dst, g.dst, list_append(path, g.dst) FROM p JOIN g ON g.src = p.at WHERE p.at <> p.dst AND NOT list_contains(path, g.dst) AND len(path) <= 3), "
    "q AS (SELECT src, dst, path, row_number() OVER (PARTITION BY src, dst ORDER BY len(path), path) AS place FROM p WHERE p.at = p.dst) SELECT src, dst, array_to_string(path, '>') AS path, len(path) - 1 AS length, place FROM q WHERE place <= 5",
    "st_graph_diff": f"WITH {_g(44, where=_SPLIT.format(op='<'), name='b')}, {_g(44, where=_SPLIT.format(op='>='), name='c')} SELECT src, dst, 'added' AS change FROM (SELECT * FROM c EXCEPT SELECT * FROM b) UNION ALL SELECT src, dst, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM c)",
    "st_node_diff": f"WITH {_g(44, where=_SPLIT.format(op='<'), name='b')}, {_g(44, where=_SPLIT.format(op='>='), name='c')}, x AS (SELECT src AS id FROM b UNION SELECT dst FROM b), y AS (SELECT src AS id FROM c UNION SELECT dst FROM c) SELECT id, 'added' AS change FROM (SELECT * FROM y EXCEPT SELECT * FROM x) UNION ALL SELECT id, 'removed' FROM (SELECT * FROM x EXCEPT SELECT * FROM y)",
    "ru_no_layer_violation": f"WITH {_g(44)} SELECT 'no-layer-violation' AS rule_id, src::VARCHAR AS file, a.p_type || ' -> ' || b.p_type || ': ' || dst AS message FROM g JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE (a.p_type, b.p_type) IN (('ECONOMY', 'STANDARD'), ('PROMO', 'ECONOMY'), ('SMALL', 'LARGE'))",
    "ru_cross_package": f"WITH {_g(44)} SELECT 'no-cross-package-internal-import' AS rule_id, src::VARCHAR AS file, b.p_brand || ': ' || dst AS message FROM g JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand AND b.p_size > 25",
    "ru_max_fan_in": f"WITH {_g(25)}, {_DEG} SELECT 'max-fan-in' AS rule_id, id::VARCHAR AS file, fan_in || ' of at most 12' AS message FROM deg WHERE fan_in > 12",
    "ru_max_fan_out": f"WITH {_g(25)}, {_DEG} SELECT 'max-fan-out' AS rule_id, id::VARCHAR AS file, fan_out || ' of at most 12' AS message FROM deg WHERE fan_out > 12",
    "ru_entry_allowlist": f"WITH {_g(25)} SELECT 'entry-point-allowlist' AS rule_id, p_partkey::VARCHAR AS file FROM part WHERE p_partkey NOT IN (SELECT dst FROM g) AND p_partkey % 2 <> 0",
    "ru_dead_module": _ENTRY + " SELECT 'dead-module' AS rule_id, id::VARCHAR AS file FROM n WHERE id NOT IN (SELECT id FROM d)",
    "ru_no_cycles": _CYC + ", z AS (SELECT cycle, count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM m GROUP BY cycle) SELECT 'no-cycles' AS rule_id, file, message FROM (SELECT cycle::VARCHAR AS file, 'cycle of ' || size AS message FROM z ORDER BY size DESC, cycle LIMIT 50) UNION ALL SELECT 'no-cycles', NULL, (count(*) - 50) || ' more cycles' FROM z HAVING count(*) > 50",
    "ru_max_cycle_size": _CYC + " SELECT 'max-cycle-size' AS rule_id, cycle::VARCHAR AS file, 'cycle of ' || count(*) AS message FROM m GROUP BY cycle HAVING count(*) > 3",
    "ag_dependency_metrics": _METRICS + " SELECT * FROM m",
    "ag_package_rollup": _METRICS + " SELECT package, count(*) AS modules, sum(loc)::BIGINT AS loc, count(*) FILTER (entry) AS entries, max(fan_in) AS max_fan_in FROM m GROUP BY package",
    "ag_package_edges": f'WITH {_g(25)} SELECT a.p_brand AS "from", b.p_brand AS "to", count(*) AS n_edges, count(DISTINCT src) AS n_files FROM g JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY 1, 2',
    "tk_hotspots": _METRICS + " SELECT id, loc * fan_in AS score, loc, fan_in FROM m WHERE loc * fan_in > 0 ORDER BY score DESC, loc DESC, fan_in DESC, id LIMIT 5",
    "tk_max_fan_related": f"WITH {_g(25)}, x AS (SELECT dst AS id, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM g) SELECT id, count(*) AS fan, string_agg(src::VARCHAR, ',' ORDER BY src) FILTER (n <= 5) AS related, greatest(count(*) - 5, 0) AS left_out FROM x GROUP BY id HAVING count(*) > 12",
    "sk_export_dot": _EXPORT.format(node="'  n' || n || ' [label=\"' || id || '\"];'", edge="'  n' || a || ' -> n' || b || ';'"),
    "sk_export_mermaid": _EXPORT.format(node="'  n' || n || '[\"' || id || '\"]'", edge="'  n' || a || ' --> n' || b"),
    "sk_export_graphml": _EXPORT.format(node="'    <node id=\"n' || n || '\"><data key=\"path\">' || id || '</data></node>'", edge="'    <edge source=\"n' || a || '\" target=\"n' || b || '\"/>'"),
    "sk_export_text": _EXPORT.format(node="id", edge="src || ' -> ' || dst"),
    "jn_relational_division": "WITH need AS (SELECT p_partkey FROM part WHERE p_size = 50 AND p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 2) SELECT l_suppkey AS supplier, count(DISTINCT l_partkey) AS n_met FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM need) GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) = (SELECT count(*) FROM need)",
}
