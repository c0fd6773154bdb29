"""Edits, reports, summaries, snapshots, incremental steps and text functions over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import edits, export, fixes, graph, rules, skew, summary
from loomgraph.plans import graph_queries as G
from loomgraph.plans import lookup_queries as L
from loomgraph.plans.fact_queries import _CALL, _F, _S, _one, call_edges, files, newest_files, symbols
from loomgraph.sources import cache, reports, workspace
from loomgraph.sources.tables import checkpoint_dir, cut, load
from loomgraph.streaming import versions


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit for each function, method and class, replacing its whole range, so that inner ones conflict with outer ones."""
    return symbols(spark, sf_dir).filter("kind in ('function', 'method', 'class')").select("file", F.col("range.start").alias("start"), F.col("range.end").alias("end"), F.concat(F.lit("/* "), "kind", F.lit(" */")).alias("text")).distinct()


def edited(spark, sf_dir):
    """Sizes and revisions of all sources after the edits that don't overlap."""
    out = edits.apply(newest_files(spark, sf_dir), renames(spark, sf_dir))
    return out.select("file", F.length("source").alias("size"), T.revision(F.col("source")).alias("revision"))


def _as_report(df: DataFrame, value) -> DataFrame:
    return df.select(F.to_json(value).alias("value"))


def eslint_report(spark, sf_dir):
    """A report file for each source file with its symbols as messages, read again."""
    s = symbols(spark, sf_dir).filter("name is not null and kind is not null")
    m = F.struct(F.col("kind").alias("ruleId"), (F.col("flags") % 2 + 1).alias("severity"), F.col("name").alias("message"), F.col("range.start").alias("line"), F.lit(1).alias("column"), F.col("range.end").alias("endLine"), F.lit(2).alias("endColumn"))
    r = s.groupBy("file").agg(F.collect_list(m).alias("messages")).select(F.array(F.struct(F.col("file").alias("filePath"), "messages")).alias("v"))
    return reports.eslint(_as_report(r, F.col("v")))


def ruff_report(spark, sf_dir):
    s = symbols(spark, sf_dir).filter("endswith(file, '.py') and name is not null and kind is not null")
    place = lambda c: F.struct(F.col(f"range.{c}").alias("row"), F.lit(1).alias("column"))
    m = F.struct(F.col("kind").alias("code"), F.col("name").alias("message"), F.col("file").alias("filename"), place("start").alias("location"), place("end").alias("end_location"))
    return reports.ruff(_as_report(s.groupBy("file").agg(F.collect_list(m).alias("v")), F.col("v")))


def biome_report(spark, sf_dir):
    s = symbols(spark, sf_dir).filter("kind in ('function', 'class') and name is not null")
    m = F.struct(F.col("kind").alias("category"), F.lit("error").alias("severity"), F.col("name").alias("description"), F.struct(F.struct("file").alias("path"), F.array("range.start", "range.end").alias("span")).alias("location"))
    return reports.biome(_as_report(s.groupBy("file").agg(F.collect_list(m).alias("diagnostics")), F.struct("diagnostics")), newest_files(spark, sf_dir)).select("rule_id", "file", "message", "line", "col")


def vulture_report(spark, sf_dir):
    """Report lines of Python symbols, with a confidence by flags."""
    s = symbols(spark, sf_dir).filter("endswith(file, '.py') and kind is not null and name is not null")
    line = F.concat("file", F.lit(":"), F.col("range.start").cast("string"), F.lit(": unused "), "kind", F.lit(" '"), "name", F.lit("' ("), (F.lit(60) + F.col("flags") % 4 * 10).cast("string"), F.lit("% confidence)"))
    return reports.vulture(s.select(line.alias("value")), 70).select("rule_id", "file", "message", "line", "severity", "confidence")


def severities(spark, sf_dir):
    return eslint_report(spark, sf_dir).groupBy(T.severity(F.col("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def scorecard(spark, sf_dir):
    """Order priorities as analyzers."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("analyzer"), (F.col("o_orderstatus") != "P").alias("ok"), F.lit(1).alias("n_diagnostics"), (F.col("o_custkey") % 1000).alias("millis"))
    return reports.scorecard(o)


def _graph(spark, sf_dir):
    e = cut(G.edges(spark, sf_dir, 46))
    return G.nodes(spark, sf_dir), e, cut(graph.components(e))


def architecture(spark, sf_dir):
    return summary.architecture(*_graph(spark, sf_dir))


def impact(spark, sf_dir):
    n, e, m = _graph(spark, sf_dir)
    return summary.impact(e, n, m, G.seeds(None, None, e), "up", 2).select("id", "depth", "fan_in", "fan_out", "entry")


def hover(spark, sf_dir):
    return summary.profiles(*_graph(spark, sf_dir))


def call_graph(spark, sf_dir):
    """Two steps of structural callees from the methods, and one of type-aware ones, merged: ``src, dst, confidence``."""
    from loomgraph.operators import relations

    e = cut(call_edges(spark, sf_dir))
    first = symbols(spark, sf_dir).filter("kind = 'method'").select("id")
    near = graph.reach(e, first, "down", 2)
    typed = e.join(first.select(F.col("id").alias("src")), "src", "left_semi")
    return relations.merge_edges(graph.induced(e, near), typed)


def longest_path(spark, sf_dir):
    e = cut(G.edges(spark, sf_dir, 46))
    return graph.longest_chain(e, cut(graph.components(e)))


def dependency_order(spark, sf_dir):
    return graph.dependency_order(cut(G.edges(spark, sf_dir, 46)), G.nodes(spark, sf_dir)).select("id", "place")


def cycle_changes(spark, sf_dir):
    """Cycles of the order graph's edges of small quantities against those of large ones."""
    a, b = (graph.components(cut(G.edges(spark, sf_dir, q))) for q in (44, 46))
    return graph.cycle_diff(cut(a), cut(b)).select("size", F.array_join("members", ",").alias("members"), "change")


def graph_nodes(spark, sf_dir):
    """All nodes: entry points, members of cycles and those in the dependency order."""
    n, e, m = _graph(spark, sf_dir)
    return graph.entry_points(n, e).select("id").unionByName(m.select("id")).unionByName(graph.topological_levels(e, n).select("id")).distinct()


def hotspots(spark, sf_dir):
    """The five modules with the most importers, then importees, then by path."""
    return graph.degrees(G.edges(spark, sf_dir, 25)).orderBy(F.desc("fan_in"), F.desc("fan_out"), "id").limit(5)


def unstable(spark, sf_dir):
    return graph.instability(G.edges(spark, sf_dir, 25)).orderBy(F.desc("instability"), "id").limit(10)


def semantic_search(spark, sf_dir):
    return summary.search(files(spark, sf_dir), symbols(spark, sf_dir).filter("name is not null"), "budget core", 50)


def tests_hidden(spark, sf_dir):
    return summary.without_tests(files(spark, sf_dir).select(F.col("file").alias("id")))


def crossing(spark, sf_dir):
    package = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("package"))
    return summary.filter_edges(G.edges(spark, sf_dir, 25), None, package)


def snapshot(spark, sf_dir):
    """The order graph written under two labels; one is deleted, the other read again."""
    root = f"{checkpoint_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    for label, q in (("kept", 44), ("dropped", 46)):
        export.write_snapshot({"nodes": G.nodes(spark, sf_dir), "edges": G.edges(spark, sf_dir, q)}, root, label)
    export.delete_snapshot(spark, root, "dropped")
    if export.labels(spark, root) != ["kept"]:
        raise ValueError("a deleted label is still listed")
    return export.read_snapshot(spark, root, "kept")["edges"].select("src", "dst")


def packages(spark, sf_dir):
    """A manifest for each package folder, whose entry is its first file, built to dist in every other package."""
    f = files(spark, sf_dir).withColumn("dir", F.regexp_extract("file", r"^(/ws/[^/]+/packages/[^/]+)/", 1)).filter("dir <> ''")
    first = f.groupBy("dir").agg(F.min("file").alias("first"))
    main = F.regexp_replace(F.expr("substring(first, length(dir) + 2)"), r"\.(?:tsx?|py|js)$", ".js")
    m = first.select(F.concat("dir", F.lit("/package.json")).alias("file"), F.to_json(F.struct(F.regexp_extract("dir", "[^/]+$", 0).alias("name"), main.alias("main"))).alias("source"))
    return workspace.packages(m, files(spark, sf_dir))


def overlays(spark, sf_dir):
    """Newest sources with the first versions opened over them."""
    first = load(spark, sf_dir, "check_contexts").filter("version = 1 and source is not null").select(F.col("file_path").alias("file"), "source").distinct()
    return workspace.with_overlays(newest_files(spark, sf_dir), first).select("file", "revision")


def user_check(spark, sf_dir):
    """A user's rule over all sources: files with lines of more than 120 characters."""

    def check(file, source):
        n = sum(len(x) > 120 for x in (source or "").split("\n"))
        return [("long-lines", file, f"{n} long lines", None, None)] if n else []

    return workspace.rule_check(newest_files(spark, sf_dir), check).select("rule_id", "file", "message")


def store(spark, sf_dir, version: str) -> DataFrame:
    c = load(spark, sf_dir, "check_contexts").filter(version).select(F.col("file_path").alias("file"), T.revision(F.col("source")).alias("revision"))
    return c.distinct()


def to_resolve(spark, sf_dir):
    """Suppliers whose parts changed: the parts of one size, and the suppliers that ship one."""
    e = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    changed = load(spark, sf_dir, "part").filter("p_size = 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file"))
    return versions.to_resolve(changed, e)


def queue(spark, sf_dir):
    """Orders as requests of their customer: 1-URGENT runs first."""
    p = F.when(F.col("o_orderpriority") == "1-URGENT", "highest").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("medium")
    return versions.queued(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("queue"), p.alias("priority"), F.col("o_orderdate").alias("arrived")))


def overlay_versions(spark, sf_dir):
    """Queries at version 1 of files whose open version is their newest."""
    c = load(spark, sf_dir, "check_contexts")
    opened = c.groupBy(F.col("file_path").alias("file")).agg(F.max("version").alias("version"))
    return versions.overlay_is_current(opened.select("file", F.lit(1).alias("asked")), opened)


def pretty(spark, sf_dir):
    """Violations grouped by file in the order of their first, as text."""
    v = rules.no_interface(symbols(spark, sf_dir).filter("name is not null")).select("file", "message")
    return reports.grouped(v)


def positions(spark, sf_dir):
    """UTF-8 offsets of the symbols' starts and back, and the offset again from line and column."""
    s = symbols(spark, sf_dir).filter("kind in ('function', 'method', 'class')").select("id", "file", F.col("range.start").alias("start"))
    j = s.join(newest_files(spark, sf_dir).select("file", "source"), "file")
    byte = T.utf8_offset(F.col("source"), F.col("start"))
    return j.select("id", byte.alias("byte"), T.offset_of_utf8(F.col("source"), byte).alias("back"), T.offset_at(F.col("source"), T.line_of(F.col("source"), F.col("start")), T.column_of(F.col("source"), F.col("start"))).alias("again"))


def names(spark, sf_dir):
    """Labels, source paths and URIs of the files, and whether a name is the end of a dotted one."""
    f = files(spark, sf_dir)
    built = F.concat(F.lit("dist"), F.regexp_replace("file", r"\.tsx?$", ".js"))
    return f.select("file", T.label(F.col("file")).alias("label"), T.dist_to_source(built).alias("built"), T.symbol_uri("sym", F.col("file")).alias("uri"), T.has_glob(F.col("file")).alias("glob"), T.name_matches(F.regexp_replace("file", "/", "."), "ts").alias("ends"))


def log_lines(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", T.redacted(F.element_at(F.array(F.lit("api_key"), F.lit("source"), F.lit("props")), (F.col("event_id") % 3 + 1).cast("int")), F.col("props")).alias("shown"))


def value_percentiles(spark, sf_dir):
    """Quartiles of the extended price by supplier, and of a binding's place by specifier."""
    a = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("k"), F.col("l_extendedprice").cast("double").alias("v"))
    b = load(spark, sf_dir, "import_bindings").select(F.col("module_spec").alias("k"), F.col("range.start").cast("double").alias("v"))
    parts = [skew.value_percentiles(skew.weighted_values(x, "k", "v"), (0.25, 0.5, 0.99)).select(F.lit(t).alias("table_name"), "*") for t, x in (("lineitem", a), ("import_bindings", b))]
    return parts[0].unionByName(parts[1])


def fixed_interfaces(spark, sf_dir):
    return fixes.interfaces_to_types(symbols(spark, sf_dir).filter("kind = 'interface' and name is not null"), newest_files(spark, sf_dir))


def fixed_exports(spark, sf_dir):
    """Edits that take export off every function and class that has it on its line."""
    return fixes.without_export(symbols(spark, sf_dir).filter("kind in ('function', 'class') and name is not null"), newest_files(spark, sf_dir))


def warm_cache(spark, sf_dir):
    """Facts kept by a run over first versions, restored for the newest: symbols of the files that didn't change."""
    root = f"{checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}"
    env = cache.environment(tool="facts", level=1)
    own = symbols(spark, sf_dir).select("file", "id")
    cache.persist({"symbols": own}, store(spark, sf_dir, "version = 1"), root, env)
    newest = newest_files(spark, sf_dir).select("file", T.revision(F.col("source")).alias("revision"))
    return cache.restore(spark, newest, root, env, ["symbols"])[0]["symbols"]


QUERIES = {
    "sk_fixed_interfaces": fixed_interfaces, "sk_fixed_exports": fixed_exports, "sk_warm_cache": warm_cache,
    "wn_edit_plan": lambda s, d: edits.plan(renames(s, d)), "wn_kept_edits": lambda s, d: edits.without_overlaps(renames(s, d)), "sk_edited_sources": edited, "sk_plan_ids": lambda s, d: edits.plan_id(renames(s, d)),
    "sc_eslint": eslint_report, "sc_ruff": ruff_report, "sc_biome": biome_report, "sc_vulture": vulture_report, "fn_severity": severities, "ag_scorecard": scorecard,
    "ag_architecture": architecture, "gr_impact_result": impact, "ag_hover_profiles": hover, "gr_call_graph": call_graph, "gr_longest_path": longest_path, "gr_dependency_order": dependency_order, "st_cycle_diff": cycle_changes, "gr_nodes": graph_nodes,
    "gr_cycle_members_in_rounds": lambda s, d: graph.components(cut(G.edges(s, d, 46)), 0), "tk_module_hotspots": hotspots, "tk_unstable": unstable, "tk_semantic_search": semantic_search, "lk_without_tests": tests_hidden, "lk_crossing_edges": crossing,
    "sk_export_json": lambda s, d: export.as_json(G.nodes(s, d), G.edges(s, d, 44)), "sk_snapshot": snapshot, "sc_packages": packages, "sc_overlays": overlays, "in_user_check": user_check,
    "in_upsert": lambda s, d: versions.upsert_by_file(store(s, d, "version = 1"), store(s, d, "version > 1")), "in_to_extract": lambda s, d: versions.to_extract(store(s, d, "version > 1"), store(s, d, "version = 1")),
    "in_apply_delta": lambda s, d: versions.apply_delta(store(s, d, "version = 1"), store(s, d, "version > 1"), L.files_in(s, d, "tsx")), "in_to_resolve": to_resolve,
    "in_invalidated": lambda s, d: versions.invalidated(store(s, d, "version = 1"), L.files_in(s, d, "python")), "in_generation": lambda s, d: versions.checked_generation(files(s, d).withColumn("generation", F.lit(3)), 3).groupBy("generation").agg(F.count(F.lit(1)).alias("n")),
    "in_priority_queue": queue, "in_overlay_versions": overlay_versions, "ag_pretty": pretty, "fn_utf8_offsets": positions, "fn_names": names, "fn_redacted": log_lines, "p2_value_percentiles": value_percentiles,
}

_E46, _E44, _E25 = G._g(46), G._g(44), G._g(25)
_SCC46 = f"{_E46}, {G._REACH.format(g='g')}, {G._SCC}"
_REN = f"{_S}, ed AS (SELECT DISTINCT file, \"range\".\"start\" AS a, \"range\".\"end\" AS z, '/* ' || kind || ' */' AS \"text\" FROM sy WHERE kind IN ('function', 'method', 'class'))"
_KEPT = f"{_REN}, o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY a, z, \"text\") AS n FROM ed), k AS (SELECT file, a, z, \"text\", n, true AS kept, z AS last FROM o WHERE n = 1 UNION ALL SELECT o.file, o.a, o.z, o.\"text\", o.n, o.a >= k.last, CASE WHEN o.a >= k.last THEN o.z ELSE k.last END FROM k JOIN o ON o.file = k.file AND o.n = k.n + 1)"
_V = lambda w: f"SELECT DISTINCT file_path AS file, substr(sha256(source), 1, 16) AS revision FROM check_contexts WHERE {w}"
_DIR = "f AS (SELECT DISTINCT file_path AS file, regexp_extract(file_path, '^(/ws/[^/]+/packages/[^/]+)/', 1) AS dir FROM check_contexts), d AS (SELECT dir, min(file) AS first FROM f WHERE dir <> '' GROUP BY dir), m AS (SELECT dir, regexp_extract(dir, '[^/]+$') AS name, regexp_replace(regexp_replace(substr(first, len(dir) + 2), '\\.(tsx?|py|js)$', '.js'), '\\.js$', '.ts') AS path FROM d)"
_SCORED = " + ".join(f"greatest({_one('name', t)}, {_one('file', t)})" for t in ("budget", "core"))
_SCORED_FILE = " + ".join(_one("file", t) for t in ("budget", "core"))
_PCT = "SELECT '{t}' AS table_name, {k} AS key_value, quantile_cont({v}, 0.25) AS p25, quantile_cont({v}, 0.5) AS p50, quantile_cont({v}, 0.99) AS p99 FROM {t} WHERE {k} IS NOT NULL GROUP BY {k}"
_CODE = f"{_S}, {_F}, k AS (SELECT DISTINCT sy.file, kind, name, \"range\".\"start\" AS a, substring(source, \"range\".\"start\" + 1, \"range\".\"end\" - \"range\".\"start\") AS code, list_last(string_split(left(source, \"range\".\"start\"), chr(10))) AS before FROM sy JOIN f ON f.file = sy.file WHERE name IS NOT NULL)"
SQL = {
    "sk_fixed_interfaces": f"WITH {_CODE}, h AS (SELECT file, a, regexp_extract(code, '(?s)^(interface\\b[^{{]*)\\{{', 1) AS head FROM k WHERE kind = 'interface'), g AS (SELECT * FROM h WHERE head <> '' AND NOT regexp_matches(head, '\\bextends\\b')) SELECT file, a AS \"start\", a + 9 AS \"end\", 'type' AS \"text\" FROM g UNION ALL SELECT file, (a + len(head))::INT, (a + len(head))::INT, '= ' FROM g",
    "sk_fixed_exports": f"WITH {_CODE}, m AS (SELECT file, a, regexp_extract(before, '(export\\s+)((?:declare\\s+|abstract\\s+|async\\s+|const\\s+|let\\s+|var\\s+)*)$', 1) AS mark, regexp_extract(before, '(export\\s+)((?:declare\\s+|abstract\\s+|async\\s+|const\\s+|let\\s+|var\\s+)*)$', 2) AS rest FROM k WHERE kind IN ('function', 'class')) SELECT DISTINCT file, (a - len(rest) - len(mark))::INT AS \"start\", (a - len(rest))::INT AS \"end\", '' AS \"text\" FROM m WHERE mark <> ''",
    "sk_warm_cache": f"WITH {_S}, {_F} SELECT sy.file, sy.id FROM sy JOIN f ON f.file = sy.file WHERE EXISTS (SELECT 1 FROM check_contexts c WHERE c.version = 1 AND c.file_path = f.file AND substr(sha256(c.source), 1, 16) = substr(sha256(f.source), 1, 16))",
    "wn_edit_plan": f"WITH RECURSIVE {_KEPT} SELECT file, a AS \"start\", z AS \"end\", \"text\", NOT kept AS conflict FROM k",
    "wn_kept_edits": f"WITH RECURSIVE {_KEPT} SELECT file, a AS \"start\", z AS \"end\", \"text\" FROM k WHERE kept",
    "sk_edited_sources": f"WITH RECURSIVE {_KEPT}, {_F}, p AS (SELECT k.file, k.a, k.z, k.\"text\", lead(k.a) OVER (PARTITION BY k.file ORDER BY k.a) AS nxt, row_number() OVER (PARTITION BY k.file ORDER BY k.a) AS i FROM k WHERE kept), q AS (SELECT f.file, f.source, string_agg(p.\"text\" || substring(source, p.z + 1, coalesce(nxt, len(source)) - p.z), '' ORDER BY i) AS rest, min(p.a) AS a0 FROM f LEFT JOIN p ON p.file = f.file GROUP BY f.file, f.source), t AS (SELECT file, CASE WHEN rest IS NULL THEN source ELSE left(source, a0) || rest END AS done FROM q) SELECT file, len(done)::INT AS size, substr(sha256(done), 1, 16) AS revision FROM t",
    "sk_plan_ids": f"WITH {_REN} SELECT file, substr(sha256(string_agg(a || ':' || z || ':' || \"text\", chr(0) ORDER BY a, z, \"text\")), 1, 16) AS plan_id FROM ed GROUP BY file",
    "sc_eslint": f"WITH {_S} SELECT kind AS rule_id, file, name AS message, \"range\".\"start\" AS line, 1 AS col, \"range\".\"end\" AS end_line, 2 AS end_col, CASE WHEN flags % 2 + 1 = 2 THEN 'error' ELSE 'warning' END AS severity FROM sy WHERE name IS NOT NULL AND kind IS NOT NULL",
    "sc_ruff": f"WITH {_S} SELECT kind AS rule_id, file, name AS message, \"range\".\"start\" AS line, 1 AS col, \"range\".\"end\" AS end_line, 1 AS end_col, 'error' AS severity FROM sy WHERE name IS NOT NULL AND kind IS NOT NULL AND ends_with(file, '.py')",
    "sc_biome": f"WITH {_S}, {_F} SELECT kind AS rule_id, sy.file, name AS message, len(left(source, \"range\".\"start\")) - len(replace(left(source, \"range\".\"start\"), chr(10), '')) + 1 AS line, len(list_last(string_split(left(source, \"range\".\"start\"), chr(10)))) + 1 AS col FROM sy LEFT JOIN f ON f.file = sy.file WHERE kind IN ('function', 'class') AND name IS NOT NULL",
    "sc_vulture": f"WITH {_S} SELECT 'unused-' || kind AS rule_id, file, 'unused ' || kind || ' ''' || name || '''' AS message, \"range\".\"start\" AS line, 'warning' AS severity, 60 + flags % 4 * 10 AS confidence FROM sy WHERE ends_with(file, '.py') AND kind IS NOT NULL AND name IS NOT NULL AND 60 + flags % 4 * 10 >= 70",
    "fn_severity": f"WITH {_S} SELECT CASE WHEN flags % 2 = 1 THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM sy WHERE name IS NOT NULL AND kind IS NOT NULL GROUP BY 1",
    "ag_scorecard": "SELECT o_orderpriority AS analyzer, count(*) AS n_runs, count(*) FILTER (o_orderstatus = 'P') AS n_failed, count(*) AS n_diagnostics, max(o_custkey % 1000) AS max_millis, round(avg(o_custkey % 1000), 3) AS mean_millis FROM orders GROUP BY 1",
    "ag_architecture": f"WITH RECURSIVE {_SCC46}, k AS (SELECT DISTINCT coalesce(a.cycle, src) AS src, coalesce(b.cycle, dst) AS dst FROM g LEFT JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst WHERE coalesce(a.cycle, src) <> coalesce(b.cycle, dst)), c AS (SELECT src AS id, dst AS x, 1 AS length FROM k UNION SELECT c.id, k.dst, length + 1 FROM c JOIN k ON k.src = c.x), z AS (SELECT cycle, count(*) AS n FROM m GROUP BY cycle) SELECT (SELECT count(*) FROM part) AS modules, (SELECT count(*) FROM g) AS edges, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT dst FROM g)) AS entries, (SELECT count(*) FROM z) AS cycles, (SELECT coalesce(sum(n), 0)::BIGINT FROM z) AS in_cycles, (SELECT coalesce(max(n), 0) FROM z) AS largest_cycle, (SELECT max(length) FROM c) AS longest_chain",
    "gr_impact_result": G._impact("up", 2) + f", {G._DEG} SELECT d.id, depth, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) = 0 AS entry FROM d LEFT JOIN deg ON deg.id = d.id",
    "ag_hover_profiles": f"WITH RECURSIVE {_SCC46}, {G._DEG} SELECT p_partkey AS id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) = 0 AS entry, cycle IS NOT NULL AS in_cycle FROM part LEFT JOIN deg ON deg.id = p_partkey LEFT JOIN m ON m.id = p_partkey",
    "gr_longest_path": f"WITH RECURSIVE {_SCC46}, k AS (SELECT DISTINCT coalesce(a.cycle, src) AS src, coalesce(b.cycle, dst) AS dst FROM g LEFT JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst WHERE coalesce(a.cycle, src) <> coalesce(b.cycle, dst)), c AS (SELECT src AS id, dst AS x, [src, dst] AS path FROM k UNION ALL SELECT c.id, k.dst, list_append(path, k.dst) FROM c JOIN k ON k.src = c.x), w AS (SELECT path FROM c ORDER BY len(path) DESC, path LIMIT 1) SELECT generate_subscripts(path, 1)::INT - 1 AS place, unnest(path) AS id FROM w",
    "gr_dependency_order": f"WITH RECURSIVE {_E46}, b AS (SELECT src AS root, dst AS x, 1 AS level FROM g UNION SELECT root, g.dst, level + 1 FROM b JOIN g ON g.src = b.x WHERE level < 60), u AS (SELECT root AS id, max(level) AS level FROM b GROUP BY root), l AS (SELECT p_partkey AS id, coalesce(u.level, 0) AS level FROM part LEFT JOIN u ON u.id = p_partkey) SELECT id, row_number() OVER (ORDER BY CASE WHEN level >= 60 THEN 1000000 ELSE level END, id) - 1 AS place FROM l",
    "st_cycle_diff": f"WITH RECURSIVE {_SCC46}, {G._g(44, name='h')}, r2 AS (SELECT src, dst FROM h UNION SELECT r2.src, h.dst FROM r2 JOIN h ON h.src = r2.dst), m2 AS (SELECT a.src AS id, min(least(a.src, a.dst)) AS cycle FROM r2 a JOIN r2 b ON b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.src), x AS (SELECT count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM m GROUP BY cycle), y AS (SELECT count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM m2 GROUP BY cycle) SELECT *, 'added' AS change FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)",
    "gr_nodes": "SELECT p_partkey AS id FROM part",
    "gr_cycle_members_in_rounds": f"WITH RECURSIVE {_SCC46} SELECT id, cycle FROM m",
    "gr_call_graph": f"WITH {_S}, {_CALL}, a AS (SELECT id FROM sy WHERE kind = 'method'), b AS (SELECT id FROM a UNION SELECT dst FROM e WHERE src IN (SELECT id FROM a)), n AS (SELECT id FROM b UNION SELECT dst FROM e WHERE src IN (SELECT id FROM b)) SELECT src, dst, CASE WHEN src IN (SELECT id FROM a) THEN 'type-aware' ELSE 'structural' END AS confidence FROM e WHERE (src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)) OR src IN (SELECT id FROM a)",
    "tk_semantic_search": f"WITH {_S}, x AS (SELECT 0 AS sort, 'symbol' AS what, file AS path, name, {_SCORED} + 20 AS score FROM sy WHERE flags & 1 <> 0 AND name IS NOT NULL UNION ALL SELECT 1, 'module', file, '', {_SCORED_FILE} FROM (SELECT DISTINCT file_path AS file FROM check_contexts)) SELECT what, path, name, score FROM x WHERE score IS NOT NULL ORDER BY score DESC, sort, path, name LIMIT 50",
    "tk_module_hotspots": f"WITH {_E25}, {G._DEG} SELECT id, fan_in, fan_out FROM deg ORDER BY fan_in DESC, fan_out DESC, id LIMIT 5",
    "tk_unstable": f"WITH {_E25}, {G._DEG} SELECT id, round(fan_out / (fan_in + fan_out), 6) AS instability FROM deg ORDER BY 2 DESC, id LIMIT 10",
    "lk_crossing_edges": f"WITH {_E25} SELECT src, dst FROM g JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand",
    "lk_without_tests": "SELECT DISTINCT file_path AS id FROM check_contexts WHERE NOT regexp_matches(file_path, '(?:^|/)(?:tests?|__tests__|spec)/|\\.(?:test|spec)\\.[a-z]+$|(?:^|/)test_[^/]*\\.py$')",
    "sk_export_json": f"WITH {_E44} SELECT 0 AS section, '{{\"path\":\"' || p_partkey || '\"}}' AS line FROM part UNION ALL SELECT 1, '{{\"from\":\"' || src || '\",\"to\":\"' || dst || '\"}}' FROM g",
    "sk_snapshot": f"WITH {_E44} SELECT src, dst FROM g",
    "sc_packages": f"WITH {_DIR}, e AS (SELECT name, dir, CASE WHEN dir || '/' || path IN (SELECT file FROM f) THEN dir || '/' || path WHEN dir || '/src/index.ts' IN (SELECT file FROM f) THEN dir || '/src/index.ts' END AS entry FROM m) SELECT name, arg_max(dir, dir) AS dir, arg_max(entry, dir) AS entry FROM e WHERE entry IS NOT NULL GROUP BY name",
    "sc_overlays": f"WITH {_F}, o AS (SELECT DISTINCT file_path AS file, source FROM check_contexts WHERE version = 1 AND source IS NOT NULL) SELECT f.file, substr(sha256(coalesce(o.source, f.source)), 1, 16) AS revision FROM f LEFT JOIN o ON o.file = f.file",
    "in_user_check": f"WITH {_F}, l AS (SELECT file, len(list_filter(string_split(source, chr(10)), lambda w: len(w) > 120)) AS n FROM f) SELECT 'long-lines' AS rule_id, file, n || ' long lines' AS message FROM l WHERE n > 0",
    "in_upsert": f"WITH a AS ({_V('version = 1')}), b AS ({_V('version > 1')}) SELECT * FROM a WHERE file NOT IN (SELECT file FROM b) UNION ALL SELECT * FROM b",
    "in_to_extract": f"WITH a AS ({_V('version = 1')}), b AS ({_V('version > 1')}) SELECT b.* FROM b ANTI JOIN a USING (file, revision)",
    "in_apply_delta": f"WITH a AS ({_V('version = 1')}), b AS ({_V('version > 1')}) SELECT * FROM a WHERE file NOT IN (SELECT file FROM b) AND file NOT IN ({L._LANG.format('tsx')}) UNION ALL SELECT * FROM b",
    "in_to_resolve": "SELECT 'p' || p_partkey AS file FROM part WHERE p_size = 10 UNION SELECT 's' || l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 10",
    "in_invalidated": f"WITH a AS ({_V('version = 1')}) SELECT * FROM a WHERE file NOT IN ({L._LANG.format('python')})",
    "in_generation": "SELECT 3 AS generation, count(DISTINCT file_path) AS n FROM check_contexts",
    "in_priority_queue": "SELECT o_orderkey AS request_id, o_custkey AS queue, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 3 ELSE 2 END, o_orderdate, o_orderkey)::INT AS place FROM orders",
    "in_overlay_versions": "SELECT file_path AS file, 1 AS asked, max(version) = 1 AS \"current\" FROM check_contexts GROUP BY file_path",
    "ag_pretty": f"WITH {_S} SELECT file, string_agg('interface ''' || name || ''' should be a type', chr(10) ORDER BY 'interface ''' || name || ''' should be a type') AS messages, count(*) AS n FROM sy WHERE kind = 'interface' AND name IS NOT NULL GROUP BY file",
    "fn_utf8_offsets": f"WITH {_S}, {_F} SELECT id, octet_length(encode(left(source, \"range\".\"start\")))::INT AS byte, \"range\".\"start\" AS back, \"range\".\"start\" AS again FROM sy JOIN f ON f.file = sy.file WHERE kind IN ('function', 'method', 'class')",
    "fn_redacted": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[secret]' WHEN 1 THEN '[' || len(props) || ' characters]' ELSE props END AS shown FROM events",
    "fn_names": "SELECT DISTINCT file_path AS file, regexp_replace(trim(file_path), '[^A-Za-z0-9._-]+', '_', 'g') AS label, CASE WHEN ends_with(file_path, '.py') THEN 'src' || file_path ELSE 'src' || regexp_replace(file_path, '\\.(tsx?|js)$', '.ts') END AS built, 'sym:' || replace(url_encode(file_path), '%7E', '~') AS uri, regexp_matches(file_path, '[*?\\[\\]{}]') AS glob, ends_with(file_path, '.ts') OR replace(file_path, '/', '.') = 'ts' AS ends FROM check_contexts",
    "p2_value_percentiles": _PCT.format(t="lineitem", k="l_suppkey", v="l_extendedprice").replace("l_suppkey AS key_value", "l_suppkey::VARCHAR AS key_value") + "\nUNION ALL\n" + _PCT.format(t="import_bindings", k="module_spec", v="\"range\".\"start\""),
}
