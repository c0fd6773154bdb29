"""Resolution across files: export maps, bindings, rewrites, callers, lexical scopes, shapes. Re-exports are read from the order tables:
parts export their type, suppliers star-export their parts, nations their suppliers, and regions their nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import graph, relations, resolve, rules
from loomgraph.plans import lookup_queries as L
from loomgraph.plans.fact_queries import _CALL, _S, _SC, bindings, call_edges, files, newest_files, scopes, symbols
from loomgraph.sources.tables import cut, load


def _file(letter: str, c: str):
    return F.concat(F.lit(letter), F.col(c).cast("string"))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, exported_name, symbol_id, source_file, source_name`` of the order tables."""
    t = lambda n: load(spark, sf_dir, n)
    none = F.lit(None).cast("string")
    star = lambda df, a, b: df.select(a.alias("file"), F.lit("*").alias("exported_name"), none.alias("symbol_id"), b.alias("source_file"), F.lit("*").alias("source_name")).distinct()
    first = t("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"))
    return (
        t("part").select(_file("p", "p_partkey").alias("file"), F.col("p_type").alias("exported_name"), F.col("p_partkey").cast("string").alias("symbol_id"), none.alias("source_file"), none.alias("source_name"))
        .unionByName(t("supplier").select(_file("s", "s_suppkey").alias("file"), F.lit("default").alias("exported_name"), _file("d", "s_suppkey").alias("symbol_id"), none.alias("source_file"), none.alias("source_name")))
        .unionByName(star(t("lineitem"), _file("s", "l_suppkey"), _file("p", "l_partkey")))
        .unionByName(star(t("supplier"), _file("n", "s_nationkey"), _file("s", "s_suppkey")))
        .unionByName(star(t("nation"), _file("r", "n_regionkey"), _file("n", "n_nationkey")))
        .unionByName(first.select(_file("n", "s_nationkey").alias("file"), F.lit("main").alias("exported_name"), none.alias("symbol_id"), _file("s", "first").alias("source_file"), F.lit("default").alias("source_name")))
        .unionByName(t("nation").select(_file("r", "n_regionkey").alias("file"), F.col("n_name").alias("exported_name"), none.alias("symbol_id"), _file("n", "n_nationkey").alias("source_file"), F.lit("*").alias("source_name")))
    )


def export_map(spark, sf_dir):
    return resolve.export_map(export_rows(spark, sf_dir))


def resolved_bindings(spark, sf_dir):
    """Customers import ``main``, ``default`` or all of their nation."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("local_symbol_id"), F.lit("main").alias("imported_name"), _file("n", "c_nationkey").alias("path"), (F.col("c_custkey") % 3 == 0).alias("is_default"), (F.col("c_custkey") % 5 == 0).alias("is_namespace"))
    return resolve.resolve_bindings(c, export_map(spark, sf_dir))


def star_collisions(spark, sf_dir):
    rows = export_rows(spark, sf_dir)
    own = rows.filter("source_file is null").select("file", "exported_name")
    stars = rows.filter("exported_name = '*' and source_name = '*'").select("file", F.col("source_file").alias("target"))
    return rules.no_star_collisions(own, stars).select("rule_id", "file", "message")


def binds(spark, sf_dir):
    return L.bound(spark, sf_dir).select("local_symbol_id", "export_id", F.lit(None).cast("string").alias("ns_path"))


def name_groups(spark, sf_dir) -> DataFrame:
    """The first symbol of each name as what the others are bound to: ``local_symbol_id, export_id, ns_path``."""
    s = symbols(spark, sf_dir).filter("name is not null").select("id", "name")
    first = s.groupBy("name").agg(F.min("id").alias("export_id"))
    return s.join(first, "name").filter("id <> export_id").select(F.col("id").alias("local_symbol_id"), "export_id", F.lit(None).cast("string").alias("ns_path"))


def rewritten_references(spark, sf_dir):
    """Call edges with each end led to the first symbol of its name; none is a namespace's member."""
    refs = call_edges(spark, sf_dir).select(F.col("src").alias("ref_id"), F.col("dst").alias("symbol_id"), F.lit("f").alias("name"))
    none = spark.createDataFrame([], "file string, exported_name string, symbol_id string")
    return resolve.rewrite_references(refs, name_groups(spark, sf_dir), none).select("ref_id", "local_symbol_id", "symbol_id")


def rewritten_calls(spark, sf_dir):
    """Calls by name, from the file of each function to what its file imports by the name of a called symbol."""
    s = symbols(spark, sf_dir).filter("kind in ('function', 'method')")
    c = call_edges(spark, sf_dir).join(s.select(F.col("id").alias("src"), "file"), "src").join(load(spark, sf_dir, "lib_symbols").select(F.col("id").alias("dst"), F.col("name").alias("callee_name")), "dst")
    calls = c.select("file", "callee_name", F.lit(None).cast("string").alias("symbol_id")).distinct()
    own = L.bound(spark, sf_dir).select("local_symbol_id", "file", F.col("imported_name").alias("local_name"), "start").filter("local_name is not null")
    named = load(spark, sf_dir, "lib_symbols").groupBy(F.col("name").alias("local_name")).agg(F.min("id").alias("export_id"))
    return resolve.rewrite_calls(calls, own, own.join(named, "local_name").select("local_symbol_id", "export_id"))


def rewritten_types(spark, sf_dir):
    return resolve.rewrite_types(L.type_relations(spark, sf_dir), name_groups(spark, sf_dir)).select("symbol_id", "target_name", "target_id", "confidence")


def inner_calls(spark, sf_dir) -> DataFrame:
    """Parameters as calls at their place: ``file, range, symbol_id``."""
    return symbols(spark, sf_dir).filter("kind = 'parameter'").select("file", "range", F.col("id").alias("symbol_id"))


def lexical(spark, sf_dir):
    """What each field and variable would see by its name from its own scope."""
    s = symbols(spark, sf_dir).filter("scope_id is not null and name is not null")
    refs = s.filter("kind in ('variable', 'field')").select(F.col("id").alias("ref_id"), "scope_id", "name", F.col("range.start").alias("start"))
    return relations.resolve_lexically(refs, s, relations.scope_ancestors(scopes(spark, sf_dir)))


def type_edges(spark, sf_dir):
    """Edges between classes and their targets, those of methods' calls type-aware."""
    r = L.type_relations(spark, sf_dir).select(F.col("symbol_id").alias("src"), F.col("target_id").alias("dst"), "confidence")
    again = r.filter(F.col("src") < F.col("dst")).withColumn("confidence", F.lit("type-aware"))
    return resolve.type_edges(r.unionByName(again))


def canonical(spark, sf_dir):
    """Parts linked to the part one third below them: the end of each chain."""
    links = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.floor(F.col("p_partkey") / 3).cast("bigint").alias("next")).filter("next >= 1")
    return graph.canonical_ids(links)


def uses(spark, sf_dir) -> DataFrame:
    """``symbol_id, usage``: calls as reads, second ones of a function as writes to it too."""
    e = call_edges(spark, sf_dir).select(F.col("dst").alias("symbol_id"), F.lit(1).alias("usage"))
    return e.unionByName(call_edges(spark, sf_dir).filter(F.col("src") > F.col("dst")).select(F.col("dst").alias("symbol_id"), F.lit(11).alias("usage")))


def unused(spark, sf_dir):
    return resolve.unused_symbols(symbols(spark, sf_dir).filter("name is not null"), resolve.usage_facts(uses(spark, sf_dir)), "none")


def python_modules(spark, sf_dir):
    """Python specifiers of the bindings, against the known files and the resolved ones."""
    b = bindings(spark, sf_dir).filter("module_spec is not null and endswith(src, '.py')")
    return relations.resolve_python(b.select(F.col("src").alias("from_file"), F.col("module_spec").alias("spec")), files(spark, sf_dir).union(b.select("dst").filter("dst is not null")))


def script_modules(spark, sf_dir):
    """Script specifiers of the bindings; each package folder is a workspace package, and ``@root/`` an alias of the workspace."""
    b = bindings(spark, sf_dir).filter("module_spec is not null and not endswith(src, '.py')")
    known = files(spark, sf_dir).union(b.select("dst").filter("dst is not null")).distinct()
    dirs = known.select(F.regexp_extract("file", r"^(/ws/[^/]+/packages/[^/]+)/", 1).alias("dir")).filter("dir <> ''").distinct()
    packages = dirs.join(known.withColumn("dir", F.regexp_extract("file", r"^(/ws/[^/]+/packages/[^/]+)/", 1)).groupBy("dir").agg(F.min("file").alias("entry")), "dir").select(F.concat(F.lit("@ws/"), F.regexp_extract("dir", "[^/]+$", 0)).alias("name"), "dir", "entry")
    more = b.select(F.col("src").alias("from_file"), F.concat(F.lit("@root"), "src").alias("spec"))
    own = b.select(F.col("src").alias("from_file"), F.concat(F.lit("@ws/"), F.regexp_extract("src", r"/packages/([^/]+)/", 1)).alias("spec"))
    absolute = b.select(F.col("src").alias("from_file"), F.col("src").alias("spec"))
    specs = b.select(F.col("src").alias("from_file"), F.col("module_spec").alias("spec")).union(more).union(own).union(absolute).distinct()
    return relations.resolve_modules(specs, known, packages.filter("name <> '@ws/'").groupBy("name").agg(F.min(F.struct("dir", "entry")).alias("p")).select("name", "p.dir", "p.entry"), {"@root/": "/"})


def undeclared(spark, sf_dir):
    shapes = cut(L.shapes(spark, sf_dir))
    m = relations.structural_matches(shapes, spark.createDataFrame([], "owner string, target string"))
    kinds = shapes.select(F.col("owner").alias("id"), "kind")
    return rules.no_undeclared_implementer(m, kinds).select("rule_id", "file", "message")


def cache_hits(spark, sf_dir):
    """Contexts whose revision a run over first versions has seen, by the file's newest version."""
    c = load(spark, sf_dir, "check_contexts").select(F.col("file_path").alias("file"), "version", F.substring(F.sha2("source", 256), 1, 16).alias("revision")).distinct()
    new = relations.latest(c, ["file"], [F.col("version")]).select("file", "revision")
    hit, miss = relations.cache_split(new, c.filter("version = 1").select("file", "revision"), ["file", "revision"])
    return hit.withColumn("hit", F.lit(True)).unionByName(miss.withColumn("hit", F.lit(False)))


def mixed(spark, sf_dir, preferred=None):
    """Modules whose exports have both styles; a name in capitals' first letter counts as a default export."""
    e = L.exports(spark, sf_dir).select("file", F.col("exported_name").rlike("^[A-Z]").alias("is_default"))
    return rules.no_mixed_exports(e, preferred).select("rule_id", "file", "message")


LAYERS = {"core": ["**/core/**", "**/lib/**"], "api": ["**/api/**"], "tools": ["**/tools/**"], "app": ["/ws/*/packages/*/app/**"], "source": ["**/src/**"]}


def layered(spark, sf_dir):
    return rules.layer_of(files(spark, sf_dir), LAYERS)


def layer_violations(spark, sf_dir):
    """Edges between the layers of files; the files of a directory are its first one's importers."""
    f = files(spark, sf_dir).withColumn("dir", F.regexp_replace("file", r"/[^/]+/[^/]+$", ""))
    e = f.join(f.groupBy("dir").agg(F.min("file").alias("dst")), "dir").filter("file <> dst").select(F.col("file").alias("src"), "dst")
    layer = layered(spark, sf_dir).select(F.col("file").alias("id"), "layer")
    return rules.no_layer_violation(e, layer, [("core", "api")], [("api", "core"), ("app", "core"), ("source", "core"), ("tools", "core")]).select("rule_id", "file", "message")


def not_exported(spark, sf_dir):
    """Names that call edges take from other files though nothing exports them."""
    s = symbols(spark, sf_dir).filter("name is not null")
    at = lambda c: s.select(F.col("id").alias(c), F.col("file").alias(c + "_file"), F.col("name").alias(c + "_name"))
    e = call_edges(spark, sf_dir).join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_file").alias("file"), F.col("dst_file").alias("target"), F.col("dst_name").alias("name"))
    return rules.not_exported(e, s.filter("kind in ('function', 'class')"), L.exports(spark, sf_dir)).select("rule_id", "file", "message")


def logger_rule(spark, sf_dir):
    """Functions of scripts by their bodies."""
    s = symbols(spark, sf_dir).filter("kind = 'function' and not endswith(file, '.py') and name is not null").select("file", "name", F.col("range.start").alias("a"), F.col("range.end").alias("b"))
    code = s.join(newest_files(spark, sf_dir).select("file", "source"), "file").select("file", "name", F.expr("substring(source, a + 1, b - a)").alias("code"))
    body = F.regexp_extract("code", r"(?s)^[^{]*\{(.*)\}\s*$", 1)
    return rules.logger_enter_exit(code.select("file", "name", F.when(F.col("code").rlike(r"(?s)^[^{]*\{.*\}\s*$"), body).alias("body"))).select("rule_id", "file", "message")


QUERIES = {
    "jn_export_map": export_map, "jn_resolved_bindings": resolved_bindings, "ru_star_collisions": star_collisions, "jn_rewritten_references": rewritten_references, "jn_rewritten_calls": rewritten_calls, "jn_rewritten_types": rewritten_types,
    "jn_callers": lambda s, d: resolve.callers(inner_calls(s, d), symbols(s, d), scopes(s, d)), "jn_callees": lambda s, d: resolve.callees(inner_calls(s, d), symbols(s, d)),
    "jn_lexical": lexical, "jn_type_edges": type_edges, "jn_canonical_ids": canonical, "ag_usage_facts": lambda s, d: resolve.usage_facts(uses(s, d)), "ru_unused_vars": unused,
    "jn_python_modules": python_modules, "jn_script_modules": script_modules,
    "jn_structural_matches": lambda s, d: relations.structural_matches(L.shapes(s, d), s.createDataFrame([], "owner string, target string")).filter("startswith(target, 'I')"),
    "ru_undeclared_implementer": undeclared, "jn_cache_split": cache_hits, "ru_mixed_exports": mixed, "ru_preferred_exports": lambda s, d: mixed(s, d, "named"),
    "ru_layers": layered, "ru_layer_violations": layer_violations, "ru_ambiguous_layers": lambda s, d: rules.ambiguous_layers(layered(s, d)).select("rule_id", "file"), "ru_not_exported": not_exported, "ru_logger_enter_exit": logger_rule,
    "st_affordable": lambda s, d: relations.affordable(relations.file_delta(*[load(s, d, "check_contexts").filter(c).select(F.col("file_path").alias("file"), F.col("file_path").alias("revision")).distinct() for c in ("target_language = 'python'", "target_language is not null")]), 0.9),
}

_STARS = "st AS (SELECT DISTINCT 's' || l_suppkey AS file, 'p' || l_partkey AS src FROM lineitem UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation)"
# three levels of stars: each level's names come from the one below, of several sources the least
_UP = "SELECT st.file, x.name, arg_min(x.sym, st.src) AS sym, arg_min(x.ns, st.src) AS ns FROM st JOIN {x} x ON x.file = st.src WHERE x.name <> 'default' {more} GROUP BY 1, 2"
_MAP = (
    f"{_STARS}, p AS (SELECT 'p' || p_partkey AS file, p_type AS name, p_partkey::VARCHAR AS sym, NULL::VARCHAR AS ns FROM part), s0 AS ({_UP.format(x='p', more='')}), "
    "s AS (SELECT * FROM s0 UNION ALL SELECT 's' || s_suppkey, 'default', 'd' || s_suppkey, NULL FROM supplier), "
    f"n0 AS ({_UP.format(x='s', more='')}), n AS (SELECT * FROM n0 UNION ALL SELECT 'n' || s_nationkey, 'main', 'd' || min(s_suppkey), NULL FROM supplier GROUP BY s_nationkey), "
    f"r0 AS ({_UP.format(x='n', more='')}), r AS (SELECT * FROM r0 UNION ALL SELECT 'r' || n_regionkey, n_name, NULL, 'n' || n_nationkey FROM nation), "
    "em AS (SELECT * FROM p UNION ALL SELECT * FROM s UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r)"
)
_GROUPS = "ng AS (SELECT id AS l, export_id AS e FROM (SELECT id, min(id) OVER (PARTITION BY name) AS export_id FROM sy WHERE name IS NOT NULL) WHERE id <> export_id)"
_INSIDE = "FROM sy v JOIN sy g ON g.file = v.file AND g.kind IN ('function', 'method') AND g.\"range\".\"start\" <= v.\"range\".\"start\" AND v.\"range\".\"end\" <= g.\"range\".\"end\" WHERE v.kind = 'parameter'"
_USES = f"{_CALL}, u AS (SELECT dst AS symbol_id, 1 AS usage FROM e UNION ALL SELECT dst, 11 FROM e WHERE src > dst)"
_MATCH = f"{L._SHAPES}, sz AS (SELECT owner, count(*) AS n FROM m GROUP BY owner), mt AS (SELECT a.owner, 'I' || b.owner AS target FROM m a JOIN m b ON a.word = b.word JOIN sz ON sz.owner = b.owner WHERE sz.n <= 2 GROUP BY a.owner, b.owner HAVING count(*) = max(sz.n))"
_REV = "c AS (SELECT DISTINCT file_path AS file, version, substr(sha256(source), 1, 16) AS revision FROM check_contexts), nw AS (SELECT file, arg_max(revision, version) AS revision FROM c GROUP BY file)"
_RANK = {n: "greatest(" + ", ".join(f"CASE WHEN regexp_matches(file, '{r}') THEN {w} ELSE -1 END" for r, w in g) + ", -1)" for n, g in {"core": [("/core/", 10), ("/lib/", 9)], "api": [("/api/", 9)], "tools": [("/tools/", 11)], "app": [("^/ws/[^/]*/packages/[^/]*/app/", 23)], "source": [("/src/", 9)]}.items()}
_LAYER = "y AS (SELECT DISTINCT file_path AS file FROM check_contexts), z AS (SELECT file, " + ", ".join(f"{x} AS {n}" for n, x in _RANK.items()) + " FROM y), la AS (SELECT file, list_filter([" + ", ".join(f"CASE WHEN {n} >= 0 AND {n} = greatest({', '.join(_RANK)}) THEN '{n}' END" for n in _RANK) + "], lambda w: w IS NOT NULL) AS hits FROM z), ly AS (SELECT file, hits[1] AS layer, len(hits) > 1 AS ambiguous FROM la)"
_NAMES = f"{_S}, {_CALL}"
SQL = {
    "jn_export_map": f"WITH {_MAP} SELECT file, name AS exported_name, sym AS symbol_id, ns AS ns_path FROM em",
    "jn_resolved_bindings": f"WITH {_MAP} SELECT c_custkey AS local_symbol_id, sym AS export_id, CASE WHEN c_custkey % 5 = 0 THEN 'n' || c_nationkey ELSE ns END AS ns_path FROM customer LEFT JOIN em ON em.file = 'n' || c_nationkey AND em.name = CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'default' ELSE 'main' END",
    "ru_star_collisions": f"WITH {_STARS}, p AS (SELECT 'p' || p_partkey AS file, p_type AS name FROM part), a AS (SELECT DISTINCT st.file, name, src FROM st JOIN p ON p.file = src), b AS (SELECT DISTINCT st.file, name, st.src FROM st JOIN a ON a.file = st.src), c AS (SELECT DISTINCT st.file, name, st.src FROM st JOIN b ON b.file = st.src) SELECT 'no-star-export-collisions' AS rule_id, file, '''' || name || ''' comes from ' || count(DISTINCT src) || ' star exports' AS message FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY file, name HAVING count(DISTINCT src) >= 2",
    "jn_rewritten_references": f"WITH {_NAMES}, {_GROUPS} SELECT src AS ref_id, dst AS local_symbol_id, coalesce(ng.e, dst) AS symbol_id FROM e LEFT JOIN ng ON ng.l = dst",
    "jn_rewritten_calls": f"WITH {L._BOUND}, {_CALL}, k AS (SELECT DISTINCT sy.file, l.name AS callee_name FROM e JOIN sy ON sy.id = src AND sy.kind IN ('function', 'method') JOIN lib_symbols l ON l.id = dst), nm AS (SELECT name, min(id) AS export_id FROM lib_symbols GROUP BY name), f AS (SELECT file, imported_name AS callee_name, arg_min(nm.export_id, (\"start\", local_symbol_id)) AS x FROM b JOIN nm ON nm.name = imported_name GROUP BY 1, 2) SELECT k.file, k.callee_name, f.x AS symbol_id FROM k LEFT JOIN f ON f.file = k.file AND f.callee_name = k.callee_name",
    "jn_rewritten_types": f"WITH {L._TYPES}, {_GROUPS} SELECT symbol_id, target_name, coalesce(ng.e, target_id) AS target_id, confidence FROM r LEFT JOIN ng ON ng.l = target_id",
    "jn_callers": f"WITH {_S} SELECT DISTINCT caller_id, symbol_id FROM (SELECT g.id AS caller_id, v.id AS symbol_id, row_number() OVER (PARTITION BY v.id ORDER BY g.\"range\".\"end\" - g.\"range\".\"start\", g.id) AS n {_INSIDE}) WHERE n = 1",
    "jn_callees": f"WITH {_S} SELECT DISTINCT g.id, v.id AS symbol_id {_INSIDE}",
    "jn_lexical": f"WITH RECURSIVE {_S}, {_SC}, l AS (SELECT DISTINCT id, parent FROM sc), u AS (SELECT id, id AS at, parent, 0 AS depth FROM l UNION ALL SELECT u.id, l.id, l.parent, depth + 1 FROM u JOIN l ON l.id = u.parent), q AS (SELECT v.id AS ref_id, t.id AS symbol_id, row_number() OVER (PARTITION BY v.id ORDER BY depth, t.\"range\".\"start\" DESC, t.id) AS n FROM sy v JOIN u ON u.id = v.scope_id JOIN sy t ON t.scope_id = u.at AND t.name = v.name WHERE v.kind IN ('variable', 'field') AND (coalesce(t.binding.hoisted, false) OR t.\"range\".\"start\" <= v.\"range\".\"start\")) SELECT ref_id, symbol_id FROM q WHERE n = 1",
    "jn_type_edges": f"WITH {L._TYPES} SELECT symbol_id AS src, target_id AS dst, CASE WHEN symbol_id < target_id THEN 'type-aware' ELSE confidence END AS confidence FROM r",
    "jn_canonical_ids": "WITH RECURSIVE c AS (SELECT p_partkey::BIGINT AS id, (p_partkey // 3)::BIGINT AS x FROM part WHERE p_partkey // 3 >= 1 UNION ALL SELECT id, x // 3 FROM c WHERE x // 3 >= 1) SELECT id, min(x) AS canonical FROM c GROUP BY id",
    "ag_usage_facts": f"WITH {_USES} SELECT symbol_id, bool_or(usage & 2 <> 0) AS assigned, bool_or(usage & 1 <> 0) AS read, bool_or(usage & 4 <> 0) AS type_read, bool_or(usage & 1 <> 0 AND usage & 8 = 0 OR usage & 4 <> 0) AS used FROM u GROUP BY symbol_id",
    "ru_unused_vars": f"WITH {_S}, {_CALL} SELECT id, kind, name, file FROM sy WHERE name IS NOT NULL AND flags & 1 = 0 AND kind IN ('variable', 'function', 'class') AND NOT regexp_matches(name, '^_') AND id NOT IN (SELECT dst FROM e)",
    "jn_structural_matches": f"WITH {_MATCH} SELECT owner, target FROM mt WHERE 'I' || owner <> target OR true",
    "ru_undeclared_implementer": f"WITH {_MATCH} SELECT 'no-undeclared-implementer' AS rule_id, owner AS file, 'implements ' || target AS message FROM mt",
    "jn_cache_split": f"WITH {_REV} SELECT nw.file, nw.revision, EXISTS (SELECT 1 FROM c WHERE c.version = 1 AND c.file = nw.file AND c.revision = nw.revision) AS hit FROM nw",
    "ru_mixed_exports": f"WITH {L._EXPORTS} SELECT 'no-mixed-exports' AS rule_id, file, 'default and named exports in one module' AS message FROM ex GROUP BY file HAVING bool_or(regexp_matches(exported_name, '^[A-Z]')) AND bool_or(NOT regexp_matches(exported_name, '^[A-Z]'))",
    "ru_preferred_exports": f"WITH {L._EXPORTS} SELECT 'no-mixed-exports' AS rule_id, file, 'exports should be named' AS message FROM ex GROUP BY file HAVING bool_or(regexp_matches(exported_name, '^[A-Z]'))",
    "ru_layers": f"WITH {_LAYER} SELECT file, layer, ambiguous FROM ly",
    "ru_ambiguous_layers": f"WITH {_LAYER} SELECT 'no-layer-violation' AS rule_id, file FROM ly WHERE ambiguous",
    "ru_layer_violations": f"WITH {_LAYER}, d AS (SELECT file, min(file) OVER (PARTITION BY regexp_replace(file, '/[^/]+/[^/]+$', '')) AS dst FROM y) SELECT 'no-layer-violation' AS rule_id, d.file, a.layer || ' -> ' || b.layer || ': ' || dst AS message FROM d JOIN ly a ON a.file = d.file JOIN ly b ON b.file = dst WHERE d.file <> dst AND a.layer <> b.layer AND NOT (b.layer = 'core' AND a.layer IN ('api', 'app', 'source', 'tools'))",
    "ru_not_exported": f"WITH {_NAMES}, q AS (SELECT DISTINCT t.file, t.name FROM e JOIN sy f ON f.id = src JOIN sy t ON t.id = dst WHERE f.file <> t.file AND f.name IS NOT NULL AND t.name IS NOT NULL) SELECT DISTINCT 'no-unused-exports' AS rule_id, q.file, '''' || q.name || ''' is imported but not exported' AS message FROM q JOIN sy ON sy.file = q.file AND sy.name = q.name AND kind IN ('function', 'class') WHERE NOT EXISTS (SELECT 1 FROM sy x WHERE x.file = q.file AND x.name = q.name AND x.flags & 1 <> 0)",
    "ru_logger_enter_exit": f"WITH {_S}, f AS (SELECT file_path AS file, arg_max(source, version) AS source FROM check_contexts GROUP BY file_path), k AS (SELECT sy.file, name, substring(source, \"range\".\"start\" + 1, \"range\".\"end\" - \"range\".\"start\") AS code FROM sy JOIN f ON f.file = sy.file WHERE kind = 'function' AND NOT ends_with(sy.file, '.py') AND name IS NOT NULL), b AS (SELECT file, name, CASE WHEN regexp_matches(code, '(?s)^[^{{]*\\{{.*\\}}\\s*$') THEN regexp_extract(code, '(?s)^[^{{]*\\{{(.*)\\}}\\s*$', 1) END AS body FROM k), w AS (SELECT file, name, CASE WHEN body IS NULL THEN 'is one expression' WHEN NOT regexp_matches(body, '(?s)^\\s*(?:(?://[^\\n]*\\n|#[^\\n]*\\n|/\\*.*?\\*/)\\s*)*(?:await\\s+)?logger\\s*\\.\\s*enter\\s*\\(') THEN 'does not begin with logger.enter' WHEN NOT regexp_matches(regexp_extract(body, '(?s)\\btry\\b.*?\\bfinally\\b(.*)', 1), '\\blogger\\s*\\.\\s*exit\\s*\\(') THEN 'does not end with logger.exit in a finally' END AS what FROM b) SELECT 'require-logger-enter-exit' AS rule_id, file, 'function ''' || name || ''' ' || what AS message FROM w WHERE what IS NOT NULL",
    "st_affordable": "WITH o AS (SELECT DISTINCT file_path AS file FROM check_contexts WHERE target_language = 'python'), n AS (SELECT DISTINCT file_path AS file FROM check_contexts WHERE target_language IS NOT NULL), m AS (SELECT (SELECT count(*) FROM n WHERE file NOT IN (SELECT file FROM o)) + (SELECT count(*) FROM o WHERE file NOT IN (SELECT file FROM n)) AS moved, (SELECT count(*) FROM n) AS \"current\") SELECT moved, \"current\", \"current\" = 0 OR moved / \"current\" <= 0.9 AS affordable FROM m",
}
