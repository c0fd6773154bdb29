"""Queries over the facts of a code base: contexts, symbols, scopes, bindings and call edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph, relations, rules
from loomgraph.sources import workspace
from loomgraph.sources.reports import rule_rollup
from loomgraph.sources.tables import load
from loomgraph.streaming import versions

VERBS = ["get", "set", "load", "store", "build", "parse", "render"]
WORDS = ["budget", "ledger"]
CASES = {"function": ["camelCase", "snake_case"], "method": ["camelCase", "snake_case"], "class": ["PascalCase"], "interface": ["PascalCase"], "const": ["SCREAMING_SNAKE_CASE", "camelCase"]}


def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, source, repo`` of the newest version of each file."""
    c = load(spark, sf_dir, "check_contexts").select(F.col("file_path").alias("file"), "version", "source", "repo")
    return relations.latest(c, ["file"], [F.col("version")]).select("file", "source", "repo")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol once: the record ingested last."""
    return relations.latest(load(spark, sf_dir, "symbols"), ["id"], [F.col("ingested_at")])


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.latest(load(spark, sf_dir, "scopes"), ["id"], [F.col("ingested_at")])


def files(spark, sf_dir):
    return load(spark, sf_dir, "check_contexts").select(F.col("file_path").alias("file")).distinct()


def bindings(spark, sf_dir):
    """``src, dst, style, local_symbol_id, module_spec, imported_name``: each binding once, with its file."""
    b = load(spark, sf_dir, "import_bindings").select("local_symbol_id", "imported_name", "module_spec", "resolved_module_path", "is_default", "is_namespace", "import_style", F.col("range.start").alias("start"))
    one = b.groupBy("local_symbol_id").agg(F.max("imported_name").alias("imported_name"), F.max("module_spec").alias("module_spec"), F.max("resolved_module_path").alias("dst"), F.max("import_style").alias("style"), F.min("start").alias("start"))
    return one.join(symbols(spark, sf_dir).select(F.col("id").alias("local_symbol_id"), F.col("file").alias("src")), "local_symbol_id")


def module_edges(spark, sf_dir):
    b = bindings(spark, sf_dir)
    known = b.select(F.col("dst").alias("file")).union(files(spark, sf_dir)).distinct()
    return graph.module_graph(b, b, known)


def edge_info(spark, sf_dir):
    b = bindings(spark, sf_dir).filter("dst is not null and src <> dst")
    return graph.edge_info(b, b)


def call_edges(spark, sf_dir):
    e = load(spark, sf_dir, "structural_edges").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return e.filter("src is not null and dst is not null and src <> dst").distinct()


def call_counts(spark, sf_dir):
    """Callers and callees of every function and method."""
    d = graph.degrees(call_edges(spark, sf_dir))
    s = symbols(spark, sf_dir).filter(F.col("kind").isin("function", "method")).select("id", "name", "file")
    return s.join(d, "id", "left").select("id", "name", "file", F.coalesce("fan_in", F.lit(0)).alias("callers"), F.coalesce("fan_out", F.lit(0)).alias("callees"))


def importers(spark, sf_dir):
    """Files that bind each resolved export."""
    b = load(spark, sf_dir, "import_bindings").filter("resolved_export_id is not null").select("local_symbol_id", "resolved_export_id")
    s = symbols(spark, sf_dir).select(F.col("id").alias("local_symbol_id"), "file")
    return b.join(s, "local_symbol_id").groupBy(F.col("resolved_export_id").alias("id")).agg(F.count_distinct("file").alias("n_files"))


def enclosing(spark, sf_dir):
    return relations.enclosing_scope(symbols(spark, sf_dir).filter("kind in ('function', 'method', 'class')"), scopes(spark, sf_dir))


def positions(spark, sf_dir):
    """Line and column of every class, function and method."""
    s = symbols(spark, sf_dir).filter("kind in ('function', 'method', 'class')").select("id", "file", F.col("range.start").alias("start"))
    j = s.join(newest_files(spark, sf_dir).select("file", "source"), "file")
    return j.select("id", T.line_of(F.col("source"), F.col("start")).alias("line"), T.column_of(F.col("source"), F.col("start")).alias("col"))


def at_position(spark, sf_dir):
    """The smallest symbol at the middle of every class."""
    s = symbols(spark, sf_dir)
    middle = s.filter("kind = 'class'").select("file", F.floor((F.col("range.start") + F.col("range.end")) / 2).cast("int").alias("offset")).distinct()
    return relations.at_position(s, middle)


def ancestors(spark, sf_dir):
    return relations.scope_ancestors(scopes(spark, sf_dir)).groupBy("id").agg(F.max("depth").alias("depth"))


def casing(spark, sf_dir):
    s = symbols(spark, sf_dir).filter("name is not null")
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(T.matches_casing(F.col("name"), [c])).alias(c.replace("-", "_")) for c in T.CASINGS])


def converted(spark, sf_dir):
    names = symbols(spark, sf_dir).select("name").filter("name rlike '^[A-Za-z_]+$'").distinct()
    return names.select("name", T.to_casing(F.col("name"), "snake_case").alias("snake"), T.to_casing(F.col("name"), "PascalCase").alias("pascal"))


def words(spark, sf_dir):
    w = symbols(spark, sf_dir).select(F.explode(T.words_of(F.col("name"))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def search(spark, sf_dir):
    s = symbols(spark, sf_dir).filter("kind in ('function', 'method', 'class')")
    scored = s.withColumn("score", T.search_score([F.col("name"), F.col("file")], "budget ledger")).filter("score is not null")
    return scored.orderBy(F.desc("score"), "file", "name", "id").limit(50).select("score", "file", "name", "id")


def loc(spark, sf_dir):
    f = newest_files(spark, sf_dir).withColumn("loc", T.loc(F.col("source")))
    return f.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.sum("loc").alias("loc"), F.max("loc").alias("max_loc"))


def languages(spark, sf_dir):
    return files(spark, sf_dir).groupBy(T.language_of(F.col("file")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


def targets(spark, sf_dir):
    rule = [{"id": "a", "targets": [{"include": ["/ws/*/packages/**/*.ts"], "language": "typescript"}, {"include": ["**/*.tsx"], "language": "tsx"}], "exclude": ["**/generated/**"]}, {"id": "b", "targets": [{"include": ["**/{ui,api}/**/*.py"]}]}]
    return workspace.rule_targets(files(spark, sf_dir), rule)


def delta(spark, sf_dir):
    """Each file's first version against its newest."""
    c = load(spark, sf_dir, "check_contexts").select(F.col("file_path").alias("file"), "version", T.revision(F.col("source")).alias("revision")).distinct()
    old = c.filter("version = 1").select("file", "revision")
    return relations.file_delta(old, relations.latest(c, ["file"], [F.col("version")]).select("file", "revision"))


def owned(spark, sf_dir):
    """Files and symbols by owning package (the longest package folder above a file)."""
    f = files(spark, sf_dir)
    package = f.select(F.regexp_extract("file", r"^(/ws/[^/]+/packages/[^/]+)/", 1).alias("dir")).filter("dir <> ''").distinct().withColumn("package", F.regexp_extract("dir", "[^/]+$", 0))
    roots = f.select(F.regexp_extract("file", r"^(/ws/[^/]+)/", 1).alias("dir")).distinct().withColumn("package", F.regexp_extract("dir", "[^/]+$", 0))
    at = relations.package_of(f, package.unionByName(roots))
    n = symbols(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return at.join(n, "file", "left").groupBy("package").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce("n", F.lit(0))).alias("n_symbols"))


def duplicates(spark, sf_dir):
    e = relations.exported(symbols(spark, sf_dir)).select("file", F.col("name").alias("exported_name"))
    return rules.no_duplicate_exports(e).select("rule_id", "file", "message")


def unused(spark, sf_dir):
    """Exported functions and classes that no binding of another file names."""
    s = relations.exported(symbols(spark, sf_dir)).filter("kind in ('function', 'class')").select("file", F.col("name").alias("exported_name"))
    b = bindings(spark, sf_dir).filter("dst is not null").select(F.col("src").alias("file"), F.col("dst").alias("target"), F.col("imported_name").alias("name"))
    return rules.no_unused_exports(s.distinct(), b, b.select("file", "target").limit(0)).select("rule_id", "file", "message")


def imports_in_sources(spark, sf_dir):
    """Module specifiers that script files import or export from, read from the sources' lines."""
    f = newest_files(spark, sf_dir).filter("not endswith(file, '.py')")
    line = f.select("file", F.explode(F.split("source", "\n")).alias("line"))
    spec = F.regexp_extract("line", r"""^(?:import|export)\b.*\bfrom\s+["']([^"']+)["']""", 1)
    return line.select("file", spec.alias("spec")).filter("spec <> ''").distinct()


def groups(spark, sf_dir):
    """Bindings by import statement: those of one file and specifier at their nearest first binding."""
    b = bindings(spark, sf_dir).filter("module_spec is not null").select(F.col("local_symbol_id").alias("id"), F.col("src").alias("file"), F.col("module_spec").alias("spec"), "start")
    statements = b.groupBy("file", "spec").agg(F.min("start").alias("start"))
    return relations.group_to_nearest(b, statements)


def external_calls(spark, sf_dir):
    """Calls by called library: edges into the index of third-party code."""
    lib = load(spark, sf_dir, "lib_symbols").select(F.col("id").alias("dst"), "file")
    return call_edges(spark, sf_dir).join(lib, "dst").groupBy(F.substring_index("file", "/", 1).alias("library")).agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_callers"))


def merged(spark, sf_dir):
    """Call edges merged with the type-aware ones, here those from methods."""
    e = call_edges(spark, sf_dir)
    typed = e.join(symbols(spark, sf_dir).filter("kind = 'method'").select(F.col("id").alias("src")), "src", "left_semi")
    return relations.merge_edges(e, typed)


def lint_rollup(spark, sf_dir):
    s = symbols(spark, sf_dir).filter("name is not null")
    every = rules.no_interface(s).unionByName(rules.no_verb_names(s, VERBS)).unionByName(rules.enforce_casing(s, CASES))
    return rule_rollup(every)


def budgeted(spark, sf_dir):
    """The first 50 symbols of each kind, 120 in all."""
    s = symbols(spark, sf_dir).filter("kind is not null").select("kind", "id")
    return relations.budget(s, "kind", [F.col("id")], 50, 120, ["function", "method", "class", "interface", "const", "field", "variable", "parameter"])


def newest_events(spark, sf_dir):
    e = versions.stream(spark, f"{sf_dir}/events.parquet")
    return versions.keep_newest(e.select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], [F.col("ts"), F.col("event_id")])


def event_windows(spark, sf_dir):
    """Events by day and type, counted over the stream."""
    e = versions.stream(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = versions.run_complete(versions.windowed_counts(e, "ts", "1 day", "7 days", ["event_type"]))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def supersession(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat_ws(":", "user_id", "event_type").alias("key"))
    return versions.superseded(e)


def revisions(spark, sf_dir):
    c = load(spark, sf_dir, "check_contexts").filter("revision is not null").select("context_id", "revision", T.revision(F.col("source")).alias("computed")).distinct()
    return c.select("context_id", "computed", (F.col("revision") == F.col("computed")).alias("same"))


def last_parameter(spark, sf_dir):
    """The last parameter index of each file, over all its parameters."""
    p = symbols(spark, sf_dir).filter("kind = 'parameter'").select("id", "file", F.col("binding.parameter_index").alias("at"))
    return p.withColumn("last", F.max("at").over(Window.partitionBy("file"))).groupBy("file").agg(F.max("last").alias("last"), F.count_if(F.col("at") == F.col("last")).alias("n_last"))


_rule = lambda f: (lambda s, d: f(s, d).select("rule_id", "file", "message"))

QUERIES = {
    "gr_module_graph": module_edges, "gr_edge_info": edge_info, "gr_call_degrees": lambda s, d: graph.degrees(call_edges(s, d)), "ag_call_counts": call_counts, "ag_importers": importers,
    "jn_enclosing_scope": enclosing, "jn_scope_depth": ancestors, "fn_positions": positions, "lk_at_position": at_position, "fn_casing": casing, "fn_convert_casing": converted, "fn_words": words,
    "tk_search": search, "ag_loc": loc, "sc_languages": languages, "sc_rule_targets": targets, "st_file_delta": delta, "lk_package_owner": owned,
    "ru_duplicate_exports": duplicates, "ru_unused_exports": unused, "sc_imports": imports_in_sources, "jn_import_groups": groups, "ag_external_calls": external_calls, "jn_merged_edges": merged,
    "ru_enforce_casing": _rule(lambda s, d: rules.enforce_casing(symbols(s, d).filter("name is not null"), CASES)),
    "ru_no_verb_names": _rule(lambda s, d: rules.no_verb_names(symbols(s, d).filter("name is not null"), VERBS)),
    "ru_no_interface": _rule(lambda s, d: rules.no_interface(symbols(s, d))),
    "ru_forbidden_declarations": _rule(lambda s, d: rules.forbidden_declarations(symbols(s, d), ["interface", "class"], ["import"])),
    "ru_forbidden_path_words": _rule(lambda s, d: rules.forbidden_path_words(files(s, d), WORDS, "/ws/")),
    "ru_forbidden_words": lambda s, d: rules.forbidden_words(newest_files(s, d), WORDS),
    "ag_lint_rollup": lint_rollup, "wn_budget": budgeted, "wn_last_parameter": last_parameter, "in_newest_events": newest_events, "in_event_days": event_windows, "in_supersession": supersession, "fn_revision": revisions,
    "lk_symbol_lookup": lambda s, d: relations.symbol_lookup(symbols(s, d), "report", None, None, 50).select("file", "kind", "id"),
    "lk_stats": lambda s, d: symbols(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"), F.count_if(F.col("flags").bitwiseAND(1) != 0).alias("n_exported")),
}

_S = "sy AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM symbols) WHERE rn = 1)"
_SC = "sc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM scopes) WHERE rn = 1)"
_F = "f AS (SELECT file_path AS file, arg_max(source, version) AS source, arg_max(coalesce(repo, chr(0)), version) AS repo0 FROM check_contexts GROUP BY file_path)"
_B = f"{_S}, b AS (SELECT x.*, sy.file AS src FROM (SELECT local_symbol_id, max(imported_name) AS imported_name, max(module_spec) AS module_spec, max(resolved_module_path) AS dst, max(import_style) AS style, min(\"range\".\"start\") AS \"start\" FROM import_bindings GROUP BY local_symbol_id) x JOIN sy ON sy.id = x.local_symbol_id)"
_CALL = "e AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM structural_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id)"
_DEG = "deg AS (SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY id)"
_SPLIT = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z\d])([A-Z])', '\1_\2', 'g')), '[_\-]+'), lambda w: w <> '')"
_W = _SPLIT.format(x="name")
_match = lambda style: f"(regexp_replace(name, '^_+', '') <> '' AND regexp_matches(regexp_replace(name, '^_+', ''), '{T.CASINGS[style]}'))"
_casing_rule = "SELECT 'enforce-casing' AS rule_id, file, kind || ' ''' || name || ''' has no allowed casing' AS message FROM sy WHERE name IS NOT NULL AND (" + " OR ".join(f"(kind = '{k}' AND NOT (" + " OR ".join(_match(s) for s in ss) + "))" for k, ss in CASES.items()) + ")"
_verb_rule = f"SELECT 'no-verb-function-name' AS rule_id, file, 'function ''' || name || ''' begins with the verb ''' || ({_W})[1] || '''' AS message FROM sy WHERE kind = 'function' AND NOT (file LIKE '%.py' AND regexp_matches(name, '^__.*__$')) AND ({_W})[1] IN ({', '.join(repr(v) for v in VERBS)})"
_iface_rule = "SELECT 'no-interface' AS rule_id, file, 'interface ''' || name || ''' should be a type' AS message FROM sy WHERE kind = 'interface'"


def _one(candidate: str, token: str) -> str:
    seg = f"list_filter(string_split_regex(lower({candidate}), '[/._-]'), lambda w: w <> '')"
    return f"CASE WHEN lower({candidate}) = '{token}' THEN 120 WHEN starts_with(lower({candidate}), '{token}') THEN 90 WHEN list_contains({seg}, '{token}') THEN 80 WHEN len(list_filter({seg}, lambda w: starts_with(w, '{token}'))) > 0 THEN 70 WHEN contains(lower({candidate}), '{token}') THEN 60 END"


_SCORE = " + ".join(f"greatest({_one('name', t)}, {_one('file', t)})" for t in ("budget", "ledger"))
_forbid = lambda x: f"CASE WHEN list_contains({_SPLIT.format(x=x)}, 'budget') THEN 'budget' WHEN list_contains({_SPLIT.format(x=x)}, 'ledger') THEN 'ledger' END"

SQL = {
    "gr_module_graph": f"WITH {_B} SELECT DISTINCT src, dst FROM b WHERE dst IS NOT NULL AND src <> dst",
    "gr_edge_info": f"WITH {_B} SELECT src, dst, count(*) AS binding_count, ['side_effect', 'static', 'cjs', 'dynamic'][max(CASE style WHEN 'dynamic' THEN 3 WHEN 'cjs' THEN 2 WHEN 'side_effect' THEN 0 ELSE 1 END) + 1] AS kind FROM b WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst",
    "gr_call_degrees": f"WITH {_CALL}, {_DEG} SELECT * FROM deg",
    "ag_call_counts": f"WITH {_S}, {_CALL}, {_DEG} SELECT sy.id, name, file, coalesce(fan_in, 0) AS callers, coalesce(fan_out, 0) AS callees FROM sy LEFT JOIN deg ON deg.id = sy.id WHERE kind IN ('function', 'method')",
    "ag_importers": f"WITH {_S} SELECT resolved_export_id AS id, count(DISTINCT file) AS n_files FROM import_bindings JOIN sy ON sy.id = local_symbol_id WHERE resolved_export_id IS NOT NULL GROUP BY 1",
    "jn_enclosing_scope": f"WITH {_S}, {_SC} SELECT id, scope_id FROM (SELECT sy.id, sc.id AS scope_id, row_number() OVER (PARTITION BY sy.id ORDER BY sc.\"range\".\"end\" - sc.\"range\".\"start\", sc.\"range\".\"start\", sc.id) AS n FROM sy JOIN sc ON sc.file = sy.file AND sc.\"range\".\"start\" <= sy.\"range\".\"start\" AND sy.\"range\".\"end\" <= sc.\"range\".\"end\" WHERE sy.kind IN ('function', 'method', 'class')) WHERE n = 1",
    "jn_scope_depth": f"WITH RECURSIVE {_SC}, l AS (SELECT DISTINCT id, parent FROM sc), u AS (SELECT id, parent, 0 AS depth FROM l UNION ALL SELECT u.id, l.parent, depth + 1 FROM u JOIN l ON l.id = u.parent) SELECT id, max(depth) AS depth FROM u GROUP BY id",
    "fn_positions": f"WITH {_S}, {_F} SELECT id, len(left(source, \"range\".\"start\")) - len(replace(left(source, \"range\".\"start\"), chr(10), '')) + 1 AS line, len(list_last(string_split(left(source, \"range\".\"start\"), chr(10)))) + 1 AS col FROM sy JOIN f ON f.file = sy.file WHERE kind IN ('function', 'method', 'class')",
    "lk_at_position": f"WITH {_S}, q AS (SELECT DISTINCT file, (\"range\".\"start\" + \"range\".\"end\") // 2 AS \"offset\" FROM sy WHERE kind = 'class') SELECT file, \"offset\", id FROM (SELECT q.file, q.\"offset\", sy.id, row_number() OVER (PARTITION BY q.file, q.\"offset\" ORDER BY \"range\".\"end\" - \"range\".\"start\", \"range\".\"start\", sy.id) AS n FROM q JOIN sy ON sy.file = q.file AND \"range\".\"start\" <= q.\"offset\" AND q.\"offset\" < \"range\".\"end\") WHERE n = 1",
    "fn_casing": f"WITH {_S} SELECT kind, count(*) AS n, " + ", ".join(f"count(*) FILTER ({_match(c)}) AS {c.replace('-', '_')}" for c in T.CASINGS) + " FROM sy WHERE name IS NOT NULL GROUP BY kind",
    "fn_convert_casing": f"WITH {_S}, w AS (SELECT DISTINCT name, regexp_extract(name, '^_*') AS pre, {_SPLIT.format(x="regexp_replace(name, '^_+', '')")} AS ws FROM sy WHERE regexp_matches(name, '^[A-Za-z_]+$')), "
    "c AS (SELECT name, pre, array_to_string(ws, '_') AS a, array_to_string(list_transform(ws, lambda w: upper(w[1]) || w[2:]), '') AS b, len(ws) AS n FROM w) "
    f"SELECT name, CASE WHEN n > 0 AND regexp_matches(a, '{T.CASINGS['snake_case']}') THEN pre || a END AS snake, CASE WHEN n > 0 AND regexp_matches(b, '{T.CASINGS['PascalCase']}') THEN pre || b END AS pascal FROM c",
    "fn_words": f"WITH {_S} SELECT word, count(*) AS n FROM (SELECT unnest({_W}) AS word FROM sy) GROUP BY word",
    "tk_search": f"WITH {_S}, q AS (SELECT {_SCORE} AS score, file, name, id FROM sy WHERE kind IN ('function', 'method', 'class')) SELECT * FROM q WHERE score IS NOT NULL ORDER BY score DESC, file, name, id LIMIT 50",
    "ag_loc": f"WITH {_F}, l AS (SELECT nullif(repo0, chr(0)) AS repo, CASE WHEN source = '' THEN 0 WHEN ends_with(source, chr(10)) THEN len(source) - len(replace(source, chr(10), '')) ELSE len(source) - len(replace(source, chr(10), '')) + 1 END AS loc FROM f) SELECT repo, count(*) AS n_files, sum(loc)::BIGINT AS loc, max(loc) AS max_loc FROM l GROUP BY repo",
    "sc_languages": "SELECT CASE WHEN regexp_matches(file_path, '\\.(tsx|jsx)$') THEN 'tsx' WHEN regexp_matches(file_path, '\\.(ts|mts|cts|js|mjs|cjs)$') THEN 'typescript' WHEN regexp_matches(file_path, '\\.pyw?$') THEN 'python' END AS language, count(DISTINCT file_path) AS n_files FROM check_contexts GROUP BY 1",
    "sc_rule_targets": "WITH p AS (SELECT DISTINCT file_path AS file FROM check_contexts) SELECT 'a' AS rule_id, 0 AS target, file FROM p WHERE regexp_matches(file, '^/ws/[^/]*/packages/.*\\.ts$') AND file NOT LIKE '%/generated/%' UNION ALL SELECT 'a', 1, file FROM p WHERE file LIKE '%.tsx' AND file NOT LIKE '%/generated/%' UNION ALL SELECT 'b', 0, file FROM p WHERE regexp_matches(file, '/(ui|api)/.*\\.py$')",
    "st_file_delta": "WITH c AS (SELECT DISTINCT file_path AS file, version, substr(sha256(source), 1, 16) AS revision FROM check_contexts), o AS (SELECT file, revision FROM c WHERE version = 1), n AS (SELECT file, arg_max(revision, version) AS revision FROM c GROUP BY file) SELECT coalesce(o.file, n.file) AS file, CASE WHEN o.revision IS NULL THEN 'added' WHEN n.revision IS NULL THEN 'removed' WHEN o.revision = n.revision THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.file = n.file",
    "lk_package_owner": f"WITH {_S}, p AS (SELECT DISTINCT file_path AS file FROM check_contexts), o AS (SELECT file, CASE WHEN regexp_matches(file, '^/ws/[^/]+/packages/[^/]+/') THEN regexp_extract(file, '^/ws/[^/]+/packages/([^/]+)/', 1) ELSE regexp_extract(file, '^/ws/([^/]+)/', 1) END AS package FROM p), n AS (SELECT file, count(*) AS n FROM sy GROUP BY file) SELECT package, count(*) AS n_files, sum(coalesce(n, 0))::BIGINT AS n_symbols FROM o LEFT JOIN n ON n.file = o.file GROUP BY package",
    "ru_duplicate_exports": f"WITH {_S}, x AS (SELECT DISTINCT name, file FROM sy WHERE flags & 1 <> 0), y AS (SELECT name, file, min(file) OVER (PARTITION BY name) AS first FROM x) SELECT 'no-duplicate-exports' AS rule_id, file, '''' || name || ''' is exported by ' || first || ' already' AS message FROM y WHERE file <> first",
    "ru_unused_exports": f"WITH {_B}, x AS (SELECT DISTINCT file, name FROM sy WHERE flags & 1 <> 0 AND kind IN ('function', 'class')), u AS (SELECT DISTINCT dst AS file, imported_name AS name FROM b WHERE dst IS NOT NULL AND src <> dst) SELECT 'no-unused-exports' AS rule_id, file, '''' || name || ''' is not imported' AS message FROM x ANTI JOIN u USING (file, name)",
    "sc_imports": f"WITH {_F}, l AS (SELECT file, unnest(string_split(source, chr(10))) AS line FROM f WHERE file NOT LIKE '%.py') SELECT DISTINCT file, regexp_extract(line, '^(?:import|export)\\b.*\\bfrom\\s+[\"'']([^\"'']+)[\"'']', 1) AS spec FROM l WHERE regexp_extract(line, '^(?:import|export)\\b.*\\bfrom\\s+[\"'']([^\"'']+)[\"'']', 1) <> ''",
    "jn_import_groups": f"WITH {_B} SELECT src AS file, module_spec AS spec, min(\"start\") AS statement, count(*) AS n_bindings, min(\"start\") AS first, max(\"start\") AS last FROM b WHERE module_spec IS NOT NULL GROUP BY src, module_spec",
    "ag_external_calls": f"WITH {_CALL} SELECT split_part(file, '/', 1) AS library, count(*) AS n_edges, count(DISTINCT src) AS n_callers FROM e JOIN lib_symbols ON id = dst GROUP BY 1",
    "jn_merged_edges": f"WITH {_S}, {_CALL} SELECT src, dst, CASE WHEN src IN (SELECT id FROM sy WHERE kind = 'method') THEN 'type-aware' ELSE 'structural' END AS confidence FROM e",
    "ru_enforce_casing": f"WITH {_S} {_casing_rule}",
    "ru_no_verb_names": f"WITH {_S} {_verb_rule}",
    "ru_no_interface": f"WITH {_S} {_iface_rule}",
    "ru_forbidden_declarations": f"WITH {_S}, x AS (SELECT file, name, CASE WHEN binding.binding_kind = 'import' THEN 'import' WHEN kind IN ('interface', 'class') THEN kind END AS what FROM sy WHERE name <> 'constructor') SELECT 'forbidden-declarations' AS rule_id, file, 'forbidden ' || what || ' ''' || name || '''' AS message FROM x WHERE what IS NOT NULL",
    "ru_forbidden_path_words": f"WITH p AS (SELECT DISTINCT file_path AS file FROM check_contexts), x AS (SELECT file, unnest(list_filter(string_split(substr(file, 5), '/'), lambda w: w <> '')) AS segment, generate_subscripts(list_filter(string_split(substr(file, 5), '/'), lambda w: w <> ''), 1) AS at, len(list_filter(string_split(substr(file, 5), '/'), lambda w: w <> '')) AS n FROM p), y AS (SELECT file, segment, CASE WHEN x.at = n THEN regexp_replace(segment, '\\.[^.]*$', '') ELSE segment END AS bare FROM x) SELECT 'forbidden-path-words' AS rule_id, file, 'path segment ''' || segment || ''' has the forbidden word ''' || ({_forbid('bare')}) || '''' AS message FROM y WHERE ({_forbid('bare')}) IS NOT NULL",
    "ag_lint_rollup": f"WITH {_S}, v AS ({_iface_rule} AND name IS NOT NULL UNION ALL {_verb_rule} UNION ALL {_casing_rule}) SELECT rule_id, count(*) AS n_violations, count(DISTINCT file) AS n_files FROM v GROUP BY rule_id",
    "wn_budget": f"WITH {_S}, k AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS n, list_position(['function', 'method', 'class', 'interface', 'const', 'field', 'variable', 'parameter'], kind) AS place FROM sy WHERE kind IS NOT NULL), a AS (SELECT kind, id, row_number() OVER (ORDER BY place, n) AS r FROM k WHERE n <= 50) SELECT kind, id FROM a WHERE r <= 120",
    "wn_last_parameter": f"WITH {_S}, p AS (SELECT file, binding.parameter_index AS at, max(binding.parameter_index) OVER (PARTITION BY file) AS last FROM sy WHERE kind = 'parameter') SELECT file, max(last) AS last, count(*) FILTER (p.at = last) AS n_last FROM p GROUP BY file",
    "in_newest_events": "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "in_event_days": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "in_supersession": "WITH k AS (SELECT event_id AS request_id, user_id || ':' || event_type AS key FROM events) SELECT request_id, key, request_id < max(request_id) OVER (PARTITION BY key) AS superseded FROM k",
    "fn_revision": "SELECT DISTINCT context_id, substr(sha256(source), 1, 16) AS computed, revision = substr(sha256(source), 1, 16) AS same FROM check_contexts WHERE revision IS NOT NULL",
    "lk_symbol_lookup": f"WITH {_S} SELECT file, kind, id FROM sy WHERE name = 'report' ORDER BY file, \"range\".\"start\", id LIMIT 50",
    "lk_stats": f"WITH {_S} SELECT kind, count(*) AS n, count(DISTINCT file) AS n_files, count(*) FILTER (flags & 1 <> 0) AS n_exported FROM sy GROUP BY kind",
}
