import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import export, graph, lookups, relations, rules, skew
from loomgraph.sources.reports import grouped
from loomgraph.streaming import versions


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_lookups_by_key(spark):
    s = spark.createDataFrame([("a", "f", "n", "x"), ("b", "g", "n", None), ("c", None, None, "x")], "id string, file string, name string, scope_id string")
    keys = spark.createDataFrame([("x",), ("x",), (None,)], "k string")
    assert rows(lookups.symbols_in_scope(s, keys), "id") == [("a",), ("c",)]
    assert lookups.symbols_in_file(s, keys.limit(0)).count() == 0 and lookups.symbols_by_name(s.limit(0), keys).count() == 0
    with pytest.raises(KeyError):
        lookups.relations_of_kind({"calls": s}, "imports")


def test_imports_take_the_first_binding(spark):
    b = spark.createDataFrame([("1", "f", "m", "x", False, False, "e1", 9), ("2", "f", "m", "x", False, False, None, 3), ("3", "f", "m", "y", True, False, "e3", 1), ("4", "f", "m", "z", False, True, "e4", 1)], "local_symbol_id string, file string, spec string, imported_name string, is_default boolean, is_namespace boolean, export_id string, start int")
    asked = spark.createDataFrame([("f", "m", n) for n in ("x", "default", "y", "z")], "file string, spec string, name string")
    assert {r["name"]: r["export_id"] for r in lookups.resolve_imports(asked, b).collect()} == {"x": None, "default": "e3", "y": None, "z": None}


def test_modules(spark):
    files = spark.createDataFrame([(f,) for f in ("/w/packages/a/src/x.ts", "/w/packages/a/src/index.ts", "/w/packages/a/b.ts", "/w/app/main.ts", "/w/app/y/index.tsx", "/abs/z.js")], "file string")
    packages = spark.createDataFrame([("@w/a", "/w/packages/a", "/w/packages/a/src/index.ts"), ("@w", "/w", None)], "name string, dir string, entry string")
    asked = {"@w/a": ("/w/packages/a/src/index.ts", "package"), "@w/a/x": ("/w/packages/a/src/x.ts", "package"), "@w/a/b": ("/w/packages/a/b.ts", "package"), "@w/a/none": (None, None), "react": (None, None), "./y": ("/w/app/y/index.tsx", "relative"), "~/app/main": ("/w/app/main.ts", "alias"), "/abs/z": ("/abs/z.js", "absolute"), "..": (None, None), "": (None, None)}
    specs = spark.createDataFrame([("/w/app/main.ts", s) for s in asked], "from_file string, spec string")
    got = {r["spec"]: (r["target"], r["how"]) for r in relations.resolve_modules(specs, files, packages, {"~/": "/w/"}).collect()}
    assert got == asked


def test_submodules(spark):
    files = spark.createDataFrame([("/p/__init__.py",), ("/p/m.py",), ("/p/q/__init__.py",)], "file string")
    r = spark.createDataFrame([("a", "p", "m", "/p/__init__.py", None), ("a", "p", "q", "/p/__init__.py", None), ("a", "p", "m", "/p/__init__.py", "e"), ("a", "p", "z", "/p/__init__.py", None), ("a", "o", "m", "/o.py", None)], "from_file string, spec string, name string, target string, export_id string")
    got = sorted((r["name"], r["export_id"] or "", r["target"], r["submodule"]) for r in relations.with_submodules(r, files).collect())
    assert got == [("m", "", "/o.py", None), ("m", "", "/p/__init__.py", "/p/m.py"), ("m", "e", "/p/__init__.py", None), ("q", "", "/p/__init__.py", "/p/q/__init__.py"), ("z", "", "/p/__init__.py", None)]


def test_shape_matches_against_brute_force(spark):
    rng, made = random.Random(4), []
    for k in range(30):
        members = rng.sample("abcdef", rng.randrange(0, 5))
        made.append((f"o{k}", rng.choice(["class", "interface"]), rng.random() < 0.1, [(m, "method", rng.randrange(3), rng.random() < 0.3, False) for m in members]))
    shapes = spark.createDataFrame(made, "owner string, kind string, truncated boolean, members array<struct<name:string,member_kind:string,param_arity:int,is_optional:boolean,is_static:boolean>>")
    wanted = []
    for o, kind, cut, have in made:
        for t, _, tcut, need in made:
            by = {m[0]: m[2] for m in have}
            if kind == "class" and not cut and not tcut and o != t and need and all(m[3] or by.get(m[0], -1) >= m[2] for m in need):
                wanted.append((o, t))
    none = spark.createDataFrame([], "owner string, target string")
    assert rows(relations.structural_matches(shapes, none), "owner", "target") == sorted(wanted)


def test_deep_scopes_keep_all_ancestors(spark):
    s = spark.createDataFrame([(f"s{k}", f"s{k - 1}" if k else None) for k in range(150)] + [("x", "y"), ("y", "x")], "id string, parent string")
    got = {(r["id"], r["ancestor"]): r["depth"] for r in relations.scope_ancestors(s).collect()}
    assert all(got[(f"s{k}", f"s{j}")] == k - j for k in range(150) for j in range(k + 1)) and got[("x", "y")] == 1 and got[("x", "x")] == 0


def test_places_and_longest_chain(spark):
    df = spark.createDataFrame([(k, k * 7 % 100) for k in range(100)], "id int, v int")
    assert [r["n"] for r in export.placed(df, [F.col("v")], "n").orderBy("v").collect()] == list(range(100))
    assert export.placed(df.limit(0), [F.col("v")], "n").count() == 0
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (1, 4), (4, 6), (3, 5), (0, 5)], "src int, dst int")
    chain = graph.longest_chain(e, graph.components(e))
    assert [r["id"] for r in chain.orderBy("place").collect()] == [1, 2, 5]
    assert graph.longest_chain(e.limit(0), graph.components(e.limit(0))).count() == 0
    nodes = spark.createDataFrame([(k,) for k in range(7)], "id int")
    assert [r["id"] for r in graph.dependency_order(e, nodes).orderBy("place").collect()] == [5, 6, 0, 4, 1, 2, 3]


def test_cycle_diff(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "id int, cycle int")
    b = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id int, cycle int")
    assert sorted((r["change"], r["members"]) for r in graph.cycle_diff(a, b).collect()) == [("added", [1, 2, 3]), ("removed", [1, 2]), ("removed", [5, 6])]


def test_snapshot_labels(spark, tmp_path):
    t = spark.createDataFrame([(1,)], "id int")
    for label in ("a", "b"):
        export.write_snapshot({"nodes": t}, str(tmp_path / "s"), label)
    assert export.labels(spark, str(tmp_path / "s")) == ["a", "b"]
    assert export.delete_snapshot(spark, str(tmp_path / "s"), "a") and not export.delete_snapshot(spark, str(tmp_path / "s"), "a")
    assert export.labels(spark, str(tmp_path / "s")) == ["b"] and export.labels(spark, str(tmp_path / "none")) == []


def test_logger_rule(spark):
    bodies = [
        ("ok", "\n  // starts\n  logger.enter('a');\n  try { f(); } finally { logger.exit('a'); }\n"), ("late", "f(); logger.enter(1); try {} finally { logger.exit(1) }"), ("open", "logger.enter(1); try { logger.exit(1) } catch {}"), ("arrow", None),
        ("py", '\n    """Doc."""\n    logger.enter(1)\n    try:\n        f()\n    finally:\n        logger.exit(1)\n'), ("other", "mylogger.enter(1); try {} finally { logger.exit(1) }"),
    ]
    f = spark.createDataFrame([("f", n, b) for n, b in bodies], "file string, name string, body string")
    assert sorted(r["message"].split("'")[1] for r in rules.logger_enter_exit(f).collect()) == ["arrow", "late", "open", "other"]


def test_cycles_left_out_are_told(spark):
    m = spark.createDataFrame([(2 * k + j, 2 * k) for k in range(5) for j in range(2)], "id int, cycle int")
    got = [(r["file"], r["message"]) for r in rules.no_cycles(m, most=3).collect()]
    assert (None, "2 more cycles") in got and len(got) == 4 and len(rules.no_cycles(m).collect()) == 5


def test_rule_options(spark):
    n = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "id string")
    e = spark.createDataFrame([("/a", "/b")], "src string, dst string")
    dead = lambda **k: [r["file"] for r in rules.dead_module(n, e, **k).orderBy("file").collect()]
    assert dead(entry_globs=["/a"]) == ["/c"] and dead(entry_globs=["/a"], ignore=["/c"]) == [] and dead(entry_globs=["/z"]) == []
    x = spark.createDataFrame([("f", True), ("f", False), ("g", False)], "file string, is_default boolean")
    assert [r["file"] for r in rules.no_mixed_exports(x, "default").orderBy("file").collect()] == ["f", "g"] and [r["file"] for r in rules.no_mixed_exports(x, "named").collect()] == ["f"]
    used = spark.createDataFrame([("q", "f", "a"), ("f", "f", "b")], "file string, target string, name string")
    s = spark.createDataFrame([("f", "a"), ("f", "b")], "file string, name string")
    none = spark.createDataFrame([], "file string, exported_name string")
    assert [r["message"] for r in rules.not_exported(used, s, none).collect()] == ["'a' is imported but not exported"]
    layers = rules.layer_of(spark.createDataFrame([("/x/y",), ("/z",)], "file string"), {"p": ["/x/*"], "q": ["/*/y"]})
    assert [r["file"] for r in rules.ambiguous_layers(layers).collect()] == ["/x/y"]


def test_incremental_steps(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file string, x int")
    f = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    assert rows(versions.apply_delta(store, spark.createDataFrame([("b", 9)], store.schema), f("c")), "file", "x") == [("a", 1), ("b", 9)]
    assert rows(versions.invalidated(store, f("a", "z")), "file") == [("b",), ("c",)] and versions.invalidated(store).count() == 0
    assert versions.checked_generation(store, 1, "x").limit(0).count() == 0
    with pytest.raises(Exception, match="generation"):
        versions.checked_generation(store, 1, "x").collect()
    q = spark.createDataFrame([(1, "k", "low", 1), (2, "k", "highest", 3), (3, "k", "medium", 2), (4, "k", None, 1)], "request_id int, queue string, priority string, arrived int")
    assert [r["request_id"] for r in versions.queued(q).orderBy("place").collect()] == [2, 4, 3, 1]


def test_stream_state_in_parts(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(n, k if n % 2 else -k, k) for n in range(60)], "id int, version int, batch int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = versions.keep_newest(versions.stream(spark, str(tmp_path / "in"), 1), ["id"], [F.col("version")])
    assert {(r["id"], r["version"]) for r in out.collect()} == {(n, 2 if n % 2 else 0) for n in range(60)}


def test_value_percentiles_of_a_hot_key(spark):
    import numpy as np

    rng = random.Random(6)
    data = [("hot", float(rng.randrange(500))) for _ in range(4000)] + [("b", 1.0), ("b", 2.0), ("n", None)]
    w = skew.weighted_values(spark.createDataFrame(data, "k string, v double"), "k", "v")
    got = {r["key_value"]: (r["p25"], r["p50"], r["p99"]) for r in skew.value_percentiles(w, (0.25, 0.5, 0.99)).collect()}
    assert np.allclose(got["hot"], np.percentile([v for k, v in data if k == "hot"], [25, 50, 99])) and got["b"] == (1.25, 1.5, 1.99) and got["n"] == (None, None, None)
    assert skew.value_percentiles(w.limit(0), (0.5,)).count() == 0


def test_text_positions(spark):
    s = "aé→\n𝄞b"
    df = spark.createDataFrame([(k,) for k in range(len(s) + 1)], "o int").withColumn("s", F.lit(s))
    for r in df.select("o", T.utf8_offset(F.col("s"), F.col("o")).alias("b"), T.offset_of_utf8(F.col("s"), T.utf8_offset(F.col("s"), F.col("o"))).alias("back")).collect():
        assert r["b"] == len(s[: r["o"]].encode()) and r["back"] == r["o"]
    at = lambda line, col: df.limit(1).select(T.offset_at(F.col("s"), F.lit(line), F.lit(col)).alias("x")).first()["x"]
    assert (at(1, 1), at(2, 1), at(2, 3), at(2, 4), at(3, 1), at(0, 1)) == (0, 4, 6, None, None, None)
    one = spark.createDataFrame([("dist/a.js", "apiKey", "v" * 600), ("./dist/b/c.d.ts", "source", "xyz"), ("lib/x.mjs", "name", "w" * 600)], "p string, k string, v string")
    assert [r[0] for r in one.select(T.dist_to_source(F.col("p"))).collect()] == ["src/a.ts", "./src/b/c.ts", "lib/x.ts"]
    assert [r[0] for r in one.select(T.redacted(F.col("k"), F.col("v"), True)).collect()] == ["[secret]", "[3 characters]", "w" * 512 + "..."]


def test_pretty_groups(spark):
    v = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z")], "file string, message string")
    assert rows(grouped(v), "file", "messages", "n") == [("a", "x\ny", 2), ("b", "z", 1)]
