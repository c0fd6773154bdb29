import sys

from loomgraph.operators import graph, resolve, summary
from loomgraph.sources import plugins

R = "struct<start:int,end:int>"
X = "file string, exported_name string, symbol_id string, source_file string, source_name string"


def test_export_closure(spark):
    rows = [
        ("a", "x", "ax", None, None), ("a", "default", "ad", None, None), ("b", "*", "", "a", "*"), ("c", "y", "", "b", "x"), ("c", "ns", "", "a", "*"),
        ("d", "*", "", "c", "*"), ("d", "y", "dy", None, None), ("p", "*", "", "q", "*"), ("q", "*", "", "p", "*"), ("q", "z", "qz", None, None), ("e", "n", "", "gone", "n"),
    ]
    got = {(r["file"], r["exported_name"]): r["symbol_id"] or r["ns_path"] for r in resolve.export_map(spark.createDataFrame(rows, X)).collect()}
    assert got == {("a", "x"): "ax", ("a", "default"): "ad", ("b", "x"): "ax", ("c", "y"): "ax", ("c", "ns"): "a", ("d", "y"): "dy", ("d", "ns"): "a", ("p", "z"): "qz", ("q", "z"): "qz"}


def test_rewrites(spark):
    exported = spark.createDataFrame([("/m", "run", "m1", None), ("/m", "default", "m2", None), ("/m", "sub", None, "/n"), ("/n", "go", "n1", None)], "file string, exported_name string, symbol_id string, ns_path string")
    b = spark.createDataFrame([("l1", "run", "/m", False, False), ("l2", None, "/m", True, False), ("l3", None, "/n", False, True), ("l4", "sub", "/m", False, False), ("l5", "none", "/m", False, False)], "local_symbol_id string, imported_name string, path string, is_default boolean, is_namespace boolean")
    bound = resolve.resolve_bindings(b, exported)
    assert {r["local_symbol_id"]: (r["export_id"], r["ns_path"]) for r in bound.collect()} == {"l1": ("m1", None), "l2": ("m2", None), "l3": (None, "/n"), "l4": (None, "/n"), "l5": (None, None)}
    refs = spark.createDataFrame([("run", "l1"), ("ns.go", "l3"), ("sub.go", "l4"), ("own", "o1"), ("free", None)], "name string, symbol_id string")
    assert {r["name"]: r["symbol_id"] for r in resolve.rewrite_references(refs, bound, exported).collect()} == {"run": "m1", "ns.go": "n1", "sub.go": "n1", "own": "o1", "free": None}
    calls = spark.createDataFrame([("f", "run", None), ("f", "own", "o1"), ("f", "a.run", None), ("g", "run", None)], "file string, callee_name string, symbol_id string")
    locals_ = spark.createDataFrame([("f", "run", 5, "l2"), ("f", "run", 3, "l1")], "file string, local_name string, start int, local_symbol_id string")
    assert {(r["file"], r["callee_name"]): r["symbol_id"] for r in resolve.rewrite_calls(calls, locals_, bound).collect()} == {("f", "run"): "m1", ("f", "own"): "o1", ("f", "a.run"): None, ("g", "run"): None}
    types = spark.createDataFrame([("c", "l1"), ("d", None), ("e", "o")], "symbol_id string, target_id string")
    assert {r["symbol_id"]: r["target_id"] for r in resolve.rewrite_types(types, bound).collect()} == {"c": "m1", "d": None, "e": "o"}


def test_callers_and_callees(spark):
    s = spark.createDataFrame([("out", "function", "f", (0, 100)), ("in", "function", "f", (10, 50)), ("c", "class", "f", (0, 200))], f"id string, kind string, file string, range {R}")
    calls = spark.createDataFrame([("f", (20, 25), "t"), ("f", (60, 65), "t"), ("f", (150, 155), "t"), ("f", (21, 22), None)], f"file string, range {R}, symbol_id string")
    scopes = spark.createDataFrame([], "id string")
    assert sorted(r["caller_id"] for r in resolve.callers(calls, s, scopes).collect()) == ["in", "out"]
    assert sorted(r["id"] for r in resolve.callees(calls, s).collect()) == ["in", "out"]


def test_types(spark):
    e = spark.createDataFrame([("a", "b", "structural"), ("a", "b", None), ("c", "d", "structural"), ("e", "f", "type-aware"), ("e", "f", "declared")], "src string, dst string, confidence string")
    kinds = lambda x: {(r["src"], r["dst"]): r["confidence"] for r in resolve.type_edges(e, x).collect()}
    assert kinds(None) == {("a", "b"): "declared", ("c", "d"): "structural", ("e", "f"): "type-aware"}
    assert set(kinds("structural")) == {("c", "d"), ("e", "f")}
    rel = spark.createDataFrame([("x", "T", "t1", None), ("y", "T", None, "declared"), ("z", "T", "t2", None), ("s", "Q", "t1", "structural")], "symbol_id string, target_name string, target_id string, confidence string")
    assert [r["symbol_id"] for r in resolve.sub_types(rel, "T", "t1").collect()] == ["x", "y"]
    assert [r["symbol_id"] for r in resolve.sub_types(rel, "T", "t1", True).collect()] == ["s", "x", "y"]


def test_usage_and_unused(spark):
    refs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 11), ("d", 4), (None, 1), ("p2", 1)], "symbol_id string, usage int")
    u = resolve.usage_facts(refs)
    assert {r["symbol_id"]: r["used"] for r in u.collect()} == {"a": True, "b": False, "c": False, "d": True, "p2": True}
    b = "struct<parameter_index:int>"
    s = spark.createDataFrame([("a", "variable", "a", "f", 0, None), ("b", "variable", "b", "f", 0, None), ("e", "function", "e", "f", 1, None), ("i", "variable", "_i", "f", 0, None), ("p1", "parameter", "p1", "f", 0, (0,)), ("p2", "parameter", "p2", "f", 0, (1,)), ("p3", "parameter", "p3", "f", 0, (2,))], f"id string, kind string, name string, file string, flags int, binding {b}")
    ids = lambda a: sorted(r["id"] for r in resolve.unused_symbols(s, u, a).collect())
    assert ids("after-used") == ["b", "p3"] and ids("all") == ["b", "p1", "p3"] and ids("none") == ["b"]


def test_summaries(spark):
    n = spark.createDataFrame([(c,) for c in "abcde"], "id string")
    e = spark.createDataFrame([("c", "a"), ("a", "b"), ("b", "a"), ("b", "d")], "src string, dst string")
    m = graph.components(e)
    r = summary.architecture(n, e, m).first()
    assert (r["modules"], r["edges"], r["entries"], r["cycles"], r["in_cycles"], r["largest_cycle"], r["longest_chain"]) == (5, 4, 2, 1, 2, 2, 2)
    seed = spark.createDataFrame([("d",)], "id string")
    got = {x["id"]: (x["depth"], x["cycle"]) for x in summary.impact(e, n, m, seed).collect()}
    assert got == {"d": (0, None), "b": (1, "a"), "a": (2, "a"), "c": (3, None)}
    assert {x["cycle"] for x in summary.impact(e, n, m, seed, "up", 1).collect()} == {None}
    assert {x["id"]: (x["entry"], x["in_cycle"]) for x in summary.profiles(n, e, m).collect()}["e"] == (True, False)
    paths = spark.createDataFrame([("src/a.ts",), ("src/a.test.ts",), ("tests/x.ts",), ("p/test_x.py",)], "id string")
    assert [x["id"] for x in summary.without_tests(paths).collect()] == ["src/a.ts"]
    package = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("d", "q")], "id string, package string")
    assert sorted((x["src"], x["dst"]) for x in summary.filter_edges(e, None, package).collect()) == [("b", "d"), ("c", "a")]


def test_search_puts_symbols_first(spark):
    mods = spark.createDataFrame([("lib/run.ts",), ("x.ts",)], "file string")
    syms = spark.createDataFrame([("runner", "lib/run.ts", 1), ("run", "q.ts", 0)], "name string, file string, flags int")
    got = [(r["what"], r["path"], r["score"]) for r in summary.search(mods, syms, "run").collect()]
    assert got == [("symbol", "lib/run.ts", 110), ("module", "lib/run.ts", 80)]


def test_plugins(spark, tmp_path):
    script = tmp_path / "plugin.py"
    script.write_text("import json, sys, time\nq = json.load(sys.stdin)\nif q['source'] == 'slow': time.sleep(5)\nif q['source'] == 'fail': sys.exit(3)\nif q['source'] == 'text': print('no'); sys.exit()\nprint(json.dumps({'violations': [{'message': 'm', 'line': len(q['source'])}]}))\n")
    s = spark.createDataFrame([("a", "xx"), ("b", "fail"), ("c", "text"), ("d", "slow")], "file string, source string")
    got = {r["file"]: (r["line"], r["error"]) for r in plugins.check(s, [sys.executable, str(script)], "r", 2).collect()}
    assert got == {"a": (2, None), "b": (None, "the plugin ended with 3"), "c": (None, "the plugin's answer is not JSON"), "d": (None, "the plugin took too long")}
