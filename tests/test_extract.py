from pyspark.sql import functions as F

from loomgraph.sources import extract

SOURCE = '''﻿"""é"""
import os.path as p, sys
from .a import b as c, d
from .star import *
TOP = 1

class Base: pass

class K(Base, p.X):
    x: int = 1
    _hidden = 2
    def run(self, a, b=TOP):
        for i in a:
            if i: continue
            break
        while True:
            try:
                return helper(i)
            except ValueError:
                raise
        TOP2 = 3
    @staticmethod
    async def stat(q): return sorted(q, key=helper)

def helper(x):
    x += 1
    return map(helper, x)
'''


def test_facts(spark):
    df = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def f(:"), ("c.py", ""), ("d.ts", "x"), ("e.py", None)], "file string, source string")
    t = extract.extract(df)
    rows = lambda n: [r for r in t[n].collect() if r["file"] == "a.py"]
    assert [r["file"] for r in t["errors"].collect()] == ["b.py"]
    by = {r["name"]: r for r in rows("symbols") if r["kind"] in ("function", "method", "class")}
    assert {n: r["kind"] for n, r in by.items()} == {"Base": "class", "K": "class", "run": "method", "stat": "method", "helper": "function"}
    for n, r in by.items():
        assert SOURCE[r["range"]["start"] :].startswith(("class " + n, "def " + n, "async def " + n)), n
    assert by["helper"]["flags"] & extract.EXPORTED and by["stat"]["flags"] & extract.STATIC and by["stat"]["flags"] & extract.ASYNC
    assert {(r["module_spec"], r["imported_name"], r["is_namespace"]) for r in rows("import_bindings")} == {("os.path", None, True), ("sys", None, True), (".a", "b", False), (".a", "d", False)}
    assert {r["spec"] for r in rows("imports")} == {"os.path", "sys", ".a", ".star"}
    assert {(r["target_name"], r["target_id"] == by["Base"]["id"]) for r in rows("type_relations")} == {("Base", True), ("p.X", False)}
    calls = {r["callee_name"]: r["symbol_id"] for r in rows("calls")}
    assert calls["helper"] == by["helper"]["id"] and calls["map"] is None
    shape = {r["owner_symbol_id"]: r["members"] for r in rows("member_shapes")}[by["K"]["id"]]
    assert [(m["name"], m["param_arity"], m["is_static"]) for m in shape] == [("run", 2, False), ("stat", 1, True), ("x", None, False)]
    assert [r["argument_index"] for r in rows("symbol_flows")] == [0]
    refs = {(r["name"], r["usage"]) for r in rows("references") if r["symbol_id"]}
    assert ("TOP", 1) in refs and ("x", 11) in refs
    found = {r["scope_id"]: r["complexity"] for r in extract.complexity(t["cfg_nodes"], t["cfg_edges"]).collect()}
    scope = {r["range"]["start"]: r["id"] for r in rows("scopes") if r["kind"] == "function"}
    assert found[scope[by["helper"]["range"]["start"]]] == 1 and found[scope[by["run"]["range"]["start"]]] >= 3
    assert {r["file"] for r in t["scopes"].collect()} == {"a.py", "c.py", "d.ts"}


def test_scripts(spark):
    text = "import a, { b } from './x';\nimport 'side';\nexport * from \"y\";\nconst z = require('w');\nconst q = await import('dyn');\n  import no from 'indented';\nexport default async function run() {}\ninterface I {}\nexport const k = 1;\n"
    df = spark.createDataFrame([("a.ts", text), ("a.py", "import x")], "file string, source string")
    assert sorted((r["spec"], r["style"]) for r in extract.script_imports(df).collect()) == [("./x", "static"), ("dyn", "dynamic"), ("side", "side_effect"), ("w", "cjs"), ("y", "static")]
    got = {r["name"]: (r["kind"], r["exported"]) for r in extract.script_declarations(df).filter(F.col("kind") != "const").collect()}
    assert got == {"run": ("function", True), "I": ("interface", False)}
