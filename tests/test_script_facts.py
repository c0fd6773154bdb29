import pytest
from pyspark.sql import functions as F

from loomgraph.sources import extract
from loomgraph.sources.script_facts import script_facts

SOURCE = '''import d, { a as b, type C } from "./m";
import * as ns from 'n';
import "side";
const fs = require("fs"), { x, y: z = 3 } = require('q');
export default class K<T> extends B.C<T> implements I, J {
  static #p: number = 1;
  @dec() private name?: string;
  constructor(private u: string, v = 2) { super(u); this.name = b(u, v); }
  async get<U>(k: U, ...r: any[]): Promise<U> { if (k) { return r[0]; } else if (u) { throw k } for (const q of r) { if (q) continue; ns.f(q).g(k); } return k; }
}
export interface I { m(a: number): void; n?: string }
export const arrow = async (p: C, { s, t: [w] }) => { let n = 0; n += p.size; n++; return `a${b(n)}c${w}`; };
export function* f(a) { switch (a) { case 1: return 1; default: break } try { g(a) } catch (e) { h(e) } finally { k() } while (true) { if (a) break } }
type A = { k: C } | I;
enum E { X = 1, Y }
export { arrow as other, K };
export * from "z"; export * as w2 from 'z2';
const o = { key: d, m(q) { return q }, get v() { return d }, [x]: y => y / 2 / 1 };
'''


def table(source, name):
    return [f for t, f in script_facts("a.ts", source) if t == name]


def test_symbols_and_scopes():
    got = {(f["kind"], f["name"]): f for f in table(SOURCE, "symbols")}
    wanted = {("class", "K"), ("interface", "I"), ("method", "get"), ("method", "constructor"), ("field", "#p"), ("field", "name"), ("function", "arrow"), ("function", "f"), ("type", "A"), ("enum", "E"), ("variable", "ns"), ("const", "z"), ("parameter", "w"), ("parameter", "e"), ("const", "o")}
    assert wanted <= set(got) and ("const", "y") not in got
    assert got["method", "get"]["flags"] & extract.ASYNC and got["field", "#p"]["flags"] & extract.STATIC and got["function", "arrow"]["flags"] & extract.EXPORTED and got["parameter", "v"]["parameter_index"] == 1
    a, z = got["function", "arrow"]["range"].values()
    assert SOURCE[a:z].startswith("arrow = async") and SOURCE[a:z].endswith("}")
    assert sorted({f["kind"] for f in table(SOURCE, "scopes")}) == ["class", "file", "function"]


def test_imports_and_exports():
    assert [f["spec"] for f in table(SOURCE, "imports")] == ["./m", "n", "side", "fs", "q", "z", "z2"]
    assert {(f["imported_name"], f["module_spec"], f["is_namespace"]) for f in table(SOURCE, "import_bindings")} == {("default", "./m", False), ("a", "./m", False), ("C", "./m", False), ("*", "n", True), (None, "fs", True), ("x", "q", False), ("z", "q", False)}
    ids = {f["name"]: f["id"] for f in table(SOURCE, "symbols")}
    exports = {f["exported_name"]: f["symbol_id"] for f in table(SOURCE, "exports")}
    assert exports == {"default": ids["K"], "I": ids["I"], "arrow": ids["arrow"], "f": ids["f"], "other": ids["arrow"], "K": ids["K"], "*": None, "w2": None}


def test_references_calls_types_and_shapes():
    calls = {f["callee_name"]: f["symbol_id"] for f in table(SOURCE, "calls")}
    assert set(calls) == {"require", "dec", "b", "ns.f", "g", "h", "k"} and not calls["b"] and not calls["ns.f"]
    assert table("function f() {} f();", "calls")[0]["symbol_id"]
    uses = {}
    for f in table(SOURCE, "references"):
        uses.setdefault(f["name"], set()).add(f["usage"])
    assert uses["n"] == {1, 11} and uses["C"] == {4} and uses["p.size"] == {1} and "key" not in uses and uses["U"] == {4}
    assert {(f["target_name"], f["relation_kind"], f["target_id"] is None) for f in table(SOURCE, "type_relations")} == {("B", "extends", True), ("I", "implements", False), ("J", "implements", True)}
    shape = next(f for f in table(SOURCE, "member_shapes") if len(f["members"]) == 2)
    assert shape["members"] == [{"name": "m", "member_kind": "method", "param_arity": 1, "is_optional": False, "is_static": False}, {"name": "n", "member_kind": "field", "param_arity": None, "is_optional": True, "is_static": False}]
    assert [f["argument_index"] for f in table("function a() {} function b() {} function f(c) { g(a, c, b); }", "symbol_flows")] == [0, 2]


def measure(body):
    facts = script_facts("a.ts", f"function f(a) {{ {body} }}")
    n, e = (sum(t == name for t, _ in facts) for name in ("cfg_nodes", "cfg_edges"))
    return e - n + 2


@pytest.mark.parametrize("body, wanted", [
    ("", 1), ("a; b", 1), ("if (a) b", 2), ("if (a) b; else c", 2), ("if (a) { b } else if (c) d; else e", 3), ("for (const x of a) b", 2), ("while (a) { if (b) break; else continue }", 3), ("do a(); while (b)", 2),
    ("switch (a) { case 1: b; break; case 2: c; default: d }", 3), ("try { a } catch { b }", 2), ("return 1; a; b", 1), ("while (true) { if (a) break }", 2), ("x: for (;;) { a }", 2),
])
def test_complexity(body, wanted):
    assert measure(body) == wanted


def test_odd_sources():
    assert [t for t, _ in script_facts("a.ts", "")] == ["scopes"]
    assert [t for t, _ in script_facts("a.ts", "f(")] == ["errors"] and [t for t, _ in script_facts("a.ts", "(]")] == ["errors"]
    for text in ("`${", "`a${b}`", "let", "export", "import", "class", "const {", "a =>", "function", "x = /[/]/g", "<a b='c'>it</a>", "}", "type A =", "@d class A {}", "for (;;", "interface", "enum E {", "async", "export default", "import {", "﻿a"):
        script_facts("a.tsx", text)


def test_extraction_of_both_languages(spark):
    df = spark.createDataFrame([("a.py", "def f(x):\n    return g(x)\n", 1), ("b.ts", "function f(x) { return g(x); }", 1), ("c.md", "f(", 1), ("d.js", None, 1), ("e.js", "(", 1)], "file string, source string, fact int")
    t = extract.extract(df)
    assert sorted((r["file"], r["name"]) for r in t["symbols"].filter(F.col("kind") == "function").collect()) == [("a.py", "f"), ("b.ts", "f")]
    assert sorted((r["file"], r["callee_name"]) for r in t["calls"].collect()) == [("a.py", "g"), ("b.ts", "g")]
    assert [r["file"] for r in t["errors"].collect()] == ["e.js"] and extract.extract(df.limit(0))["calls"].count() == 0
