import ast
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm.syntax.files import cost, diagnose, diagnosis, is_invalid

PY = '''from __future__ import annotations
import os, sys as s
from .a.b import (c, d as e,)
@dec.x(1)
async def f(a: int, /, b=2, *args, c: str = "x", **kw) -> list[int]:
    """doc"""
    async with open(a) as g, b: pass
    x: int = 3; y = z = [i for i in range(3) if i % 2]
    d = {"a": 1, **kw, 'b': lambda q, r=1: q}
    s = {1, 2}; t = (yield); u = a if b else c
    print(f"{x!r:>{y}} {a['k']} {{}}", *args, sep='', **kw)
    del x[1:2, ::3], y.z
    try:
        raise ValueError("x") from None
    except (A, B) as err:
        assert x, "y"
    else:
        return await g()
    finally:
        global q
    for i, (j, *k) in enumerate(a):
        if not i: continue
        elif (n := 3) > 2: break
        else: pass
    else: pass
    while True:
        x += 1
try: pass
except* C: pass
match x:
    case [1, *rest] if y:
        pass
    case {"a": b}: pass
    case _:
        pass
class C(B, metaclass=M):
    a = 1
'''
TS = '''import type { A } from "a";
import d, * as n from './b.js';
export { x as y, type Z } from "z";
export default abstract class K<T extends object = {}> extends B<T> implements I, J.K {
  @dec() private readonly a?: number = 1;
  static #b: Map<string, Array<number>> = new Map<string, Array<number>>();
  constructor(private x: string, y?: number, ...r: any[]) { super(); }
  get v(): number { return this.a! }
  async *gen<U>(this: K<T>, u: U): AsyncGenerator<U> { yield* u as any; }
  abstract m(): void;
  [key: string]: unknown;
}
interface I<T> extends J { (a: T): void; new (x: number): I<T>; readonly [k: string]: T; m?(x: T): asserts x is T }
type F = (a: number, b?: string) => a is string;
type M = { readonly [K in keyof T]?: T[K] } | typeof x | `a${string}` | [a: number, ...b: string[]];
type C = A extends B ? infer1 : never;
enum E { A = 1, B, "c" = "x" }
declare module "m" { export function f(x: number): void; }
function over(a: string): void;
function over(a: any): void { if (a) return; else for (const [k, v] of Object.entries(a)) { continue } }
const g = <T,>(x: T): x is any => x, h = async (y) => { await y; };
let re = /[/\\]]+/gi, t = `a${`b${c}`}d`, q = a?.b?.[0]?.(1) ?? 2;
label: do { x++ } while (x < 3)
switch (x) { case 1: case 2: { break } default: y = x satisfies T }
try { throw new Error(`x`) } catch { } finally { }
const o = { a, b: 1, [c]: 2, get d() { return 1 }, async e() {}, 'f'() {}, ...g };
for (let i = 0, n = 3; i < n; i++) ;
'''
JSX = "const x = (<div a='1' b={2} {...c}>\n  it's <b>{d}</b> {/* e */}\n  <></> <A.B/>\n</div>);\n"


@pytest.mark.parametrize("path, source", [
    ("a.py", PY), ("a.ts", TS.replace("for (let i = 0, n = 3; i < n; i++) ;\n", "")), ("a.tsx", JSX), ("a.js", "const a = 1\nlet b = a\n  .c()\nb++\nc.x\n"), ("a.js", ""), ("a.py", "\n \n"), ("a.py", "\ufeffx = 1"), ("a.js", "\ufeff#!/bin/node\nx"), ("a.ts", "let a = <any>b;"),
    ("a.js", "a\r\nb\r\n"), ("a.js", "export default async function* () {}"), ("a.py", "if x:\n\tpass\n"), ("a.py", "x = (\n  1,\n# c\n)\n"), ("a.js", "x = a / b / c; y = a\n/ 2"),
])
def test_valid(path, source):
    assert cost(path, source) == 0


@pytest.mark.parametrize("path, source", [
    ("a.py", "def f(:\n  pass"), ("a.py", "def f():\npass"), ("a.py", "x = 'abc"), ("a.py", "  x = 1\ny = 2"), ("a.py", 'x = """a'), ("a.py", "print 'x'"), ("a.py", "try:\n    x\n"), ("a.py", "f'{'"), ("a.py", "try:\n    x\nexcept A:\n    y\nexcept* B:\n    z\n"), ("a.py", "else:\n    x"), ("a.py", "if x:\n        a\n    b\n"),
    ("a.py", "<<<<<<< HEAD\nx = 1\n=======\n"), ("a.js", "let x: number = 1"), ("a.js", "interface A {}"), ("a.js", "class A { @d m() {} }"), ("a.js", JSX), ("a.ts", JSX), ("a.tsx", "let a = <any>b;"), ("a.tsx", "<a></b>"), ("a.ts", "/* x"), ("a.js", "`a${b"), ("a.js", "x = 'a\n'"),
    ("a.js", "f(1,,2)"), ("a.ts", "function f( { }"), ("a.js", "}"), ("a.js", "a b"), ("a.js", "=======\n"), ("a.py", TS), ("a.ts", PY), ("a.js", "# notes\n\nHow to do it:\n"), ("a.ts", "const x = ;"), ("a.js", "return x +"),
])
def test_invalid(path, source):
    assert cost(path, source) > 0


@pytest.mark.parametrize("path, source", [
    ("a.js", "if (a)\nb\nelse\nc"), ("a.js", "do\na++\nwhile (b)\nc"), ("a.js", "foo\nas\nof\nbar"), ("a.js", "i++\n(b)"), ("a.js", "do x++; while (y)\nz()"), ("a.js", "if (a) b; else if (c) d; else e"), ("a.js", "a\n`x`\nb"),
    ("a.tsx", "const f = <" + " " * 300 + "T ,>(x: T) => x"), ("a.tsx", "const f = </* a comment */ T, U>(x: T) => x"), ("a.js", "({a = 1} = x)"), ("a.js", "for ({a = 1} of x) b"),
    ("a.js", "const a = 1\nfunction f() {\n  return 1\n}\nclass B {\n a = 1\n b = 2\n c() {}\n}\nlet c = f()\n  .d()\n"), ("a.ts", "interface A {\n a: string\n b(): void\n}\ntype B = {\n a: 1\n}\nlet x = {\n a: 1 } as\n B"),
    ("a.js", "if (a)\n  if (b)\n    c\n" + "else\n  d\n" + "e\n" * 5), ("a.py", "def f(a, /, b=1, *c, d, e=2, **g): pass\nf(*a, b, c=1, *d, **e, f=2)\nlambda a, /, b=1, *c, d, **e: 1\nf(x for x in y)\n"),
    ("a.py", "x = 0x1F + 1_000 + 0 + 00 + 1e5 + .5j + 5. + 1_0.0_1e+1_0j\n"), ("a.py", "if x:\n\ty\n\tz\n"),
])
def test_line_ends_and_orders_that_are_valid(path, source):
    assert cost(path, source) == 0


@pytest.mark.parametrize("path, source", [
    ("a.py", "f(a=1, b)"), ("a.py", "def f(a=1, b): pass"), ("a.py", "def f(*): pass"), ("a.py", "f(**a, *b)"), ("a.py", "f(x for x in y, 1)"), ("a.py", "[*a for a in b]"), ("a.py", "x = 0777"), ("a.py", "x = 1__0"), ("a.py", "x = b'\u00e9'"),
    ("a.py", "if x:\n\ty\n        z\n"), ("a.js", "x = {a = 1}"), ("a.js", "if (a) else b"), ("a.js", "a\n+\n"),
])
def test_orders_and_forms_that_are_not(path, source):
    assert cost(path, source) > 0


def test_flagged_files_are_repaired_by_the_chart(monkeypatch):
    """A flag comes from a repair, not from a failed recognition."""
    from loomgraph.llm.syntax.chart import Grammar

    asked = []
    found = Grammar.repair
    monkeypatch.setattr(Grammar, "repair", lambda self, *a: asked.append(a) or found(self, *a))
    for path, source in [("a.js", "const a = ;"), ("a.ts", "function f() { let x = 1 +"), ("a.py", "def f(:\n  pass"), ("a.tsx", "x = <a>{b +}</a>"), ("a.py", "print 'x'")]:
        asked.clear()
        assert cost(path, source) > 0 and asked, source


def test_undefined_inputs():
    assert cost(None, "x") is None and cost("a.py", None) is None and cost("a.md", "x") is None and cost("noext", "x") is None


def test_python_agrees_with_the_interpreter():
    """Random cuts, deletions and swaps of lines and characters: the charts flag what the interpreter's parser flags."""
    rng, wrong = random.Random(1), []
    for _ in range(300):
        lines = PY.split("\n")
        kind = rng.randrange(3)
        if kind == 0:
            source = PY[: rng.randrange(len(PY))]
        elif kind == 1:
            k = rng.randrange(len(lines))
            source = "\n".join(lines[:k] + lines[k + 1 :])
        else:
            k = rng.randrange(len(PY))
            source = PY[:k] + PY[k + 1 :]
        try:
            ast.parse(source)
            ok = True
        except SyntaxError:
            ok = False
        if (cost("a.py", source) == 0) != ok:
            wrong.append((ok, source))
    # left to name checks of the interpreter's parser: order of parameters, targets in parentheses and the like
    assert len(wrong) <= 6


def test_quick_reader_agrees_with_the_full_one():
    from loomgraph.llm.syntax.files import parser

    rng = random.Random(2)
    for path, source in (("py", PY), ("ts", TS)):
        p = parser(path)
        for _ in range(60):
            text = source[: rng.randrange(len(source))]
            if p.quick(text):
                full = p.fold(text)[1] if path == "ts" else len(p.lines(text, 0)[1])
                assert full == 0


def test_repair_costs_and_causes():
    assert diagnose("a.py", "x = (1\n")[:2] == (1, "truncation")
    assert diagnose("a.py", "a = 1\n<<<<<<< HEAD\nb = 2\n=======\nc = 3\n>>>>>>> x\nd = 4\n")[1] == "conflict"
    assert diagnose("a.ts", "def f(x):\n    return x\n")[1] == "mismatch"
    assert diagnose("a.py", "x = 1\n") == (0, None, None)
    assert diagnose("a.js", "const a = ;")[:2] == (1, "other")
    assert diagnose("a.js", "a = 1;\nb = f(\n")[1] == diagnose("a.js", "a = 1;\nb = ")[1] == diagnose("a.py", "x = 1\ndef f():\n")[1] == "truncation"
    assert diagnose("a.js", "let a = = 1;\nlet b = 2;\nlet c = 3;\nlet d = 4;\n")[0] == 1


def test_least_repair_against_brute_force():
    """The chart's cost equals the least edit distance to any derived string, over a small language."""
    from itertools import product

    from loomgraph.llm.syntax.chart import Grammar

    g = Grammar("S: ( S ) S | _\n", lambda c: {c})
    words = [w for n in range(0, 9) for w in map("".join, product("()", repeat=n)) if g.derives("S", w)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for n in range(0, 6):
        for w in map("".join, product("()", repeat=n)):
            assert g.repair("S", w) == min(distance(w, v) for v in words), w


def test_long_phrases_take_an_upper_bound_that_is_never_nothing():
    from loomgraph.llm.syntax.chart import SPAN_SYMBOLS, Grammar

    g = Grammar("S: ( S ) S | _\n", lambda c: {c})
    # of what no bracket matches, two of a kind can be made a pair by one edit
    for text, unmatched in (("()" * SPAN_SYMBOLS + "(" * 3, 3), (")" * 5 + "()" * SPAN_SYMBOLS, 5), ("(" + ")" * (SPAN_SYMBOLS + 6), SPAN_SYMBOLS + 5)):
        assert g.repair("S", text) >= -(-unmatched // 2)


def test_least_repair_is_exact_at_any_length():
    """Of brackets that nothing matches, one edit mends two of a kind."""
    from loomgraph.llm.syntax.chart import SPAN_SYMBOLS, Grammar

    g, rng = Grammar("S: ( S ) S | _\n", lambda c: {c}), random.Random(5)
    texts = ["(" + ")" * (SPAN_SYMBOLS + 6), "()" * SPAN_SYMBOLS + ")" * 3 + "(" * 3] + ["".join(rng.choices("()", k=n)) for n in (SPAN_SYMBOLS - 1, SPAN_SYMBOLS, SPAN_SYMBOLS + 1, 2 * SPAN_SYMBOLS)]
    for text in texts:
        opened = closed = 0
        for c in text:
            opened, closed = (opened + 1, closed) if c == "(" else (opened - 1, closed) if opened else (0, closed + 1)
        assert g.repair("S", text) == -(-opened // 2) + -(-closed // 2), text


def test_on_dataframes(spark):
    rows = [(1, "a.py", "x = 1", 0), (2, "a.py", "x =", 0), (3, None, "x =", 0), (4, "a.ts", None, 0), (5, "b.js", "", 0), (6, "b.js", "a;" * 20000, 0), (7, "b.js", "(" * 300, 0)]
    df = spark.createDataFrame(rows, "context_id long, file_path string, source string, cost int")
    assert sorted(r[0] for r in df.filter(is_invalid(F.col("file_path"), F.col("source"))).collect()) == [2, 7]
    got = {r["context_id"]: r["d"]["cost"] for r in df.withColumn("d", diagnosis(F.col("file_path"), F.col("source"))).collect()}
    assert got[1] == 0 and got[2] > 0 and got[3] is None and got[4] is None and got[6] == 0
    assert df.limit(0).filter(is_invalid(F.col("file_path"), F.col("source"))).count() == 0
