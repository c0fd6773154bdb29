"""Facts of source files: one pass over the sources in Arrow batches, a row for each fact, split into tables.

Python is read with the interpreter's own parser, scripts by their tokens (``script_facts``); a script's imports and
declarations can also be read line by line in SQL (``script_imports``, ``script_declarations``). Offsets count characters. A file that can't be
parsed gives one row in ``errors`` and doesn't stop the others.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.tables import cut

RANGE = "struct<start:int,end:int>"
TABLES = {
    "scopes": f"id string, kind string, range {RANGE}, parent string",
    "symbols": f"id string, kind string, name string, range {RANGE}, scope_id string, flags int, parameter_index int",
    "references": f"scope_id string, name string, range {RANGE}, symbol_id string, usage int",
    "imports": f"spec string, range {RANGE}",
    "import_bindings": f"local_symbol_id string, imported_name string, module_spec string, is_namespace boolean, range {RANGE}",
    "exports": f"symbol_id string, exported_name string, range {RANGE}",
    "calls": f"scope_id string, callee_name string, range {RANGE}, symbol_id string",
    "type_relations": f"symbol_id string, target_name string, relation_kind string, target_id string, range {RANGE}",
    "member_shapes": "owner_symbol_id string, members array<struct<name:string,member_kind:string,param_arity:int,is_optional:boolean,is_static:boolean>>, truncated boolean",
    "symbol_flows": f"flowing_symbol_id string, owner_scope_id string, argument_index int, range {RANGE}",
    "cfg_nodes": "scope_id string, id int, kind string",
    "cfg_edges": "scope_id string, src int, dst int, label string",
    "errors": "message string, line int",
}
# Bits of a symbol's flags and of a reference's usage.
EXPORTED, ASYNC, STATIC = 1, 2, 4
READ, WRITE, BOTH = 1, 2, 8
MOST_MEMBERS = 64
PYTHON, SCRIPT = r"\.pyw?$", r"\.[cm]?[jt]sx?$"


def key(*parts: object) -> str:
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()[:24]


class _Flow:
    """The control-flow graph of one function body; unreachable statements have no nodes."""

    def __init__(self) -> None:
        self.nodes, self.edges = ["entry", "exit"], []

    def node(self, kind: str, sources: list[tuple[int, str]]) -> int:
        self.nodes.append(kind)
        self.edges += [(s, len(self.nodes) - 1, label) for s, label in sources]
        return len(self.nodes) - 1

    def body(self, statements: list[ast.stmt], ins: list, loops: list) -> list:
        for s in statements:
            if not ins:
                break
            ins = self.statement(s, ins, loops)
        return ins

    def statement(self, s: ast.stmt, ins: list, loops: list) -> list:
        if isinstance(s, ast.If):
            n = self.node("branch", ins)
            return self.body(s.body, [(n, "true")], loops) + (self.body(s.orelse, [(n, "false")], loops) if s.orelse else [(n, "false")])
        if isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            n = self.node("loop", ins)
            breaks: list = []
            for out in self.body(s.body, [(n, "true")], [*loops, (n, breaks)]):
                self.edges.append((out[0], n, "back"))
            endless = isinstance(s, ast.While) and isinstance(s.test, ast.Constant) and bool(s.test.value)
            return ([] if endless else self.body(s.orelse, [(n, "false")], loops)) + breaks
        if isinstance(s, (ast.Try, ast.TryStar)):
            outs = self.body(s.orelse, self.body(s.body, ins, loops), loops)
            for h in s.handlers:
                outs = outs + self.body(h.body, [(self.node("catch", ins), "")], loops)
            return self.body(s.finalbody, outs or ins, loops) if s.finalbody else outs
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return self.body(s.body, [(self.node("statement", ins), "")], loops)
        if isinstance(s, ast.Match):
            n, outs, whole = self.node("branch", ins), [], False
            for c in s.cases:
                outs = outs + self.body(c.body, [(n, "case")], loops)
                whole = whole or (c.guard is None and isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None)
            return outs + ([] if whole else [(n, "default")])
        n = self.node("statement", ins)
        if isinstance(s, (ast.Return, ast.Raise)):
            self.edges.append((n, 1, ""))
            return []
        if isinstance(s, ast.Break) and loops:
            loops[-1][1].append((n, ""))
            return []
        if isinstance(s, ast.Continue) and loops:
            self.edges.append((n, loops[-1][0], "back"))
            return []
        return [(n, "")]


class _Reader(ast.NodeVisitor):
    def __init__(self, file: str, source: str):
        self.file, self.facts = file, []
        self.lines = source.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.ascii = source.isascii()
        self.names: dict[str, dict[str, str]] = {}
        self.parents: dict[str, str | None] = {}
        self.kinds: dict[str, str] = {}
        self.later: list = []
        root = self.scope("file", None, (0, len(source)))
        self.stack = [root]
        self.root = root

    def at(self, line: int, col: int) -> int:
        return self.starts[line - 1] + (col if self.ascii else len(self.lines[line - 1].encode()[:col].decode("utf-8", "replace")))

    def range(self, n: ast.AST) -> dict:
        return {"start": self.at(n.lineno, n.col_offset), "end": self.at(n.end_lineno, n.end_col_offset)}

    def emit(self, table: str, **fact) -> None:
        self.facts.append((table, fact))

    def scope(self, kind: str, parent: str | None, span: tuple[int, int]) -> str:
        i = key("python", self.file, "scope:" + kind, *span)
        self.emit("scopes", id=i, kind=kind, range={"start": span[0], "end": span[1]}, parent=parent)
        self.names[i], self.parents[i], self.kinds[i] = {}, parent, kind
        return i

    def symbol(self, kind: str, name: str, span: dict, flags: int = 0, index: int | None = None) -> str:
        scope = self.stack[-1]
        i = key("python", self.file, kind, f"{scope}::{name}", span["start"])
        if kind not in ("variable", "field") or name not in self.names[scope]:
            if scope == self.root and not name.startswith("_"):
                flags |= EXPORTED
                self.emit("exports", symbol_id=i, exported_name=name, range=span)
            self.emit("symbols", id=i, kind=kind, name=name, range=span, scope_id=scope, flags=flags, parameter_index=index)
            self.names[scope].setdefault(name, i)
        return i

    def find(self, scope: str, name: str) -> str | None:
        at: str | None = scope
        while at is not None:
            if name in self.names[at] and (at == scope or self.kinds[at] != "class"):
                return self.names[at][name]
            at = self.parents[at]
        return None

    def function(self, n) -> None:
        inside = self.kinds[self.stack[-1]] == "class"
        static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in n.decorator_list)
        self.symbol("method" if inside else "function", n.name, self.range(n), (ASYNC if isinstance(n, ast.AsyncFunctionDef) else 0) | (STATIC if static else 0))
        for d in [*n.decorator_list, n.args, n.returns]:
            if d is not None and not isinstance(d, ast.arguments):
                self.visit(d)
        span = self.range(n)
        scope = self.scope("function", self.stack[-1], (span["start"], span["end"]))
        for default in [*n.args.defaults, *n.args.kw_defaults]:
            if default is not None:
                self.visit(default)
        self.stack.append(scope)
        for k, a in enumerate([*n.args.posonlyargs, *n.args.args, *([n.args.vararg] if n.args.vararg else []), *n.args.kwonlyargs, *([n.args.kwarg] if n.args.kwarg else [])]):
            self.symbol("parameter", a.arg, self.range(a), 0, k)
            if a.annotation:
                self.visit(a.annotation)
        for s in n.body:
            self.visit(s)
        self.stack.pop()
        flow = _Flow()
        flow.edges += [(s, 1, label) for s, label in flow.body(n.body, [(0, "")], [])]
        for k, kind in enumerate(flow.nodes):
            self.emit("cfg_nodes", scope_id=scope, id=k, kind=kind)
        for a, b, label in dict.fromkeys(flow.edges):
            self.emit("cfg_edges", scope_id=scope, src=a, dst=b, label=label)

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        i = self.symbol("class", n.name, self.range(n))
        for d in [*n.decorator_list, *n.bases, *n.keywords]:
            self.visit(d)
        for b in n.bases:
            name = ast.unparse(b) if isinstance(b, (ast.Name, ast.Attribute)) else None
            if name:
                self.later.append(("type", i, name, self.stack[-1], self.range(b)))
        span = self.range(n)
        self.stack.append(self.scope("class", self.stack[-1], (span["start"], span["end"])))
        members = []
        for s in n.body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) and not s.name.startswith("_"):
                static = any(isinstance(d, ast.Name) and d.id in ("staticmethod", "classmethod") for d in s.decorator_list)
                members.append({"name": s.name, "member_kind": "method", "param_arity": max(0, len(s.args.posonlyargs) + len(s.args.args) - (not static)), "is_optional": False, "is_static": static})
            for t in s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []:
                if isinstance(t, ast.Name) and not t.id.startswith("_"):
                    members.append({"name": t.id, "member_kind": "property", "param_arity": None, "is_optional": False, "is_static": False})
            self.visit(s)
        unique = {(m["name"], m["member_kind"], m["is_static"]): m for m in reversed(members)}
        kept = [unique[k] for k in sorted(unique)][:MOST_MEMBERS]
        self.emit("member_shapes", owner_symbol_id=i, members=kept, truncated=len(unique) > MOST_MEMBERS)
        self.stack.pop()

    def visit_Lambda(self, n: ast.Lambda) -> None:
        span = self.range(n)
        self.stack.append(self.scope("lambda", self.stack[-1], (span["start"], span["end"])))
        for k, a in enumerate([*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]):
            self.symbol("parameter", a.arg, self.range(a), 0, k)
        self.visit(n.body)
        self.stack.pop()

    def imported(self, n, module: str | None) -> None:
        for a in n.names:
            spec = a.name if module is None else module
            local = a.asname or (a.name.split(".")[0] if module is None else a.name)
            span = self.range(a)
            if a.name != "*":
                i = self.symbol("variable", local, span)
                self.emit("import_bindings", local_symbol_id=i, imported_name=None if module is None else a.name, module_spec=spec, is_namespace=module is None, range=span)
            if module is None:
                self.emit("imports", spec=spec, range=self.range(n))
        if module is not None:
            self.emit("imports", spec=module, range=self.range(n))

    def visit_Import(self, n: ast.Import) -> None:
        self.imported(n, None)

    def visit_ImportFrom(self, n: ast.ImportFrom) -> None:
        self.imported(n, "." * n.level + (n.module or ""))

    def visit_Name(self, n: ast.Name) -> None:
        span = self.range(n)
        if isinstance(n.ctx, ast.Store) and n.id not in self.names[self.stack[-1]]:
            self.symbol("field" if self.kinds[self.stack[-1]] == "class" else "variable", n.id, span)
        else:
            self.later.append(("ref", self.stack[-1], n.id, span, READ if isinstance(n.ctx, ast.Load) else WRITE))

    def visit_Attribute(self, n: ast.Attribute) -> None:
        parts, x = [], n
        while isinstance(x, ast.Attribute):
            parts.append(x.attr)
            x = x.value
        if isinstance(x, ast.Name):
            self.later.append(("ref", self.stack[-1], ".".join([x.id, *reversed(parts)]), self.range(n), READ if isinstance(n.ctx, ast.Load) else WRITE))
        self.visit(x)

    def visit_AugAssign(self, n: ast.AugAssign) -> None:
        if isinstance(n.target, ast.Name):
            self.later.append(("ref", self.stack[-1], n.target.id, self.range(n.target), READ | WRITE | BOTH))
        else:
            self.visit(n.target)
        self.visit(n.value)

    def visit_Call(self, n: ast.Call) -> None:
        if isinstance(n.func, (ast.Name, ast.Attribute)):
            name = ast.unparse(n.func)
            if name.replace(".", "").replace("_", "").isalnum():
                self.later.append(("call", self.stack[-1], name, self.range(n)))
        for k, a in enumerate(n.args):
            if isinstance(a, ast.Name):
                self.later.append(("flow", self.stack[-1], a.id, self.range(a), k))
        self.generic_visit(n)

    def finish(self) -> list:
        functions: dict[str, str] = {}
        kinds = {f["id"]: f["kind"] for t, f in self.facts if t == "symbols"}
        for t, f in self.facts:
            if t == "symbols" and f["kind"] in ("function", "method"):
                functions.setdefault(f["name"], f["id"])
        for what, *x in self.later:
            if what == "ref":
                self.emit("references", scope_id=x[0], name=x[1], range=x[2], symbol_id=self.find(x[0], x[1]), usage=x[3])
            elif what == "call":
                self.emit("calls", scope_id=x[0], callee_name=x[1], range=x[2], symbol_id=functions.get(x[1]))
            elif what == "type":
                self.emit("type_relations", symbol_id=x[0], target_name=x[1], relation_kind="extends", target_id=self.find(x[2], x[1]), range=x[3])
            else:
                i = self.find(x[0], x[1])
                if kinds.get(i) in ("function", "method"):
                    self.emit("symbol_flows", flowing_symbol_id=i, owner_scope_id=x[0], argument_index=x[3], range=x[2])
        return self.facts


def python_facts(file: str, source: str) -> list[tuple[str, dict]]:
    """(table, fact) of one Python file."""
    try:
        text = source.removeprefix("﻿")
        shift = len(source) - len(text)
        tree = ast.parse(text)
        reader = _Reader(file, text)
        reader.starts = [s + shift for s in reader.starts]
        reader.visit(tree)
        return reader.finish()
    except (SyntaxError, ValueError, RecursionError) as error:
        return [("errors", {"message": str(error)[:200], "line": getattr(error, "lineno", None)})]


def facts(sources: DataFrame) -> DataFrame:
    """``file, table, fact`` (JSON) of the Python and script files among ``file, source``."""
    from loomgraph.sources.script_facts import script_facts

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(f, t, json.dumps(x)) for f, s in zip(pdf.file, pdf.source) for t, x in (python_facts if re.search(PYTHON, f) else script_facts)(f, s)]
            yield pd.DataFrame(rows, columns=["file", "table", "fact"])

    return sources.filter(F.col("file").rlike(f"{PYTHON}|{SCRIPT}") & F.col("source").isNotNull()).select("file", "source").mapInPandas(run, "file string, table string, fact string")


def extract(sources: DataFrame) -> dict[str, DataFrame]:
    """All fact tables, each with ``file``; sources are read once."""
    found = cut(facts(sources))
    return {name: found.filter(F.col("table") == name).select("file", F.from_json("fact", schema).alias("f")).select("file", "f.*") for name, schema in TABLES.items()}


def complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``file, scope_id, complexity``: edges - nodes + 2 of each function's graph."""
    n = nodes.groupBy("file", "scope_id").agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy("file", "scope_id").agg(F.count(F.lit(1)).alias("e"))
    return n.join(e, ["file", "scope_id"], "left").select("file", "scope_id", (F.coalesce("e", F.lit(0)) - F.col("n") + 2).alias("complexity"))


def script_imports(sources: DataFrame) -> DataFrame:
    """``file, spec, style`` of scripts: static, re-export, side_effect, dynamic and cjs imports at the start of a line."""
    line = sources.filter(~F.col("file").rlike(r"\.pyw?$")).select("file", F.explode(F.split("source", r"\r?\n")).alias("line"))
    static = F.regexp_extract("line", r"""^(?:import|export)\b.*\bfrom\s+["']([^"']+)["']""", 1)
    bare = F.regexp_extract("line", r"""^import\s+["']([^"']+)["']""", 1)
    dynamic = F.regexp_extract("line", r"""\bimport\(\s*["']([^"']+)["']\s*\)""", 1)
    cjs = F.regexp_extract("line", r"""^(?:const|let|var)\b.*\brequire\(\s*["']([^"']+)["']\s*\)""", 1)
    spec = F.coalesce(*[F.nullif(c, F.lit("")) for c in (static, bare, dynamic, cjs)])
    style = F.when(static != "", "static").when(bare != "", "side_effect").when(dynamic != "", "dynamic").otherwise("cjs")
    return line.select("file", spec.alias("spec"), style.alias("style")).filter(F.col("spec").isNotNull())


def script_declarations(sources: DataFrame) -> DataFrame:
    """``file, line, kind, name, exported`` of declarations at the start of a script's lines."""
    pattern = r"^(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|type|enum|const|let|var)\s*\*?\s+([A-Za-z_$][\w$]*)"
    line = sources.filter(~F.col("file").rlike(r"\.pyw?$")).select("file", F.posexplode(F.split("source", "\n")).alias("at", "text"))
    part = lambda n: F.regexp_extract("text", pattern, n)
    return line.select("file", (F.col("at") + 1).alias("line"), part(2).alias("kind"), part(3).alias("name"), (part(1) != "").alias("exported")).filter(F.col("name") != "")
