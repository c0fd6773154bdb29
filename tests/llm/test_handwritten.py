import random

import pytest
from loomgraph.llm import handwritten as H

BODY = "\n".join(f"function f{c}(a) {{\n  const {c}x = a.{c}y + 1;\n  return {c}x.map((q) => q.{c}z);\n}}" for c in "abcdefghijklmnopqrst")


@pytest.mark.parametrize("text, why", [
    ("// Code generated by tool. DO NOT EDIT.\n", "generated"), ("/* @generated by x 1.2 */\n", "generated"), ("# Autogenerated on 2024-01-01 by t 1, do not modify.\n", "generated"), ("# AUTO-GENERATED FILE\n", "generated"),
    ("// Machine-written: regenerate with `x`, hand edits get overwritten.\n", "generated"), ("/*\n * This file was created automatically from a.idl; manual changes will be lost.\n */\n", "generated"), ("# Copyright 2020 The me authors.\n\n# <auto-written>\n", "generated"),
    ("/*! lib 1.2.3 */\n", "vendored"), ("// Bundled copy of lib 1.2.\n", "vendored"), ("# Taken from the lib project at revision abc.\n", "vendored"), ('"""(c) 2019 lib maintainers. Redistributed under the terms of its own license."""\n', "vendored"),
    ("// Copyright 2020 The me authors.\n// See LICENSE at the top of this repository.\n", None), ("// Writes files that start with 'Code generated, DO NOT EDIT'; this writer itself is kept by people.\n", None), ("# Unlike the minified bundle, this module stays readable.\n", None),
    ("// Do not edit the graph table while a session is open.\n", None), ("// The generated writer is never read back from here.\n", None), ("// First version came from a template, rewritten and kept by hand since 2023-01-07.\n", None), ("// Vendored packages are skipped before this step runs.\n", None), ('const h = "# AUTO-GENERATED FILE";\n', None),
    ("// This module parses files that were produced by a tool; do not edit the grammar by hand, run make\n", None), ("// Generated by swagger-codegen 3.0\n", "generated"), ("# kept by hand. Code generated by protoc. DO NOT EDIT.\n", "generated"),
    ("// Created by Jane Doe on 2020-01-01\n", None), ("# This file was automatically generated by SWIG.\n# Don't modify this file, modify the SWIG interface instead.\n", "generated"), ("// Tests for code generated by protoc\n", None), ("/* eslint-disable */\n// This file is generated. Do not touch.\n", "generated"),
    ("// Produced by the build from a.tmpl; your edits disappear with the next run.\n", "generated"), ("# Compiled from a.idl.\n# Run make to refresh it.\n", "generated"), ("# Derived from the base class.\n", None), ("// The parser is built from grammar.y; run make after you change it.\n", None),
])
def test_notices(text, why):
    assert H.said(H.remarks(text + BODY)) == why


@pytest.mark.parametrize("text, why", [
    (BODY + "\n// Code generated by tool. DO NOT EDIT.\n", "generated"), (BODY + "\n\n/**\n * @generated by x 1.2\n */", "generated"), ("import os\r\nx = os.y\r\n\r\n# <auto-written>\r\n", "generated"),
    ("import a from 'a';\n\n// Bundled copy of lib 1.2.\n// See its page.\n\n" + BODY, "vendored"), ("const q = /['`]/;\n// it's `one`\n" + BODY + "\n// producer: tool 1.2\n", "generated"),
    (BODY + "\n// Do not modify.\nconst t = 1;\n", None), ("def f():\n    return 1\n    # Never change it.\n", None), (BODY + "\nconst h = `\n// Code generated by tool. DO NOT EDIT.\n\n`;\n", None),
    ('x = """\n# AUTO-GENERATED FILE\n\n"""\n', None), (BODY + "\n// Files with '@generated' are skipped.\n", None),
])
def test_notices_below_the_head(text, why):
    assert H.said(H.remarks(text)) == why


def test_a_notice_at_the_end_is_found(spark):
    c, k = tables(spark)
    source = c.filter("context_id = 7").first()["source"] + "\n\n// Code generated by t. DO NOT EDIT.\n"
    c = c.union(spark.createDataFrame([(950, "/ws/r1/packages/p/src/e1.ts", source, 1)], c.schema))
    assert {r["context_id"]: r["reason"] for r in H.not_by_hand(c, k).collect()}.get(950) == "generated"


def test_shapes():
    rng = random.Random(1)
    assert H.shape("export const x = [" + ", ".join(hex(rng.randrange(256)) for _ in range(400)) + "];\n") == "data"
    assert H.shape("words = [\n" + "".join(f"  'w{k}',\n" for k in range(300)) + "]\n") == "data"
    assert H.shape("".join(f"function {chr(97 + k % 26)}(b,c){{return b?c[b]:c*{k}}}" for k in range(60))) == "minified"
    assert H.shape("".join(f"class A{k} {{\n  get_{k}() {{\n    return {k};\n  }}\n}}\n" for k in range(30))) == "generated"
    assert H.shape(BODY) is None and H.shape("") is None and H.shape("x = [1, 2, 3]\n" + BODY) is None
    assert H.shape(BODY + "\nconst p = /(" + "|".join(f"word-{k}" for k in range(80)) + ")/;\n") is None


def test_gram_scores_do_not_depend_on_the_batch():
    import numpy as np

    w = np.random.default_rng(0).normal(size=H.DIMS).astype(np.float32)
    texts = ["", "ab", "some text", "→é", "x" * 5000]
    assert np.allclose(H.score(texts, w, (3, 8)), [H.score([t], w, (3, 8))[0] for t in texts])
    assert all(np.isclose(H.score([t], w, (12,))[0], w[H.grams(t, (12,))].sum() / max(1, len(t.encode()) - 11) ** 0.5, atol=1e-4) for t in texts)


def tables(spark, extra=()):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    code = lambda: "\n".join(f"export function {word()}({word()}) {{\n  const {word()} = {word()}.{word()}({word()});\n  return {word()};\n}}" for _ in range(14))
    lib = [code() for _ in range(4)]
    rows = [(k, f"/ws/r{k % 9}/packages/p/src/f{k}.ts", code()) for k in range(120)]
    rows += [(200 + k, f"/ws/r{k}/packages/p/src/g{k}.ts", "// Code generated by t. DO NOT EDIT.\n" + code()) for k in range(12)]
    rows += [(300 + k, f"/ws/r{k}/packages/p/vendor/lib/v{k}.ts", code()) for k in range(9)]
    rows += [(400 + k, f"/ws/r{k}/packages/p/src/c{k}.ts", "// my own copy\n" + lib[k].replace("return", "return  ", 1)) for k in range(4)]
    c = spark.createDataFrame([*[(i, p, s, 1) for i, p, s in rows], *extra], "context_id long, file_path string, source string, reason int")
    k = spark.createDataFrame([(n, "1", f"a{n}.ts", s) for n, s in enumerate(lib)] + [(9, "1", "n.ts", None)], "lib_name int, lib_version string, rel_path string, source string")
    return c, k


def test_found(spark):
    extra = [(900, "/ws/r1/packages/p/src/g1.ts", "an older version by hand", 1), (901, None, "x", 1), (902, "/ws/r/packages/p/src/x.ts", None, 1), (903, "/ws/r/packages/p/vendor/lib/e.ts", "", 1), (200, "/ws/r0/packages/p/src/g0.ts", "// Code generated by t. DO NOT EDIT.\n", 1)]
    c, k = tables(spark, extra)
    got = {r["context_id"]: r["reason"] for r in H.not_by_hand(c, k).collect()}
    assert set(got) == {*range(200, 212), *range(300, 309), *range(400, 404), 900}
    assert got[205] == "generated" and got[303] == got[401] == "vendored"


def test_empty_tables(spark):
    c, k = tables(spark)
    assert H.not_by_hand(c.limit(0), k).count() == 0
    assert H.not_by_hand(c, k.limit(0)).count() == 12 + 9


def test_recall_is_of_held_out_repositories(spark):
    c, k = tables(spark)
    out = lambda r: H._stable(f"repo:r{r}") % 5 == 0
    fitted, held = next(r for r in range(99) if not out(r)), next(r for r in range(99) if out(r))
    sources = [r["source"] for r in c.filter("context_id < 40").orderBy("context_id").collect()]
    at = lambda n, r, source: (n, f"/ws/r{r}/packages/p/src/h{n}.ts", source, 1)
    rows = [at(n, fitted, ("// Code generated by t. DO NOT EDIT.\n" if n % 2 else "// my own\n") + x) for n, x in enumerate(sources)]
    alone = H.train(spark.createDataFrame(rows, c.schema), H.library_sources(k))
    assert [r[3] for r in alone.report] == [None, None, None]
    rows.append(at(99, held, "// my own my own my own my own\n// Code generated by t. DO NOT EDIT.\n" + sources[0]))
    report = H.train(spark.createDataFrame(rows, c.schema), H.library_sources(k)).report
    assert report[1][1] == 1 and report[1][3] is not None and report[0][3] is report[2][3] is None
