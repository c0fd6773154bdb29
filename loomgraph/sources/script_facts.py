"""Facts of a TypeScript or JavaScript source from one pass over its tokens.

Tokens are matched bracket to bracket, then read statement by statement; expressions are scanned for what they hold
(functions, classes, references, calls), not parsed. Text between JSX tags is read as tokens too. A source whose brackets
don't match gives one ``errors`` fact. Offsets count characters.
"""

from __future__ import annotations

import re

from loomgraph.sources.extract import ASYNC, BOTH, EXPORTED, MOST_MEMBERS, READ, STATIC, WRITE, _Flow, key

TYPE, DEFAULT = 4, "default"
TOKEN = re.compile(
    r"(?P<skip>[ \t\r\n\f\v ﻿  ]+|//[^\n]*|/\*[\s\S]*?\*/)|(?P<word>\#?[A-Za-z_$ª-￿][\w$ª-￿]*)|(?P<number>\d[\w.]*|\.\d\w*)"
    r"""|(?P<string>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<punct>=>|\.\.\.|\?\.(?!\d)|\?\?=?|\+\+|--|[=!]==?|[<>]=|&&=?|\|\|=?|\*\*=?|[-+*/%&|^]=|[\s\S])"""
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
CLOSER = {"(": ")", "[": "]", "{": "}"}
# The words of the languages that name nothing.
RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true
try typeof var void while with let yield await async of as is keyof infer readonly satisfies""".split()
)
PRIMITIVES = frozenset("any unknown never void string number boolean bigint symbol object null undefined true false this".split())
MODIFIERS = frozenset("public private protected readonly static abstract override declare async get set accessor".split())
CONTROL = frozenset("if for while switch catch with function return typeof await".split())
UPDATES = frozenset("+= -= *= /= %= &= |= ^= **= &&= ||= ??=".split())


class Unmatched(ValueError):
    pass


def tokenize(source: str) -> list[tuple[str, str, int, int]]:
    """``kind, text, start, end``; the expressions of a template follow it as bracketed operands."""
    out: list[tuple[str, str, int, int]] = []
    templates: list[tuple[int, int]] = []  # where a template began, and how many brackets are open in its expression
    at, depth = 0, 0
    text = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")

    def template(begin: int, at: int) -> int:
        end = text.match(source, at).end()
        if source.startswith("${", end):
            out.extend([("string", source[begin:end], begin, end), ("punct", "+", end, end), ("punct", "(", end, end + 2)])
            templates.append((begin, depth))
            return end + 2
        out.append(("string", source[begin : end + 1], begin, min(len(source), end + 1)))
        return end + 1

    while at < len(source):
        if source[at] == "`":
            at = template(at, at + 1)
            continue
        if source[at] == "}" and templates and templates[-1][1] == depth:
            templates.pop()
            out.extend([("punct", ")", at, at + 1), ("punct", "+", at + 1, at + 1)])
            at = template(at, at + 1)
            continue
        last = out[-1] if out else ("punct", ";", 0, 0)
        if source[at] == "/" and last[0] == "punct" and last[1] not in ")]}" or source[at] == "/" and last[1] in ("return", "typeof", "case"):
            m = REGEX.match(source, at)
            if m:
                out.append(("string", m[0], at, m.end()))
                at = m.end()
                continue
        m = TOKEN.match(source, at)
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0], at, m.end()))
            if m.lastgroup == "punct":
                depth += (m[0] == "{") - (m[0] == "}")
        at = m.end()
    return out


class _Reader:
    def __init__(self, file: str, source: str):
        self.file, self.source, self.facts = file, source, []
        self.t = tokenize(source)
        self.match = self._brackets()
        self.names: dict[str, dict[str, tuple[str, int]]] = {}
        self.parent: dict[str, str | None] = {}
        self.pending: list[tuple[str, dict]] = []

    def _brackets(self) -> dict[int, int]:
        out, stack = {}, []
        for k, (kind, text, _, _) in enumerate(self.t):
            if kind == "punct" and text in "([{":
                stack.append(k)
            elif kind == "punct" and text in ")]}":
                if not stack or CLOSER[self.t[stack[-1]][1]] != text:
                    raise Unmatched(f"unmatched {text}")
                out[stack.pop()] = k
        if stack:
            raise Unmatched(f"unmatched {self.t[stack[-1]][1]}")
        return out

    # -- small helpers -----------------------------------------------------------------------------------

    def text(self, k: int) -> str:
        return self.t[k][1] if 0 <= k < len(self.t) else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k][0] == "word"

    def span(self, a: int, b: int) -> dict:
        return {"start": self.t[a][2], "end": self.t[b][3]}

    def put(self, table: str, **fact) -> None:
        self.facts.append((table, fact))

    def scope(self, kind: str, a: int, b: int, parent: str | None) -> str:
        id_ = key(self.file, "scope", kind, a)
        self.names[id_], self.parent[id_] = {}, parent
        r = {"start": 0, "end": len(self.source)} if parent is None else self.span(a, b)
        self.put("scopes", id=id_, kind=kind, range=r, parent=parent)
        return id_

    def symbol(self, kind: str, at: int, a: int, b: int, scope: str, flags: int = 0, index: int | None = None) -> str:
        name = self.text(at)
        id_ = key(self.file, scope, name, at)
        self.names[scope].setdefault(name, (id_, self.t[at][2]))
        self.put("symbols", id=id_, kind=kind, name=name, range=self.span(a, b), scope_id=scope, flags=flags, parameter_index=index)
        if flags & EXPORTED:
            self.put("exports", symbol_id=id_, exported_name=name, range=self.span(at, at))
        return id_

    def angle(self, k: int) -> int:
        """The place after type arguments or parameters at ``<``, or ``k`` if it opens none."""
        depth, at = 0, k
        while at < len(self.t):
            x = self.text(at)
            if x in "([{" and at in self.match:
                at = self.match[at]
            elif x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return at + 1
            elif x in (";", ")", "]", "}", "&&", "||"):
                return k
            at += 1
        return k

    def end(self, k: int, j: int, stops: tuple[str, ...] = (",", ";")) -> int:
        """Where the expression or type that begins at ``k`` ends: before a stop, a closing bracket or a line end that no operator spans."""
        begun = k
        while k < j:
            x = self.text(k)
            if x in stops or x in (")", "]", "}"):
                return k
            if k > begun and self.source.find("\n", self.t[k - 1][3], self.t[k][2]) >= 0:
                before = self.t[k - 1]
                joins = before[0] == "punct" and before[1] not in ")]}>" or before[1] in ("new", "typeof", "await", "return", "in", "of", "extends")
                if not joins and (self.t[k][0] != "punct" or x in ("{", "@", "++", "--")) and x not in ("in", "instanceof", "of", "as", "satisfies", "extends"):
                    return k
            k = self.match[k] + 1 if k in self.match else k + 1
        return j

    def arrow(self, k: int) -> int:
        """The ``=>`` of an arrow function whose parameters begin at ``k``, or -1."""
        if self.is_word(k):
            return k + 1 if self.text(k + 1) == "=>" else -1
        at = self.match[k] + 1
        if self.text(at) == "=>":
            return at
        if self.text(at) == ":" and self.text(k - 1) != "?":
            at += 1
            while at < len(self.t) and (self.t[at][0] in ("word", "string") or self.text(at) in (".", "|", "&", "<", ">", ",", "[", "{", "(")):
                at = self.match[at] + 1 if at in self.match else at + 1
            return at if self.text(at) == "=>" else -1
        return -1

    # -- declarations ------------------------------------------------------------------------------------

    def types(self, k: int, j: int, scope: str) -> None:
        for at in range(k, j):
            x = self.text(at)
            if self.is_word(at) and x not in RESERVED and x not in PRIMITIVES and self.text(at - 1) != "." and not (self.text(at + 1) in (":", "?") and self.text(at - 1) in ("{", "(", ",", ";")):
                self.pending.append(("references", {"scope_id": scope, "name": x, "range": self.span(at, at), "usage": TYPE}))

    def pattern(self, k: int, j: int, found: list[int], scope: str) -> int:
        """Collects the names that a binding target declares; the place after it."""
        if k not in self.match:
            found.append(k)
            return k + 1
        close, at = self.match[k], k + 1
        while at < close:
            if self.text(at) in (",", "..."):
                at += 1
                continue
            if self.text(k) == "{" and self.text(at + 1) == ":" or self.text(at) == "[" and self.text(k) == "{":
                at = (self.match[at] if at in self.match else at) + 2
            at = self.pattern(at, close, found, scope)
            if self.text(at) == "=":
                stop = self.end(at + 1, close)
                self.scan(at + 1, stop, scope)
                at = stop
        return close + 1

    def parameters(self, k: int, scope: str) -> int:
        """Declares the parameters between brackets at ``k``; their number."""
        close, at, n = self.match[k], k + 1, 0
        while at < close:
            begun = at
            while self.text(at) == "@":
                at += 2
                at = self.match[at] + 1 if at in self.match else at
            while self.text(at) in MODIFIERS and (self.is_word(at + 1) or self.text(at + 1) in "[{"):
                at += 1
            at += self.text(at) == "..."
            names: list[int] = []
            if self.text(at) != "this":
                at = self.pattern(at, close, names, scope)
            else:
                at += 1
            at += self.text(at) == "?"
            if self.text(at) == ":":
                stop = self.end_of_type(at + 1, close)
                self.types(at + 1, stop, scope)
                at = stop
            if self.text(at) == "=":
                stop = self.end(at + 1, close)
                self.scan(at + 1, stop, scope)
                at = stop
            for x in names:
                self.symbol("parameter", x, begun if len(names) == 1 else x, max(x, at - 1) if len(names) == 1 else x, scope, 0, n)
            n += 1
            at = max(at, begun + 1)
            at += self.text(at) == ","
        return n

    def end_of_type(self, k: int, j: int) -> int:
        at = k
        while at < j:
            x = self.text(at)
            if x == "<":
                at = max(self.angle(at), at + 1)
                continue
            if x in (",", "=", ";", ")", "]", "}"):
                return at
            if at > k and x == "{" and self.text(at - 1) not in ("|", "&", ":", "=>", "<", ","):
                return at
            if at > k and self.source.find("\n", self.t[at - 1][3], self.t[at][2]) >= 0 and x not in ("|", "&", "=>", ".") and self.text(at - 1) not in ("|", "&", "=>", ":", "."):
                return at
            at = self.match[at] + 1 if at in self.match else at + 1
        return j

    def function(self, k: int, j: int, outer: str) -> tuple[int, int]:
        """Reads parameters (at ``k``, perhaps after type parameters), return type and body; the place after and the number of parameters."""
        if self.text(k) == "<":
            k = self.angle(k)
        if self.text(k) != "(":
            return k, 0
        close = self.match[k]
        at = close + 1
        scope_end = at
        body = -1
        if self.text(at) == ":":
            at = self.end_of_type(at + 1, j)
        if self.text(at) == "{":
            body, scope_end = at, self.match[at]
        scope = self.scope("function", k, min(scope_end, len(self.t) - 1) if body >= 0 else close, outer)
        n = self.parameters(k, scope)
        if self.text(close + 1) == ":":
            self.types(close + 2, at, scope)
        if body >= 0:
            self.scan(body + 1, scope_end, scope)
            self.flow(scope, body, scope_end)
            return scope_end + 1, n
        return at, n

    def arrow_function(self, k: int, sign: int, j: int, outer: str) -> int:
        body = sign + 1
        stop = self.match[body] + 1 if self.text(body) == "{" else self.end(body, j)
        scope = self.scope("function", k, max(body, stop - 1), outer)
        if k in self.match:
            self.parameters(k, scope)
            if self.text(self.match[k] + 1) == ":":
                self.types(self.match[k] + 2, sign, scope)
        else:
            self.symbol("parameter", k, k, k, scope, 0, 0)
        if self.text(body) == "{":
            self.scan(body + 1, stop - 1, scope)
            self.flow(scope, body, stop - 1)
        else:
            self.scan(body, stop, scope)
        return stop

    def members(self, k: int, scope: str, owner: str) -> None:
        """The members of a class or interface body at ``k``."""
        close, at, found = self.match[k], k + 1, []
        while at < close:
            begun, flags = at, 0
            if self.text(at) in (";", ","):
                at += 1
                continue
            if self.text(at) == "@":
                stop = at + 2
                while self.text(stop) == ".":
                    stop += 2
                stop = self.match[stop] + 1 if self.text(stop) == "(" else stop
                self.scan(at + 1, stop, scope)
                at = stop
                continue
            while self.text(at) in MODIFIERS and self.text(at + 1) not in ("(", ":", "=", ";", "?", "<", "}", ","):
                flags |= {"static": STATIC, "async": ASYNC}.get(self.text(at), 0)
                at += 1
            at += self.text(at) == "*"
            if self.text(at) == "{":  # a static block
                self.scan(at + 1, self.match[at], scope)
                at = self.match[at] + 1
                continue
            named = self.is_word(at) or self.t[at][0] in ("string", "number")
            place = at
            at = self.match[at] + 1 if at in self.match and not named else at + 1
            optional = self.text(at) in ("?", "!")
            at += optional
            optional = optional and self.text(at - 1) == "?"
            if self.text(at) in ("(", "<"):
                stop, arity = self.function(at, close, scope)
                kind = "method"
            else:
                stop, arity, kind = at, None, "field"
                if self.text(stop) == ":":
                    stop = self.end_of_type(at + 1, close)
                    self.types(at + 1, stop, scope)
                if self.text(stop) == "=":
                    more = self.end(stop + 1, close, (";",))
                    self.scan(stop + 1, more, scope)
                    stop = more
            stop = max(stop, at)
            if named:
                self.symbol(kind, place, begun if kind == "method" else place, max(place, stop - 1), scope, flags)
                found.append({"name": self.text(place).strip("\"'"), "member_kind": kind, "param_arity": arity, "is_optional": optional, "is_static": bool(flags & STATIC)})
            at = max(stop, begun + 1)
        found.sort(key=lambda m: (m["name"], m["member_kind"]))
        self.put("member_shapes", owner_symbol_id=owner, members=found[:MOST_MEMBERS], truncated=len(found) > MOST_MEMBERS)

    def classlike(self, k: int, j: int, scope: str, flags: int) -> int:
        """A class, interface or enum at its keyword; the place after it."""
        word, at = self.text(k), k + 1
        name = at if self.is_word(at) and self.text(at) not in ("extends", "implements") else -1
        at += name >= 0
        at = self.angle(at) if self.text(at) == "<" else at
        related: list[tuple[str, int]] = []
        kind = "extends"
        while at < j and self.text(at) != "{":
            if self.text(at) in ("extends", "implements"):
                kind = self.text(at)
            elif self.is_word(at) and self.text(at - 1) in ("extends", "implements", ","):
                related.append((kind, at))
                while self.text(at + 1) == ".":
                    at += 2
            at = self.angle(at) if self.text(at) == "<" and self.angle(at) > at else self.match[at] + 1 if at in self.match else at + 1
        if self.text(at) != "{":
            return k + 1
        stop = self.match[at]
        owner = self.symbol(word, name, k, stop, scope, flags) if name >= 0 else key(self.file, "anonymous", k)
        inner = self.scope("class", k, stop, scope)
        for kind, x in related:
            target = self.text(x)
            self.pending.append(("type_relations", {"symbol_id": owner, "target_name": target, "relation_kind": kind, "range": self.span(x, x), "scope_id": scope}))
            self.pending.append(("references", {"scope_id": scope, "name": target, "range": self.span(x, x), "usage": READ if word == "class" and kind == "extends" else TYPE}))
        if word == "enum":
            self.scan(at + 1, stop, inner)
        else:
            self.members(at, inner, owner)
        return stop + 1

    def declarators(self, k: int, j: int, scope: str, kind: str, flags: int) -> int:
        """The declarations after const, let or var at ``k``."""
        at = k + 1
        while at < j:
            names: list[int] = []
            first = at
            at = self.pattern(at, j, names, scope)
            at += self.text(at) == "!"
            if self.text(at) == ":":
                stop = self.end_of_type(at + 1, j)
                self.types(at + 1, stop, scope)
                at = stop
            made, last = "const" if kind == "const" else "variable", at - 1
            if self.text(at) == "=":
                stop = self.end(at + 1, j)
                value = at + 1 + (self.text(at + 1) == "async")
                if len(names) == 1 and (self.text(value) == "function" or (self.text(value) == "(" or self.is_word(value)) and self.arrow(value) > 0):
                    made = "function"
                if self.text(at + 1) == "require" and self.text(at + 2) == "(" and self.t[at + 3][0] == "string":
                    spec = self.text(at + 3)[1:-1]
                    self.put("imports", spec=spec, range=self.span(k, stop - 1))
                    for x in names:
                        self.put("import_bindings", local_symbol_id=key(self.file, scope, self.text(x), x), imported_name=self.text(x) if self.text(first) == "{" else None, module_spec=spec, is_namespace=self.text(first) != "{", range=self.span(k, stop - 1))
                self.scan(at + 1, stop, scope)
                last = stop - 1
                at = stop
            for x in names:
                if self.is_word(x):
                    self.symbol(made, x, x, last if len(names) == 1 else x, scope, flags)
            if self.text(at) != ",":
                break
            at += 1
        return at

    def importing(self, k: int, j: int, scope: str) -> int:
        at = k + 1
        if self.text(at) in ("(", "."):
            if self.text(at) == "(" and at + 1 < j and self.t[at + 1][0] == "string":
                self.put("imports", spec=self.text(at + 1)[1:-1], range=self.span(k, self.match[at]))
            return at
        if at < j and self.t[at][0] == "string":
            self.put("imports", spec=self.text(at)[1:-1], range=self.span(k, at))
            return at + 1
        at += self.text(at) == "type" and self.text(at + 1) not in ("from", ",", "=")
        found: list[tuple[int, str | None, bool]] = []  # local name, imported name, namespace
        while at < j and self.text(at) not in ("from", "=", ";"):
            if self.text(at) == "*" and self.text(at + 1) == "as":
                found.append((at + 2, "*", True))
                at += 3
            elif self.text(at) == "{":
                x, close = at + 1, self.match[at]
                while x < close:
                    x += self.text(x) == "type" and self.text(x + 1) not in (",", "}", "as")
                    renamed = self.text(x + 1) == "as"
                    found.append((x + 2 if renamed else x, self.text(x).strip("\"'"), False))
                    x += 4 if renamed else 2
                at = close + 1
            else:
                if self.is_word(at):
                    found.append((at, DEFAULT, False))
                at += 1
        source = at + 1
        if self.text(at) == "=" and self.text(at + 1) == "require":
            source = at + 3
        if source >= j or self.t[source][0] != "string":
            return k + 1
        spec = self.text(source)[1:-1]
        self.put("imports", spec=spec, range=self.span(k, source))
        for x, name, space in found:
            if self.is_word(x):
                id_ = self.symbol("variable", x, x, x, scope)
                self.put("import_bindings", local_symbol_id=id_, imported_name=name, module_spec=spec, is_namespace=space, range=self.span(k, source))
        return source + 1 + (self.text(source + 1) == ")")

    def exporting(self, k: int, j: int, scope: str) -> int:
        at = k + 1
        at += self.text(at) == "type" and self.text(at + 1) in ("{", "*")
        if self.text(at) == "{":
            close, x = self.match[at], at + 1
            source = self.text(close + 2)[1:-1] if self.text(close + 1) == "from" else None
            while x < close:
                x += self.text(x) == "type" and self.text(x + 1) not in (",", "}", "as")
                renamed = self.text(x + 1) == "as"
                fact = {"exported_name": self.text(x + 2 if renamed else x).strip("\"'"), "range": self.span(x, x), "name": self.text(x), "scope_id": scope}
                self.pending.append(("exports", fact | ({"source": source} if source else {})))
                x += 4 if renamed else 2
            if source is not None:
                self.put("imports", spec=source, range=self.span(k, close + 2))
                return close + 3
            return close + 1
        if self.text(at) == "*":
            named = self.text(at + 1) == "as"
            source = at + (4 if named else 2)
            if source < j and self.t[source][0] == "string":
                self.put("imports", spec=self.text(source)[1:-1], range=self.span(k, source))
                self.put("exports", symbol_id=None, exported_name=self.text(at + 2) if named else "*", range=self.span(at, source))
            return source + 1
        if self.text(at) == "default":
            x = at + 1
            while self.text(x) in ("async", "abstract", "function", "class", "*"):
                x += 1
            name = x if self.is_word(x) and self.text(x) not in ("extends", "implements") and self.text(x - 1) in ("function", "class", "*") else -1
            fact = {"exported_name": DEFAULT, "range": self.span(at, at), "name": self.text(name) if name >= 0 else self.text(at + 1), "scope_id": scope}
            self.pending.append(("exports", fact))
            return at + 1
        return self.statement(at, j, scope, EXPORTED)

    def statement(self, k: int, j: int, scope: str, flags: int = 0) -> int:
        """A declaration at ``k``; the place after it, or ``k`` if there is none."""
        x, at = self.text(k), k
        while self.text(at) in ("declare", "abstract", "async") and self.is_word(at + 1):
            flags |= ASYNC if self.text(at) == "async" else 0
            at += 1
            x = self.text(at)
        if x in ("const", "let", "var") and not (x == "const" and self.text(at + 1) == "enum"):
            return self.declarators(at, j, scope, x, flags)
        if x == "const":
            at, x = at + 1, "enum"
        if x == "function":
            name = at + 1 + (self.text(at + 1) == "*")
            if self.is_word(name):
                stop, _ = self.function(name + 1, j, scope)
                self.symbol("function", name, at, max(name, stop - 1), scope, flags)
                return stop
            return max(self.function(name, j, scope)[0], at + 1)
        if x in ("class", "interface", "enum") and (self.is_word(at + 1) or x == "class" and self.text(at + 1) == "{"):
            return self.classlike(at, j, scope, flags)
        if x == "type" and self.is_word(at + 1) and self.text(at + 2) in ("=", "<"):
            sign = self.angle(at + 2) if self.text(at + 2) == "<" else at + 2
            stop = self.end(sign + 1, j, (";",))
            self.types(sign + 1, stop, scope)
            self.symbol("type", at + 1, at, max(at + 1, stop - 1), scope, flags)
            return stop
        if x in ("namespace", "module") and self.is_word(at + 1) and self.text(at + 2) == "{":
            self.scan(at + 3, self.match[at + 2], scope)
            return self.match[at + 2] + 1
        return k

    # -- expressions -------------------------------------------------------------------------------------

    def scan(self, k: int, j: int, scope: str) -> None:
        """All statements and expressions from ``k`` to ``j``, nested ones included."""
        while k < j:
            kind, x, _, _ = self.t[k]
            before = self.text(k - 1)
            if kind == "word" and before not in (".", "?."):
                if x == "import":
                    k = max(self.importing(k, j, scope), k + 1)
                    continue
                if x == "export":
                    k = max(self.exporting(k, j, scope), k + 1)
                    continue
                after = self.statement(k, j, scope) if x in STARTERS else k
                if after > k:
                    k = after
                    continue
                if x == "catch" and self.text(k + 1) == "(":
                    names: list[int] = []
                    self.pattern(k + 2, self.match[k + 1], names, scope)
                    for at in names:
                        self.symbol("parameter", at, at, at, scope, 0, 0)
                    k = self.match[k + 1] + 1
                    continue
                if x not in RESERVED:
                    sign = self.arrow(k)
                    if sign > 0:
                        k = self.arrow_function(k, sign, j, scope)
                        continue
                    method = self.text(k + 1) == "(" and before in ("{", ",", "get", "set", "async", "*")
                    if method and (self.text(self.match[k + 1] + 1) == "{" or self.text(self.match[k + 1] + 1) == ":" and before not in ("?",)) and x not in CONTROL:
                        k = max(self.function(k + 1, j, scope)[0], k + 1)
                        continue
                    k = self.chain(k, j, scope, before)
                    continue
                if x in ("as", "satisfies") and self.t[k - 1][0] != "punct" and self.text(k + 1) != "const":
                    stop = self.end_of_type(k + 1, j)
                    self.types(k + 1, stop, scope)
                    k = max(stop, k + 1)
                    continue
            elif x == "(":
                sign = self.arrow(k)
                if sign > 0:
                    k = self.arrow_function(k, sign, j, scope)
                    continue
            k += 1

    def chain(self, k: int, j: int, scope: str, before: str) -> int:
        """A name with the members asked of it: references, the call if one follows, what flows into it."""
        name, at = self.text(k), k
        parts = [name]
        while self.text(at + 1) in (".", "?.") and self.is_word(at + 2):
            at += 2
            parts.append(self.text(at))
        after = self.text(at + 1)
        if after == ":" and before in ("{", ",") and len(parts) == 1:
            return k + 1  # a key
        usage = READ
        if len(parts) == 1 and after == "=":
            usage = WRITE
        elif len(parts) == 1 and (after in UPDATES or after in ("++", "--") or before in ("++", "--")):
            usage = READ | WRITE | BOTH
        self.pending.append(("references", {"scope_id": scope, "name": name, "range": self.span(k, k), "usage": usage}))
        if len(parts) > 1:
            self.pending.append(("references", {"scope_id": scope, "name": ".".join(parts), "range": self.span(k, at), "usage": READ}))
        opened = at + 1
        if after == "<" and self.text(self.angle(opened)) == "(" and self.angle(opened) > opened:
            self.types(opened + 1, self.angle(opened) - 1, scope)
            opened = self.angle(opened)
        if self.text(opened) == "(" and opened in self.match:
            close = self.match[opened]
            self.pending.append(("calls", {"scope_id": scope, "callee_name": ".".join(parts), "range": self.span(k, close), "name": name if len(parts) == 1 else None}))
            x, n = opened + 1, 0
            while x < close:
                stop = self.end(x, close)
                stop = stop if self.text(stop) == "," or stop == close else self.end(stop, close, (",",))
                if stop == x + 1 and self.is_word(x) and self.text(x) not in RESERVED:
                    self.pending.append(("symbol_flows", {"name": self.text(x), "scope_id": scope, "owner_scope_id": scope, "argument_index": n, "range": self.span(x, x)}))
                x, n = max(stop, x) + 1, n + 1
        return at + 1

    # -- control flow ------------------------------------------------------------------------------------

    def flow(self, scope: str, a: int, b: int) -> None:
        f = _ScriptFlow(self)
        for last, label in f.run(a + 1, b, [(0, "")], []):
            f.edges.append((last, 1, label))
        for n, kind in enumerate(f.nodes):
            self.put("cfg_nodes", scope_id=scope, id=n, kind=kind)
        for s, d, label in dict.fromkeys(f.edges):
            self.put("cfg_edges", scope_id=scope, src=s, dst=d, label=label)

    # -- the file ----------------------------------------------------------------------------------------

    def see(self, scope: str | None, name: str) -> str | None:
        while scope is not None:
            if name in self.names[scope]:
                return self.names[scope][name][0]
            scope = self.parent[scope]
        return None

    def read(self) -> list[tuple[str, dict]]:
        top = self.scope("file", 0, 0, None)
        self.scan(0, len(self.t), top)
        kinds = {f["id"]: f["kind"] for t, f in self.facts if t == "symbols"}
        functions: dict[str, str] = {}
        for t, f in self.facts:
            if t == "symbols" and f["kind"] in ("function", "method"):
                functions.setdefault(f["name"], f["id"])
        for table, fact in self.pending:
            fact = dict(fact)
            if table == "references":
                fact["symbol_id"] = None if "." in fact["name"] else self.see(fact["scope_id"], fact["name"])
            elif table == "calls":
                name = fact.pop("name")
                fact["symbol_id"] = functions.get(name)
            elif table == "type_relations":
                fact["target_id"] = self.see(fact.pop("scope_id"), fact["target_name"])
            elif table == "exports":
                scope, name = fact.pop("scope_id"), fact.pop("name")
                fact["symbol_id"] = None if fact.pop("source", None) is not None else self.see(scope, name)
            elif table == "symbol_flows":
                fact["flowing_symbol_id"] = self.see(fact.pop("scope_id"), fact.pop("name"))
                if kinds.get(fact["flowing_symbol_id"]) not in ("function", "method"):
                    continue
            self.facts.append((table, fact))
        return self.facts


STARTERS = frozenset("const let var function class interface enum type namespace module declare abstract async".split())


class _ScriptFlow(_Flow):
    """Statements by their tokens; unreachable ones have no nodes."""

    def __init__(self, reader: _Reader) -> None:
        super().__init__()
        self.r = reader

    def run(self, k: int, j: int, ins: list, loops: list) -> list:
        while k < j and ins:
            k, ins = self.one(k, j, ins, loops)
        return ins

    def skip(self, k: int, j: int) -> int:
        """The place after the statement at ``k``."""
        return self.one(k, j, [], [])[0]

    def one(self, k: int, j: int, ins: list, loops: list) -> tuple[int, list]:
        r, x = self.r, self.r.text(k)
        live = bool(ins)
        node = lambda kind, sources: self.node(kind, sources) if live else 0
        if x == ";":
            return k + 1, ins
        if x == "{":
            return r.match[k] + 1, self.run(k + 1, r.match[k], ins, loops)
        if x == "if" and r.text(k + 1) == "(":
            n = node("branch", ins)
            at, outs = self.one(r.match[k + 1] + 1, j, [(n, "true")] if live else [], loops)
            if r.text(at) == "else":
                at, more = self.one(at + 1, j, [(n, "false")] if live else [], loops)
                return at, outs + more
            return at, outs + ([(n, "false")] if live else [])
        if x in ("for", "while"):
            head = k + 1 + (r.text(k + 1) == "await")
            n, breaks = node("loop", ins), []
            at, outs = self.one(r.match[head] + 1, j, [(n, "true")] if live else [], [*loops, (n, breaks)])
            self.edges += [(s, n, "back") for s, _ in outs]
            endless = x == "while" and r.text(head + 1) == "true" and r.match[head] == head + 2
            return at, ([] if endless or not live else [(n, "false")]) + breaks
        if x == "do":
            n, breaks = node("loop", ins), []
            at, outs = self.one(k + 1, j, [(n, "true")] if live else [], [*loops, (n, breaks)])
            self.edges += [(s, n, "back") for s, _ in outs]
            at = r.match[at + 1] + 1 if r.text(at) == "while" and at + 1 in r.match else at
            return at + (r.text(at) == ";"), ([(n, "false")] if live else []) + breaks
        if x == "switch" and r.text(r.match.get(k + 1, k) + 1) == "{":
            opened = r.match[k + 1] + 1
            close, n, breaks = r.match[opened], node("branch", ins), []
            at, outs, whole = opened + 1, [], False
            while at < close:
                if r.text(at) in ("case", "default"):
                    whole = whole or r.text(at) == "default"
                    while r.text(at) != ":" and at < close:
                        at = r.match[at] + 1 if at in r.match else at + 1
                    at += 1
                    outs = outs + ([(n, "case")] if live else [])
                    continue
                if outs:
                    at, outs = self.one(at, close, outs, [*loops, (loops[-1][0] if loops else n, breaks)])
                else:
                    at = max(self.skip(at, close), at + 1)
            return close + 1, outs + breaks + ([] if whole or not live else [(n, "default")])
        if x == "try" and r.text(k + 1) == "{":
            outs = self.run(k + 2, r.match[k + 1], ins, loops)
            at = r.match[k + 1] + 1
            if r.text(at) == "catch":
                body = at + 1 if r.text(at + 1) == "{" else r.match[at + 1] + 1
                outs = outs + (self.run(body + 1, r.match[body], [(node("catch", ins), "")], loops) if live else [])
                at = r.match[body] + 1
            if r.text(at) == "finally":
                outs = self.run(at + 2, r.match[at + 1], outs or ins, loops)
                at = r.match[at + 1] + 1
            return at, outs
        if r.is_word(k) and r.text(k + 1) == ":" and x not in RESERVED:
            return self.one(k + 2, j, ins, loops)
        at = k
        if x in ("function", "class", "interface", "enum") or x == "async" and r.text(k + 1) == "function":
            while at < j and r.text(at) != "{":
                at = r.match[at] + 1 if at in r.match else at + 1
            at = r.match[at] + 1 if at in r.match else j
        else:
            at = max(r.end(k, j, (";",)), k + 1)
        at += r.text(at) == ";" and at < j
        n = node("statement", ins)
        if not live:
            return at, []
        if x in ("return", "throw"):
            self.edges.append((n, 1, ""))
            return at, []
        if x == "break" and loops:
            loops[-1][1].append((n, ""))
            return at, []
        if x == "continue" and loops:
            self.edges.append((n, loops[-1][0], "back"))
            return at, []
        return at, [(n, "")]


def script_facts(file: str, source: str) -> list[tuple[str, dict]]:
    """The facts of one script, or one error."""
    try:
        return _Reader(file, source).read()
    except (Unmatched, RecursionError, IndexError, KeyError) as error:
        return [("errors", {"message": str(error)[:200], "line": None})]
