"""Python 3: logical lines, indentation blocks and the grammar of a line.

A logical line becomes a string of one-character symbols in which bracket groups are single characters
that stand for the phrases they derive. Blocks are strings of line kinds; a header and its block
are derived together, so a missing body or a stray clause is an error of the chart too.
"""

from __future__ import annotations

import re

from loomgraph.llm.syntax.chart import PREFIX, Grammar

# The keywords of Python 3.
RESERVED = """False None True and as assert async await break class continue def del elif else except finally for from global if
import in is lambda nonlocal not or pass raise return try while with yield""".split()
SOFT = "match case type _".split()
PUNCTUATORS = """... **= //= >>= <<= -> := == != <= >= += -= *= /= %= &= |= ^= @= ** // << >>""".split()
SINGLE = "{}()[];,<>+-*/%&|^~:=.@"

CODE = {s: chr(0xE100 + k) for k, s in enumerate([*RESERVED, *SOFT, *PUNCTUATORS])} | {s: s for s in SINGLE}
GROUP = 0xE400
#: Tokens and groups whose reading is remembered, and the longest such token.
REMEMBERED, KEPT = 200_000, 48

_HEAD = r"(?!(?:" + "|".join(RESERVED) + r")\b)"
TOKEN = re.compile(
    r"(?P<space>[ \t\f]+|\\\r?\n|#[^\r\n]*)"
    r"|(?P<line>\r\n|\n|\r)"
    r"""|(?P<string>(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|"(?!"")(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'))"""
    rf"|(?P<chain>{_HEAD}[^\W\d]\w*(?:\.{_HEAD}[^\W\d]\w*)+)"
    r"|(?P<word>[^\W\d]\w*)"
    r"|(?P<number>(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|[1-9](?:_?\d)*|0(?:_?0)*)(?!\w))"
    r"|(?P<open>[({\[])|(?P<close>[)}\]])"
    r"|(?P<punct>" + "|".join(re.escape(p) for p in PUNCTUATORS) + r"|[;,<>+\-*/%&|^~:=.@])"
    r"|(?P<bad>[\s\S])"
)
INDENT = re.compile(r"[ \t\f]*")
TABBED = re.compile(r"^ *\t", re.M)
FIELD_END = re.compile(r"(?:=\s*)?(?:![rsa])?(?::|$)")

GRAMMAR = """
Simples: Simple | Simples ; Simple | Simples ;
Simple: Stars | Yield | Targets = Rhs | TargetPrim AugOp Rhs0 | TargetPrim : Expr | TargetPrim : Expr = Rhs0 | return Stars~? | raise | raise Expr | raise Expr from Expr | del Targets | pass | break | continue | assert Expr | assert Expr , Expr | global Ids | nonlocal Ids | import Modules | From | type id [P~? = Expr
Rhs: Rhs0 | Targets = Rhs
Rhs0: Stars | Yield
Yield: yield Stars~? | yield from Expr
Ids: id | Ids , id
Modules: Module | Modules , Module
Module: Dotted | Dotted as id
Dotted: id | chain
From: from Dots~* Dotted import Names | from Dots~+ import Names
Dots: . | ...
Names: (I | * | NameList
NameList: Name | NameList , Name
Name: id | id as id
Targets: TargetElem | Targets , TargetElem | Targets ,
TargetElem: *~? TargetPrim
TargetPrim: id | chain | Prim . id | Prim . chain | Prim [S | (T | [T
Stars: Star | StarList | StarList ,
StarList: Star | StarList , Star
Star: Expr | * Flat | Walrus
Walrus: id := Expr
Named: Walrus | Expr
Expr: Flat | Flat if Flat else Expr | lambda LParams~? : Expr
LParams: LList | LList ,
LList: LLead | LLead , LTail | LTail
LLead: Ids | Ids , / | Ids , / , Ids | Ids , / , LGivens | Ids , / , Ids , LGivens | Ids , LGivens | Ids , LGivens , / | Ids , LGivens , / , LGivens | LGivens | LGivens , / | LGivens , / , LGivens
LGivens: KeyArg | LGivens , KeyArg
LTail: LRest | LRest , ** id | ** id
LRest: * , LKeys | * id | * id , LKeys
LKeys: id | KeyArg | LKeys , id | LKeys , KeyArg
Flat: Unary | Flat BinOp Unary
Unary: Prim | UnOp Unary
UnOp: - | + | ~ | not | await
BinOp: or | and | < | > | == | != | <= | >= | in | not in | is | is not | bar | ^ | & | << | >> | + | - | * | / | // | % | @ | **
Prim: Atom | Prim . id | Prim . chain | Prim (A | Prim [S
Atom: id | chain | n | Strings | True | False | None | ... | (G | [L | {D
Strings: s | Strings s
Gen: Named CompFor~+
CompFor: async~? for Targets in Flat CompIf~*
CompIf: if Flat | if lambda LParams~? : Flat | if Walrus
Paren: _ | Stars | Yield | Gen
Elems: _ | Stars | Gen
Args: _ | Gen | ArgList | ArgList ,
ArgList: PosArgs | PosArgs , KeyArgs | KeyArgs
PosArgs: PosArg | PosArgs , PosArg
PosArg: Named | * Expr
KeyArgs: KeyArg | KeyArgs , KeyArg | KeyArgs , * Expr | KeyArgs , Spreads | Spreads
KeyArg: id = Expr
Spreads: ** Expr | Spreads , ** Expr | Spreads , KeyArg
Element: PosArg | KeyArg | ** Expr
Params: _ | ParamList | ParamList ,
ParamList: Lead | Lead , Tail | Tail
Lead: Plains | Plains , / | Plains , / , Plains | Plains , / , Givens | Plains , / , Plains , Givens | Plains , Givens | Plains , Givens , / | Plains , Givens , / , Givens | Givens | Givens , / | Givens , / , Givens
Plains: Plain | Plains , Plain
Plain: id | id : Expr
Givens: Given | Givens , Given
Given: id = Expr | id : Expr = Expr
Tail: Rest | Rest , Dict | Dict
Rest: * , Keys | * id | * id : Star | * id , Keys | * id : Star , Keys
Keys: Plain | Given | Keys , Plain | Keys , Given
Dict: ** id | ** id : Expr
Imports: NameList | NameList ,
Withs: WithList | WithList ,
WithList: WithItem | WithList , WithItem
WithItem: Expr | Expr as TargetElem
Slices: SliceList | SliceList ,
SliceList: Slice | SliceList , Slice
Slice: Named | * Flat | Expr~? : Expr~? | Expr~? : Expr~? : Expr~?
TypeParams: TypeList | TypeList ,
TypeList: TypeParam | TypeList , TypeParam
TypeParam: id | id : Expr | * id | ** id | id = Expr
Braces: _ | Items | Items , | Stars | Gen | Pair CompFor~+
Items: Pair | Items , Pair
Pair: Expr : Expr | ** Flat
Suite: block | Simples
IfLine: if Named : Suite
ElifLine: elif Named : Suite
ElseLine: else : Suite
ForLine: async~? for Targets in Stars : Suite
WhileLine: while Named : Suite
TryLine: try : Suite
ExceptLine: except *~? Expr~? : Suite | except *~? Expr as id : Suite
FinallyLine: finally : Suite
DefLine: async~? def id [P~? (P Arrow~? : Suite | class id [P~? (A~? : Suite
Arrow: -> Expr
WithLine: async~? with WithList : Suite | async~? with (W : Suite
AtLine: @ Named
MatchLine: match Stars : cases
CaseLine: case Pattern Guard~? : Suite
Guard: if Named
Pattern: Stars | Stars as id | * id
Block: Item~+
Item: simple | If | Loop | Try | Def
If: I E~* L~?
Loop: F L~? | W L~?
Try: T X~+ L~? Y~? | T Z~+ L~? Y~? | T Y
Def: D | Ats D
Ats: A | Ats A
Cases: C~+
"""
AUGMENTED = "AugOp: " + " | ".join(p for p in PUNCTUATORS if p.endswith("=") and p not in (":=", "==", "!=", "<=", ">=") and p != "|=") + " | bareq\n"
PHRASES = {"(G": "Paren", "(A": "Args", "(P": "Params", "(I": "Imports", "(W": "Withs", "(T": "Targets", "[L": "Elems", "[S": "Slices", "[T": "Targets", "[P": "TypeParams", "{D": "Braces"}
ELEMENTS = {"(A": "Element", "(G": "Star", "[L": "Star", "{D": "Pair"}
#: First word of a line -> what derives the line, kind of the line in its block.
KINDS = {"if": ("IfLine", "I"), "elif": ("ElifLine", "E"), "else": ("ElseLine", "L"), "for": ("ForLine", "F"), "while": ("WhileLine", "W"), "try": ("TryLine", "T"), "except": ("ExceptLine", "X"), "finally": ("FinallyLine", "Y"), "def": ("DefLine", "D"), "class": ("DefLine", "D"), "with": ("WithLine", "s"), "@": ("AtLine", "A")}
KINDS = {CODE[k]: v for k, v in KINDS.items()}
NAMES: dict[str, frozenset] = {c: frozenset({w, "id"} if w in SOFT else {w}) for w, c in CODE.items()}
NAMES |= {"|": frozenset({"bar"}), CODE["|="]: frozenset({"bareq"}), "i": frozenset({"id"}), "m": frozenset({"chain"}), "b": frozenset({"block"}), "c": frozenset({"cases"}), "S": frozenset({"simple"})}
NAMES |= {c: frozenset({c}) for c in "nsIELFWTXZYDAC"}


_STRING = TOKEN.pattern[TOKEN.pattern.index("(?P<string>") + len("(?P<string>") : TOKEN.pattern.index(")|(?P<chain>")]
_NUMBER = TOKEN.pattern[TOKEN.pattern.index("(?P<number>") + len("(?P<number>") : TOKEN.pattern.index(")|(?P<open>")]
#: All tokens of a source in one pass; a line end counts if more follows, with the indentation of what follows.
FAST = re.compile(
    r"(?:[ \t\f\r]+|\\\r?\n|#[^\r\n]*|\r?\n(?![ \t\f]*[^\s#]))*(?:(" + rf"\n[ \t\f]*|{_STRING}|{_HEAD}[^\W\d]\w*(?:\.{_HEAD}[^\W\d]\w*)*|[^\W\d]\w*|{_NUMBER}|" + "|".join(re.escape(p) for p in PUNCTUATORS) + r"|[\s\S])|\Z)"
)
FOLD = re.compile(r"([({\[])([^(){}\[\]]*)([)}\]])")
CLOSER = {"(": ")", "[": "]", "{": "}"}
WIDTH = 0x3000
BREAK = re.compile(r"\n[\s\S]")


def uneven(source: str, lines: list[tuple[int, str, int]]) -> int:
    """The number of logical lines whose indentation compares otherwise if a tab counts one column instead of eight."""
    out, stack = 0, [(0, 0)]
    for _, _, begin in lines:
        text = INDENT.match(source, begin)[0]
        wide, narrow = len(text.expandtabs(8)), len(text)
        while wide < stack[-1][0]:
            stack.pop()
        if wide == stack[-1][0]:
            out += narrow != stack[-1][1]
        else:
            out += narrow <= stack[-1][1]
            stack.append((wide, narrow))
    return out


def ordered(arguments: list[str]) -> bool:
    """Whether no plain argument follows a keyword or ``**``, and no ``*`` follows ``**``."""
    keyword = spread = False
    for a in arguments:
        if a[0] == CODE["**"]:
            spread = True
        elif a[1:2] == "=":
            keyword = True
        elif spread or (keyword and a[0] != "*"):
            return False
    return True


class Symbols(dict):
    """The symbol of a token's text, remembered; a line end is followed by the width of the next indentation."""

    def __init__(self, python: "Python"):
        self.python = python

    def __missing__(self, text: str) -> str:
        if len(self) > REMEMBERED:
            self.clear()
        c = text[:1]
        if text in CODE:
            out = CODE[text]
        elif not text:
            out = ""
        elif c == "\n":
            out = "\n" + chr(WIDTH + min(0x1000, len(text[1:].expandtabs(8))))
        elif text[-1] in "\"'" and len(text) > 1:
            out = "s" if self.python.stands(text) else "\0"
        elif c.isdecimal() or (c == "." and len(text) > 1):
            out = "n"
        elif c == "_" or c.isidentifier():
            out = "m" if "." in text else "i"
        else:
            out = "\0"
        if len(text) <= KEPT:
            self[text] = out
        return out


class Python:
    """``cost(source)`` is 0 exactly for sources that are derived."""

    def __init__(self) -> None:
        self.flags: dict[str, frozenset] = {}
        self.char: dict[frozenset, str] = {}
        self.folded: dict[tuple, str] = {}
        self.fields: dict[str, bool] = {}
        self.symbols = Symbols(self)
        self.exact = self.lacking = False
        self.spent = 0
        self.grammar = Grammar(GRAMMAR + AUGMENTED, lambda c: NAMES.get(c) or self.flags.get(c, frozenset()))

    def symbol(self, flags: frozenset) -> str:
        if flags not in self.char:
            self.char[flags] = c = chr(GROUP + len(self.char))
            self.flags[c] = flags
        return self.char[flags]

    def group(self, kind: str, content: str, mend: bool) -> str:
        key = (kind, content)
        out = self.folded.get(key)
        kinds = [k for k in PHRASES if k[0] == kind]
        if out is None:
            if len(self.folded) > REMEMBERED:
                self.folded.clear()
            out = self.folded[key] = self.symbol(frozenset(k for k in kinds if self._derives(k, content)))
        if mend and not self.flags[out]:
            if self.exact or not self.spent:
                self.spent += self._cheapest(kinds, content)
            out = self.symbol(frozenset(kinds))
        return out

    def _cheapest(self, kinds: list[str], content: str) -> int:
        """The least cost of making ``content`` one of the phrases."""
        least = 0
        for k in kinds:
            cost = self.grammar.repair(PHRASES[k], content, self.exact)
            least = min(least, cost) if least else cost
            if least == 1:
                break
        return max(1, least)

    def _derives(self, k: str, content: str) -> bool:
        parts = content.split(",")
        if k in ELEMENTS and len(parts) > 1 and CODE["for"] not in content and CODE["lambda"] not in content:
            if not parts[-1]:
                parts.pop()
            if all(self.grammar.derives(ELEMENTS[k], p) for p in dict.fromkeys(parts)):
                return k != "(A" or ordered(parts)
            if k != "{D":
                return False
        return self.grammar.derives(PHRASES[k], content)

    def _fold(self, m: re.Match) -> str:
        bracket, text, end = m.groups()
        if CLOSER[bracket] != end:
            return "\0"
        return self.group(bracket, BREAK.sub("", text) if "\n" in text else text, False)

    def quick(self, source: str) -> bool:
        """True if the tokens of one pass are derived; False leaves the question to the full reader."""
        text = "".join(map(self.symbols.__getitem__, FAST.findall("\n" + source)))
        if "\0" in text:
            return False
        while True:
            new = FOLD.sub(self._fold, text)
            if new == text:
                break
            text = new
        lines = [(ord(x[0]) - WIDTH, x[1:], 0) for x in text.split("\n") if len(x) > 1]
        return self.blocks(lines, False)[0] == 0

    def lines(self, source: str, mend: bool) -> tuple[list[tuple[int, str, int]], list[int]]:
        """The logical lines (indentation, content, place) and the places of lexical and bracket errors."""
        out: list[tuple[int, str, int]] = []
        errors: list[int] = []
        stack: list[tuple[str, list]] = []
        parts: list[str] = []
        pos, size = (1 if source.startswith("﻿") else 0), len(source)
        indent, begun = 0, pos
        m = INDENT.match(source, pos)
        indent = len(m[0].expandtabs(8))
        code = CODE.get
        for m in TOKEN.finditer(source, pos):
            kind = m.lastgroup
            if kind == "space":
                continue
            if kind == "line":
                if not stack:
                    if parts:
                        out.append((indent, "".join(parts), begun))
                        parts = []
                    begun = m.end()
                    text = INDENT.match(source, begun)[0]
                    indent = len(text.expandtabs(8)) if "\t" in text else len(text)
                continue
            if kind == "word":
                parts.append(code(m[0], "i"))
            elif kind == "chain":
                parts.append("m")
            elif kind == "string":
                parts.append("s")
                if not self.stands(m[0]):
                    errors.append(m.start())
            elif kind == "number":
                parts.append("n")
            elif kind == "punct":
                parts.append(CODE[m[0]])
            elif kind == "open":
                stack.append((m[0], parts))
                parts = []
            elif kind == "close":
                want = {")": "(", "]": "[", "}": "{"}[m[0]]
                if not stack or stack[-1][0] != want:
                    errors.append(m.start())
                    if not mend:
                        break
                    if not any(f[0] == want for f in stack):
                        continue
                    while stack[-1][0] != want:
                        bracket, outer = stack.pop()
                        outer.append(self.group(bracket, "".join(parts), mend))
                        parts = outer
                bracket, outer = stack.pop()
                outer.append(self.group(bracket, "".join(parts), mend))
                parts = outer
            else:
                errors.append(m.start())
            if errors and not mend:
                return out, errors
        while stack:
            errors.append(size)
            if not mend:
                return out, errors
            bracket, outer = stack.pop()
            outer.append(self.group(bracket, "".join(parts), mend))
            parts = outer
        if parts:
            out.append((indent, "".join(parts), begun))
        return out, errors

    def stands(self, text: str) -> bool:
        """Whether a string's fields are expressions, and bytes are ASCII."""
        prefix = text[: min(text.find(q) for q in "\"'" if q in text)].lower()
        return ("f" not in prefix and "t" not in prefix or self.formatted(text)) and ("b" not in prefix or text.isascii())

    def formatted(self, text: str) -> bool:
        """Whether the fields of an f-string are expressions."""
        quote = 3 if text.endswith(('"""', "'''")) and len(text) >= 6 else 1
        body = text[text.index(text[-1]) + quote : -quote]
        known = self.fields.get(body)
        if known is None:
            if len(self.fields) > REMEMBERED:
                self.fields.clear()
            known = self.fields[body] = self._fields(body)
        return known

    def _fields(self, body: str) -> bool:
        pos = 0
        while pos < len(body):
            c = body[pos]
            if body.startswith(("{{", "}}"), pos):
                pos += 2
            elif c == "}":
                return False
            elif c == "{":
                depth, end = 0, pos + 1
                while end < len(body):
                    m = TOKEN.match(body, end)
                    if depth == 0 and (body[end] in ":}" or (body[end] == "!" and not body.startswith("!=", end)) or (body[end] == "=" and body[end + 1 : end + 2] in ("}", "!", ":"))):
                        break
                    depth += {"open": 1, "close": -1}.get(m.lastgroup, 0)
                    end = m.end()
                spent = getattr(self, "spent", 0)
                lines, errors = self.lines("(" + body[pos + 1 : end] + ")", False)
                self.spent = spent
                if errors or len(lines) != 1 or not self.grammar.derives("Paren", lines[0][1]) or not body[pos + 1 : end].strip():
                    return False
                m = re.compile(r"=?\s*(?:!\s*[rsa]\s*)?").match(body, end)
                pos = m.end()
                if body.startswith(":", pos):
                    pos, depth = pos + 1, 1
                    while pos < len(body) and depth:
                        depth += {"{": 1, "}": -1}.get(body[pos], 0)
                        pos += 1
                    if depth:
                        return False
                elif body.startswith("}", pos):
                    pos += 1
                else:
                    return False
            else:
                pos += 1
        return True

    def blocks(self, lines: list, mend: bool) -> tuple[int, list[int]]:
        """The cost of the lines and blocks, and the places of repaired lines."""
        cost, places = 0, []
        stack: list[list] = [[lines[0][0] if lines and mend else 0, [], None, 0]]  # [indentation, kinds, header, its place]
        grammar, exact = self.grammar, self.exact

        def close() -> bool:
            nonlocal cost
            indent, kinds, header, place = stack.pop()
            text = "".join(kinds)
            mark = "b" if grammar.derives("Block", text) else "c" if grammar.derives("Cases", text) else ""
            if not mark:
                if not mend:
                    return False
                if exact or not cost:
                    cost += grammar.repair("Block", text, exact)
                places.append(place)
                mark = "b"
            return put(header + mark, place)

        def put(text: str, place: int) -> bool:
            nonlocal cost
            start, kind = KINDS.get(text[0], ("Simples", "S"))
            if text[0] == CODE["async"] and len(text) > 1:
                start, kind = KINDS.get(text[1], ("Simples", "S"))
            if kind == "X" and text[1:2] == "*":
                kind = "Z"
            if text[0] == CODE["match"] and text[-1] == "c":
                start, kind = "MatchLine", "S"
            elif text[0] == CODE["case"] and ":" in text and not grammar.derives("Simples", text):
                start, kind = "CaseLine", "C"
            if not grammar.derives(start, text):
                if not mend:
                    return False
                if exact or not cost:
                    cost += grammar.repair(start, text, exact)
                places.append(place)
                if place == lines[-1][2] and grammar.status(start, text) == PREFIX:
                    self.lacking = True
            stack[-1][1].append("S" if kind == "s" else kind)
            return True

        held: tuple | None = None  # the line before, which may be the header of a block
        for indent, text, place in lines:
            if held is not None:
                if indent > stack[-1][0] and held[0][-1] == ":":
                    stack.append([indent, [], held[0], held[1]])
                    held = None
                else:
                    if not put(*held):
                        return 1, [held[1]]
                    held = None
            if indent > stack[-1][0]:
                cost += 1
                places.append(place)
                if not mend:
                    return 1, places
                stack.append([indent, [], CODE["if"] + "i:", place])  # an unexpected indentation, read as a block of its own
            while indent < stack[-1][0] and len(stack) > 1:
                if not close():
                    return 1, [place]
            if indent != stack[-1][0]:
                cost += 1
                places.append(place)
                if not mend:
                    return 1, places
            held = (text, place)
        if held is not None and not put(*held):
            return 1, [held[1]]
        while len(stack) > 1:
            if not close():
                return 1, [lines[-1][2]]
        kinds = "".join(stack[0][1])
        if kinds and not grammar.derives("Block", kinds):
            if not mend:
                return 1, [0]
            if exact or not cost:
                cost += grammar.repair("Block", kinds, exact)
            places.append(lines[-1][2])
        return cost, places

    def cost(self, source: str, exact: bool = False) -> int:
        """0 if the source is derived; else the least edits of its phrases, summed. Without ``exact`` the sum ends with the first phrase that costs anything."""
        self.spent = 0
        tabbed = TABBED.search(source)
        if not tabbed and self.quick(source.removeprefix("\ufeff")):
            return 0
        lines, errors = self.lines(source, False)
        mixed = uneven(source, lines) if tabbed and not errors else 0
        if not (errors or mixed or self.blocks(lines, False)[0]):
            return 0
        self.exact, self.spent, self.lacking = exact, 0, False
        lines, errors = self.lines(source, True)
        cost = len(errors) + self.spent + mixed
        if exact or not cost:
            cost += self.blocks(lines, True)[0]
        return max(1, cost)

    def places(self, source: str) -> tuple[list[int], bool]:
        """Where the repairs of an invalid source are, and whether it ends before a phrase does."""
        self.exact, self.spent, self.lacking = False, 0, False
        lines, errors = self.lines(source, True)
        at = errors + self.blocks(lines, True)[1]
        return at, self.lacking or any(p >= len(source) for p in errors)
