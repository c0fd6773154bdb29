"""JavaScript, TypeScript and TSX: a lexer that folds brackets, and the grammar of what stands between them.

A source becomes a tree of bracket groups. Each group's content is a short string of one-character
symbols in which inner groups are single characters that stand for the set of phrases they derive (a
block, an object, parameters, ...). Contents are derived by the chart grammar, so equal shapes are parsed
once for a worker however many files hold them. Lists are parsed element by element and statement lists
statement by statement; automatic semicolons are tried at line ends only, each line end being read both ways.
"""

from __future__ import annotations

import re

from loomgraph.llm.syntax.chart import PREFIX, WHOLE, Grammar

# The reserved words of ECMAScript, which never name a binding.
RESERVED = """break case catch class const continue debugger default delete do else enum export extends false finally for
function if import in instanceof new null return super switch this throw true try typeof var void while with""".split()
# Words with a meaning in some places, names elsewhere.
SOFT = """as async await from get let of set static yield type interface namespace module declare abstract readonly private
public protected override accessor implements keyof infer is asserts satisfies unique out global require target""".split()
PUNCTUATORS = """>>>= ... === !== **= <<= >>= &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << **""".split()
SINGLE = "{}()[];,<>+-*/%&|^!~?:=.@"

_WORD = r"[A-Za-z_$\u00aa\u00b5\u00ba\u00c0-\u1fff\u3040-\ud7ff][\w$]*"
_NOT_HEAD = r"(?!(?:" + "|".join(w for w in RESERVED if w not in ("this", "super", "import", "new")) + r")\b)"
TOKEN = re.compile(
    r"(?P<space>[ \t\r\f\v\u00a0\ufeff]+|//[^\n\u2028\u2029]*)"
    r"|(?P<line>\n|\u2028|\u2029|/\*[^*]*(?:\*(?!/)[^*]*)*\*/)"
    rf"|(?P<chain>{_NOT_HEAD}{_WORD}(?:\.#?{_WORD})+)"
    rf"|(?P<word>{_WORD})"
    r"|(?P<number>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$]))"
    r"""|(?P<string>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"""
    r"|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<tick>`)|(?P<slash>/=?)"
    r"|(?P<punct>" + "|".join(re.escape(p) for p in PUNCTUATORS if p != "/=") + r"|\?\.(?!\d)|[;,<>+\-*%&|^!~?:=.@])"
    rf"|(?P<private>\#{_WORD})|(?P<bang>(?<![\s\S])\#![^\n]*)|(?P<bad>[\s\S])"
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?:[.:][A-Za-z_$][\w$-]*)*")
JSX_SPACE = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*)*")
JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
JSX_TEXT = re.compile(r"[^<{>}]*")
#: In a file with JSX, a '<' before an operand opens type parameters if a comma or ``extends`` follows the name, else an element.
GENERIC = re.compile(rf"(?:\s|/\*[\s\S]*?\*/|//[^\n]*)*(?:const\s+)?{_WORD}(?:\s|/\*[\s\S]*?\*/|//[^\n]*)*(?:,|extends\b(?!\s*[=/>]))")

# One character for each word and punctuator; groups follow from GROUP on.
CODE = {s: chr(0xE100 + k) for k, s in enumerate([*RESERVED, *SOFT, *PUNCTUATORS])} | {s: s for s in SINGLE}
GROUP = 0xE400
#: Tokens and groups whose reading is remembered, and the longest such token.
REMEMBERED, KEPT = 200_000, 48
FIRST = chr(GROUP)
ENDS = set("imnsrptJ") | {CODE[w] for w in ("this", "super", "null", "true", "false", "++", "--", "break", "continue", "return", "debugger", *SOFT)}
STARTS = set("imnsrptJ@") | {CODE[w] for w in [*RESERVED, *SOFT] if w not in ("catch", "finally", "in", "instanceof", "extends")} | {CODE["++"], CODE["--"]}
#: Before these a statement without a block may end: ``if (a) b; else c``, ``do a; while (b)``.
JOINERS = (CODE["else"], CODE["while"])
#: What begins a statement and continues none that ends with a bracket.
BEGINS = {"i", "m"} | {CODE[w] for w in ("const", "let", "var", "function", "class", "return", "if", "for", "try", "switch", "throw", "import", "export", "interface", "type", "enum", "declare", "async", "abstract", "break", "continue", "await", "do")}

#: The phrases a group may be: bracket, letter -> how its content is derived.
LISTS = {"(A": "ArgElem", "(P": "Param", "[L": "ArgElem", "[Q": "BindElem", "[Y": "TupleElem", "{O": "ObjElem", "{Q": "BindProp", "{M": "Specifier", "{N": "EnumElem", "<A": "Type", "<P": "TypeParam"}
PHRASES = {"(E": "Expr", "(F": "ForHead", "(T": "Type", "(C": "Bind", "[I": "Expr", "[Y1": "Type", "[X": "IndexSig", "{X": "JsxExpr", "`t": "TemplatePart"}
BODIES = {"{B": "Seg", "{K": "ClassSeg", "{T": "TypeSeg", "{S": "SwitchSeg"}

BASE = """
Seg: BlkStmt~* | BlkStmt~* Stmt
Stmt: Head~* Simple | BlkStmt
BlkStmt: Head~* BlkEnd
Head: if (E | if (E BlkStmt else | if (E Stmt ; else | for (F | for await (F | while (E | id :
BlkEnd: {B | FuncDecl | ClassDecl | try {B Catch | try {B Catch~? finally {B | switch (E {S | export FuncDecl | export ClassDecl | export default FuncAnon | export default ClassAnon
Catch: catch (C {B | catch {B
Simple: Expr | VarDecl | return Expr~? | throw Expr | break id~? | continue id~? | debugger | Import | Export | do {B while (E | do Stmt ; while (E
VarDecl: Var Decl | VarDecl , Decl
Var: var | let | const
Decl: Bind | Bind = Assign
Bind: id | {Q | [Q
Import: import s | import Clause from s | import {M from s With | import id from s With
With: with {O
Clause: id | {M | * as id | id , {M | id , * as id
Export: export VarDecl | export default Assign | export {M | export {M from s | export * from s | export * as name from s
Specifier: name | name as name | s as name | name as s
FuncDecl: async~? function *~? id (P {B
FuncAnon: FuncDecl | async~? function *~? (P {B
ClassDecl: Decor~* class id Heritage~? {K
ClassAnon: ClassDecl | Decor~* class Heritage~? {K
Heritage: extends Left
Decor: @ id | @ chain | @ id (A | @ chain (A | @ (E
ClassSeg: BlkMember~* | BlkMember~* Field
BlkMember: Mod~* PropName (P {B | static {B
Mod: static | async | get | set | * | accessor
Field: FieldMod~* PropName | FieldMod~* PropName = Assign
FieldMod: static | accessor
PropName: name | s | n | [I | private
SwitchSeg: SwitchPart~* | SwitchPart~* Stmt
SwitchPart: case Expr : | default : | BlkStmt
Expr: Assign | Expr , Assign
Assign: Cond | {Q = Assign | [Q = Assign | Left AssignOp Assign | Arrow | yield | yield Assign | yield * Assign
Arrow: ArrowHead => Assign | ArrowHead => {B
ArrowHead: id | async id | async~? (P
Cond: Bin | Bin ? Assign : Assign
Bin: Unary | Bin BinOp Unary
Unary: Left | Left ++ | Left -- | UnOp Unary | ++ Unary | -- Unary
UnOp: + | - | ! | ~ | typeof | void | delete | await
Left: Primary | Left . name | Left . private | Left . chain | Left ?. name | Left ?. chain | Left ?. (A | Left ?. [I | Left [I | Left (A | Left t | new Left
Primary: id | chain | this | super | n | s | r | t | null | true | false | (E | [L | {O | FuncAnon | ClassAnon | import (A | private in Unary
ArgElem: Assign | ... Assign
ObjElem: PropName : Assign | id | id = Assign | ... Assign | ObjMod~* PropName (P {B
ObjMod: async | get | set | *
Param: Bind | Bind = Assign | ... Bind
BindElem: Target | Target = Assign | ... Target
BindProp: id | id = Assign | PropName : Target | PropName : Target = Assign | ... id
Target: Bind | Left
ForHead: ForInit~? ; Expr~? ; Expr~? | Var Bind of Assign | Var Bind in Expr | Left of Assign | Left in Expr | {Q of Assign | [Q of Assign
ForInit: Expr | VarDecl
TemplatePart: Expr
JsxExpr: Expr | ... Assign | _
"""
OPERATORS = "AssignOp: " + " | ".join(p for p in PUNCTUATORS if p.endswith("=") and p not in ("==", "!=", "===", "!==", "<=", ">=") or p == "=") + " | =\nBinOp: " + " | ".join(["||_", "&&", "??", "BitOr", "^", "&", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "instanceof", "in", "<<", "> >", "> > >", "+", "-", "*", "/", "%", "**"]).replace("||_", "LogOr") + "\nBitOr: bar\nLogOr: barbar\n"
TYPED = """
Decl: Bind !~? Ann | Bind !~? Ann = Assign | Bind ! Ann
Simple: type id <P~? = Type | declare Stmt | FuncSig | export FuncSig | export default FuncSig | TypeExport | declare FuncSig | abstract ClassDecl
TypeExport: export type id <P~? = Type | export type {M | export type {M from s | export type * from s | export = Expr | export as namespace id | export import id = Expr | import id = Expr | export declare Stmt
Import: import type id from s | import type {M from s | import type * as id from s
Specifier: type name | type name as name
FuncSig: async~? function *~? id <P~? (P Ret~?
FuncDecl: async~? function *~? id <P~? (P Ret~? {B
FuncAnon: async~? function *~? id~? <P~? (P Ret~? {B
BlkEnd: Interface | export Interface | export default Interface | Enum | export Enum | Namespace | export Namespace | declare BlkEnd | export declare BlkEnd | declare global {B
Interface: interface id <P~? {T | interface id <P~? extends TypeList {T
TypeList: Named | TypeList , Named
Named: id <A~? | chain <A~?
Enum: const~? enum id {N
Namespace: namespace id {B | namespace chain {B | module id {B | module s {B
ClassDecl: Decor~* abstract~? class id <P~? Heritage~? Impl~? {K
ClassAnon: Decor~* abstract~? class <P~? Heritage~? Impl~? {K
Heritage: extends Left <A
Impl: implements TypeList
Mod: Access
FieldMod: Access
Access: public | private_ | protected | abstract | readonly | override | declare
BlkMember: Decor~* Mod~* PropName ?~? <P~? (P Ret~? {B
Field: Decor~* FieldMod~* PropName Mark~? Ann~? | Decor~* FieldMod~* PropName Mark~? Ann~? = Assign | Decor~* Mod~* PropName ?~? <P~? (P Ret~? | static~? readonly~? [X Ann
Mark: ? | !
ObjElem: ObjMod~* PropName <P~? (P Ret~? {B
Param: Decor~* ParamMod~* Bind ?~? Ann~? | Decor~* ParamMod~* Bind ?~? Ann~? = Assign | Decor~* ... Bind Ann~? | this Ann
ParamMod: public | private_ | protected | readonly | override
Catch: catch (P {B
ArrowHead: async~? <P~? (P Ret~?
Bin: Bin as Type | Bin as const | Bin satisfies Type
Left: Left ! | Left <A | Left ?. <A (A
ForHead: Var Bind Ann of Assign
Ann: : Type
Ret: : Type | : id is Type | : this is Type | : asserts id | : asserts id is Type
IndexSig: id : Type
TypeSeg: Member~?
Member: MemMod~* PropName ?~? Ann~? | MemMod~* PropName ?~? <P~? (P Ret~? | <P~? (P Ret~? | new <P~? (P Ret~? | readonly~? [X Ann | MapMod~? [Map ?~? Ann | MapMod~? [Map - ? Ann | MapMod~? [Map + ? Ann
MemMod: readonly | get | set
MapMod: readonly | - readonly | + readonly
MapHead: id in Type | id in Type as Type
TypeParam: TypeMod~* id | TypeMod~* id extends Type | TypeMod~* id = Type | TypeMod~* id extends Type = Type
TypeMod: const | in | out
TupleElem: Type | id ?~? : Type | Type ? | ... Type | ... id : Type
Type: Union | Union extends Union ? Type : Type | abstract~? new~? <P~? (P => Type | <P~? (P => id is Type | <P~? (P => asserts id
Union: TypePost | Bar TypePost | Union Bar TypePost
Bar: bar | &
TypePost: TypePrim | TypePost [0 | TypePost [Y1
TypePrim: Named | s | n | - n | true | false | null | void | this | t | {T | [Y | (T | typeof Named | typeof import (A | keyof TypePost | readonly TypePost | unique TypePost | infer id | infer id extends Type | import (A | import (A . name | import (A . name <A
EnumElem: PropName | PropName = Assign
TemplatePart: Type
"""
CAST = "Unary: <A Unary\n"
JSX = "Primary: J\n"
PHRASES_TYPED = {"[Map": "MapHead"}

NAMES: dict[str, frozenset] = {c: frozenset({w, "name"} | ({"id"} if w in SOFT else set()) | ({"private_"} if w == "private" else set())) for w, c in CODE.items() if w[0].isalpha()}
NAMES |= {c: frozenset({w}) for w, c in CODE.items() if not w[0].isalpha()}
NAMES |= {"|": frozenset({"bar"}), CODE["||"]: frozenset({"barbar"}), "i": frozenset({"id", "name"}), "m": frozenset({"chain"}), "p": frozenset({"private"}), "\n": frozenset()}
NAMES |= {c: frozenset({c}) for c in "nsrtJ"}

ANGLE = re.compile(r"<((?:[ims,|&=.n\-{s}]|[{g}])*)>(?=$|[{g},;\n=|&>.?:!)@ims{f}t])".replace("{s}", "".join(CODE[w] for w in (*SOFT, "extends", "typeof", "void", "null", "this", "true", "false", "=>", "...", "in", "new", "const", "import"))).replace("{g}", f"{chr(GROUP)}-{chr(0xF8FF)}").replace("{f}", "".join(CODE[w] for w in ("=>", "extends", "implements", "as", "async", "null", "this", "new", "function", "&&", "||", "??"))))


_STRINGS = r"""\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"""


def _templates(depth: int) -> str:
    """A template literal whose expressions nest up to ``depth`` further ones; deeper ones are left to the full reader."""
    inner = rf"(?:[^`{{}}'\"/]|{_STRINGS}|\{{(?:[^`{{}}'\"/]|{_STRINGS})*\}}" + (f"|{_templates(depth - 1)}" if depth else "") + ")*"
    return rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{inner}\}})*`"


_BEFORE_REGEX = r"(?:(?<=[(,=:\[!&|?{;])|(?<=[(,=:\[!&|?{;>] )|(?<=\breturn ))"
#: All tokens of a source in one pass, for sources without JSX. What it can't tell makes a chart fail, and the full reader decide.
FAST = re.compile(
    r"(?:[ \t\r\f\v]+|//[^\n]*|/\*[^*]*(?:\*(?!/)[^*]*)*\*/)*(?:("
    rf"\n|{_NOT_HEAD}{_WORD}(?:\.#?{_WORD})*|{_WORD}"
    r"|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$])"
    rf"|{_STRINGS}|{_templates(2)}|{_BEFORE_REGEX}{REGEX.pattern}"
    r"|" + "|".join(re.escape(p) for p in PUNCTUATORS) + rf"|\#{_WORD}|[\s\S])|\Z)"
)
FOLD = re.compile(r"([({\[])([^(){}\[\]]*)([)}\]])")
#: ``{a = 1}`` is a pattern, never an object.
ASSIGNED = re.compile(rf"(?:^|,)(?:i|[{''.join(CODE[w] for w in SOFT)}])=")
CLOSER = {"(": ")", "[": "]", "{": "}"}
_ENDS = "".join(map(re.escape, sorted(ENDS))) + f"{FIRST}-\uf8ff"
_STARTS = "".join(map(re.escape, sorted(STARTS)))
NO_END = re.compile(rf"(?<![{_ENDS}])\n+|\n+(?![{_STARTS}\n])")


class Symbols(dict):
    """The symbol of a token's text, remembered."""

    def __init__(self, script: "Script"):
        self.script = script

    def __missing__(self, text: str) -> str:
        if len(self) > REMEMBERED:
            self.clear()
        c = text[0] if text else ""
        if text in CODE:
            out = CODE[text]
        elif not text or text == "\n":
            out = text
        elif c in "\"'" and len(text) > 1:
            out = "s"
        elif c == "`" and len(text) > 1:
            out = "t" if not self.script.fold(text)[1] else "\0"
        elif c == "/" and len(text) > 1:
            out = "r"
        elif c == "#" and len(text) > 1:
            out = "p"
        elif c.isdigit() or (c == "." and len(text) > 1):
            out = "n"
        elif c == "_" or c == "$" or c.isalpha():
            out = "m" if "." in text else "i"
        else:
            out = "\0"
        if len(text) <= KEPT:
            self[text] = out
        return out


class Script:
    """One of the three languages. ``cost(source)`` is 0 exactly for sources that are derived."""

    def __init__(self, typed: bool, jsx: bool):
        self.typed, self.jsx = typed, jsx
        self.flags: dict[str, frozenset] = {}
        self.char: dict[frozenset, str] = {}
        self.folded: dict[tuple, str] = {}
        self.lists = {k: v for k, v in LISTS.items() if typed or k not in ("[Y", "{N", "<A", "<P")}
        self.phrases = {k: v for k, v in PHRASES.items() if typed or k not in ("(T", "[Y1", "[X")} | (PHRASES_TYPED if typed else {})
        self.bodies = {k: v for k, v in BODIES.items() if typed or k != "{T"}
        self.grammar = Grammar(BASE + OPERATORS + (TYPED if typed else "") + (CAST if typed and not jsx else "") + (JSX if jsx else ""), self._matches)
        self.symbols = Symbols(self)
        self.exact = self.lacking = False
        self.spent, self.edits, self.place = 0, [], 0

    def _fold(self, m: re.Match) -> str:
        bracket, text, end = m.groups()
        if CLOSER[bracket] != end:
            return "\0"
        if "\n" in text:
            text = NO_END.sub("", text).strip("\n")
        if self.typed and "<" in text:
            text = self.angles(text, False)
        before = ""
        if bracket == "{":
            at = m.start()
            before = m.string[at - 1 : at].strip("\n") or m.string[:at].rstrip("\n")[-1:]
            if before >= FIRST and not any(n[0] == "(" for n in self.flags.get(before, ())):
                before = "i"
            elif before in ")]}({[":
                before = "" if before in "({[" else "i"
        return self.group(bracket, text, False, before)

    def quick(self, source: str) -> bool:
        """True if the tokens of one pass are derived; False leaves the question to the full reader."""
        text = "".join(map(self.symbols.__getitem__, FAST.findall(source)))
        if "\0" in text:
            return False
        while True:
            new = FOLD.sub(self._fold, text)
            if new == text:
                break
            text = new
        text = NO_END.sub("", text).strip("\n")
        if self.typed and "<" in text:
            text = self.angles(text, False)
        return self.body("Seg", text, False) == 0

    def _matches(self, char: str) -> frozenset:
        return NAMES.get(char) or self.flags.get(char, frozenset())

    def symbol(self, flags: frozenset) -> str:
        if flags not in self.char:
            self.char[flags] = c = chr(GROUP + len(self.char))
            self.flags[c] = flags
        return self.char[flags]

    def angles(self, text: str, mend: bool) -> str:
        """``text`` with type arguments and parameters folded, innermost first."""
        while True:
            new = ANGLE.sub(lambda m: self.group("<", m[1], mend), text)
            if new == text:
                return text
            text = new

    def group(self, kind: str, content: str, mend: bool, before: str = "") -> str:
        """The character of a group; to mend, a group of no phrase is repaired and the cost is added to ``spent``."""
        key = (kind, content, before)
        out = self.folded.get(key)
        if out is None:
            if len(self.folded) > REMEMBERED:
                self.folded.clear()
            out = self.folded[key] = self.symbol(self._derive(kind, content, before))
        if mend and not self.flags[out]:
            kinds = self._kinds(kind, before)
            if self.exact or not self.spent:
                self.spent += self._cheapest(kinds, content)
                self.edits.append(self.place)
            out = self.symbol(frozenset(kinds))
        return out

    def _kinds(self, kind: str, before: str) -> list[str]:
        """The phrases that may stand at a bracket after the symbol ``before``: what a chart would predict there."""
        if kind != "{":
            return [k for d in (self.lists, self.phrases) for k in d if k[0] == kind]
        names = self._matches(before) if before else frozenset()
        if before in ("jsx",):
            return ["{X"]
        if not before or before in ";\n":
            out = ["{B", "{Q", "{O", "{T"]
        elif any(n[0] == "(" for n in names):
            out = ["{B", "{S", "{K"]
        elif before == CODE["=>"]:
            out = ["{B", "{T"]
        elif names & {"const", "let", "var"} and "id" not in names:
            out = ["{Q", "{N"]
        elif names & {"import", "export"}:
            out = ["{M"]
        elif names & {"else", "try", "finally", "do"}:
            out = ["{B"]
        elif before in ("=", ",", "?", ":", "&", "|") or before in (CODE["..."], CODE["return"], CODE["??"], CODE["||"], CODE["&&"], CODE["case"], CODE["default"]):
            out = ["{O", "{Q", "{T", "{M"] + (["{B"] if before == ":" else [])
        else:
            out = ["{B", "{K", "{T", "{N", "{M", "{O", "{Q", "{S"]
        return [k for k in out if k in self.bodies or k in self.lists]

    def _derive(self, kind: str, content: str, before: str) -> frozenset:
        out = [k for k in self._kinds(kind, before) if self._price(k, content, False) == 0]
        if kind == "[" and not content and self.typed:
            out.append("[0")
        return frozenset(out)

    def _cheapest(self, kinds: list[str], content: str) -> int:
        """The least cost of making ``content`` one of the phrases."""
        least = 0
        for k in kinds:
            cost = self._price(k, content, True)
            least = min(least, cost) if least else cost
            if least == 1:
                break
        return max(1, least)

    def _price(self, k: str, content: str, mend: bool) -> int:
        """0 if ``content`` is the phrase; else 1, or to mend the least edits of its pieces."""
        cost = (lambda start, text: self.grammar.repair(start, text, self.exact)) if mend else (lambda start, text: int(not self.grammar.derives(start, text)))
        if k in self.bodies:
            return self.body(self.bodies[k], content, mend)
        text = content.replace("\n", "")
        if k in self.lists:
            if not text:
                return int(k == "<A" or k == "<P")
            parts = text.split(",")
            if len(parts) > 1 and not parts[-1]:
                parts.pop()
            if k in ("[L", "[Q"):
                parts = [p for p in parts if p]
            if k == "{O" and ASSIGNED.search(text) and not mend:
                return 1
            return sum(cost(self.lists[k], p) for p in (parts if mend else dict.fromkeys(parts)))
        return cost(self.phrases[k], text)

    def body(self, start: str, content: str, mend: bool) -> int:
        """Statement lists: the cost of their statements."""
        if start == "TypeSeg":
            content = content.replace(",", ";")
        kept = CODE["else"]
        pieces = content.replace(";\n" + kept, ";" + kept).replace(";" + kept, "\0" + kept).split(";")
        derives = self.grammar.derives
        for piece in dict.fromkeys(pieces):
            if piece and not derives(start, piece.replace("\n", "").replace("\0", ";")):
                return self._statements(start, content, mend)
        return 0

    def _ends(self, start: str, lines: list[tuple[str, str]], k: int, reached: list[bool]) -> list[int]:
        """After which lines the statements that begin with line ``k`` may end; a line end is read as nothing and as a semicolon."""
        status, out, end = self.grammar.status, [], k + 1
        variants = {lines[k][1]}
        while True:
            states = {v: status(start, v) for v in variants}
            live = [v for v, state in states.items() if state >= PREFIX]
            known = reached[end]
            if any(state == WHOLE for state in states.values()):
                out.append(end)
            if not live or end == len(lines):
                return out
            by, text = lines[end]
            # a statement that ends with a bracket is followed by one that is met from there
            if known and text[0] in BEGINS and all(v[-1] >= FIRST for v in live):
                return out
            joined = {v + text for v in live} if by == "\n" else set()
            if text[0] in JOINERS:
                joined |= {v + ";" + text for v in live}
            if not joined:
                return out
            variants, end = joined, end + 1

    def _statements(self, start: str, content: str, mend: bool) -> int:
        lines = [("\n" if k else ";", x) for piece in content.split(";") for k, x in enumerate(y for y in piece.split("\n") if y)]
        n = len(lines)
        reached = [True] + [False] * n
        ends: list[list[int]] = [[] for _ in lines]
        for k in range(n):
            if reached[k]:
                ends[k] = self._ends(start, lines, k, reached)
                for end in ends[k]:
                    reached[end] = True
                if reached[n]:
                    return 0
        if not mend:
            return 1 if n else 0
        if not self.exact:
            stuck = max(k for k in range(n) if reached[k])
            self._note(start, content, lines, stuck)
            return self.grammar.repair(start, lines[stuck][1], False)
        best = [0] + [1 << 30] * n
        for k in range(n):
            if best[k] == 1 << 30:
                continue
            if not reached[k]:
                ends[k] = self._ends(start, lines, k, reached)
            for end in ends[k]:
                best[end] = min(best[end], best[k])
            if not ends[k]:
                self._note(start, content, lines, k)
                best[k + 1] = min(best[k + 1], best[k] + self.grammar.repair(start, lines[k][1], True))
        return best[n]

    def _note(self, start: str, content: str, lines: list, k: int) -> None:
        """Remembers where a repair is, and whether what is repaired only lacks more text."""
        self.edits.append(self.place)
        if k == len(lines) - 1 and content[-1:] != ";" and self.grammar.status(start, lines[k][1]) == PREFIX:
            self.lacking = True

    # -- lexing ------------------------------------------------------------------------------------------

    def fold(self, source: str, mend: bool = False) -> tuple[str, int, list[int]]:
        """The top content of ``source``, the cost of lexical and bracket repairs, and where they are."""
        self.spent, self.edits, self.place = 0, [], 0
        errors: list[int] = []
        stack: list[list] = []  # [bracket, parts of the content outside, symbol before]
        parts: list[str] = []
        line = False
        last = ""
        code, ends, starts, group = CODE.get, ENDS, STARTS, self.group
        pos, size = 0, len(source)
        jsx, typed = self.jsx, self.typed
        while pos < size:
            for m in TOKEN.finditer(source, pos):
                kind = m.lastgroup
                if kind == "space":
                    continue
                if kind == "line":
                    line = True
                    continue
                if kind == "word":
                    c = code(m[0], "i")
                    if c != "i" and last and last in ("." , CODE["?."]):
                        c = "i"
                elif kind == "chain":
                    c = "m"
                elif kind == "string":
                    c = "s"
                elif kind == "number":
                    c = "n"
                elif kind == "punct":
                    c = CODE[m[0]]
                    if c == "<" and jsx and not (last in ends or last >= FIRST):
                        if not GENERIC.match(source, m.end()):
                            pos = m.start()
                            break
                elif kind == "open":
                    self.place = m.start()
                    if line and last and (last in ends or last >= FIRST):
                        parts.append("\n")
                    stack.append([m[0], parts, last])
                    parts, last, line = [], "", False
                    continue
                elif kind == "close":
                    want = {")": "(", "]": "[", "}": "{"}[m[0]]
                    if not stack:
                        errors.append(m.start())
                        if not mend:
                            return "", 1, errors
                        continue
                    if stack[-1][0] != want:
                        if stack[-1][0] in "`J" and m[0] == "}":
                            pos = m.start()
                            break
                        errors.append(m.start())
                        if not mend:
                            return "", 1, errors
                        if not any(f[0] == want for f in stack):
                            continue
                        while stack[-1][0] != want:
                            parts, last = self._pop(stack, parts, mend)
                            errors.append(m.start())
                        errors.pop()
                    parts, last = self._pop(stack, parts, mend)
                    line = False
                    continue
                elif kind == "tick" or kind == "slash":
                    pos = m.start()
                    break
                elif kind == "private":
                    c = "p"
                elif kind == "bang":
                    continue
                else:
                    errors.append(m.start())
                    if not mend:
                        return "", 1, errors
                    continue
                if line:
                    if c in starts and (last in ends or last >= FIRST):
                        parts.append("\n")
                    line = False
                parts.append(c)
                last = c
            else:
                break
            # a token whose reading depends on what stands before it
            char = source[pos]
            if line and last and (last in ends or last >= FIRST) and char in "<`":
                parts.append("\n")
            if char == "/":
                m = None if last and (last in ends or last >= FIRST) else REGEX.match(source, pos)
                if m:
                    parts.append("r")
                    last, pos = "r", m.end()
                else:
                    c = CODE["/="] if source.startswith("/=", pos) else "/"
                    parts.append(c)
                    last, pos = c, pos + (1 if c == "/" else 2)
            elif char == "<":
                element, pos = self._element(source, pos, mend, errors)
                parts.append(element)
                last = element
                if errors and not mend:
                    return "", 1, errors
            elif char == "}":  # the end of a template's or an element's expression is met by its own reader
                errors.append(pos)
                pos += 1
                if not mend:
                    return "", 1, errors
            else:
                end, valid = self._template(source, pos, mend, errors)
                if errors and not mend:
                    return "", 1, errors
                parts.append("t")
                last, pos = "t", end
            line = False
        while stack:
            errors.append(size)
            if not mend:
                return "", 1, errors
            parts, last = self._pop(stack, parts, mend)
        return self.angles("".join(parts), mend) if typed else "".join(parts), len(errors), errors

    def _pop(self, stack: list, parts: list, mend: bool) -> tuple[list, str]:
        bracket, outer, before = stack.pop()
        text = "".join(parts)
        if self.typed and "<" in text:
            text = self.angles(text, mend)
        if bracket != "{":
            before = ""
        elif FIRST <= before and not any(n[0] == "(" for n in self.flags.get(before, ())):
            before = "i"
        last = self.group(bracket, text, mend, before)
        outer.append(last)
        return outer, last

    def _inner(self, source: str, pos: int, mend: bool, errors: list, start: str) -> int:
        """Reads an expression up to its closing brace; the place after it."""
        depth, at = 0, pos
        last = ""
        while at < len(source):
            m = TOKEN.match(source, at)
            kind = m.lastgroup
            if kind == "tick":
                at, _ = self._template(source, at, mend, errors)
                last = "t"
                continue
            if kind == "slash":
                r = None if last and (last in ENDS or last >= FIRST) else REGEX.match(source, at)
                at = r.end() if r else m.end()
                last = "r" if r else "/"
                continue
            if self.jsx and m[0] == "<" and not (last in ENDS or last >= FIRST):
                _, at = self._element(source, at, mend, errors)
                last = "J"
                continue
            if m[0] == "{":
                depth += 1
            elif m[0] == "}":
                if depth == 0:
                    break
                depth -= 1
            if kind not in ("space", "line"):
                last = "" if kind == "close" else {"word": CODE.get(m[0], "i"), "chain": "i", "string": "s", "number": "n"}.get(kind, ";")
            at = m.end()
        else:
            errors.append(len(source))
            return at
        spent, edits = self.spent, self.edits
        text, cost, _ = self._sub(source[pos:at], mend)
        self.spent, self.edits = self.spent + spent, edits
        text = text.replace("\n", "")
        if cost or not self.grammar.derives(start, text):
            errors.extend([pos] * max(1, cost + (self.grammar.repair(start, text, self.exact) if mend else 0)))
        return at + 1

    def _sub(self, text: str, mend: bool) -> tuple[str, int, list]:
        return self.fold(text, mend)

    def _template(self, source: str, pos: int, mend: bool, errors: list) -> tuple[int, bool]:
        pos += 1
        while True:
            pos = TEMPLATE.match(source, pos).end()
            if pos >= len(source):
                errors.append(len(source))
                return pos, False
            if source[pos] == "`":
                return pos + 1, True
            if source[pos] == "$":
                pos = self._inner(source, pos + 2, mend, errors, "TemplatePart")
            else:  # a backslash at the end
                errors.append(pos)
                return len(source), False

    def _element(self, source: str, pos: int, mend: bool, errors: list) -> tuple[str, int]:
        """Reads a JSX element from its '<'; the symbol and the place after it. An explicit stack holds open tags."""
        open_tags: list[str] = []
        size = len(source)
        while pos < size and not (errors and not mend):
            # at '<'
            pos = JSX_SPACE.match(source, pos + 1).end()
            closing = source.startswith("/", pos)
            if closing:
                pos = JSX_SPACE.match(source, pos + 1).end()
            m = JSX_NAME.match(source, pos)
            tag, pos = (m[0], m.end()) if m else ("", pos)
            single = False
            while True:
                pos = JSX_SPACE.match(source, pos).end()
                c = source[pos : pos + 1]
                if c == ">" or not c:
                    break
                if closing:
                    break
                if c == "/" and JSX_SPACE.match(source, pos + 1) and source[JSX_SPACE.match(source, pos + 1).end() : JSX_SPACE.match(source, pos + 1).end() + 1] == ">":
                    single, pos = True, JSX_SPACE.match(source, pos + 1).end()
                    break
                if c == "{":
                    pos = self._inner(source, pos + 1, mend, errors, "JsxExpr")
                    continue
                m = JSX_NAME.match(source, pos)
                if not m or not tag:
                    break
                pos = JSX_SPACE.match(source, m.end()).end()
                if source.startswith("=", pos):
                    pos = JSX_SPACE.match(source, pos + 1).end()
                    s = JSX_STRING.match(source, pos)
                    if s:
                        pos = s.end()
                    elif source.startswith("{", pos):
                        pos = self._inner(source, pos + 1, mend, errors, "Expr")
                    else:
                        break
            if source[pos : pos + 1] != ">":
                errors.append(pos)
                if not mend or pos >= size:
                    return "J", size if pos >= size else pos + 1
                return "J", pos + 1
            pos += 1
            if closing:
                if not open_tags or open_tags.pop() != tag:
                    errors.append(pos)
                    return "J", pos
            elif not single:
                open_tags.append(tag)
            if not open_tags:
                return "J", pos
            while True:  # children
                pos = JSX_TEXT.match(source, pos).end()
                if pos >= size:
                    errors.append(size)
                    return "J", size
                if source[pos] == "{":
                    pos = self._inner(source, pos + 1, mend, errors, "JsxExpr")
                elif source[pos] == "<":
                    break
                else:
                    errors.append(pos)
                    pos += 1
                if errors and not mend:
                    return "J", pos
        return "J", pos

    # -- the file ----------------------------------------------------------------------------------------

    def cost(self, source: str, exact: bool = False) -> int:
        """0 if the source is derived; else the least edits of its phrases, summed. Without ``exact`` the sum ends with the first phrase that costs anything."""
        source = source.removeprefix("\ufeff")
        if not self.jsx and self.quick(source):
            return 0
        text, cost, _ = self.fold(source)
        if not (cost or self.body("Seg", text, False)):
            return 0
        self.exact, self.lacking = exact, False
        text, cost, errors = self.fold(source, True)
        cost += self.spent
        if exact or not cost:
            cost += self.body("Seg", text, True)
        return max(1, cost)

    def places(self, source: str) -> tuple[list[int], bool]:
        """Where the repairs of an invalid source are (brackets and tokens, the last opening before a bad group, and top statements by their share
        of the symbols), and whether it ends before a phrase does."""
        source = source.removeprefix("\ufeff")
        self.exact, self.lacking = False, False
        text, _, errors = self.fold(source, True)
        out, done = errors + self.edits, 0
        self.lacking = False  # groups that are closed lack nothing
        self.body("Seg", text, True)
        for line in re.split(r"[;\n]", text):
            if line and not self.grammar.derives("Seg", line):
                out.append(int(len(source) * min(1.0, (done + len(line)) / max(1, len(text)))))
            done += len(line) + 1
        return out, self.lacking or any(p >= len(source) for p in errors)
