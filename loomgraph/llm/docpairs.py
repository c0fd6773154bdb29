"""Functions paired with their documentation (problem 4), in Spark SQL.

Sources are lexed into rows: comments, strings, brackets, line ends and runs of other text, each with its
place. Running sums over a file's tokens give the offset, bracket depth and line of each. Lines of the same
depth are then islands: a run of comment and decorator lines that nothing else interrupts belongs to the
line that ends it, and in Python a line of nothing but strings belongs to the line before. Lag and lead
windows over (file, depth) attach both to the declaration whose symbol starts on the line.

The pattern of a script's template nests twice; a file in which it meets a template that goes deeper, or holds braces it
can't pair, is lexed again with a stack (``lexed_by_stack``), in Arrow batches that carry no other file's text.

All windows and groupings after the first exchange are by file, so the tokens are shuffled never and the
sources once. A file is one group; a group is as large as the file, whatever the skew of repositories.

Cases: files with a null path or source, and symbols with a null id, file, range or kind, give no rows. Of
redelivered versions one is read (they repeat each other); of an id ingested again, too. An empty file has
no tokens. Offsets count characters (code points). Other columns of the inputs are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PY = r"""(?:[rRuUbBfFtT]{0,2})(?:\"\"\"[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+(?:\"\"\"|\z)|'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+(?:'''|\z)|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?)"""
PYTHON_TOKEN = rf"""#[^\n]*+|{_PY}|\r?\n[ \t\f]*+|[()\[\]{{}}]|[^\r\n#"'()\[\]{{}}]++|\r"""


def _template(depth: int) -> str:
    strings = r""""[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"""
    inner = rf"(?:[^`{{}}'\"/]++|/(?![/*])|{strings}|\{{(?:[^`{{}}'\"/]++|/(?![/*])|{strings})*+\}}" + (f"|{_template(depth - 1)}" if depth else "") + ")*+"
    return rf"`[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{{)|\$\{{{inner}\}})[^`\\$]*+)*+`" + ("" if depth < 2 else "?")


#: What a regular expression may follow.
_OPERAND = r"(?<=[(,=:\[!&|?{;][ ]{0,2}|\breturn )"
_AROUND = (
    r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)|//[^\n]*+"
    r"""|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"""
    r"|{template}"
    r"|{operand}/(?![*/])[^/\\\[\n]*+(?:(?:\\.|\[[^\]\\\n]*+(?:\\.[^\]\\\n]*+)*+\])[^/\\\[\n]*+)*+/"
    r"|\r?\n[ \t\f]*+|[()\[\]{}]|[^\r\n/`\"'()\[\]{}]++|[/\r]"
)
SCRIPT_TOKEN = _AROUND.replace("{template}", _template(2)).replace("{operand}", _OPERAND)
# the same for Python's engine, which looks back by a fixed width only, with the backtick alone
_FIXED = "(?:" + "|".join([rf"(?<=[(,=:\[!&|?{{;]{' ' * k})" for k in range(3)] + [r"(?<=\breturn )"]) + ")"
_STACK_TOKEN = re.compile(_AROUND.replace("{template}", "`").replace("{operand}", _FIXED).replace(r"\z", r"\Z"))
#: Only a template with one of these in an expression may go too deep.
RISKY = r"\$\{[^{}`'\"/]*+[{`'\"/]|`[^`]*\z"
_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")

# Words that stand for documentation still to be written, and tools that read comments.
PLACEHOLDER = r"(?i)^(?:todo|fixme|xxx|tbd|tba|wip|hack)\b.*$|^(?:n/?a|none|null|placeholder|doc ?string|documentation|description|summary|comment)s?[.: ]*$|^.*\b(?:description|documentation|docs?|doc ?string|summary|comment)\b.*\b(?:goes?|here|later|missing|pending)\b.*$|^(?:add|write|insert|fill in|document)\b.*\b(?:description|documentation|docs?|me|this|here)\W*$|^no (?:description|documentation)\b.*$|^lorem ipsum.*$"
DIRECTIVE = r"(?i)^(?:eslint|tslint|jslint|jshint|prettier|biome|stylelint|istanbul|c8|v8|noqa|nosec|nosonar|pylint|pyright|mypy|flake8|ruff|isort|fmt|yapf|black|pragma|type|ts-\w+|@ts-\w+|@flow|@jsx|@vite|webpack\w+|region|endregion|#region|#endregion|noinspection|nolint|deno-\w+|codeql|sonar|coverage|cspell|spell-?checker|global|globals|exported|jscpd|@generated|-\*-)(?:\s*[:=\-]|\b(?= (?:ignore|disable|enable|skip|off|on|next|no)\b)|\W*$).*$|^(?:@ts-|eslint-|tslint:|prettier-|istanbul |c8 |noqa|pylint:|type: ?ignore|pragma:?|ts-ignore|biome-|#?(?:end)?region\b).*$"
CODE = r"^(?:return|await|yield|import|from|const|let|var|if|elif|for|while|with|def|class|function|async|export|raise|throw|assert|del|print|try|switch|case)\b.*[(){}=;\[\]].*$|^.*[;{}]$|^(?:await )?[\w$.]+(?:\[[^\]]*\])*\([^)]*\)[;,]?$|^[\w$.\[\]'\"]+\s*(?::\s*[\w.\[\], ]+)?\s*[-+*/|&]?=(?!=|>).*$|^(?:return|break|continue|pass|else:?|try:|finally:)$"
TAG = [
    (r"\{@\w+[^}]*\}", ""),
    (r"^[@\\](?:param|parameter|arg|argument|prop|property|template|typeparam|throws|exception|raises)\b\s*(?:\{[^}]*\})?\s*(?:\[[^\]]*\]|[\w.$]+)?\s*[-–—:]*\s*", ""),
    (r"^[@\\](?:type|rtype|see|since|version|author|module|name|memberof|extends|implements|typedef|kind|access|category|group|default|enum|link|alias|borrows|license|copyright)\b.*$", ""),
    (r"^[@\\]\w+\b\s*(?:\{[^}]*\})?\s*[-–—:]*\s*", ""),
    (r"^:(?:type|rtype|vartype)\b[^:]*:.*$", ""),
    (r"^:\w+(?:\s+[^:]*)?:\s*", ""),
    (r"^(?:Args|Arguments|Params|Parameters|Returns?|Yields?|Raises|Throws|Examples?|Notes?|See Also|Attributes)\s*:?\s*$", ""),
]
# An inflected word may be each of these: its ending and what the plain word ends with.
_ENDINGS = [(r"s$", ""), (r"es$", ""), (r"ies$", "y"), (r"ed$", ""), (r"d$", ""), (r"ied$", "y"), (r"ing$", ""), (r"ing$", "e"), (r"er$", ""), (r"([bdgklmnprt])\1(?:ed|ing|er)$", "$1")]


def newest(contexts: DataFrame) -> DataFrame:
    """``file_path, source`` of the highest version of each file."""
    return (
        contexts.filter(F.col("file_path").isNotNull() & F.col("source").isNotNull())
        .groupBy("file_path").agg(F.max_by("source", F.coalesce("version", F.lit(-1))).alias("source"))
    )


def lexed_by_stack(source: str) -> list[str]:
    """The tokens of a script, templates of any nesting whole."""
    out, at = [], 0
    while at < len(source):
        m = _STACK_TOKEN.match(source, at)
        end = m.end() if m else at + 1
        if source[at] == "`":
            # open templates and the braces in their expressions
            stack = ["`"]
            while stack and end < len(source):
                if stack[-1] == "`":
                    end = _TEXT.match(source, end).end()
                    if source.startswith("${", end):
                        stack.append("{")
                        end += 2
                    else:
                        stack.pop()
                        end += 1
                    continue
                char = source[end]
                if char in "`{":
                    stack.append(char)
                elif char == "}":
                    stack.pop()
                m = None if char == "`" else _STACK_TOKEN.match(source, end)
                end = m.end() if m else end + 1
            end = min(end, len(source))
        out.append(source[at:end])
        at = end
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lexed_by_stack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for sources in parts:
        yield pd.Series([None if s is None else lexed_by_stack(s) for s in sources], dtype=object)


def _cut_off(tokens: Column) -> Column:
    """Whether the pattern couldn't follow a script's template to its end."""
    return F.exists(tokens, lambda t: t.startswith("`") & ((F.length(t) == 1) | ~t.endswith("`")))


def tokens(files: DataFrame) -> DataFrame:
    """``file_path, py, place, token``: a row for each token; the tokens of a file add up to its source. Files that ``deep_tokens`` reads have none."""
    py = F.col("file_path").endswith(".py")
    script = F.regexp_extract_all("source", F.lit(SCRIPT_TOKEN), F.lit(0))
    # in an array of one, so that the pattern runs once for the test and the tokens
    followed = F.get(F.transform(F.array(script), lambda t: F.when(_cut_off(t), F.array().cast("array<string>")).otherwise(t)), F.lit(0))
    lexed = F.when(py, F.regexp_extract_all("source", F.lit(PYTHON_TOKEN), F.lit(0))).otherwise(followed)
    return files.select("file_path", py.alias("py"), F.posexplode(lexed).alias("place", "token"))


def deep_tokens(files: DataFrame) -> DataFrame:
    """The same for scripts whose templates the pattern can't follow, by the stack."""
    risky = ~F.col("file_path").endswith(".py") & F.col("source").rlike(RISKY)
    deep = files.filter(risky & _cut_off(F.regexp_extract_all("source", F.lit(SCRIPT_TOKEN), F.lit(0))))
    return deep.select("file_path", F.lit(False).alias("py"), F.posexplode(_lexed_by_stack("source")).alias("place", "token"))


def lines(tokens: DataFrame) -> DataFrame:
    """A row for each line that is not blank: where it begins and ends, ``depth`` and ``indent`` at its start, and what it is.

    A line is told by its first token, the one that a line end precedes: ``kind`` c (nothing but a
    comment), s (nothing but strings), d (a decorator) or x; ``text`` holds a comment or string.
    """
    token, head = F.col("token"), F.substring("token", 1, 1)
    py, bare = F.col("py"), F.ltrim("token")
    comment = F.when(py, head == "#").otherwise(token.startswith("//") | token.startswith("/*"))
    kind = (
        F.when(head.isin("\n", "\r"), "n").when(comment, "c").when(py & token.rlike(r"""^[rRuUbBfFtT]{0,2}["']"""), "s")
        .when(bare == "", "b").when(bare.rlike(r"^@\s*[\w.$]+\s*$"), "d").otherwise("x")
    )
    flat = tokens.select(
        "file_path", "py", "place", kind.alias("kind"), F.length("token").alias("size"),
        F.when(head.isin("(", "[", "{"), 1).when(head.isin(")", "]", "}"), -1).otherwise(0).alias("step"),
        F.when(kind.isin("c", "s"), token).alias("text"),
    )
    over = Window.partitionBy("file_path").orderBy("place")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    placed = flat.select(
        "file_path", "py", "place", "kind", "text",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begin"),
        F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"),
        F.sum(F.when(F.col("kind") == "n", 1).otherwise(0)).over(over).alias("line"),
        F.lag("kind", 1, "n").over(over).alias("last"),
        F.lag("size", 1, 0).over(over).alias("indent"),
        F.lead("kind", 1, "n").over(over).alias("next"),
    )
    first = placed.filter((F.col("last") == "n") & ~F.col("kind").isin("n", "b"))
    alone = F.col("next").isin("n", "b") | ((F.col("kind") == "s") & (F.col("next") == "c"))
    return first.select(
        "file_path", "py", "line", "begin", "depth", "indent",
        F.lead("begin", 1, 1 << 60).over(over).alias("end"),
        F.when(F.col("kind").isin("c", "s") & ~alone, "x").otherwise(F.col("kind")).alias("kind"),
        F.when(alone, F.col("text")).alias("text"),
    )


def documented_lines(lines: DataFrame) -> DataFrame:
    """``file_path, begin, end, above, docstring`` of the code lines that have either."""
    same = Window.partitionBy("file_path", "depth").orderBy("line")
    so_far = same.rowsBetween(Window.unboundedPreceding, 0)
    # a run ends after a line that hangs on nothing, or where the next line isn't directly below (a decorator's arguments may stand between)
    joined = F.lag("kind").over(same).isin("c", "d") & ((F.lag("line").over(same) + 1 == F.col("line")) | (F.lag("kind").over(same) == "d"))
    # a comment of many lines is one token: its line ends are inside it
    runs = lines.withColumn("starts", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("starts").over(so_far))
    comments = F.when(F.col("kind") == "c", F.col("text"))
    above = runs.withColumn("above", F.array_join(F.collect_list(comments).over(Window.partitionBy("file_path", "depth", "run").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)), "\n"))
    # what follows a line of code at its depth, comments left out
    code = above.filter(F.col("kind") != "c")
    text = F.lead(F.when(F.col("kind") == "s", F.col("text"))).over(same)
    constant = (F.lead("indent").over(same) > F.col("indent")) & ~text.rlike(r"^[rRuU]?[bBfFtT]")
    doc = F.when(F.col("py") & constant, text)
    return (
        code.withColumn("docstring", doc)
        .filter((F.col("kind") != "d") & ((F.col("above") != "") | F.col("docstring").isNotNull()))
        .select("file_path", "begin", "end", "above", F.coalesce("docstring", F.lit("")).alias("docstring"))
    )


def _replace_all(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def _plain(word: Column) -> Column:
    """The plain words that ``word`` may be an inflection of, itself included."""
    return F.array(word, *[F.regexp_replace(word, pattern, to) for pattern, to in _ENDINGS])


def _words(text: Column) -> Column:
    """Lower-case words, parts of camelCase and snake_case names apart."""
    return F.split(F.lower(F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")), r"[^\p{L}]+")


def meaningful(text: Column, name: Column, comment: bool) -> Column:
    """The lines of a documentation text that say something, without marks, tags and what is trivial."""
    marks = r"^\s*(?:/\*+|\*+/|\*(?!\*)|//+[!/]?|#+!?)?\s*|\s*\*+/\s*$|\s+$" if comment else r"^\s*(?:[rRuU]?(?:\"\"\"|'''|\"|'))?\s*|\s*(?:\"\"\"|'''|\"|')\s*$|\s+$"
    own = F.flatten(F.transform(F.filter(_words(name), lambda w: w != ""), _plain))
    bare = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, marks, ""), r"^[\s*]+|[\s*]+$", "")))
    bare = F.filter(bare, lambda x: ~(x.rlike(PLACEHOLDER) | x.rlike(DIRECTIVE) | (x.rlike(CODE) if comment else F.lit(False))))
    told = F.transform(bare, lambda x: F.trim(_replace_all(x, TAG)))
    told = F.filter(told, lambda x: ~x.rlike(PLACEHOLDER) & ~x.rlike(r"^[-=*#~_+.]{2,}.*[-=*#~_+.]{2,}$"))
    new = lambda x: F.exists(_words(x), lambda w: (F.length(w) > 1) & ~w.isin("a", "an", "the") & ~F.arrays_overlap(_plain(w), own))
    return F.filter(told, new)


def function_symbols(symbols: DataFrame) -> DataFrame:
    """``id, name, file, start, stop`` of functions and methods, each id once."""
    known = symbols.filter(F.col("kind").isin("function", "method") & F.col("id").isNotNull() & F.col("file").isNotNull() & F.col("range.start").isNotNull())
    return known.select("id", "name", "file", F.col("range.start").alias("start"), F.col("range.end").alias("stop")).distinct()


def documentation(contexts: DataFrame, symbols: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """``symbol_id, file_path, start, stop, documentation`` of each function or method whose documentation says something.

    A symbol finds its line by order: lines and symbols of a file are sorted by offset and each symbol
    takes the last line that began before it (an as-of join without a join).
    """
    files = newest(contexts) if latest is None else latest
    found = documented_lines(lines(tokens(files))).unionByName(documented_lines(lines(deep_tokens(files))))
    s = function_symbols(symbols)
    both = found.select("file_path", F.col("begin").alias("at"), F.lit(0).alias("sort"), F.struct("end", "above", "docstring").alias("doc"), F.lit(None).cast("struct<id:string,name:string,stop:int>").alias("s")).unionByName(
        s.select(F.col("file").alias("file_path"), F.col("start").cast("bigint").alias("at"), F.lit(1).alias("sort"), F.lit(None).cast(found.select(F.struct("end", "above", "docstring").alias("d")).schema["d"].dataType).alias("doc"), F.struct("id", "name", "stop").alias("s"))
    )
    order = Window.partitionBy("file_path").orderBy("at", "sort").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("doc", F.last("doc", ignorenulls=True).over(order)).filter(F.col("s").isNotNull() & (F.col("at") < F.col("doc.end")))
    told = F.concat(meaningful(F.col("doc.above"), F.col("s.name"), True), meaningful(F.col("doc.docstring"), F.col("s.name"), False))
    return (
        placed.select(F.col("s.id").alias("symbol_id"), "file_path", F.col("at").alias("start"), F.col("s.stop").alias("stop"), told.alias("told"))
        .filter(F.size("told") > 0)
        .select("symbol_id", "file_path", "start", "stop", F.array_join("told", "\n").alias("documentation"))
    )


def pairs(contexts: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbol_id, file_path, code, documentation``."""
    latest = newest(contexts)
    found = documentation(contexts, symbols, latest)
    return found.join(latest, "file_path").select("symbol_id", "file_path", F.col("source").substr(F.col("start") + 1, F.col("stop") - F.col("start")).alias("code"), "documentation")
