"""Scalar functions over names, paths and sources, as column expressions that stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each casing style matches.
CASINGS = {
    "camelCase": r"^[a-z][a-zA-Z0-9]*$",
    "PascalCase": r"^[A-Z][a-zA-Z0-9]*$",
    "snake_case": r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$",
    "SCREAMING_SNAKE_CASE": r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$",
    "kebab-case": r"^[a-z][a-z0-9]*(-[a-z0-9]+)*$",
}
# Scores of a search token against a candidate.
EXACT, PREFIX, SEGMENT, SEGMENT_PREFIX, CONTAINS = 120, 90, 80, 70, 60


def words_of(name: Column) -> Column:
    """Lower-case words of an identifier in any casing; a run of capitals is a word."""
    # fixed values: the two places at which a name is split
    apart = F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(apart), r"[_\-]+"), lambda w: w != "")


def matches_casing(name: Column, styles: list[str]) -> Column:
    """Whether a name, without leading underscores, has one of the styles; no style allows all, a name of underscores none."""
    if not styles:
        return F.lit(True)
    bare = F.regexp_replace(name, "^_+", "")
    return (bare != "") & reduce(lambda a, b: a | b, [bare.rlike(CASINGS[s]) for s in styles])


def to_casing(name: Column, style: str) -> Column:
    """The name in a style, leading underscores kept; null if the words can't be written so."""
    lead, words = F.regexp_extract(name, "^_*", 0), words_of(F.regexp_replace(name, "^_+", ""))
    capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    out = {
        "camelCase": F.concat(F.element_at(words, 1), F.array_join(F.slice(capital, 2, F.greatest(F.size(words) - 1, F.lit(0))), "")),
        "PascalCase": F.array_join(capital, ""),
        "snake_case": F.array_join(words, "_"),
        "SCREAMING_SNAKE_CASE": F.upper(F.array_join(words, "_")),
        "kebab-case": F.array_join(words, "-"),
    }[style]
    return F.when((F.size(words) > 0) & out.rlike(CASINGS[style]), F.concat(lead, out))


def first_forbidden(name: Column, words: list[str]) -> Column:
    """The first configured word among the words of a name, null if none."""
    own = words_of(name)
    return F.coalesce(*[F.when(F.array_contains(own, w.lower()), F.lit(w)) for w in words], F.lit(None).cast("string"))


def leading_verb(name: Column, verbs: list[str]) -> Column:
    """The first word of a name if it is one of the verbs, else null."""
    first = F.try_element_at(words_of(name), F.lit(1))
    return F.when(first.isin(verbs), first)


def path_segments(path: Column, root: str = "") -> Column:
    """Directories and file name below ``root``."""
    below = F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path) if root else path
    return F.filter(F.split(below, "/"), lambda s: s != "")


def loc(source: Column) -> Column:
    """Lines of a source: its line ends, plus one for a last line without; 0 if empty."""
    ends = F.length(source) - F.length(F.replace(source, F.lit("\n"), F.lit("")))
    return F.when(source == "", 0).when(source.endswith("\n"), ends).otherwise(ends + 1)


def line_of(source: Column, offset: Column) -> Column:
    """The 1-based line of a character offset."""
    before = F.substring(source, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(source: Column, offset: Column) -> Column:
    """The 1-based column of a character offset."""
    return F.length(F.substring_index(F.substring(source, F.lit(1), offset), "\n", -1)) + 1


def revision(source: Column) -> Column:
    """16 hex digits of SHA-256."""
    return F.substring(F.sha2(source, 256), 1, 16)


def key(*parts: Column) -> Column:
    """24 hex digits of SHA-256 over the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24)


def search_score(candidates: list[Column], query: str) -> Column:
    """The summed best scores of the query's tokens over the candidates; null if a token matches none, 1 without tokens."""
    tokens = [t for t in re.split(r"\s+", query.strip().lower()) if t]
    if not tokens:
        return F.lit(1)

    def one(candidate: Column, token: str) -> Column:
        c = F.lower(candidate)
        segments = F.filter(F.split(c, r"[/._-]"), lambda s: s != "")
        return (
            F.when(c == token, EXACT).when(c.startswith(token), PREFIX).when(F.array_contains(segments, token), SEGMENT)
            .when(F.exists(segments, lambda s: s.startswith(token)), SEGMENT_PREFIX).when(c.contains(token), CONTAINS)
        )

    best = [F.greatest(*[one(c, t) for c in candidates], F.lit(None).cast("int")) for t in tokens]
    return reduce(lambda a, b: a + b, best)


def glob_regex(pattern: str) -> str:
    """A regular expression for a path glob with ``*``, ``**``, ``?``, ``[...]`` and ``{a,b}``; dot files match."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def has_glob(text: Column) -> Column:
    return text.rlike(r"[*?\[\]{}]")


def matches_any(path: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(g)) for g in globs], F.lit(False))


def language_of(path: Column) -> Column:
    """The language of a file by its extension, null if unknown."""
    return (
        F.when(path.rlike(r"\.(?:tsx|jsx)$"), "tsx").when(path.rlike(r"\.(?:ts|mts|cts|js|mjs|cjs)$"), "typescript").when(path.rlike(r"\.pyw?$"), "python")
    )


def label(text: Column) -> Column:
    """A snapshot label fit for a file name; null if nothing fit is left."""
    clean = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_")
    return F.when(~clean.isin("", ".", ".."), clean)


def dist_to_source(path: Column) -> Column:
    """The source of a built file: ``dist`` at the start becomes ``src``, a declaration or script of any module kind a ``.ts`` file."""
    stem = F.regexp_extract(path, r"^(.*?)(?:\.d\.ts|\.[cm]?js)?$", 1)
    folder = F.regexp_replace(stem, r"^((?:\./)?)dist(?=/)", "$1src")
    return F.when(stem == path, folder).otherwise(F.concat(folder, F.lit(".ts")))


def name_matches(name: Column, wanted: str) -> Column:
    """A name or the last part of a dotted one."""
    return (name == wanted) | name.endswith("." + wanted)


def severity(level: Column) -> Column:
    """The diagnostic severity of a lint severity."""
    return F.when(level.isin("error", "2"), "error").when(level.isin("warn", "warning", "1"), "warning").when(level.isin("info", "information"), "info").otherwise("hint")


def symbol_uri(scheme: str, identifier: Column) -> Column:
    return F.concat(F.lit(scheme + ":"), F.replace(F.url_encode(identifier), F.lit("+"), F.lit("%20")))


def escape_dot(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_xml(text: Column) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")], text)


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def utf8_offset(source: Column, offset: Column) -> Column:
    """The UTF-8 byte offset of a character offset."""
    return F.octet_length(F.encode(F.substring(source, F.lit(1), offset), "UTF-8"))


def offset_of_utf8(source: Column, at: Column) -> Column:
    """The character offset of a UTF-8 byte offset; inside a character, that of the character."""
    # each byte as two digits; those that continue a character begin with 8, 9, A or B
    digits = F.hex(F.encode(source, "UTF-8"))
    begun = F.length(F.regexp_replace(F.substring(digits, F.lit(1), (at + 1) * 2), "[89AB][0-9A-F]|([0-7C-F])[0-9A-F]", "$1"))
    total = F.length(source)
    return F.when(at * 2 >= F.length(digits), total).otherwise(begun - 1)


def offset_at(source: Column, line: Column, column: Column) -> Column:
    """The character offset of a 1-based line and column; null outside the source."""
    lines = F.split(source, "\n", -1)
    before = F.aggregate(F.slice(lines, F.lit(1), line - 1), F.lit(0), lambda acc, x: acc + F.length(x) + 1)
    return F.when((line >= 1) & (line <= F.size(lines)) & (column >= 1) & (column <= F.length(F.try_element_at(lines, line)) + 1), before + column - 1)


def redacted(key_name: Column, value: Column, strict: bool = False, most: int = 512) -> Column:
    """A logged value: masked under keys that name secrets or sources; in strict mode cut at ``most`` characters."""
    secret = F.lower(key_name).rlike("password|passwd|secret|token|api_?key|authorization|cookie|credential")
    source = F.lower(key_name).rlike("^(?:source|sourcetext|content|body|text)$")
    shown = F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(value) if strict else value
    return F.when(secret, "[secret]").when(source, F.concat(F.lit("["), F.length(value).cast("string"), F.lit(" characters]"))).otherwise(shown)
