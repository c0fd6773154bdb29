"""Files that do not parse (problem 5): least-cost repairs by an error-correcting chart, per file.

Each file is parsed where it is read, in Arrow batches, without a shuffle; only its path and source
reach Python and only its cost and cause come back. The charts are shared by all files a worker meets.

Cost is 0 exactly for valid files. Otherwise it sums the least edits of the smallest phrases that can't be
derived (statements, lines, groups; a bracket or token that can't stand counts 1), so it is an upper bound of
the least edits of the whole file. To flag files, the sum ends with the first phrase that costs anything.

Cases: a null source has a null cost and is not flagged; an empty one is valid; a null path or one whose
extension is none of the four has a null cost. A byte order mark is ignored. Very long files are parsed
whole. Other columns of the input are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType([T.StructField("cost", T.IntegerType()), T.StructField("cause", T.StringType()), T.StructField("edits_at", T.DoubleType())])
CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: .*)?\r?$\n?", re.M)
_PARSERS: dict[str, object] = {}


def parser(extension: str):
    """The worker's parser of a language; its charts live as long as the worker."""
    if extension not in _PARSERS:
        from loomgraph.llm.syntax.python import Python
        from loomgraph.llm.syntax.script import Script

        _PARSERS[extension] = {"py": Python, "ts": lambda: Script(True, False), "tsx": lambda: Script(True, True), "js": lambda: Script(False, False)}[extension]()
    return _PARSERS[extension]


def language(path: str | None) -> str | None:
    extension = (path or "").rsplit(".", 1)[-1]
    return extension if extension in ("py", "ts", "tsx", "js") else None


def cost(path: str | None, source: str | None, exact: bool = False) -> int | None:
    of = language(path)
    if of is None or source is None:
        return None
    if source.isspace() or not source:
        return 0
    return parser(of).cost(source, exact)


def diagnose(path: str | None, source: str | None) -> tuple[int | None, str | None, float | None]:
    """Cost, cause and where the edits are on average, as a share of the file (0 start, 1 end).

    Conflict: removing the marker lines makes the file cheaper to repair. Mismatch: another of the four
    languages derives it as it stands. Truncation: the text ends before a bracket, string or the last phrase does,
    or its first edit is a closer that nothing opened. Mismatch again, if more than half of the lines need edits.
    """
    c = cost(path, source, True)
    if not c:
        return c, None, None
    of = language(path)
    places, lacking = parser(of).places(source)
    at = min(1.0, sum(places) / len(places) / max(1, len(source))) if places else None
    if CONFLICT.search(source) and cost(path, CONFLICT.sub("", source), True) < c:
        return c, "conflict", at
    if any(cost("x." + other, source) == 0 for other in ("py", "ts", "tsx", "js") if other != of):
        return c, "mismatch", at
    if lacking or (places and source[min(places) : min(places) + 1] in (")", "]", "}")):
        return c, "truncation", at
    if len(set(places)) > max(2, (source.count("\n") + 1) / 2):
        return c, "mismatch", at
    return c, "other", at


@F.pandas_udf(T.IntegerType())
def _cost(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for paths, sources in parts:
        yield pd.Series([cost(p, s) for p, s in zip(paths, sources)], dtype="Int32")


def is_invalid(path: Column, source: Column) -> Column:
    """True where the least repair costs anything."""
    return _cost(path, source) > 0


def diagnosis(path: Column, source: Column) -> Column:
    """``cost, cause, edits_at`` of each file."""

    @F.pandas_udf(RESULT)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, sources in parts:
            rows = [diagnose(p, s) for p, s in zip(paths, sources)]
            yield pd.DataFrame({"cost": pd.array([r[0] for r in rows], dtype="Int32"), "cause": pd.array([r[1] for r in rows], dtype="string"), "edits_at": pd.array([r[2] for r in rows], dtype="Float64")})

    return run(path, source)
