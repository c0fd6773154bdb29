"""Files that nobody wrote by hand (problem 1): generated, minified, vendored, or data kept as code.

Three linear support-vector classifiers on hashed character n-grams propose files: one reads bodies (comments masked, so
that no notice gives them away) with path components and line layout, one the clauses of the comments on the file (at its
head, its end or alone between; digits masked), one tells copies of known libraries from longer n-grams of bodies. They are
fitted on a bounded sample of weakly labelled rows (``SAMPLE_ROWS`` expected rows, all of known_libs, whole and in
quarters). A fifth of the repositories is held out: neither weights nor thresholds know them, and they tell recall. A
threshold lies ``MARGIN`` below every label of the fitted repositories. An exact check then confirms each proposed file: a
notice, a place, a copy's shared shingles, or a body of literals, packed or repeated lines.

Scoring is a pass over the rows in Arrow batches with no shuffle. Broadcast are the weights (4 x 2**16
floats) and the shingles of known_libs, a fixed table of libraries whose size is checked before it is read.

Cases: a null source or path is no case; empty files and files of white space are none. All versions of a
file with a found version are found. Very long files are read whole. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 1 << 16
#: Lengths of the n-grams by classifier: a copy is told by longer ones.
GRAMS = {"body": (3, 5), "notice": (3, 5), "copy": (8, 12)}
CHUNK = 1 << 20
SAMPLE_ROWS = 4000
#: Expected characters of the sample at most, so that long files don't fill the driver.
SAMPLE_CHARS = 40_000_000
MARGIN = {"body": 0.6, "notice": 0.1, "copy": 0.25}
#: known_libs is broadcast as hashed shingles; a larger table is refused.
MOST_LIBRARY_CHARS = 20_000_000
SHINGLE_WORDS = 5
#: Characters without comments from which a body has a shape: below, it is the small table or the one long line that is no case.
LEAST_BODY = 600
#: Share of a file's shingles that one library file must hold for it to be its copy, slightly changed or not.
COPY_SHARE = 0.7

HEAD = re.compile(r"\A﻿?(?:\s*(?:#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''))*")
COMMENT = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|/\*[\s\S]*?\*/|//[^\n]*|^[ \t]*#[^\n]*", re.M)
#: Strings come first, so what looks like a comment in one stays.
STRING_OR_COMMENT = re.compile(r"(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|/\*[\s\S]*?\*/|//[^\n]*|^[ \t]*#[^\n]*)|(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')", re.M)
LITERAL = re.compile(r"(?:[bru]?\"(?:[^\"\\\n]|\\.)*\"|[bru]?'(?:[^'\\\n]|\\.)*'|\b0x[0-9a-fA-F]+\b|-?\b\d[\w.]*|[\[\],{}:()\s]++|\b(?:true|false|null|None|True|False)\b)++")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
#: A pattern of many alternatives is one long line of a file, not data or packed code.
PATTERN = re.compile(r"[rR]?\"(?:[^\"\\\n]|\\.)*\"|[rR]?'(?:[^'\\\n]|\\.)*'|/(?![*/])(?:[^/\\\n]|\\.)+/")
#: Comments (group 1), and what may hold the look of one: strings, templates, patterns.
REMARK = re.compile(
    r"(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|/\*[\s\S]*?\*/|//[^\n]*|(?:^|(?<=[ \t]))#[^\n]*)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|/(?![*/])(?:[^/\\\n]|\\.)+/", re.M
)
#: What comes after a comment that stands alone: a blank line or the end.
_AFTER = r"[ \t\r]*(?:\Z|\n[ \t\r]*(?:\n|\Z))"
ALONE = re.compile(_AFTER)
#: What may be the end of one, found without telling strings from comments.
MAYBE_ALONE = re.compile(r"(?:^(?:#|//)[^\n]*|\*/|\"\"\"|''')" + _AFTER, re.M)
DIGITS = re.compile(r"\d+")
NUMBERED = re.compile(r"\w*\d\w*")
WORD = re.compile(r"\w+")

_TO_ITSELF = r"(?:this|these|the following)?\s*(?:(?:\w+\s+)?(?:file|module|code|script|source|sources|header|bindings|stubs?|client|class|types?|bundle|package|document|table|output|contents?))"
_WAS = r"(?:,?\s*(?:was|were|is|are|has been|have been)?\s*)"
_MAKING = r"(?:auto[- ]?|machine[- ]?)?(?:generated|produced|created|built|rebuilt|emitted|compiled|transpiled|rendered|derived|written|made)"
# How tools and vendors mark files. A mark opens a clause of the comments on the file (``remarks``), outside quotes, so one
# about other files, told by a verb of its own, is none.
SURE = re.compile(
    r"(?i)(?<![\w.])@generated\b|<auto[- ]\w+>|\bauto(?:matically)?[- ]?(?:generated|written|created)\b(?=.*\b(?:file|by|on|from|code|do not|don't)\b|\W*$)|\bmachine[- ](?:written|generated|made)\b"
)
#: The clause tells how the file was made.
OPENS = re.compile(
    rf"(?i)^\W*(?:(?:note|warning|caution|attention|important)\W+)?(?:{_TO_ITSELF}{_WAS})?(?:automatically\s+)?(?P<how>{_MAKING})\b(?:\s+(?:automatically|code|file))?(?P<by>\s*(?:by|from|with|using|via|on|out of|at)\b(?!\s+(?:hand|people|humans?|me|us|top)\b)|\W*$)"
    r"|^\W*producer:\s*[\w.-]+|^\W*(?:warning\W+)?output of [\w./-]+"
)
#: Tells readers to leave this file alone.
KEEP_OFF = re.compile(
    r"(?i)\b(?:do not|don't|never|please don't) (?:hand[- ]?)?(?:edit|modify|touch|change|alter)\b(?:\s+(?:this|these)(?: \w+)?\b|\s+(?:by hand|manually|directly|it|them|anything)\b|\s*(?:[.!:;,(*]|\W*$))|\bnot (?:meant|intended) (?:for|to be) (?:review|reading|edit\w*|read|changed)\b"
    r"|\b(?:hand|manual|your|local|any|all)\s+(?:edits?|changes?|modifications?)\b.*\b(?:lost|overwritten|disappear\w*|discarded|vanish\w*|reverted)\b|(?<!not )(?<!n't )\bedit the (?:template|schema|source|input|spec|generator|definition)\b"
)
#: Says how the file is made again: a mark only beside a clause that tells of its making.
REMAKE = re.compile(r"(?i)\bregenerate\b|\bto (?:rebuild|refresh)\b|\b(?:checksum|rerun|re-run|run)\b.*\b(?:refresh|rebuild|update)")
VENDORED = re.compile(
    r"(?i)\bthird[- ]party (?:code|library|source|component)\b|\b(?:bundled|vendored|verbatim|unmodified|local) copy of\b|\bvendored from\b|\b(?:taken|copied|imported|forked|adapted|borrowed) (?:unchanged |verbatim )?from (?:https?:|the [\w.-]+ (?:project|library|package))|\bcopied (?:unchanged|verbatim)\b|\bredistributed under\b|\bits own license\b"
    r"|\bupstream(?: release|:|,| version)|\bsend (?:fixes|patches) upstream\b|^\W*origin: [\w.-]+,|\bpermission is granted under the [\w.-]+ license|^/\*! ?[\w@./-]+ v?\d[\w.]*|\blocal (?:changes|modifications): \w+|\(c\) (?:\d{4} )?[\w-]+ (?:maintainers|contributors)"
)
CLAUSE = re.compile(r"(?<=[.;])\s+|(?<=\w!)\s+")
#: Ways of making that no one does by hand; others need a clause of REMAKE too.
FIRM = re.compile(r"(?i)generated|emitted|transpiled")
QUOTED = re.compile(r"(?<!\w)'[^'\n]*'|\"(?!\"\")[^\"\n]*\"")
PLACE = re.compile(r"/(?:vendor|_vendor|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|site-packages|dist-packages|extern|external|deps/upstream|jspm_packages)/(?=[^/]+/)")
PACKED_NAME = re.compile(r"[.-]min\.js$|\.bundle\.js$")

RESULT = T.StructType([T.StructField("body", T.FloatType()), T.StructField("notice", T.FloatType()), T.StructField("copy", T.FloatType()), T.StructField("reason", T.StringType())])


def code_of(source: str, by: str = "") -> str:
    """The source without comments, ``by`` for each and after each string."""
    return STRING_OR_COMMENT.sub(r"\1" + by, source)


def head(source: str) -> str:
    return HEAD.match(source)[0]


def remarks(source: str) -> str:
    """The comments on the file: its head, and below it blocks at the start of a line that stand alone, as at the end. One right above code or in it is about that code."""
    top = head(source)
    if not MAYBE_ALONE.search(source, len(top)):
        return top
    out, block, end = [top], [], -1
    for m in REMARK.finditer(source, len(top)):
        if m[1] is None:
            continue
        at = m.start()
        if block and source[end:at].strip():
            block = []
        if at and source[at - 1] != "\n":
            continue
        block.append(m[1])
        end = m.end()
        if ALONE.match(source, end):
            out += block
            block = []
    return "\n".join(out)


def clauses(comments: str) -> Iterator[str]:
    """The clauses of each line, without what is quoted."""
    for line in comments.splitlines():
        yield from CLAUSE.split(QUOTED.sub(" ", line) if line.count("`") < 2 else line)


def mark(clause: str) -> str | None:
    """generated or vendored, if the clause says so by itself; made or again, if it takes both to say it."""
    made = OPENS.search(clause)
    if SURE.search(clause) or KEEP_OFF.search(clause) or (made and (made["how"] is None or FIRM.search(made["how"]))):
        return "generated"
    if VENDORED.search(clause):
        return "vendored"
    return "made" if made else "again" if REMAKE.search(clause) else None


def said(comments: str) -> str | None:
    found = set()
    for clause in clauses(comments):
        m = mark(clause)
        if m in ("generated", "vendored"):
            return m
        found.add(m)
    return "generated" if {"made", "again"} <= found else None


def shape(source: str) -> str | None:
    """data, minified or generated, if the body is mainly literals, packed long lines, or lines repeated up to numbered names."""
    body = code_of(source)
    if body.count("|") >= 8:
        body = PATTERN.sub(lambda m: '""' if m[0].count("|") >= 8 and len(m[0]) > 100 else m[0], body)
    size = len(body)
    if size < LEAST_BODY:
        return None
    if len(LITERAL.sub("", body)) < 0.15 * size:
        return "data"
    rows = [x for x in body.split("\n") if x.strip()]
    packed = sum(len(x) for x in rows if len(x) > 200)
    longest = max((len(x) for x in rows), default=0)
    if packed > 0.6 * size and size > 150 * len(rows) and sum(map(body.count, " \n\t")) < 0.2 * size and (len(STRING.sub("", body)) > 0.5 * size or longest < 0.5 * size):
        return "minified"
    kinds = {NUMBERED.sub("0", x.strip()) for x in rows}
    if len(rows) >= 20 and len(kinds) < 0.5 * len(rows):
        return "generated"
    return None


def shingles(source: str) -> np.ndarray:
    """Hashes of all runs of five words of the code, comments left out."""
    words = WORD.findall(code_of(source, " "))
    if len(words) < SHINGLE_WORDS:
        return np.empty(0, np.uint64)
    ids = np.fromiter((_stable(w) for w in words), np.uint64, len(words))
    out = np.zeros(len(ids) - SHINGLE_WORDS + 1, np.uint64)
    for k in range(SHINGLE_WORDS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(out)]
    return np.unique(out)


_WORD_IDS: dict[str, int] = {}


def _stable(word: str) -> int:
    """A hash of a word that is the same in every process."""
    out = _WORD_IDS.get(word)
    if out is None:
        import xxhash

        if len(_WORD_IDS) > 100_000:
            _WORD_IDS.clear()
        out = _WORD_IDS[word] = xxhash.xxh64_intdigest(word)
    return out


def _hashed(buffer: np.ndarray, n: int) -> np.ndarray:
    """The number of the n-gram that begins at each byte; long ones are put together from runs of four."""
    step = 4 if n % 4 == 0 else n
    run = np.zeros(max(0, len(buffer) - step + 1), np.uint32)
    for k in range(step):
        run = run * np.uint32(0x01000193) + buffer[k : k + len(run)]
    h = run[: max(0, len(buffer) - n + 1)].copy()
    for k in range(step, n, step):
        h = h * np.uint32(0x9E3779B1) + run[k : k + len(h)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return (h & np.uint32(DIMS - 1)).astype(np.int32)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def grams(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """The n-gram numbers of a text."""
    b = np.frombuffer(_bytes(text), np.uint8).astype(np.uint32)
    return np.concatenate([_hashed(b, n) for n in sizes])


def places(path: str) -> list[int]:
    """The numbers of a path's components below its package, extensions and name parts."""
    parts = path.split("/")[2:]
    return [_stable("path:" + re.sub(r"[\d]+", "0", p)) % DIMS for p in parts[:-1]] + [_stable("file:" + x) % DIMS for x in re.findall(r"[.-][a-z]+", parts[-1] if parts else "")]


def layout(body: str) -> list[int]:
    """The numbers of a body's line length (by doubling) and share of white space (by twentieths)."""
    lines = body.count("\n") + 1
    blank = sum(map(body.count, " \n\t"))
    return [_stable(f"line:{int(np.log2(len(body) / lines + 1))}") % DIMS, _stable(f"blank:{20 * blank // max(1, len(body))}") % DIMS]


@dataclass
class Model:
    """Weights of the three classifiers (and of the body's path), their thresholds and how they did on held-out repositories."""

    text: np.ndarray
    path: np.ndarray
    least: np.ndarray
    report: list[tuple[str, int, int, float | None, float]]


def _fit(rows: list[np.ndarray], extra: list[list[int]], y: np.ndarray, epochs: int = 6, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """A linear SVC by stochastic subgradients of the hinge loss, both classes weighing the same; the mean of the later weights."""
    w, v = np.zeros(DIMS, np.float64), np.zeros(DIMS, np.float64)
    mw, mv, n = np.zeros_like(w), np.zeros_like(v), 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    rng, t = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        for k in rng.permutation(len(y)):
            t += 1
            rate = 1.0 / (1 + 0.002 * t)
            x, p = rows[k], extra[k]
            norm = max(1.0, len(x)) ** 0.5
            if y[k] * (w[x].sum() / norm + v[p].sum()) < 1:
                step = rate * y[k] * min(weight[k], 8.0)
                np.add.at(w, x, 0.1 * step / norm)
                v[p] += 0.1 * step
        w *= 1 - decay * len(y) * 0.01
        v *= 1 - decay * len(y) * 0.01
        if epoch >= epochs // 2:
            mw, mv, n = mw + w, mv + v, n + 1
    return mw / n, mv / n


def masked(source: str) -> str:
    """The body without comments."""
    return COMMENT.sub(" ", source)


def told(comments: str) -> list[str]:
    """The distinct clauses of comments as the classifier reads them: digits masked."""
    return sorted({DIGITS.sub("0", c.strip()) for c in clauses(comments)} - {""})


def quarters(text: str) -> list[str]:
    """A text and its quarters by lines, so that a copy of a part is known too."""
    lines = text.split("\n")
    size = -(-len(lines) // 4)
    return [text] + ["\n".join(lines[k : k + size]) for k in range(0, len(lines), size) if size < len(lines)]


def score(texts: list[str], weights: np.ndarray, grams_of: tuple[int, ...]) -> np.ndarray:
    """The weights of each text's n-grams, summed and divided by the root of their number; about a megabyte is hashed at once."""
    out = np.zeros(len(texts))
    first = 0
    while first < len(texts):
        parts, size, last = [], 0, first
        while last < len(texts) and (last == first or size < CHUNK):
            parts.append(_bytes(texts[last]))
            size += len(parts[-1])
            last += 1
        b = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        sizes = np.array([len(x) for x in parts])
        ends = np.cumsum(sizes)
        sums, counts = np.zeros(len(parts)), np.zeros(len(parts))
        for n in grams_of:
            # an n-gram belongs to the text that holds all of it
            total = np.concatenate([[0.0], np.cumsum(weights[_hashed(b, n)], dtype=np.float64)])
            begin, end = ends - sizes, np.maximum(ends - sizes, ends - n + 1)
            sums += total[np.minimum(end, len(total) - 1)] - total[np.minimum(begin, len(total) - 1)]
            counts += end - begin
        out[first:last] = sums / np.sqrt(np.maximum(1, counts))
        first = last
    return out


def library_sources(known_libs: DataFrame) -> list[str]:
    """The library files; the table's size is checked before it is gathered."""
    libs = known_libs.filter(F.col("source").isNotNull())
    if (libs.agg(F.sum(F.length("source"))).first()[0] or 0) > MOST_LIBRARY_CHARS:
        raise ValueError("known_libs is larger than what may be broadcast")
    return [r[0] for r in libs.select("source").orderBy("lib_name", "lib_version", "rel_path").collect()]


def copied(source: str, table: tuple[np.ndarray, np.ndarray]) -> float:
    """The largest share of the file's shingles that one library file holds."""
    own = shingles(source)
    if not len(own):
        return 0.0
    left, right = np.searchsorted(table[0], own, "left"), np.searchsorted(table[0], own, "right")
    hits = [table[1][a:b] for a, b in zip(left, right) if b > a]
    if not hits:
        return 0.0
    return float(np.bincount(np.concatenate(hits)).max() / len(own))


def shingle_table(libraries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All library shingles sorted, with the file of each."""
    if not libraries:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    keys = np.concatenate(libraries)
    of = np.repeat(np.arange(len(libraries), dtype=np.int32), [len(x) for x in libraries])
    order = np.argsort(keys, kind="stable")
    return keys[order], of[order]


def train(contexts: DataFrame, libs: list[str], rows: int = SAMPLE_ROWS) -> Model:
    """Fits the classifiers on about ``rows`` contexts (and ``SAMPLE_CHARS`` characters) chosen by the hash of their path."""
    size = contexts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("source")).alias("chars")).first()
    share = min(1.0, rows / max(1, size["n"]), SAMPLE_CHARS / max(1, size["chars"] or 0))
    chosen = F.pmod(F.xxhash64("file_path"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)
    sample = contexts.filter(F.col("source").isNotNull() & F.col("file_path").isNotNull() & chosen).select("file_path", "source").distinct().toPandas().sort_values(["file_path", "source"])
    return fit(sample.file_path.tolist(), sample.source.tolist(), libs)


def fit(paths: list[str], sources: list[str], libs: list[str]) -> Model:
    table = shingle_table([shingles(x) for x in libs])
    own = [remarks(s) for s in sources]
    marked = np.array([said(x) is not None for x in own], bool)
    shaped = np.array([shape(s) is not None for s in sources], bool)
    copies = np.array([copied(s, table) >= COPY_SHARE for s in sources], bool)
    place = np.array([bool(PLACE.search(p)) for p in paths], bool)
    held = np.array([_stable("repo:" + p.split("/")[2] if p.count("/") > 2 else p) % 5 == 0 for p in paths], bool)
    bodies = list(map(masked, sources))
    parts = [told(x) for x in own]
    routes = [places(p) + layout(b) for p, b in zip(paths, bodies)]
    plain = ~(marked | place | shaped)
    # rows to fit on: a file of another classifier's kind is no example against
    taken = {"body": ~held & ((shaped | place) | ~marked), "copy": ~held & (copies | plain)}
    text, path, least, report = [], np.zeros(DIMS), [], []
    for name, y in {"body": shaped | place, "notice": marked, "copy": copies}.items():
        sizes = GRAMS[name]
        if name == "notice":
            known = sorted({c for k in np.flatnonzero(~held) for c in parts[k]})
            xs, ys = [grams(c, sizes) for c in known], np.array([1 if mark(c) else -1 for c in known])
            rs: list[list[int]] = [[]] * len(xs)
        else:
            at = np.flatnonzero(taken[name])
            xs, ys, rs = [grams(bodies[k], sizes) for k in at], np.where(y[at], 1, -1), [routes[k] if name == "body" else [] for k in at]
            if name == "copy":
                more = [grams(x, sizes) for lib in libs for x in quarters(masked(lib))]
                xs, ys, rs = xs + more, np.concatenate([ys, np.ones(len(more), int)]), rs + [[]] * len(more)
        w, v = _fit(xs, rs, ys) if len(set(ys.tolist())) == 2 else (np.zeros(DIMS), np.zeros(DIMS))
        s = file_scores(name, bodies, parts, routes, w, v)
        known_y = y & ~held
        bound = (min(0.0 if name != "notice" else np.inf, float(s[known_y].min())) if known_y.any() else 0.0) - MARGIN[name]
        test = held & y
        report.append((name, int(test.sum()), int((held & ~y).sum()), float((s[test] >= bound).mean()) if test.any() else None, float((held & (s >= bound)).sum() / max(1, held.sum()))))
        text.append(w)
        least.append(bound)
        path = v if name == "body" else path
    return Model(np.stack(text).astype(np.float32), path.astype(np.float32), np.array(least), report)


def file_scores(name: str, bodies: list[str], parts: list[list[str]], routes: list[list[int]], w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each file's score by a classifier; for notices that of its highest clause (far below any threshold without one)."""
    if name == "notice":
        known = sorted({c for p in parts for c in p})
        of = dict(zip(known, score(known, w, GRAMS[name]).tolist()))
        return np.array([max((of[c] for c in p), default=-1e9) for p in parts])
    s = score(bodies, w, GRAMS[name])
    return s + np.array([v[r].sum() for r in routes]) if name == "body" and len(bodies) else s


def judge(contexts: DataFrame, libs: list[str], model: Model) -> DataFrame:
    """``contexts`` with a struct ``judged``: the three scores and the reason, null for what was written by hand."""
    shared = contexts.sparkSession.sparkContext.broadcast((model.text, model.path, model.least, shingle_table([shingles(x) for x in libs])))

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        text, path, least, table = shared.value
        for paths, sources in batches:
            known = [p is not None and s is not None and not s.isspace() and s != "" for p, s in zip(paths, sources)]
            ps, ss = [p or "" for p in paths], [s or "" for s in sources]
            own = [remarks(s) for s in ss]
            bodies, parts = list(map(masked, ss)), list(map(told, own))
            routes = [places(p) + layout(b) for p, b in zip(ps, bodies)]
            body, notice, copy = (file_scores(name, bodies, parts, routes, text[k], path) for k, name in enumerate(GRAMS))
            reasons = []
            for k, (p, s) in enumerate(zip(ps, ss)):
                why = None
                if known[k]:
                    if body[k] >= least[0]:
                        why = "vendored" if PLACE.search(p) else shape(s)
                    if why is None and notice[k] >= least[1]:
                        why = said(own[k])
                    if why is None and copy[k] >= least[2] and copied(s, table) >= COPY_SHARE:
                        why = "vendored"
                reasons.append(why)
            yield pd.DataFrame({"body": body, "notice": notice, "copy": copy, "reason": reasons}).astype({"body": "float32", "notice": "float32", "copy": "float32"})

    return contexts.withColumn("judged", run(F.col("file_path"), F.col("source")))


def not_by_hand(contexts: DataFrame, known_libs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``context_id, reason`` of all versions of files of which a version is found; the first reason by name."""
    own = contexts.select("context_id", "file_path", "source")
    libs = library_sources(known_libs)
    judged = judge(own, libs, train(own, libs, rows))
    found = judged.filter(F.col("judged.reason").isNotNull()).groupBy("file_path").agg(F.min("judged.reason").alias("reason"))
    return own.select("context_id", "file_path").join(found, "file_path").select("context_id", "reason").distinct()
