"""Source files, packages and configuration as tables."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def read_sources(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file, source, revision`` of the files below ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    source = F.decode("content", "UTF-8")
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), source.alias("source")).withColumn("revision", T.revision(F.col("source")))


def with_overlays(sources: DataFrame, overlays: DataFrame) -> DataFrame:
    """Open texts instead of stored ones, with their revision."""
    o = overlays.select("file", F.col("source").alias("open"))
    text = F.coalesce("open", "source")
    return sources.join(o, "file", "left").select("file", text.alias("source"), T.revision(text).alias("revision"))


def rule_targets(files: DataFrame, rules: list[dict]) -> DataFrame:
    """``rule_id, target, file`` of each rule's targets: included globs without excluded ones, by language.

    A rule is ``{"id", "targets": [{"include": [...], "exclude": [...], "language"}], "exclude": [...]}``. ``tsx`` takes
    only .tsx, ``typescript`` .ts and .tsx, any other language every file.
    """
    out: DataFrame | None = None
    for rule in rules:
        for n, target in enumerate(rule["targets"]):
            hit = T.matches_any(F.col("file"), target["include"])
            left_out = [*target.get("exclude", []), *rule.get("exclude", [])]
            if left_out:
                hit = hit & ~T.matches_any(F.col("file"), left_out)
            if target.get("language") == "tsx":
                hit = hit & F.col("file").endswith(".tsx")
            elif target.get("language") == "typescript":
                hit = hit & (F.col("file").endswith(".ts") | F.col("file").endswith(".tsx"))
            part = files.filter(hit).select(F.lit(rule["id"]).alias("rule_id"), F.lit(n).alias("target"), "file")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no rule")
    return out


def packages(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """``name, dir, entry`` from manifests ``file, source``: the entry is the built path's source if it is known, else src/index.ts, else none.

    Manifests without a name are left out; of those that share one, the last by path stays.
    """
    text = F.col("source")
    get = lambda p: F.get_json_object(text, p)
    built = F.coalesce(get("$.exports['.'].import"), get("$.exports['.'].require"), get("$.exports['.'].default"), get("$.exports['.'].types"), F.when(~get("$.exports['.']").startswith("{"), get("$.exports['.']")), get("$.main"), get("$.types"))
    folder = F.regexp_replace("file", "/[^/]*$", "")
    m = manifests.select("file", get("$.name").alias("name"), folder.alias("dir"), F.concat(folder, F.lit("/"), F.regexp_replace(T.dist_to_source(built), r"^\./", "")).alias("first"), F.concat(folder, F.lit("/src/index.ts")).alias("second")).filter(F.col("name").isNotNull())
    known = files.select(F.col("file").alias("entry")).distinct()
    tried = m.select("file", "name", "dir", F.posexplode(F.array("first", "second")).alias("n", "entry")).join(known, "entry")
    best = tried.groupBy("file", "name", "dir").agg(F.min_by("entry", "n").alias("entry"))
    return best.groupBy("name").agg(F.max_by(F.struct("dir", "entry"), "file").alias("r")).select("name", "r.dir", "r.entry")


def read_config(start: str, name: str = "loomgraph.toml") -> dict:
    """The nearest configuration file at or above ``start``; read on the driver. Raises if there is none."""
    at = Path(start).resolve()
    for folder in [at, *at.parents]:
        if (folder / name).is_file():
            return tomllib.loads((folder / name).read_text())
    raise FileNotFoundError(name)


def rule_check(sources: DataFrame, check, schema: str = "rule_id string, file string, message string, line int, col int") -> DataFrame:
    """A user's check ``(file, source) -> rows`` over all sources, in Arrow batches."""
    import pandas as pd

    def run(parts):
        for pdf in parts:
            rows = [r for f, s in zip(pdf.file, pdf.source) for r in check(f, s)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return sources.select("file", "source").mapInPandas(run, schema)


def revision_column() -> Column:
    return T.revision(F.col("source"))
