"""Facts kept between runs: tables below ``path/environment=.../``, valid for the files whose revision is still the same.

Another environment (tools, settings, versions) has its own folder, so what it wrote is never read. Also graphs kept as baselines.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def environment(**settings: object) -> str:
    """A name for everything that facts depend on besides the sources."""
    return hashlib.sha256(repr([VERSION, sorted(settings.items())]).encode()).hexdigest()[:16]


def persist(facts: dict[str, DataFrame], files: DataFrame, path: str, env: str) -> None:
    """Writes the fact tables and the revisions ``file, revision`` they belong to; what the environment had is replaced."""
    for name, df in {**facts, "files": files.select("file", "revision")}.items():
        df.write.mode("overwrite").parquet(f"{path}/environment={env}/{name}")


def restore(spark: SparkSession, files: DataFrame, path: str, env: str, names: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The kept facts of the files whose revision is known, and the files to extract anew; all of them if nothing is kept."""
    root = f"{path}/environment={env}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/files")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {}, files
    known = spark.read.parquet(f"{root}/files")
    same = files.join(known, ["file", "revision"], "left_semi").select("file")
    return {n: spark.read.parquet(f"{root}/{n}").join(same, "file", "left_semi") for n in names}, files.join(known, ["file", "revision"], "left_anti")


def baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``nodes(id), edges(src, dst)`` of a JSON graph: objects or plain paths as nodes, from and to as edges; a snapshot's ``graph`` is looked into. Repeats count once."""
    edge = "struct<from:string,to:string>"
    graph = f"struct<nodes:array<string>,edges:array<{edge}>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<graph:{graph},nodes:array<string>,edges:array<{edge}>>").alias("g"))
    node = F.explode(F.coalesce("g.graph.nodes", "g.nodes")).alias("n")
    nodes = raw.select(node).select(F.coalesce(F.get_json_object("n", "$.path"), F.col("n")).alias("id")).distinct()
    edges = raw.select(F.explode(F.coalesce("g.graph.edges", "g.edges")).alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst")).distinct()
    return nodes, edges
