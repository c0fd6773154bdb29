"""Graphs as text: DOT, Mermaid and GraphML lines, and snapshots as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import escape_dot, escape_xml
from loomgraph.sources.tables import cut


def numbered(nodes: DataFrame) -> DataFrame:
    """``id, n``: the place of each node by its id as text."""
    return placed(nodes.select("id").distinct(), [F.col("id").cast("string")], "n")


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place in a total order: ranges are counted and numbered each by itself, so no task holds all rows."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # one row a partition
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_inside") - 1).drop("_range", "_inside", "_start")


def lines(nodes: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """``section, line`` of the export; edges with an unknown end are dropped. Sections: 0 nodes, 1 edges."""
    ids = numbered(nodes)
    a, b = ids.select(F.col("id").alias("src"), F.col("n").alias("a")), ids.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    ends = edges.join(a, "src").join(b, "dst")
    name, x, y = F.col("id").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")
    n = F.col("n").cast("string")
    node, edge = {
        "dot": (F.concat(F.lit("  n"), n, F.lit(' [label="'), escape_dot(name), F.lit('"];')), F.concat(F.lit("  n"), x, F.lit(" -> n"), y, F.lit(";"))),
        "mermaid": (F.concat(F.lit("  n"), n, F.lit('["'), F.replace(name, F.lit('"'), F.lit("#quot;")), F.lit('"]')), F.concat(F.lit("  n"), x, F.lit(" --> n"), y)),
        "graphml": (F.concat(F.lit('    <node id="n'), n, F.lit('"><data key="path">'), escape_xml(name), F.lit("</data></node>")), F.concat(F.lit('    <edge source="n'), x, F.lit('" target="n'), y, F.lit('"/>'))),
        "text": (name, F.concat(F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"))),
    }[form]
    return ids.select(F.lit(0).alias("section"), node.alias("line")).unionByName(ends.select(F.lit(1).alias("section"), edge.alias("line")))


def as_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``section, line``: a JSON object for each node and each edge between known nodes."""
    known = nodes.select(F.col("id").cast("string").alias("id")).distinct()
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    ends = e.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return known.select(F.lit(0).alias("section"), F.to_json(F.struct(F.col("id").alias("path"))).alias("line")).unionByName(ends.select(F.lit(1).alias("section"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"))).alias("line")))


def labels(spark, path: str) -> list[str]:
    """The labels that any table of a snapshot folder has, sorted."""
    return sorted({p.getName().removeprefix("label=") for _, p in _label_folders(spark, path)})


def delete_snapshot(spark, path: str, label: str) -> bool:
    """Deletes a label's tables; whether there were any."""
    found = [(fs, p) for fs, p in _label_folders(spark, path) if p.getName() == f"label={label}"]
    for fs, p in found:
        fs.delete(p, True)
    return bool(found)


def _label_folders(spark, path: str) -> list:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tables = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    return [(fs, s.getPath()) for t in tables for s in fs.listStatus(t) if s.getPath().getName().startswith("label=")]


def write_snapshot(tables: dict[str, DataFrame], path: str, label: str) -> None:
    """Each table below ``path/name/label=...``; another label's rows stay."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/label={label}")


def read_snapshot(spark, path: str, label: str) -> dict[str, DataFrame] | None:
    """The tables of a label; null if there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = {n: f"{path}/{n}/label={label}" for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/label={label}"))}
    return {n: spark.read.parquet(p) for n, p in found.items()} or None
