"""Reports of external tools as violations ``rule_id, file, message, line, col, end_line, end_col, severity``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ESLINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int,column:int,endLine:int,endColumn:int>>>>"
_RUFF = "array<struct<code:string,message:string,filename:string,location:struct<row:int,column:int>,end_location:struct<row:int,column:int>>>"
_BIOME = "struct<diagnostics:array<struct<category:string,severity:string,description:string,location:struct<path:struct<file:string>,span:array<int>>>>>"


def eslint(reports: DataFrame) -> DataFrame:
    """From rows with the JSON text in ``value``."""
    files = reports.select(F.explode(F.from_json("value", _ESLINT)).alias("f")).select("f.filePath", F.explode("f.messages").alias("m"))
    return files.select(F.col("m.ruleId").alias("rule_id"), F.col("filePath").alias("file"), "m.message", "m.line", F.col("m.column").alias("col"), F.col("m.endLine").alias("end_line"), F.col("m.endColumn").alias("end_col"), F.when(F.col("m.severity") == 2, "error").otherwise("warning").alias("severity"))


def ruff(reports: DataFrame) -> DataFrame:
    rows = reports.select(F.explode(F.from_json("value", _RUFF)).alias("m"))
    return rows.select(F.col("m.code").alias("rule_id"), F.col("m.filename").alias("file"), "m.message", F.col("m.location.row").alias("line"), F.col("m.location.column").alias("col"), F.col("m.end_location.row").alias("end_line"), F.col("m.end_location.column").alias("end_col"), F.lit("error").alias("severity"))


def biome(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """Spans are character offsets, so lines and columns come from the sources ``file, source``."""
    from loomgraph.functions.text import column_of, line_of

    rows = reports.select(F.explode(F.from_json("value", _BIOME)["diagnostics"]).alias("m"))
    flat = rows.select(F.col("m.category").alias("rule_id"), F.col("m.location.path.file").alias("file"), F.col("m.description").alias("message"), F.col("m.location.span")[0].alias("a"), F.col("m.location.span")[1].alias("b"), F.col("m.severity").alias("severity"))
    s = flat.join(sources.select("file", "source"), "file", "left")
    return s.select("rule_id", "file", "message", line_of(F.col("source"), F.col("a")).alias("line"), column_of(F.col("source"), F.col("a")).alias("col"), line_of(F.col("source"), F.col("b")).alias("end_line"), column_of(F.col("source"), F.col("b")).alias("end_col"), "severity")


def vulture(lines: DataFrame, least_confidence: int = 0) -> DataFrame:
    """From report lines ``file:line: unused kind 'name' (n% confidence)`` in ``value``; other lines are ignored."""
    pattern = r"^(.*?):(\d+): unused (.+?) '([^']*)' \((\d+)% confidence"
    part = lambda n: F.regexp_extract("value", pattern, n)
    found = lines.filter(F.col("value").rlike(pattern)).select(F.concat(F.lit("unused-"), part(3)).alias("rule_id"), part(1).alias("file"), F.concat(F.lit("unused "), part(3), F.lit(" '"), part(4), F.lit("'")).alias("message"), part(2).cast("int").alias("line"), part(5).cast("int").alias("confidence"))
    none = F.lit(None).cast("int")
    return found.filter(F.col("confidence") >= least_confidence).select("rule_id", "file", "message", "line", none.alias("col"), none.alias("end_line"), none.alias("end_col"), F.lit("warning").alias("severity"), "confidence")


def scorecard(runs: DataFrame) -> DataFrame:
    """Per analyzer: runs, failures, diagnostics and latency, from ``analyzer, ok, n_diagnostics, millis``."""
    return runs.groupBy("analyzer").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(~F.col("ok")).alias("n_failed"), F.sum("n_diagnostics").alias("n_diagnostics"), F.max("millis").alias("max_millis"), F.round(F.avg("millis"), 3).alias("mean_millis"))


def rule_rollup(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_violations"), F.count_distinct("file").alias("n_files"))


def grouped(found: DataFrame) -> DataFrame:
    """``file, messages, n``: the violations of each file as lines of text, in their order."""
    return found.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("message")), "\n").alias("messages"), F.count(F.lit(1)).alias("n"))
