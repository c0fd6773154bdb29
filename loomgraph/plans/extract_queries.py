"""Facts read from the sources of the newest versions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.fact_queries import newest_files, symbols
from loomgraph.sources import extract


def _sources(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    return newest_files(spark, sf_dir).filter(F.col("file").rlike(pattern))


def counts(spark: SparkSession, sf_dir: str, pattern: str = extract.PYTHON) -> DataFrame:
    """Facts by table."""
    return extract.facts(_sources(spark, sf_dir, pattern)).groupBy("table").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("file").alias("n_files"))


def complexity(spark: SparkSession, sf_dir: str, pattern: str = extract.PYTHON) -> DataFrame:
    """Cyclomatic complexity by file: sum and largest."""
    t = extract.extract(_sources(spark, sf_dir, pattern))
    return extract.complexity(t["cfg_nodes"], t["cfg_edges"]).groupBy("file").agg(F.sum("complexity").alias("complexity"), F.max("complexity").alias("largest"))


def calls(spark: SparkSession, sf_dir: str, pattern: str = extract.PYTHON) -> DataFrame:
    t = extract.extract(_sources(spark, sf_dir, pattern))
    return t["calls"].groupBy("callee_name").agg(F.count(F.lit(1)).alias("n_calls"), F.count("symbol_id").alias("n_resolved"))


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, methods, classes and interfaces of the symbols table, by kind and language: how many extraction finds in the same file by name."""
    own = extract.extract(newest_files(spark, sf_dir))["symbols"].select("file", "name", "kind").distinct().withColumn("found", F.lit(1))
    asked = symbols(spark, sf_dir).filter("kind in ('function', 'method', 'class', 'interface') and name is not null").select("file", "name", "kind").distinct()
    by = asked.join(newest_files(spark, sf_dir).select("file"), "file").join(own, ["file", "name", "kind"], "left").groupBy("kind", F.col("file").endswith(".py").alias("python"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.count("found").alias("n_found"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.script_imports(newest_files(spark, sf_dir)).groupBy("spec", "style").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.script_declarations(newest_files(spark, sf_dir))


QUERIES = {
    "ex_python_counts": counts, "ex_python_complexity": complexity, "ex_python_calls": calls, "ex_script_counts": partial(counts, pattern=extract.SCRIPT), "ex_script_complexity": partial(complexity, pattern=extract.SCRIPT),
    "ex_script_calls": partial(calls, pattern=extract.SCRIPT), "ex_agreement": agreement, "ex_script_imports": imports, "ex_script_declarations": declarations,
}

_LINES = "f AS (SELECT file_path AS file, arg_max(source, version) AS source FROM check_contexts GROUP BY file_path), l AS (SELECT file, string_split(source, chr(10)) AS ls FROM f WHERE file NOT LIKE '%.py'), x AS (SELECT file, unnest(ls) AS line, generate_subscripts(ls, 1) AS at FROM l)"
_Q = "[\"'']([^\"'']+)[\"'']"
_DECL = r"^(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|type|enum|const|let|var)\s*\*?\s+([A-Za-z_$][\w$]*)"
_SY = "sy AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM symbols) WHERE rn = 1)"
SQL = {
    # extraction is to find every one of them
    "ex_agreement": f"WITH {_SY}, q AS (SELECT DISTINCT file, name, kind FROM sy WHERE kind IN ('function', 'method', 'class', 'interface') AND name IS NOT NULL AND file IN (SELECT file_path FROM check_contexts)) SELECT kind, ends_with(file, '.py') AS python, count(*) AS n, count(*) AS n_found FROM q GROUP BY ALL",
    "ex_script_imports": f"WITH {_LINES}, y AS (SELECT file, regexp_extract(line, '^(?:import|export)\\b.*\\bfrom\\s+{_Q}', 1) AS a, regexp_extract(line, '^import\\s+{_Q}', 1) AS b, regexp_extract(line, '\\bimport\\(\\s*{_Q}\\s*\\)', 1) AS c, regexp_extract(line, '^(?:const|let|var)\\b.*\\brequire\\(\\s*{_Q}\\s*\\)', 1) AS d FROM x), "
    "z AS (SELECT file, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), nullif(d, '')) AS spec, CASE WHEN a <> '' THEN 'static' WHEN b <> '' THEN 'side_effect' WHEN c <> '' THEN 'dynamic' ELSE 'cjs' END AS style FROM y) SELECT spec, style, count(*) AS n, count(DISTINCT file) AS n_files FROM z WHERE spec IS NOT NULL GROUP BY spec, style",
    "ex_script_declarations": f"WITH {_LINES} SELECT file, x.\"at\" AS line, regexp_extract(line, '{_DECL}', 2) AS kind, regexp_extract(line, '{_DECL}', 3) AS name, regexp_extract(line, '{_DECL}', 1) <> '' AS exported FROM x WHERE regexp_extract(line, '{_DECL}', 3) <> ''",
}
