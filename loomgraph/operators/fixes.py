"""Fixes of violations as edits ``file, start, end, text``, and which rules may fix by themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """The asked symbols ``file, range`` with the text from their start on and the line before it."""
    s = symbols.select("file", "name", F.col("range.start").alias("a"), F.col("range.end").alias("b")).distinct().join(sources.select("file", "source"), "file")
    before = F.substring_index(F.substring("source", F.lit(1), F.col("a")), "\n", -1)
    return s.select("file", "name", "a", "b", F.substring("source", F.col("a") + 1, F.col("b") - F.col("a")).alias("code"), before.alias("before"))


def interfaces_to_types(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Edits that make each interface ``symbols`` a type; those that extend another are left alone."""
    head = F.regexp_extract("code", r"(?s)^(interface\b[^{]*)\{", 1)
    hit = _at(symbols, sources).withColumn("head", head).filter((F.col("head") != "") & ~F.col("head").rlike(r"\bextends\b"))
    word = hit.select("file", F.col("a").alias("start"), (F.col("a") + len("interface")).alias("end"), F.lit("type").alias("text"))
    sign = hit.select("file", (F.col("a") + F.length("head")).alias("start"), (F.col("a") + F.length("head")).alias("end"), F.lit("= ").alias("text"))
    return word.unionByName(sign)


def without_export(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Edits that take ``export`` off the declarations ``symbols``; default exports and export lists are left alone."""
    mark = r"(export\s+)((?:declare\s+|abstract\s+|async\s+|const\s+|let\s+|var\s+)*)$"
    hit = _at(symbols, sources).withColumn("mark", F.regexp_extract("before", mark, 1)).withColumn("rest", F.regexp_extract("before", mark, 2)).filter(F.col("mark") != "")
    start = F.col("a") - F.length("rest") - F.length("mark")
    return hit.select("file", start.alias("start"), (start + F.length("mark")).alias("end"), F.lit("").alias("text")).distinct()


def fix_modes(entries: list[tuple[str, str, str | None]]) -> dict[str, str]:
    """The mode of each rule from entries ``rule, severity, fix``, the last of a rule winning: never if it is off or has no fix, else the fix or manual."""
    out: dict[str, str] = {}
    for rule, severity, fix in entries:
        out[rule] = "never" if severity == "off" or fix == "none" else fix or "manual"
    return out


def fixable(found: DataFrame, modes: dict[str, str], mode: str) -> DataFrame:
    """The violations of the rules with a mode; rules without an entry are manual."""
    rule = F.col("rule_id")
    own: Column = F.lit("manual")
    for name, m in sorted(modes.items()):
        own = F.when(rule == name, m).otherwise(own)
    return found.filter(own == mode)
