"""Edits of sources: overlaps, fix plans, application. Offsets count characters, ranges are half-open.

Which edits stay depends on those kept before, so a file's edits are read in order by one task, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDITS = "file string, start int, end int, text string"


def plan(edits: DataFrame) -> DataFrame:
    """Every distinct edit with ``conflict``: whether it overlaps one accepted before it, in order of (start, end, text).

    A partition's edits are sorted and read once, with the file at hand and the end of its last accepted edit as state, so a file
    is never gathered. Edits without a start or end are left out.
    """
    known = edits.select("file", "start", "end", "text").filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    ordered = known.repartition("file").sortWithinPartitions("file", "start", "end", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = run  # no file is this
        last = empty = -1
        before: tuple | None = None
        for pdf in batches:
            new, conflict = [], []
            for row in zip(pdf.file, pdf.start, pdf.end, pdf.text):
                file, a, b, _ = row
                if file != at:
                    at, last, empty = file, -1, -1
                new.append(row != before)
                before = row
                ok = a >= last and not a == b == empty
                if new[-1] and ok:
                    last, empty = max(last, b), a if a == b else -1
                conflict.append(not ok)
            yield pdf.assign(conflict=conflict)[new]

    return ordered.mapInPandas(run, EDITS + ", conflict boolean")


def without_overlaps(edits: DataFrame) -> DataFrame:
    """Edits in order of (start, end, text), repeats once, those dropped that overlap the last one kept."""
    return plan(edits).filter(~F.col("conflict")).drop("conflict")


def apply(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """``file, source`` after the edits that don't overlap; files without edits stay as they are."""
    kept = without_overlaps(edits)
    by = kept.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("edits"))
    joined = sources.select("file", "source").join(by, "file", "left")
    spliced = F.aggregate(
        F.coalesce("edits", F.array()),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, e: F.struct(
            F.concat(acc["done"], F.substring("source", acc["at"] + 1, e["start"] - acc["at"]), e["text"]).alias("done"), e["end"].alias("at")
        ),
        lambda acc: F.concat(acc["done"], F.substring("source", acc["at"] + 1, F.length("source") - acc["at"])),
    )
    return joined.select("file", F.when(F.col("edits").isNull(), F.col("source")).otherwise(spliced).alias("source"))


def plan_id(edits: DataFrame) -> DataFrame:
    """``file, plan_id``: 16 hex digits over the file's edits in order."""
    one = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), "text")
    return edits.groupBy("file").agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", one.alias("one")))), lambda e: e["one"]), "\0"), 256), 1, 16).alias("plan_id"))
