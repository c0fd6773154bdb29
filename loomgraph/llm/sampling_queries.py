"""Queries of problem 3: symbols and scopes, weighted by the characters of their range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.sampling import merge_state, sample_ids, sample_rows, select
from loomgraph.sources.tables import cut, load

SEED = 17
#: Chosen per character: a record of 1000 characters is chosen with probability 0.4.
CONSTANT = 0.0004
TABLES = ("symbols", "scopes")


def _weight():
    return F.col("range.end") - F.col("range.start")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [sample_ids(load(spark, sf_dir, t), "id", _weight(), CONSTANT, SEED).select(F.lit(t).alias("table_name"), "id", "max_weight") for t in TABLES]
    return parts[0].unionByName(parts[1])


def p3_stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sample from stored maxima: those of the earlier half of the records, then of the later half merged into them."""
    parts = []
    for t in TABLES:
        records = load(spark, sf_dir, t)
        middle = records.agg(F.timestamp_micros(F.avg(F.unix_micros(F.col("ingested_at").cast("timestamp"))).cast("bigint")).alias("m")).first()["m"]
        late = F.coalesce(F.col("ingested_at").cast("timestamp") > F.lit(middle), F.lit(True))
        state = cut(merge_state(None, records.filter(~late), "id", _weight()))
        state = merge_state(state, records.filter(late), "id", _weight())
        parts.append(select(state, CONSTANT, SEED).select(F.lit(t).alias("table_name"), "id", "max_weight"))
    return parts[0].unionByName(parts[1])


def p3_sample_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, ids and time span of the sampled records by kind: what the sample holds."""
    parts = [
        sample_rows(load(spark, sf_dir, t), "id", _weight(), CONSTANT, SEED)
        .groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.max("ingested_at").alias("last_ingested"))
        .select(F.lit(t).alias("table_name"), "kind", "n_rows", "n_ids", "last_ingested")
        for t in TABLES
    ]
    return parts[0].unionByName(parts[1])


QUERIES = {"p3_sample": p3_sample, "p3_stored_state": p3_stored_state, "p3_sample_kinds": p3_sample_kinds}

_CHOSEN = """SELECT id, max(w) AS max_weight FROM (
  SELECT id, CASE WHEN "range"."end" - "range"."start" > 0 THEN ("range"."end" - "range"."start")::DOUBLE ELSE 1.0 END AS w FROM {t} WHERE id IS NOT NULL)
GROUP BY id HAVING ('0x' || substr(md5('17:' || id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < max(w) * 0.0004"""
SQL = {
    "p3_sample": "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, id, max_weight FROM ({_CHOSEN.format(t=t)})" for t in TABLES),
    "p3_sample_kinds": "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, kind, count(*) AS n_rows, count(DISTINCT id) AS n_ids, max(ingested_at) AS last_ingested FROM {t} WHERE id IN (SELECT id FROM ({_CHOSEN.format(t=t)})) GROUP BY kind"
        for t in TABLES
    ),
}
SQL["p3_stored_state"] = SQL["p3_sample"]
