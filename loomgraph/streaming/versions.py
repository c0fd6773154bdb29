"""Versioned streams: the newest version of each key stays; late means a lower version, not a later time.

State is a table below the shared checkpoint folder, one folder a batch, so a lost executor or a restarted
query loses nothing: a batch that runs again writes the same folder again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.relations import latest
from loomgraph.sources.tables import checkpoint_dir


#: Parts of a stream's state.
STATE_PARTS = 32


def stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A file stream of Parquet files with the schema of what is there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")  # one file: its folder is watched for that name
    return reader.option("pathGlobFilter", name).parquet(folder)


def keep_newest(changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Runs the stream to its end and gives the newest row of each key: upserts by key, lower versions are ignored.

    State lies in ``STATE_PARTS`` parts by the hash of the key; a batch rewrites the parts it touches and deletes what they replace.
    """
    spark = changes.sparkSession
    root = f"{checkpoint_dir(spark)}/newest-{uuid.uuid4().hex}"
    state: dict[int, str] = {}

    def merge(batch: DataFrame, number: int) -> None:
        own, at = batch.sparkSession, f"{root}/state-{number}"
        new = batch.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(STATE_PARTS)).cast("int"))
        touched = sorted(r[0] for r in new.select("_part").distinct().collect())  # at most STATE_PARTS rows
        old = [state[k] for k in touched if k in state]
        both = new if not old else own.read.schema(changes.schema).parquet(*old).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(STATE_PARTS)).cast("int")).unionByName(new)
        latest(both, ["_part", *keys], order).write.mode("overwrite").partitionBy("_part").parquet(at)
        state.update({k: f"{at}/_part={k}" for k in touched})
        for path in old:
            _delete(own, path)

    changes.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(*sorted(state.values())) if state else spark.createDataFrame([], changes.schema)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def windowed_counts(changes: DataFrame, time: str, size: str, late: str, by: list[str]) -> DataFrame:
    """Counts by tumbling window, with a watermark that closes windows ``late`` after the newest time."""
    return changes.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n"))


def run_complete(result: DataFrame) -> DataFrame:
    """Runs an aggregating stream to its end; the table of its last batch, which holds every group."""
    spark = result.sparkSession
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: dict[str, str] = {}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/state-{number}")
        last["path"] = f"{root}/state-{number}"

    result.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/progress").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(last["path"]) if last else spark.createDataFrame([], result.schema)


def apply_delta(store: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of removed files go, those of added or changed files replace what the store has of them."""
    gone = removed.select("file").unionByName(added.select("file")).distinct()
    return store.join(gone, "file", "left_anti").unionByName(added)


def to_resolve(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """``file``: the changed files and those that import one of them, whose bindings must be resolved again."""
    importers = edges.join(changed.select(F.col("file").alias("dst")), "dst", "left_semi").select(F.col("src").alias("file"))
    return changed.select("file").unionByName(importers).distinct()


def invalidated(cache: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """What stays of a cache after all, or the given files, were invalidated."""
    return cache.limit(0) if files is None else cache.join(files.select("file").distinct(), "file", "left_anti")


def checked_generation(rows: DataFrame, expected: int, column: str = "generation") -> DataFrame:
    """``rows`` if all are of the expected generation; a row of another raises an error when it is read."""
    same = F.col(column) == expected
    return rows.filter(F.when(F.coalesce(same, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"not of generation {expected}")).cast("boolean")))


def queued(requests: DataFrame) -> DataFrame:
    """``request_id, queue, place``: the order in which each queue's requests run: by weight (highest, high, medium, low), then arrival."""
    weight = F.when(F.col("priority") == "highest", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "low", 3).otherwise(2)
    order = Window.partitionBy("queue").orderBy(weight, "arrived", "request_id")
    return requests.select("request_id", "queue", F.row_number().over(order).alias("place"))


def upsert_by_file(store: DataFrame, delta: DataFrame) -> DataFrame:
    """All rows of the delta's files replace those of the store."""
    return store.join(delta.select("file").distinct(), "file", "left_anti").unionByName(delta)


def to_extract(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose ``(file, revision)`` isn't known: what an incremental run reads again."""
    return files.join(known.select("file", "revision"), ["file", "revision"], "left_anti")


def superseded(requests: DataFrame) -> DataFrame:
    """``request_id, key, superseded``: all but the newest request of each key."""
    newest = requests.groupBy("key").agg(F.max("request_id").alias("newest"))
    return requests.select("request_id", "key").join(newest, "key").select("request_id", "key", (F.col("request_id") < F.col("newest")).alias("superseded"))


def overlay_is_current(queries: DataFrame, overlays: DataFrame) -> DataFrame:
    """``file, asked, current``: a query's version must be the open one; files without an overlay pass."""
    opened = overlays.groupBy("file").agg(F.max("version").alias("open_version"))
    return queries.join(opened, "file", "left").select("file", "asked", (F.col("open_version").isNull() | (F.col("open_version") == F.col("asked"))).alias("current"))
