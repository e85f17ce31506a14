"""Incremental upkeep: debounced change streams, upserts, reconciliation and review overlays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.diffs import affected_files, file_changes
from ..operators.kernels import remove
from ..operators.packs import upsert_latest

#: A batch of more paths than this asks for a full rescan.
MAX_HINTS = 500


def read_changes(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of change records that land as files below ``path``, or in one file; bounded files a batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # streams list folders
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def debounce(changes: DataFrame, quiet: str = "2 seconds", late: str = "10 minutes", max_hints: int = MAX_HINTS) -> DataFrame:
    """One row per repository and burst: a burst ends after ``quiet`` without changes.

    ``changes`` has repo, path and ts, batch or stream; files of a stream arrive in order but for ``late``.
    Too many paths ask for a rescan. Distinct paths are counted by their 64-bit hashes, eight bytes each.
    """
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    burst = changes.groupBy("repo", F.session_window("ts", quiet).alias("w"))
    out = burst.agg(F.count(F.lit(1)).alias("events"), F.size(F.collect_set(F.xxhash64("path"))).alias("paths"))
    return out.select("repo", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", (F.col("paths") > max_hints).alias("rescan"))


def not_closed(changes: DataFrame, closed: DataFrame) -> DataFrame:
    """The changes of bursts that a stream still holds: those after their repository's last closed burst."""
    last = closed.groupBy("repo").agg(F.max("end").alias("last"))
    return changes.join(last, "repo", "left").where("last is null or ts >= last").drop("last")


def merge_pending(pending: DataFrame) -> DataFrame:
    """Waiting hints of a repository become one: the union of paths, a rescan if any asks for it."""
    return pending.groupBy("repo").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.bool_or("rescan").alias("rescan"))


def run_available(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Drive a stream over what there is now; ``apply`` runs once for each batch."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
    q.awaitTermination()


def table_append(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes each batch to its own folder below ``path``; one that runs again writes the same folder."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/{number}")


def table_upsert(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the latest row of each key below ``path``, a folder a batch.

    A batch that runs again after a failure reads the folder before its own and writes its own again,
    so its effect is the same; older folders are removed.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = upsert_latest(batch, keys, [F.desc(order)])
        if number > 0:
            old = spark.read.schema(batch.schema).parquet(f"{path}/{number - 1}")
            new = upsert_latest(old.unionByName(new), keys, [F.desc(order)])
        new.write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:
            remove(spark, f"{path}/{number - 2}")

    return apply


def latest_state(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The state after the last whole batch of :func:`table_upsert`; empty before the first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName()) for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/[0-9]*")) or []]
    done = [n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.schema(schema).parquet(f"{path}/{max(done)}") if done else spark.createDataFrame([], schema)


def suppressed(errors: DataFrame, most: int = 5, seconds: int = 5) -> DataFrame:
    """Each attempt of a repository and whether it is held back: ``most`` failures in a row, the last less than ``seconds`` ago.

    ``errors`` has repo, at (seconds), id and failed.
    """
    before = Window.partitionBy("repo").orderBy("at", "id").rowsBetween(-most, -1)
    held = (F.count_if("failed").over(before) == most) & (F.col("at") - F.max("at").over(before) < seconds)
    return errors.withColumn("suppressed", F.coalesce(held, F.lit(False)))


def notices(before: DataFrame, after: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(subscriber, repo, changed, deleted): what each subscriber of a repository is told after an index run; null subscribes to all."""
    d = file_changes(before, after).where("status <> 'unchanged'").groupBy("repo").agg(F.count_if(F.col("status") != "deleted").alias("changed"), F.count_if(F.col("status") == "deleted").alias("deleted"))
    every = subscribers.where("repo is null").select("subscriber").distinct()
    named = subscribers.where("repo is not null").join(every, "subscriber", "left_anti").distinct()
    return d.join(named, "repo").select("subscriber", "repo", "changed", "deleted").unionByName(d.crossJoin(every).select("subscriber", "repo", "changed", "deleted"))


def incremental_plan(stored: DataFrame, snapshot: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Files to parse again: what was added or modified, and what depends on anything that changed."""
    d = file_changes(stored, snapshot)
    changed = d.where("status <> 'unchanged'").select("repo", "file_path")
    return affected_files(changed, dependencies).join(d.where("status = 'deleted'").select("repo", "file_path"), ["repo", "file_path"], "left_anti")


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("id")
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def virtual_dependents(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(external_id, repo, owner_file) of edges from other repositories into changed virtual nodes. ``changed``: external_id, repo."""
    v = nodes.where(F.col("is_virtual")).select(F.col("id").alias("target"), "external_id").join(changed.withColumnRenamed("repo", "changed_in"), "external_id")
    own = nodes.select(F.col("id").alias("source"), "repo")
    return edges.join(v, "target").join(own, "source").where("repo <> changed_in").select("external_id", "repo", "owner_file").distinct()


def overlay(baseline: DataFrame, delta: DataFrame, replaced: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline rows of files that were not replaced, and the rows of those that were."""
    return baseline.join(replaced.select(*keys).distinct(), keys, "left_anti").select(*baseline.columns).unionByName(delta.select(*baseline.columns))
