"""Sinks: partitioned tables, rendered reports and footprints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import sanitize_cell
from ..operators.kernels import remove
from ..operators.packs import replace_slice
from ..schema import SCHEMA_VERSION, assert_version


def replace_repos(df: DataFrame, path: str) -> None:
    """Overwrite the slices of the repositories in ``df``; other slices stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges beside a version row, edges laid out by kind so that kind filters prune."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")
    nodes.sparkSession.range(1).select(F.lit(SCHEMA_VERSION).alias("version")).write.mode("overwrite").parquet(f"{path}/version")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    assert_version(spark.read.parquet(f"{path}/version").first()["version"])
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


class VersionedTable:
    """A table whose readers see whole versions only: a change is staged beside it, then renamed to the next version or dropped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.staged = spark, path.rstrip("/"), None
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        root = self._path("")
        found = root.getFileSystem(self._conf).globStatus(self._path("v[0-9]*")) or []
        return sorted(int(s.getPath().getName()[1:]) for s in found)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.versions()[-1]}")

    def stage(self, df: DataFrame) -> None:
        """Write the next version's rows; nobody reads them yet."""
        if self.staged:
            raise ValueError("a change is staged already")
        self.staged = f"staged-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{self.staged}")

    def commit(self) -> int:
        """One rename makes the staged rows the newest version; of two writers that race for a number the second fails."""
        n = (self.versions() or [0])[-1] + 1
        fs = self._path("").getFileSystem(self._conf)
        if self.staged is None or fs.exists(self._path(f"v{n}")) or not fs.rename(self._path(self.staged), self._path(f"v{n}")):
            raise ValueError("nothing is staged, or another writer was first")
        self.staged = None
        return n

    def rollback(self) -> None:
        if self.staged:
            remove(self.spark, f"{self.path}/{self.staged}")
            self.staged = None

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest versions."""
        for n in self.versions()[:-keep]:
            remove(self.spark, f"{self.path}/v{n}")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows with those of the new rows' keys replaced."""
    return replace_slice(old, new, keys)


def without_repos(old: DataFrame, repos: list[str]) -> DataFrame:
    """The rows of all other repositories; those without one stay."""
    return old.where(F.col("repo").isNull() | ~F.col("repo").isin(list(repos)))


def table_line(*cells: Column) -> Column:
    """A markdown table row with its cells made safe."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(sanitize_cell(c) for c in cells)), F.lit(" |"))


def delta_report(deltas: DataFrame) -> DataFrame:
    """Deltas by section as JSON lines and markdown rows: section, json, markdown."""
    return deltas.select("section", F.to_json(F.struct("section", "key", "change")).alias("json"), table_line(F.col("section"), F.col("key"), F.col("change")).alias("markdown"))


def codeowners(owned: DataFrame, min_pct: float = 0.5) -> DataFrame:
    """A line per file that one author owns most of."""
    return owned.where((F.col("rank") == 1) & (F.col("pct") >= min_pct)).select(F.concat(F.lit("/"), "file_path", F.lit(" "), "author_email").alias("line"))


def footprint(files: DataFrame) -> DataFrame:
    """Files, bytes and the share of all bytes of each top folder."""
    per = files.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    total = files.agg(F.sum("size").alias("total"))
    return per.join(F.broadcast(total)).select("folder", "files", "bytes", F.round(F.col("bytes") / F.col("total"), 6).alias("share"))  # one row
