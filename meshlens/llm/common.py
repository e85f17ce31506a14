"""Shared plumbing: lineage cuts in the cluster's shared folder, passes over texts, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from ..operators.kernels import new_path, remove, shared_dir  # noqa: F401


def written(df: DataFrame, label: str, rows_per_file: int = 200_000) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again.

    Lost executors cost nothing that was written. Files are as many as the rows need, not as many
    as the last shuffle had partitions: rows are held on local disks until they are counted, from
    where they can be computed again if an executor goes meanwhile. The schema is given, not inferred.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        n = held.count()
        held.coalesce(max(1, -(-n // rows_per_file))).write.parquet(path)
    finally:
        held.unpersist()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing still to be computed reads."""
    for t in tables:
        remove(t.sparkSession, t.written_path)


def map_texts(df: DataFrame, text_col: str, keep: tuple[str, ...], fields: str, fn: Callable[[list], list[list]], rows: int = 2_000, size: int = 8 << 20) -> DataFrame:
    """The ``keep`` columns and those of ``fields`` (DDL), which ``fn`` makes of up to ``rows`` texts or ``size`` bytes of them, a list a field.

    Kept columns pass as Arrow arrays, whatever their types, nulls and names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = df.sparkSession.createDataFrame([], fields).schema
    source = df.select(*(F.col(c) for c in keep), F.col(text_col).cast("string").alias("__text"))
    schema = StructType([*source.schema.fields[:-1], *made.fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = to_arrow_schema(made).types
        names = [f.name for f in schema.fields]
        for batch in batches:
            for i, n in portions(batch.column(batch.num_columns - 1), rows, size):
                b = batch.slice(i, n)
                out = fn(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, t) for x, t in zip(out, types))], names)

    return source.mapInArrow(run, schema)


def portions(texts, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, number) of runs of an Arrow string array: at most ``rows`` texts and, but for single ones, ``size`` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, n = 0, len(end)
    while at < n:
        before = int(end[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(end, before + size, side="right"))))
        yield at, stop - at
        at = stop


_held: dict = {}


def worker_cache(name: object, make: Callable[[], object]) -> object:
    """A Python worker's one cache: it outlives tasks, and goes when another is asked for, so caches of different operators don't add up."""
    if name not in _held:
        _held.clear()
        gc.collect()
        _held[name] = make()
    return _held[name]


NO_ID = -(1 << 63)


def without_null(df: DataFrame, col: str) -> Column:
    """An integer id column whose nulls are the smallest long, so that it stays an integer on the way through pandas; other types as they are."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID)) if isinstance(df.schema[col].dataType, IntegralType) else F.col(col)


def with_null(df: DataFrame, col: str, of: DataFrame, name: str) -> Column:
    """The column that :func:`without_null` made, as it was in ``of``."""
    kind = of.schema[name].dataType
    return (F.when(F.col(col) != NO_ID, F.col(col)).cast(kind) if isinstance(kind, IntegralType) else F.col(col)).alias(name)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)``, integer ids, by alternating large-star and small-star steps.

    Returns (node, component) for every node with a link; component is the smallest node
    reachable. Before the first step and after each, every partition puts the links it holds into
    stars of its own, as a combiner would, so few steps are left; none is where one partition holds
    all. Each step is a min-aggregation (combined before its shuffle) and a join whose large side
    can be split; only a count comes to the driver. Null ends and self-links are ignored.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        last, e = e, written(e.mapInPandas(_local_stars, "u bigint, v bigint"), "stars")
        drop(last)
        if _is_stars(e):
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(low2, "u")
        small = pulled.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, written(small, "links")
        drop(last)
    else:
        raise RuntimeError("components did not converge")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _is_stars(e: DataFrame) -> bool:
    """Whether each node has one larger end's link at most and no root is itself linked to a smaller node."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionAll(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    per = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("root"))
    return per.where("ups > 1 or (ups = 1 and root = 0)").limit(1).count() == 0


def _local_stars(batches: Iterator, at_once: int = 500_000) -> Iterator:
    """The links of a partition as stars around the smallest node each reaches in it, ``at_once`` links at a time."""
    import numpy as np
    import pandas as pd

    def put(held: list) -> pd.DataFrame:
        u, v = (np.concatenate([b[c].to_numpy(np.int64) for b in held]) for c in ("u", "v"))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        i, j = place[: len(u)], place[len(u) :]
        label = np.arange(len(nodes))
        while (label[i] != label[j]).any():
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while (label != label[label]).any():
                label = label[label]
        far = label != np.arange(len(nodes))
        return pd.DataFrame({"u": nodes[far], "v": nodes[label[far]]})

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= at_once:
            held = [put(held)]
            if len(held[0]) > at_once // 2:  # too many stars to hold on to
                yield held.pop()
            n = sum(map(len, held))
    if n:
        yield put(held)
