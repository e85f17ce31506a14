"""Shared kernels: lineage cuts, bounded traversal, set propagation, diffs, top-k and budgets.

Iterations keep a frontier apart from what was visited, so each round joins only what is new, and
cut their lineage with reliable checkpoints. No round collects more than a count.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. A local session without one gets a temporary folder; a cluster is refused."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meshlens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system that owns it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: ``df`` as a compressed table in the shared folder, read again. The shuffle files of its plan go once it is written."""
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing still to be computed reads."""
    for t in tables:
        remove(t.sparkSession, t.written_path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def edge_filter(edges: DataFrame, kinds: list[str] | None = None, min_confidence: int | None = None) -> DataFrame:
    """Edges of the kinds (all if none) whose confidence is missing or high enough."""
    if kinds:
        edges = edges.where(F.col("kind").isin(list(kinds)))
    if min_confidence is not None:
        edges = edges.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    return edges


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"source": F.col("target"), "target": F.col("source")})


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(reversed_edges(edges))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None, fan_out: int | None = None, carry_confidence: bool = False, paths: bool = True) -> DataFrame:
    """Breadth-first traversal from many seeds at once.

    ``edges`` has source, target, kind and confidence, ``seeds`` one column node. Returns (seed, node,
    depth, path, confidence) for each node first reached at ``depth``; of several ways the
    smallest path of kinds wins, then the smallest parent. A seed is not reached from itself.
    ``fan_out`` keeps that many edges of a node, in the order of kind and target. Without ``paths``
    they stay empty, so that rows do not grow with depth.
    """
    e = edges.select("source", "target", "kind", F.col("confidence").cast("int").alias("confidence"))
    if fan_out is not None:
        e = e.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("kind", "target"))).where(F.col("r") <= fan_out).drop("r")
    if max_depth is None or max_depth > 2:
        e = cut(e)  # it is joined once a round
    start = seeds.select(F.col("node").alias("seed"), "node").distinct().select("seed", "node", F.lit(0).alias("depth"), F.lit("").alias("path"), F.lit(None).cast("int").alias("confidence"))
    visited = cut(start)
    frontier, depth = visited, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select("seed", F.col("node").alias("source"), F.col("path").alias("before"), F.col("confidence").alias("so_far")).join(e, "source")
        path = F.when(F.col("before") == "", F.col("kind")).otherwise(F.concat_ws(">", "before", "kind")) if paths else F.lit("")
        both = F.coalesce(F.floor(F.col("so_far").cast("long") * F.col("confidence") / 1000).cast("int"), "so_far", "confidence")
        step = step.select("seed", F.col("target").alias("node"), path.alias("path"), F.col("source").alias("parent"), (both if carry_confidence else F.lit(None).cast("int")).alias("confidence"))
        new = step.join(visited.select("seed", "node"), ["seed", "node"], "left_anti")
        new = new.groupBy("seed", "node").agg(F.min(F.struct("path", "parent", F.coalesce("confidence", F.lit(-1)).alias("c"))).alias("b"))
        new = cut(new.select("seed", "node", F.lit(depth).alias("depth"), F.col("b.path").alias("path"), F.when(F.col("b.c") >= 0, F.col("b.c")).alias("confidence")))
        if new.isEmpty():
            break
        visited = visited.unionByName(new)
        if depth % 8 == 0:
            visited = cut(visited)
        frontier = new
    return visited.where("depth > 0")


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The nodes (column node) that any seed reaches, seeds included; no depths and no paths are kept.

    Edges leave once their source is reached, so a round reads only what may still tell something.
    """
    known = [stored(seeds.select("node").distinct(), "reached")]
    left, last = edges.select("source", "target").where("source <> target"), None
    while True:
        hit = left.join(known[-1].select(F.col("node").alias("source"), F.lit(True).alias("hit")), "source", "left")
        now = stored(hit.select(F.when(F.col("hit").isNull(), F.col("source")).alias("source"), "target"), "edges")
        found = now.where("source is null").select(F.col("target").alias("node")).distinct()
        new = stored(found.join(_all(known), "node", "left_anti"), "reached")
        if last is not None:
            drop(last)
        left, last = now.where("source is not null"), now
        known.append(new)
        if new.isEmpty():
            drop(now)
            return _all(known)
        if len(known) > 8:
            older = stored(_all(known[:-1]), "reached")
            drop(*known[:-1])
            known = [older, new]


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def coding(names: DataFrame) -> tuple[Callable[[Column], Column], DataFrame]:
    """64-bit codes for the names (column node): what makes a column's codes, and the table (code, node). No two names share a code: that is checked, and if two do another salt is taken."""
    salt = 0
    while True:
        code = lambda c, salt=salt: F.xxhash64(F.lit(salt), c)
        table = stored(names.select(code(F.col("node")).alias("code"), "node").where("node is not null").distinct().repartition("code"), "names")
        if table.groupBy("code").count().where("count > 1").isEmpty():
            return code, table
        drop(table)
        salt += 1


def propagate(facts: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Least fixpoint of (node, value) along source -> target; semi-naive.

    ``names`` (column node) are the names of all nodes, if there is a table of them. Rounds move codes
    of nodes with sets of values as bits, 64 values a row.
    """
    if names is None:
        names = facts.select("node").union(edges.select("source")).union(edges.select("target"))
    code, table = coding(names)
    *_, (_, state, values) = spread(facts.select(code(F.col("node")).alias("node"), "value"), edges.select(code(F.col("source")).alias("source"), code(F.col("target")).alias("target")))
    return valued(state.select("node", "chunk", "bits"), values).join(table, F.col("node_code") == F.col("code")).select("node", "value")


def valued(sets: DataFrame, values: DataFrame) -> DataFrame:
    """(node_code, value) for the bits of (node, chunk, bits)."""
    has = F.expr("shiftright(bits, bit) & 1L") == 1
    return sets.where("bits <> 0").withColumnRenamed("node", "node_code").join(values.select("chunk", "bit", "value"), "chunk").where(has).select("node_code", "value")


def spread(facts: DataFrame, edges: DataFrame, both: bool = False, steps: int | None = None) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Sets of values spread along edges between coded nodes, a step at a time.

    Yields for steps 0, 1, ... the state (node, chunk, bits, fresh), fresh being what the step has brought,
    and the values' places (value, chunk, bit). A state is gone when the next is asked for. With ``both`` edges lead either way. Ends after ``steps`` or when nothing is fresh.
    """
    number = stored(facts.select("value").distinct().withColumn("v", F.monotonically_increasing_id()), "values")
    values = number.select("value", F.expr("shiftright(v, 6)").alias("chunk"), F.expr("cast(v & 63 as int)").alias("bit"))
    e = stored(edges.select("source", "target").where("source <> target"), "edges")
    bits = facts.join(values, "value").groupBy("node", "chunk").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    state, depth = stored(bits.select("node", "chunk", "bits", F.col("bits").alias("fresh")), "sets"), 0
    zero = F.lit(0).cast("long")
    while True:
        yield depth, state, values
        if depth == steps or state.where("fresh <> 0").isEmpty():
            drop(e)
            return
        new = state.where("fresh <> 0").select(F.col("node").alias("source"), "chunk", F.col("fresh").alias("got"))
        told = _tell(new, undirected(e) if both else e)
        merged = told.unionAll(state.select("node", "chunk", "bits", zero.alias("got"))).groupBy("node", "chunk").agg(F.expr("bit_or(bits)").alias("old"), F.expr("bit_or(got)").alias("got"))
        after = stored(merged.select("node", "chunk", F.expr("old | got").alias("bits"), F.expr("got & ~old").alias("fresh")), "sets")
        drop(state)
        state, depth = after, depth + 1


def _tell(new: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(new.hint("shuffle_hash"), "source").select(F.col("target").alias("node"), "chunk", F.lit(0).cast("long").alias("bits"), "got")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of strongly connected components of two nodes and more.

    Each partition first contracts the components of its own edges, a block at a time. Where no
    member occurs outside its block the component is whole and stays as it is. The others meet in a
    graph of what is left: edges between contracted nodes, and links of members that occur again.
    """
    kind = edges.schema["source"].dataType.simpleString()
    local = stored(edges.where("source <> target").select("source", "target").mapInArrow(_contract, f"node {kind}, component {kind}, size bigint, target {kind}"), "contracted")
    stars, rest = local.where("component is not null").select("node", "component", "size"), local.where("component is null").select(F.col("node").alias("source"), "target")
    # hashes that meet by chance only send more components through the second step
    hashed = lambda df, c, star: df.select(F.xxhash64(c).alias("h"), F.lit(star).alias("star"))
    ends = hashed(stars, "node", 1).unionAll(hashed(rest, "source", 0)).unionAll(hashed(rest, "target", 0))
    again = stored(ends.groupBy("h").agg(F.sum("star").alias("stars"), F.count(F.lit(1)).alias("n")).where("stars > 0 and n > 1").select("h"), "again")
    if again.isEmpty() and rest.isEmpty():
        drop(again)
        return stars
    met = stored(stars.withColumn("h", F.xxhash64("node")).join(again, "h", "left_semi").select("node", "component"), "met")
    open_ = met.select("component").distinct()
    links = met.where("node <> component").select(F.col("node").alias("source"), F.col("component").alias("target"))
    found = _components(rest.unionAll(links).unionAll(reversed_edges(links)))
    stays = stars.join(open_, "component", "left_anti").select("node", "component", "size")
    moved = stars.join(open_, "component", "left_semi").select("node", F.col("component").alias("root")).join(found.select(F.col("node").alias("root"), "component"), "root", "left")
    moved = stored(moved.select("node", F.coalesce("component", "root").alias("component")).unionByName(found).distinct(), "moved")
    size = moved.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    drop(again, found)
    return stays.unionByName(moved.join(size, "component").select("node", "component", "size"))


def _components(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components, some of single nodes among them.

    Nodes without incoming or outgoing edges are trimmed away, then the smallest name that reaches a
    node along edges and against them is found; nodes where both agree form its component and leave.
    Rounds move labels, never pairs of nodes.
    """
    left = stored(edges.where("source <> target").select("source", "target").distinct(), "edges")
    done = [stored(edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0), "found")]
    n = left.count()
    while n:
        while n:  # trim
            core = stored(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"), "edges")
            drop(left)
            left, before, n = core, n, core.count()
            if n == before:
                break
        if not n:
            break
        fwd, back = _smallest(left), _smallest(reversed_edges(left))
        both = fwd.join(back.withColumnRenamed("label", "other"), "node").where("label = other").select("node", F.col("label").alias("component"))
        done.append(stored(both, "found"))
        gone = done[-1].select("node")
        after = stored(left.join(gone, left["source"] == gone["node"], "left_anti").join(gone, F.col("target") == gone["node"], "left_anti").select("source", "target"), "edges")
        drop(left, fwd, back)
        left, n = after, after.count()
    drop(left)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = stored(out, "found")
    drop(*done)
    return out


def _smallest(edges: DataFrame) -> DataFrame:
    """The smallest node that reaches each node.

    What reaches a node's label reaches the node, so labels take their label's label in each round
    too, and a path of n steps needs some log n rounds.
    """
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    label = stored(nodes.select("node", F.col("node").alias("old"), F.col("node").alias("label")), "labels")
    while True:
        offer = label.join(edges, label["node"] == edges["source"]).groupBy(F.col("target").alias("node")).agg(F.min("label").alias("offer"))
        near = label.select("node", F.col("label").alias("old")).join(offer, "node", "left").select("node", "old", F.least("old", F.coalesce("offer", "old")).alias("near"))
        further = near.select(F.col("node").alias("near"), F.col("near").alias("further"))
        new = stored(near.join(further, "near", "left").select("node", "old", F.least("near", F.coalesce("further", "near")).alias("label")), "labels")
        drop(label)
        label = new
        if new.where("label < old").isEmpty():
            out = new.select("node", "label")
            out.written_path = new.written_path
            return out


def _contract(batches: Iterator, at_once: int = 500_000) -> Iterator:
    """Of ``at_once`` edges of a partition at a time: members of their strong components, then the edges between contracted nodes (no component)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def put(held: list) -> Iterator:
        t = pa.Table.from_batches(held)
        ends = pa.concat_arrays([*t["source"].chunks, *t["target"].chunks]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        names, rank = ends.dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        at = rank[ends.indices.to_numpy()]
        s, d = at[: t.num_rows], at[t.num_rows :]
        low = _strong(s, d, len(names))
        size = np.bincount(low, minlength=len(names))
        i = np.flatnonzero(size[low] > 1)
        far = np.unique((low[s] * len(names) + low[d])[low[s] != low[d]])
        s, d = far // len(names), far % len(names)
        as_ = ["node", "component", "size", "target"]
        none = lambda kind, n: pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(low[i])), pa.array(size[low[i]]), none(names.type, len(i))], as_)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(s)), none(names.type, len(s)), none(pa.int64(), len(s)), names.take(pa.array(d))], as_)

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= at_once:
            yield from put(held)
            held, n = [], 0
    if n:
        yield from put(held)


def _strong(s, d, n: int, rounds: int = 8, trims: int = 16):
    """The smallest number of each node's strong component. What ``rounds`` leave apart stays apart, which is for the caller to join."""
    import numpy as np

    def lowest(s, d):
        label = np.arange(n)
        while True:
            near = label.copy()
            np.minimum.at(near, d, label[s])
            near = np.minimum(near, near[near])
            if (near == label).all():
                return label
            label = near

    low = np.arange(n)
    for _ in range(rounds):
        for _ in range(trims):
            into, out = np.zeros(n, bool), np.zeros(n, bool)
            into[d], out[s] = True, True
            keep = into[s] & out[d]
            s, d = s[keep], d[keep]
            if keep.all():
                break
        if not len(s):
            break
        fwd, back = lowest(s, d), lowest(d, s)
        same = fwd == back
        low[same] = np.minimum(low, fwd)[same]
        keep = ~(same[s] | same[d])
        s, d = s[keep], d[keep]
    return low


def diff(baseline: DataFrame, review: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Full outer comparison: keys, change (added, removed, changed, same), before_* and after_* of ``compare``."""
    b = baseline.select(*keys, *(F.col(c).alias(f"before_{c}") for c in compare), F.lit(True).alias("__b"))
    r = review.select(*keys, *(F.col(c).alias(f"after_{c}") for c in compare), F.lit(True).alias("__r"))
    same = F.lit(True)
    for c in compare:
        same &= F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__r").isNull(), "removed").when(same, "same").otherwise("changed")
    return b.join(r, keys, "full_outer").withColumn("change", change).drop("__b", "__r")


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank and whether the group had more."""
    w = Window.partitionBy(*partition)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    return ranked.where(F.col("rank") <= k + 1).withColumn("truncated", F.max("rank").over(w) > k).where(F.col("rank") <= k)


def within_budget(df: DataFrame, partition: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The longest prefix of each group, in order, whose sizes sum to ``budget`` at most."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
