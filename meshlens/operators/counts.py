"""Counts, health and score aggregates over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..schema import VIRTUAL_REPO, edge_kinds, node_kinds
from .events import EVENT_KINDS
from .kernels import top_k


def nodes_by_kind(nodes: DataFrame) -> DataFrame:
    """Every kind, also those without nodes."""
    n = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(node_kinds(nodes.sparkSession)).join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def edges_by_kind(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def repo_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, functions and owned edges of each repository."""
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind") == "function").alias("functions"))
    e = edges.join(nodes.select(F.col("id").alias("owner_file"), "repo"), "owner_file").groupBy("repo").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "repo", "left").select("repo", "nodes", "functions", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def cross_repo_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge totals: all, between repositories, and those split into true, virtual and history ones."""
    n = nodes.select("id", "repo", "kind")
    j = edges.join(n.select(F.col("id").alias("source"), F.col("repo").alias("a")), "source").join(n.select(F.col("id").alias("target"), F.col("repo").alias("b"), F.col("kind").alias("tk")), "target")
    differ = F.col("a") != F.col("b")
    v = F.lit(VIRTUAL_REPO)
    return j.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if((F.col("kind") == "cross_repo_depends") | differ).alias("cross_repo"), F.count_if(differ & (F.col("a") != v) & (F.col("b") != v)).alias("true_cross_repo"),
        F.count_if((F.col("b") == v) & (F.col("tk") == "author")).alias("history_ownership"), F.count_if(differ & (F.col("b") == v) & (F.col("tk") != "author")).alias("virtual_other"))


def attributed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select("id", "repo")
    return edges.join(n.select(F.col("id").alias("source"), F.col("repo").alias("source_repo")), "source").join(n.select(F.col("id").alias("target"), F.col("repo").alias("target_repo")), "target")


def anchor_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How well a node anchors an answer: fan-out, boundary, event and shared use, from 0 to about 1.2."""
    out = edges.groupBy(F.col("source").alias("id")).agg(
        F.count_if(F.col("kind").isin("calls", "publishes", "consumes", "serves", "consumes_api_from")).alias("fan"), F.count_if(F.col("kind").isin("publishes", "consumes", "produces_event_for", "uses_event_from")).alias("events"), F.count_if(F.col("kind") == "uses_shared").alias("shared"))
    boundary = F.when(F.col("kind").isin("route", "topic", "queue", "event"), 0.3).when(F.col("kind").isin("service", "shared_symbol"), 0.25).otherwise(0.0)
    score = 0.4 * F.least(F.coalesce("fan", F.lit(0)), F.lit(10)) / 10 + boundary + 0.3 * F.least(F.coalesce("events", F.lit(0)), F.lit(5)) / 5 + F.when(F.col("shared") > 0, 0.2).otherwise(0.0)
    return nodes.join(out, "id", "left").select("id", "kind", F.round(score, 6).alias("score"))


def edge_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connectedness of every node with an edge: 30 in, 20 out, 45 boundary, 35 virtual, 60 foreign repositories, each capped."""
    n = nodes.select("id", "repo", "is_virtual")
    bridges = F.broadcast(edge_kinds(nodes.sparkSession).select("kind", "is_bridge"))
    e = edges.join(bridges, "kind").join(n.select(F.col("id").alias("source"), F.col("repo").alias("sr"), F.col("is_virtual").alias("sv")), "source").join(n.select(F.col("id").alias("target"), F.col("repo").alias("tr"), F.col("is_virtual").alias("tv")), "target")
    ends = e.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), "is_bridge", F.col("sv").alias("v"), F.when((F.col("sr") != F.col("tr")) & (F.col("sr") != VIRTUAL_REPO), F.col("sr")).alias("foreign")).unionAll(
        e.select(F.col("source").alias("id"), F.lit(0), F.lit(1), "is_bridge", F.col("tv"), F.when((F.col("sr") != F.col("tr")) & (F.col("tr") != VIRTUAL_REPO), F.col("tr"))))
    cap = lambda c, k: F.least(c, F.lit(k))
    got = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.count_if("is_bridge").alias("b"), F.count_if("v").alias("v"), F.count_distinct("foreign").alias("f"))
    return got.select("id", (30 * cap(F.col("i"), 6) + 20 * cap(F.col("o"), 6) + 45 * cap(F.col("b"), 6) + 35 * cap(F.col("v"), 4) + 60 * cap(F.col("f"), 4)).cast("long").alias("score"))


def semantic_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per kind of virtual event node: total, linked, unlinked, ambiguous, coverage (1 where there are none)."""
    sides = edges.where(F.col("kind").isin("publishes", "consumes")).groupBy(F.col("target").alias("id")).agg(F.max((F.col("kind") == "publishes").cast("int")).alias("p"), F.max((F.col("kind") == "consumes").cast("int")).alias("c"))
    v = nodes.where(F.col("is_virtual") & F.col("kind").isin(*EVENT_KINDS)).join(sides, "id", "left")
    linked = (F.col("p") == 1) & (F.col("c") == 1)
    out = v.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if(linked).alias("linked"), (F.count(F.lit(1)) - F.count_distinct("external_id")).alias("ambiguous"))
    return out.select("kind", "total", "linked", (F.col("total") - F.col("linked")).alias("unlinked"), "ambiguous", F.round(F.when(F.col("total") == 0, 1.0).otherwise(F.col("linked") / F.col("total")), 6).alias("coverage"))


def fingerprint(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sorted distinct edge lines as one digest per kind; equal graphs have equal digests."""
    name = nodes.select("id", F.coalesce("qualified_name", "name").alias("qn"))
    e = edges.join(name.select(F.col("id").alias("source"), F.col("qn").alias("s")), "source").join(name.select(F.col("id").alias("target"), F.col("qn").alias("t")), "target")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat_ws("\t", "s", "kind", "t", said("resolver") if "resolver" in edges.columns else F.lit("-"), said("confidence"))
    # a sum of line digests instead of one sorted text: it needs no order, so no single task holds all lines
    h = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("decimal(20,0)")
    return e.select("kind", line.alias("line"), h.alias("h")).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.sum("h").cast("string").alias("digest"))


def shared_usage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per virtual node and repository: distinct files of neighbours on either side."""
    v = nodes.where("is_virtual").select(F.col("id").alias("v"))
    n = nodes.where(~F.col("is_virtual")).select("id", "repo", "file_path")
    near = edges.select(F.col("target").alias("v"), F.col("source").alias("id")).unionAll(edges.select(F.col("source").alias("v"), F.col("target").alias("id"))).distinct()
    return near.join(v, "v", "left_semi").join(n, "id").groupBy("v", "repo").agg(F.count_distinct("file_path").alias("files"))


def conventions(nodes: DataFrame, examples: int = 3) -> DataFrame:
    """Top folders, decorators and virtual surfaces that a repository uses at least twice, with confidence and first examples."""
    pick = lambda c, pattern, what: nodes.where(c).select(F.lit(pattern).alias("pattern"), "repo", what.alias("what"), F.col("file_path").alias("example"))
    dirs = pick("kind = 'file' and file_path like '%/%'", "files_under", F.substring_index("file_path", "/", 1))
    decorators = pick("kind = 'decorator'", "decorator", F.col("name"))
    surfaces = pick("kind in ('route', 'topic', 'queue', 'subject', 'stream', 'event')", "virtual_surface", F.col("kind"))
    both = dirs.unionByName(decorators).unionByName(surfaces)
    keys = ["pattern", "repo", "what"]
    count = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    first = top_k(both.join(count, keys, "left_semi"), keys, [F.col("example")], examples).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("example")), "; ").alias("examples"))
    return count.join(first, keys).withColumn("confidence", F.when(F.col("pattern") == "files_under", 0.7).when(F.col("pattern") == "decorator", 0.8).otherwise(0.75))


def node_labels(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", X.node_label(F.col("kind"), F.col("name"), F.col("external_id")).alias("label"))
