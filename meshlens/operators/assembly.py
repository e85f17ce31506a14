"""Context packs from the other operators, plan checklists, briefs and quality evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as X
from .kernels import bfs, edge_filter, reversed_edges, undirected
from .packs import BUDGETS, brief_risk, trim

# What a pack's sections start from, and what each step away costs.
BASE = {"callers": 400, "callees": 360, "shared": 320, "events": 300}
DEPTH_COST = 25
# Sections of a change plan and the dimensions in which it may have gaps.
PLAN_SECTIONS = ("summary", "targets", "contracts", "events", "routes", "shared_symbols", "data", "deployments", "tests", "rollout", "risks", "open_questions")
GAP_DIMENSIONS = ("callers", "contracts", "events", "routes", "tests", "ownership", "deployment", "data")
# Orders in which pack modes prefer their sections.
MODE_ORDER = {
    "planning": ("shared", "events", "callers", "callees"), "debug": ("callees", "callers", "events", "shared"), "fix": ("callees", "callers", "shared", "events"),
    "review": ("callers", "shared", "events", "callees"), "change_impact": ("callers", "events", "shared", "callees"),
}


def pack_items(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, section, id, depth, score) of what stands around each seed: callers and callees, and neighbours over shared and event edges."""
    calls = edge_filter(edges, ["calls"])
    near = undirected(edges.select("source", "target", "kind", "confidence"))

    def section(name: str, e: DataFrame, d: int) -> DataFrame:
        got = bfs(e, seeds, d).select("seed", F.col("node").alias("id"), "depth")
        return got.select("seed", F.lit(name).alias("section"), "id", "depth", (BASE[name] - DEPTH_COST * F.col("depth")).alias("score"))

    shared = near.where(F.col("kind").isin("uses_shared", "uses_type_from", "imports", "contract_on"))
    event = near.where(F.col("kind").isin("publishes", "consumes", "produces_event_for", "uses_event_from", "references"))
    out = section("callers", reversed_edges(calls), depth).unionByName(section("callees", calls, depth)).unionByName(section("shared", shared, 1)).unionByName(section("events", event, 1))
    return out.join(nodes.select("id"), "id", "left_semi").select("seed", "section", "id", "depth", "score")


def context_pack(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, mode: str = "planning", budget: int | None = None) -> DataFrame:
    """A pack for each seed: every node once, in its best section, ordered as the mode prefers, within the mode's bytes."""
    order = MODE_ORDER[mode]
    place: Column = F.coalesce(*(F.when(F.col("section") == s, F.lit(i)) for i, s in enumerate(order)))
    w = Window.partitionBy("seed", "id").orderBy(F.desc("score"), place)
    once = pack_items(nodes, edges, seeds).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    ranked = once.withColumn("score", F.col("score") - 10 * place).withColumn("section_of", F.col("section")).withColumn("section", F.lit("items"))
    return trim(ranked, ["seed"], budget or BUDGETS[mode]).drop("section").withColumnRenamed("section_of", "section")


def pack_gaps(items: DataFrame, seeds: DataFrame) -> DataFrame:
    """Dimensions that a seed's pack has nothing for."""
    want = seeds.select(F.col("node").alias("seed"), F.explode(F.array(*(F.lit(s) for s in BASE))).alias("section"))
    return want.join(items.select("seed", "section").distinct(), ["seed", "section"], "left_anti")


def plan_change(spark: SparkSession, found: DataFrame) -> DataFrame:
    """The sections of a change plan with the number of rows found for each, and whether it is a gap. ``found``: section."""
    sections = spark.createDataFrame([(i, s, s in GAP_DIMENSIONS) for i, s in enumerate(PLAN_SECTIONS)], "position int, section string, required boolean")
    n = found.groupBy("section").agg(F.count(F.lit(1)).alias("rows"))
    return F.broadcast(sections).join(n, "section", "left").select("position", "section", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), (F.col("required") & F.col("rows").isNull()).alias("gap"))


def brief(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Risk digest of every node: callers, callees, foreign repositories that use it, repositories it uses."""
    n = nodes.select("id", "repo", "kind")
    e = edges.join(n.select(F.col("id").alias("source"), F.col("repo").alias("sr")), "source").join(n.select(F.col("id").alias("target"), F.col("repo").alias("tr")), "target")
    into = e.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"), F.count_distinct(F.when(F.col("sr") != F.col("tr"), F.col("sr"))).alias("impacted_repos"))
    out = e.groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("kind") == "calls").alias("callees"), F.count_distinct(F.when(F.col("sr") != F.col("tr"), F.col("tr"))).alias("repo_deps"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return brief_risk(n.join(into, "id", "left").join(out, "id", "left").select("id", "kind", *(zero(c) for c in ("fan_in", "callees", "impacted_repos", "repo_deps"))))


def qa_evidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file outside tests: how many test files reach it in one step, and the support that gives, in thousandths."""
    n = nodes.select("id", "repo", "file_path", X.is_test_path(F.col("file_path")).alias("test"))
    e = edges.join(n.select(F.col("id").alias("source"), F.col("file_path").alias("sf"), F.col("test").alias("st")), "source").join(n.select(F.col("id").alias("target"), F.col("file_path").alias("tf"), F.col("test").alias("tt")), "target")
    t = e.where("st and not tt").groupBy(F.col("tf").alias("file_path")).agg(F.count_distinct("sf").alias("tests"))
    files = n.where("not test").select("repo", "file_path").distinct()
    return files.join(t, "file_path", "left").select("repo", "file_path", F.coalesce("tests", F.lit(0)).alias("tests"), F.least(F.lit(1000), 400 * F.coalesce("tests", F.lit(0))).cast("int").alias("support"))


def change_impact_cap(impact: DataFrame, most: int = 8) -> DataFrame:
    """The strongest repositories of each target, and how many were left out with the reason."""
    w = Window.partitionBy("target").orderBy(F.desc("weight"), "repo")
    j = impact.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("target")))
    return j.where(F.col("r") <= most).select("target", "repo", "weight", F.greatest(F.lit(0), F.col("n") - most).alias("left_out"), F.when(F.col("n") > most, "too_many_repos").alias("reason"))


def sibling_events(nodes: DataFrame) -> DataFrame:
    """(id, sibling): event nodes of one event name."""
    n = nodes.where(F.col("is_virtual") & F.col("kind").isin("topic", "event", "queue", "stream", "subject")).select("id", X.event_name(F.col("external_id"), F.col("name")).alias("event"))
    return n.join(n.withColumnRenamed("id", "sibling"), "event").where("id <> sibling").select("id", "sibling")


def sessions(calls: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Tool-call traces cut into sessions by silence: user, start, calls, tools, errors."""
    w = Window.partitionBy("user").orderBy("at", "id")
    j = calls.withColumn("new", (F.col("at") - F.coalesce(F.lag("at").over(w), F.col("at")) > gap_seconds).cast("int")).withColumn("s", F.sum("new").over(w))
    return j.groupBy("user", "s").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("calls"), F.count_distinct("tool").alias("tools"), F.count_if("error").alias("errors")).drop("s")


def resolve_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Import paths with the longest matching alias prefix of their repository put in place; the others as they are."""
    j = imports.join(aliases, (imports["repo"] == aliases["alias_repo"]) & F.expr("startswith(spec, prefix)"), "left")
    w = Window.partitionBy("repo", "spec").orderBy(F.desc_nulls_last(F.length("prefix")), "replacement")
    path = F.when(F.col("prefix").isNull(), F.col("spec")).otherwise(F.concat("replacement", F.expr("substring(spec, length(prefix) + 1)")))
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select("repo", "spec", path.alias("path"))


def validate_config(config: dict) -> list[str]:
    """What is wrong with a workspace configuration; nothing if it is sound."""
    problems, seen = [], set()
    for i, r in enumerate(config.get("repos") or []):
        name = r.get("name", "")
        if not re.fullmatch(r"[A-Za-z0-9._-]+", name or ""):
            problems.append(f"repos[{i}]: bad name")
        if name in seen:
            problems.append(f"repos[{i}]: {name} is named twice")
        seen.add(name)
        if not r.get("path"):
            problems.append(f"repos[{i}]: no path")
    if not config.get("repos"):
        problems.append("no repos")
    return problems
