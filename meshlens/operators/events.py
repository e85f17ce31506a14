"""Event, route and transport topology over virtual nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .kernels import bfs, edge_filter, top_k

PRODUCER = ("publishes", "produces_event_for")
CONSUMER = ("consumes", "uses_event_from", "contract_on")
EVENT_KINDS = ("topic", "queue", "subject", "stream", "event")


def hydrate(edges: DataFrame, nodes: DataFrame, end: str, prefix: str, cols: tuple[str, ...] = ("repo", "kind", "name", "file_path", "is_virtual")) -> DataFrame:
    """Columns of the node at one end; edges without that node drop out."""
    n = nodes.select(F.col("id").alias(end), *(F.col(c).alias(f"{prefix}_{c}") for c in cols))
    return edges.join(n, end)


def matches(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], min_confidence: int | None = None) -> DataFrame:
    """(target, source, kind, confidence, repo, file_path, name): real nodes at the source end, once a target and node, the first kind wins."""
    e = edge_filter(edges, list(kinds), min_confidence)
    real = nodes.where(~F.col("is_virtual")).select(F.col("id").alias("source"), "repo", "file_path", "name")
    first = e.groupBy("target", "source").agg(F.min(F.struct("kind", "confidence")).alias("k")).select("target", "source", "k.kind", "k.confidence")
    return first.join(real, "source")


def event_trace(nodes: DataFrame, edges: DataFrame, min_confidence: int | None = None, limit: int | None = None) -> DataFrame:
    """Producers and consumers of every event target, a row each: target, side, node, repo, file_path, name, kind, confidence, truncated.

    Where a side of a target is empty, that side of the topic of the same event name stands in.
    """
    targets = nodes.where(F.col("kind").isin(*EVENT_KINDS) & F.col("is_virtual")).select(F.col("id").alias("target"), F.col("kind").alias("target_kind"), X.event_name(F.col("external_id"), F.col("qualified_name"), F.col("name")).alias("event"))
    sides = matches(nodes, edges, PRODUCER, min_confidence).withColumn("side", F.lit("producer")).unionByName(matches(nodes, edges, CONSUMER, min_confidence).withColumn("side", F.lit("consumer")))
    direct = sides.join(targets, "target")
    topics = direct.where("target_kind = 'topic'").drop("target", "target_kind")
    wanted = targets.where("target_kind <> 'topic'").crossJoin(F.broadcast(edges.sparkSession.createDataFrame([("producer",), ("consumer",)], "side string")))  # two rows
    empty = wanted.join(direct.select("target", "side").distinct(), ["target", "side"], "left_anti")
    stand_in = empty.join(topics, ["event", "side"])
    out = direct.unionByName(stand_in.select(*direct.columns)).drop("target_kind")
    if limit is None:
        return out.withColumn("truncated", F.lit(False))
    return top_k(out, ["target", "side"], [F.col("repo"), F.col("file_path"), F.col("name"), F.col("source")], limit).drop("rank")


def producer_consumer_repos(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(producer_repo, consumer_repo, topics): distinct topics that link two repositories."""
    def side(kinds: tuple[str, ...], name: str) -> DataFrame:
        return matches(nodes, edges, kinds).select("target", F.col("repo").alias(name)).distinct()

    return side(PRODUCER, "producer_repo").join(side(CONSUMER, "consumer_repo"), "target").groupBy("producer_repo", "consumer_repo").agg(F.count(F.lit(1)).alias("topics"))


def orphan_topics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Virtual event nodes with exactly one of publishers and consumers: high if only consumed, medium if only published."""
    e = edges.where(F.col("kind").isin("publishes", "consumes")).join(nodes.where(~F.col("is_virtual")).select(F.col("id").alias("source")), "source", "left_semi")
    counts = e.groupBy("target").agg(F.count_if(F.col("kind") == "publishes").alias("publishers"), F.count_if(F.col("kind") == "consumes").alias("consumers"))
    t = nodes.where(F.col("kind").isin(*EVENT_KINDS) & F.col("is_virtual")).select(F.col("id").alias("target"), "name", "kind")
    one = (F.col("publishers") > 0) != (F.col("consumers") > 0)
    return t.join(counts, "target").where(one).withColumn("severity", F.when(F.col("consumers") > 0, "high").otherwise("medium"))


SIDES = (("publishes", "consumes"), ("serves", "consumes_api_from"))


def transport_links(nodes: DataFrame, edges: DataFrame, sides: tuple[tuple[str, str], ...] = SIDES) -> DataFrame:
    """(transport, producer_repo, consumer_repo, targets, links): how many producers and consumers of two repositories meet, and at how many virtual targets.

    Each side is counted by target and repository before the sides meet, so no pair of ends is listed.
    """
    n = nodes.select("id", "repo")
    v = nodes.where("is_virtual").select(F.col("id").alias("target"))
    out = None
    for give, take in sides:
        ends = lambda kind, p: edges.where(F.col("kind") == kind).join(v, "target", "left_semi").join(n.select(F.col("id").alias("source"), F.col("repo").alias(f"{p}_repo")), "source").groupBy("target", f"{p}_repo").agg(F.count(F.lit(1)).alias(p))
        j = ends(give, "producer").join(ends(take, "consumer"), "target").groupBy(F.lit(give).alias("transport"), "producer_repo", "consumer_repo").agg(F.count(F.lit(1)).alias("targets"), F.sum(F.col("producer") * F.col("consumer")).alias("links"))
        out = j if out is None else out.unionByName(j)
    return out


def transport_pairs(nodes: DataFrame, edges: DataFrame, producer_repo: str, consumer_repo: str, sides: tuple[tuple[str, str], ...] = SIDES) -> DataFrame:
    """(transport, target, producer, consumer, producer_repo, consumer_repo) for each pair of two repositories' ends that meets at a virtual target."""
    v = nodes.where("is_virtual").select(F.col("id").alias("target"))
    end = lambda repo, p: nodes.where(F.col("repo") == repo).select(F.col("id").alias(p), F.lit(repo).alias(f"{p}_repo"))
    out = None
    for give, take in sides:
        a = edges.where(F.col("kind") == give).select("target", F.col("source").alias("producer")).join(end(producer_repo, "producer"), "producer").join(v, "target", "left_semi")
        b = edges.where(F.col("kind") == take).select("target", F.col("source").alias("consumer")).join(end(consumer_repo, "consumer"), "consumer")
        j = a.join(b, "target").select(F.lit(give).alias("transport"), "target", "producer", "consumer", "producer_repo", "consumer_repo")
        out = j if out is None else out.unionByName(j)
    return out


def co_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, other, kinds, targets): repositories that meet at a virtual node; only a repository itself is left out."""
    n = nodes.select("id", "repo", "is_virtual")
    v = n.where("is_virtual").select(F.col("id").alias("target"))
    per = edges.join(v, "target", "left_semi").join(n.select(F.col("id").alias("source"), "repo"), "source").select("target", "repo", "kind").distinct()
    a = per.select("target", "repo").distinct()
    # kinds are gathered before the join, so a pair of repositories meets once a target
    b = per.groupBy("target", F.col("repo").alias("other")).agg(F.array_sort(F.collect_set("kind")).alias("ks"))
    pairs = a.join(b, "target").where("repo <> other").groupBy("repo", "other").agg(F.collect_set("ks").alias("ks"), F.count(F.lit(1)).alias("targets"))
    return pairs.select("repo", "other", F.array_join(F.array_sort(F.array_distinct(F.flatten("ks"))), ",").alias("kinds"), "targets")


def blast_radius(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 2, limit: int | None = None) -> DataFrame:
    """From event nodes to consumers, to what those publish, consume or serve, and on; confidence multiplies along the way."""
    out_kinds = ["publishes", "consumes", "serves"]
    e = edges.where(F.col("kind").isin(*out_kinds))
    inward = e.where("kind in ('consumes', 'serves')").select(F.col("target").alias("source"), F.col("source").alias("target"), F.concat(F.lit("<"), "kind").alias("kind"), "confidence")
    both = inward.unionByName(e.select("source", "target", "kind", "confidence"))
    reached = bfs(both, seeds, max_depth, carry_confidence=True)
    if limit is None:
        return reached
    return top_k(reached, ["seed"], [F.col("depth"), F.desc_nulls_first("confidence"), F.col("node")], limit).drop("rank")


def route_trace(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Handlers and callers of every route key, whatever node bears it: route_key, side, node, kind, repo, name; once by node and kind."""
    routes = nodes.where("kind = 'route'").select(F.col("id").alias("target"), X.route_key_of(F.coalesce("external_id", "qualified_name")).alias("route_key")).where("route_key is not null")
    n = nodes.select(F.col("id").alias("source"), "repo", "name")
    side = F.when(F.col("kind") == "serves", "handler").otherwise("caller")
    e = edges.where(F.col("kind").isin("serves", "consumes", "consumes_api_from")).join(routes, "target")
    return e.select("route_key", side.alias("side"), "source", "kind").distinct().join(n, "source")


def target_rank(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """Event nodes by how well they answer a query: kind, family match, then incoming edges."""
    kinds = {"event": 5, "topic": 4, "queue": 3, "stream": 2, "subject": 1}
    kind: Column = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in kinds.items()), F.lit(0))
    name = X.event_name(F.col("external_id"), F.col("name"))
    family = F.when(name == F.lit(query.lower()), 500).when(X.family_match(name, F.lit(query)), 220)
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("incoming"))
    found = nodes.where(F.col("kind").isin(*kinds) & family.isNotNull()).join(into, "id", "left")
    score = kind * 100 + family + F.coalesce("incoming", F.lit(0))
    return found.select("id", "kind", name.alias("event"), score.cast("long").alias("score"))
