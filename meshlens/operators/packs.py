"""Context packs: candidate scores, selection, budgets, caches and follow-ups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .kernels import cut, within_budget

# Points for words in a path, kinds of nodes and parts of repository names.
PATH_POINTS = {"api": 140, "transport": 140, "service": 120, "controller": 120, "usecase": 110, "provider": 90, "hook": 80}
KIND_POINTS = {"shared_symbol": 180, "interface": 150, "type": 140, "class": 120, "topic": 110, "queue": 110, "event": 110, "route": 110, "service": 90, "controller": 90, "function": 40, "import": -150, "file": -200}
SHARED_REPOS = ("shared", "common", "contracts", "core", "types", "lib")
# Least score and margin over the runner-up for high and medium certainty.
HIGH, MEDIUM, ALTERNATE = (500, 125), (425, 75), 250
# Default response sizes in bytes, by mode.
BUDGETS = {"brief": 2_000, "planning": 16_000, "debug": 12_000, "fix": 12_000, "review": 16_000, "change_impact": 32_000}


def candidate_score(edge_score: Column, anchor: Column, search: Column, words: list[str] = ()) -> Column:
    """Integer score of a pack candidate with columns repo, file_path, name and kind."""
    path = F.lower("file_path")
    points = reduce(lambda a, p: a + F.when(path.contains(p), PATH_POINTS[p]).otherwise(0), PATH_POINTS, F.lit(0))
    repo = F.when(F.arrays_overlap(F.split(F.lower("repo"), r"[-_/.]"), F.array(*(F.lit(s) for s in SHARED_REPOS))), 100).otherwise(0)
    kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in KIND_POINTS.items()), F.lit(0))
    clamp = lambda x, most: F.greatest(F.lit(0), F.least(F.lit(most), F.round(x * 100).cast("int")))
    align = reduce(lambda a, w: a + F.when(F.lower("repo").contains(w), 70).otherwise(0) + F.when(path.contains(w), 45).otherwise(0) + F.when(F.lower("name").contains(w), 25).otherwise(0) + F.when(F.col("kind").contains(w), 15).otherwise(0), [w for w in words if len(w) >= 2], F.lit(0))
    return (300 + edge_score + points + repo + kind + clamp(anchor, 250) + clamp(search, 120) + align).cast("long")


def select_target(scored: DataFrame, by: list[str]) -> DataFrame:
    """The best of each group and how certain it is: by its score and its margin over the runner-up."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    whole = Window.partitionBy(*by)
    j = scored.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("alternates", F.count_if(F.col("score") >= ALTERNATE).over(whole) - 1)
    margin = F.col("score") - F.coalesce("next", F.lit(0))
    sure = F.when((F.col("score") >= HIGH[0]) & (margin >= HIGH[1]), "high").when((F.col("score") >= MEDIUM[0]) & (margin >= MEDIUM[1]), "medium").otherwise("low")
    return j.where("r = 1").select(*by, "id", "score", margin.alias("margin"), sure.alias("certainty"), F.greatest("alternates", F.lit(0)).alias("alternates"))


def trim(items: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Items within a byte budget: sections in priority order, then rank; whole rows only."""
    priority = F.coalesce(*(F.when(F.col("section") == s, F.lit(i)) for i, s in enumerate(("impact", "siblings", "gaps", "bridges", "items"))), F.lit(9))
    return within_budget(items, by, [priority, F.desc("score"), F.col("id")], F.octet_length(F.to_json(F.struct("section", "id", "score"))), budget)


def lru_keep(cache: DataFrame, max_bytes: int, shards: int = 64) -> DataFrame:
    """Entries that stay in a cache: the most recently read whose sizes sum to the cap, with that sum (``used``).

    A total order over the whole cache: entries are dealt into ``shards`` ranges of it, ties by key, so
    that no day is one task; sums of the ranges come first, then those within each.
    """
    order = [F.desc("last_read"), F.desc("key")]
    dealt = cut(cache.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id()))
    per = dealt.groupBy("shard").agg(F.sum("bytes").alias("b"))
    before = per.select("shard", F.coalesce(F.sum("b").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a shard
    j = dealt.join(F.broadcast(before), "shard").where(F.col("before") < max_bytes)
    inner = F.sum("bytes").over(Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return j.withColumn("used", F.col("before") + inner).where(F.col("used") <= max_bytes).drop("shard", "before")


def invalidate(packs: DataFrame, pack_files: DataFrame, changed: DataFrame) -> DataFrame:
    """Packs that depend on none of the changed files."""
    hit = pack_files.join(changed, ["repo", "file_path"], "left_semi").select("key").distinct()
    return packs.join(hit, "key", "left_anti")


def call_log(calls: DataFrame, k: int) -> DataFrame:
    """The most called (target, mode): count, last time."""
    return calls.groupBy("target", "mode").agg(F.count(F.lit(1)).alias("calls"), F.max("at").alias("last_called")).orderBy(F.desc("calls"), F.desc("last_called"), "target", "mode").limit(k)


def upsert_latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def replace_slice(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys the new rows do not name, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def migration_siblings(edges: DataFrame, k: int = 25) -> DataFrame:
    """Per migration, other migrations of the same collection from other files, named once, first ``k``.

    No collection lists its pairs: the first ``k`` outside of any one file are among its first
    ``2 * k`` once each file has given ``k`` at most, and ``k`` collections with a second file give a
    migration all it can show.
    """
    m = edges.where("kind = 'migrates_collection'").select("source", "target", "owner_file").distinct()
    shared = m.groupBy("target").agg(F.min("owner_file").alias("low"), F.max("owner_file").alias("high")).where("low <> high").select("target")
    m = m.join(shared, "target", "left_semi")
    first = lambda df, by, order, n: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n).drop("r")
    offered = first(first(m, ["target", "owner_file"], ["source"], k), ["target"], ["source", "owner_file"], 2 * k)
    asking = m.withColumn("r", F.dense_rank().over(Window.partitionBy("source").orderBy("target"))).where(F.col("r") <= k).drop("r")
    j = asking.alias("a").join(offered.alias("b"), F.expr("a.target = b.target and a.owner_file <> b.owner_file")).select(F.col("a.source").alias("migration"), F.col("b.source").alias("sibling"), F.col("b.target").alias("collection")).distinct()
    return first(j, ["migration"], ["collection", "sibling"], k)


def brief_risk(df: DataFrame) -> DataFrame:
    """Risk from counts fan_in, callees, impacted_repos, repo_deps and the node's kind."""
    s = F.when(F.col("fan_in") >= 5, 1).otherwise(0) + F.when(F.col("callees") >= 3, 1).otherwise(0) + F.when(F.col("impacted_repos") > 0, 2).otherwise(0) + F.when(F.col("repo_deps") > 0, 1).otherwise(0) + F.when(F.col("kind").isin("shared_symbol", "payload_contract", "ai_contract", "topic", "event", "route"), 1).otherwise(0)
    return df.withColumn("risk_score", s).withColumn("risk", F.when(s <= 1, "low").when(s <= 3, "medium").otherwise("high"))


def query_shape(text: Column, kinds: Column) -> Column:
    """What a question is about: by its kinds, then by its words."""
    low = F.lower(text)
    return (
        F.when(F.array_contains(kinds, "route"), "route").when(F.array_contains(kinds, "event"), "event").when(low.rlike(r"^(get|post|put|patch|delete)\s+/"), "route").when(low.rlike(r"guard|permission|auth"), "guard")
        .when(low.rlike(r"dto|payload|schema|contract"), "payload").when(low.rlike(r"^[a-z0-9_-]+(\.[a-z0-9_-]+)+$"), "event").when(low.rlike(r"^use[A-Z]") | text.rlike(r"^use[A-Z]"), "hook").otherwise("generic")
    )


def batch(operations: list[tuple[str, Callable[[], DataFrame]]], most: int = 10) -> list[tuple[str, DataFrame | None, str | None]]:
    """Run up to ten read-only operations; one that fails to build does not stop the others."""
    if len(operations) > most:
        raise ValueError(f"at most {most} operations")
    out = []
    for name, f in operations:
        try:
            out.append((name, f(), None))
        except Exception as e:  # noqa: BLE001  an operation's failure is its result
            out.append((name, None, str(e).split("\n")[0]))
    return out


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """Per query: precision and recall at k, reciprocal rank and whether the first is right. ``ranked``: query, item, rank."""
    j = ranked.join(relevant.withColumn("good", F.lit(1)), ["query", "item"], "left")
    n = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    a = j.groupBy("query").agg(F.count_if((F.col("good") == 1) & (F.col("rank") <= k)).alias("hits"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"))
    return n.join(a, "query", "left").select("query", F.round(F.coalesce("hits", F.lit(0)) / k, 6).alias("precision"), F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.coalesce(F.col("first") == 1, F.lit(False)).alias("top1"))
