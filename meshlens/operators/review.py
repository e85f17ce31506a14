"""Change-set review: deltas of routes, symbols, events, decorators and deployments, impact by repository, merged proofs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as X
from .kernels import cut, diff

# Decorators that enforce access.
ENFORCING = ("audit", "permission", "authenticated", "authorized", "rolesallowed", "requirespermission")
# Edge kinds by what a consumer does with a target.
USE_CLASSES = {"read": ("reads_field", "filters_on_field", "consumes", "uses_event_from", "consumes_api_from"), "write": ("writes_field", "persists_to", "publishes", "produces_event_for", "backfills_field"), "construct": ("calls", "implements", "extends", "uses_shared", "uses_type_from")}


def handlers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, path, handler): the first real source that serves a route."""
    routes = nodes.where("kind = 'route'").select(F.col("id").alias("target"), F.split(F.substring_index("external_id", "__", -1), " ", 2).alias("p"))
    real = nodes.where(~F.col("is_virtual")).select(F.col("id").alias("source"), F.concat_ws(":", "repo", "file_path", "name").alias("handler"))
    served = edges.where("kind = 'serves'").join(routes, "target").join(real, "source")
    return served.groupBy(F.upper(F.col("p")[0]).alias("method"), X.route_path(F.col("p")[1]).alias("path")).agg(F.min("handler").alias("handler"))


def route_deltas(baseline: tuple[DataFrame, DataFrame], review: tuple[DataFrame, DataFrame]) -> DataFrame:
    return diff(handlers(*baseline), handlers(*review), ["method", "path"], ["handler"]).where("change <> 'same'")


def symbol_deltas(baseline: DataFrame, review: DataFrame) -> DataFrame:
    """Public symbols by repository and qualified name, not by id: added, removed, or of another signature or visibility."""
    def pick(n: DataFrame) -> DataFrame:
        own = F.col("kind").isin("function", "class", "type") & ~F.col("is_virtual") & (F.col("visibility") == "public")
        return n.where(own | (F.col("kind") == "shared_symbol")).groupBy("repo", "qualified_name").agg(F.min("signature").alias("signature"), F.min("visibility").alias("visibility"))

    return diff(pick(baseline), pick(review), ["repo", "qualified_name"], ["signature", "visibility"]).where("change <> 'same'")


def event_deltas(baseline: tuple[DataFrame, DataFrame], review: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Participants that events gained or lost on either side: kind, event, side, node, change."""
    def sides(g: tuple[DataFrame, DataFrame]) -> DataFrame:
        nodes, edges = g
        t = nodes.where(F.col("is_virtual") & F.col("kind").isin("topic", "queue", "subject", "stream", "event")).select(F.col("id").alias("target"), F.col("kind").alias("event_kind"), X.event_name(F.col("external_id"), F.col("name")).alias("event"))
        side = F.when(F.col("kind").isin("publishes", "produces_event_for"), "producer").when(F.col("kind").isin("consumes", "uses_event_from"), "consumer")
        return edges.select("target", "source", side.alias("side")).where("side is not null").join(t, "target").select("event_kind", "event", "side", F.col("source").alias("node")).distinct()

    return diff(sides(baseline), sides(review), ["event_kind", "event", "side", "node"], []).where("change <> 'same'")


def decorator_deltas(baseline: DataFrame, review: DataFrame) -> DataFrame:
    """Enforcing decorators put on or taken off: (repo, file_path, decorator, target_qn, change)."""
    keys = ["repo", "file_path", "decorator", "target_qn"]
    pick = lambda d: d.where(F.lower("decorator").isin(*ENFORCING)).select(*keys).distinct()
    return diff(pick(baseline), pick(review), keys, []).where("change <> 'same'")


def deployment_deltas(baseline: DataFrame, review: DataFrame, kinds: tuple[str, ...] = ("deployment", "env_var", "workflow_job", "secret", "config_map", "broker", "database")) -> DataFrame:
    pick = lambda n: n.where(F.col("kind").isin(*kinds)).select("kind", "repo", "name").distinct()
    return diff(pick(baseline), pick(review), ["kind", "repo", "name"], []).where("change <> 'same'")


def impact_by_repo(nodes: DataFrame, edges: DataFrame, targets: DataFrame, cap: int = 50) -> DataFrame:
    """Per target and consumer repository: distinct sources and how many read, write or construct; most first, capped."""
    e = edges.join(targets.select(F.col("id").alias("target")), "target", "left_semi").join(nodes.select(F.col("id").alias("source"), "repo"), "source")
    use: Column = F.coalesce(*(F.when(F.col("kind").isin(*k), F.lit(c)) for c, k in USE_CLASSES.items()), F.lit("unknown"))
    out = e.groupBy("target", "repo").agg(F.count_distinct("source").alias("sources"), *(F.count_if(use == c).alias(c) for c in (*USE_CLASSES, "unknown")))
    r = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("sources"), "repo"))
    return out.withColumn("r", r).where(F.col("r") <= cap).drop("r")


def merge_proofs(proofs: DataFrame, per_repo: int = 2) -> DataFrame:
    """Proofs once by their ends and kind, with all edge kinds and the best strength; the best of each target repository."""
    one = proofs.groupBy("source_repo", "source_file", "target_repo", "target_file", "kind").agg(F.array_join(F.array_sort(F.collect_set("edge_kind")), ",").alias("edge_kinds"), F.max("strength").alias("strength"))
    r = F.row_number().over(Window.partitionBy("target_repo").orderBy(F.desc("strength"), "kind", "source_repo", "source_file", "target_file"))
    return one.withColumn("r", r).where(F.col("r") <= per_repo).drop("r")


def evidence_split(proofs: DataFrame, confirmed: int = 67, probable: int = 33) -> DataFrame:
    """Target repositories by their strongest proof: confirmed, probable, or weaker ones that are neither."""
    s = proofs.groupBy("target_repo").agg(F.max("strength").alias("strength"))
    return s.withColumn("class", F.when(F.col("strength") >= confirmed, "confirmed").when(F.col("strength") < probable, "probable").otherwise("possible"))


def dependents(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """Files that depend on the given ones, with the number of edges."""
    f = files.select(F.col("repo").alias("target_repo"), F.col("file_path").alias("target_path"))
    return dependencies.join(f, ["target_repo", "target_path"], "left_semi").groupBy("source_repo", "source_path").agg(F.sum("edge_count").alias("edges"))


def unresolved_retry(candidates: DataFrame, keys: DataFrame, changed: DataFrame) -> DataFrame:
    """Unresolved calls whose candidate key names a changed symbol."""
    hit = keys.join(changed.select("candidate_key").distinct(), "candidate_key", "left_semi").select("repo", "file_path").distinct()
    return candidates.join(hit, ["repo", "file_path"], "left_semi")


def shared_candidates(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, kinds: tuple[str, ...] = ("uses_shared", "uses_type_from", "implements_contract_from", "contract_on")) -> DataFrame:
    """(seed, id): the node, its peers over shared edges, and virtual symbols of the same short name."""
    s = seeds.select(F.col("node").alias("seed"))
    own = s.select("seed", F.col("seed").alias("id"))
    e = edges.where(F.col("kind").isin(*kinds))
    peers = s.join(e.select(F.col("source").alias("seed"), F.col("target").alias("id")).unionAll(e.select(F.col("target").alias("seed"), F.col("source").alias("id"))), "seed")
    short = nodes.select("id", X.short_name(F.coalesce("qualified_name", "name")).alias("short"), "kind", "is_virtual")
    named = s.join(short.select(F.col("id").alias("seed"), "short"), "seed").join(short.where("is_virtual and kind = 'shared_symbol'").select("id", "short"), "short").select("seed", "id")
    return own.unionByName(peers).unionByName(named).distinct()


def field_evidence(edges: DataFrame, fields: DataFrame) -> DataFrame:
    """Per data field: readers, writers, filters, indexes and backfills, and the risk they pose together."""
    kinds = {"readers": "reads_field", "writers": "writes_field", "filters": "filters_on_field", "indexes": "indexes_field", "backfills": "backfills_field"}
    c = edges.join(fields.select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("target").alias("field")).agg(*(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()))
    risk = F.when((F.col("filters") > 0) & (F.col("indexes") == 0), "filter_without_index").when((F.col("writers") > 0) & (F.col("readers") > 0) & (F.col("backfills") == 0), "no_backfill").when((F.col("readers") > 0) & (F.col("writers") == 0), "read_only").otherwise("none")
    return c.withColumn("risk", risk)


def optional_filter_risks(contracts: DataFrame, filters: DataFrame, min_confidence: int = 750) -> DataFrame:
    """Fields that a contract may leave out and a filter relies on. ``filters``: target_id, name, file_path."""
    f = contracts.select("target_id", F.explode("fields").alias("f")).where(F.col("f.optional") & (F.col("f.confidence") >= min_confidence)).select("target_id", F.col("f.name").alias("name")).distinct()
    return filters.join(f, ["target_id", "name"], "left_semi")


def bridges(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, kinds: list[str]) -> DataFrame:
    """Virtual neighbours one hop away; for seeds without any, those two hops away. (seed, node, hops)."""
    e = edges.where(F.col("kind").isin(*kinds)).select("source", "target")
    both = e.unionAll(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    v = nodes.where("is_virtual").select(F.col("id").alias("node"))
    s = seeds.select(F.col("node").alias("seed"))
    one = s.join(both, s["seed"] == both["source"]).select("seed", F.col("target").alias("node"))
    near = one.join(v, "node", "left_semi").select("seed", "node", F.lit(1).alias("hops"))
    two = one.join(near.select("seed").distinct(), "seed", "left_anti").select("seed", F.col("node").alias("source")).join(both, "source").select("seed", F.col("target").alias("node")).where("seed <> node").distinct()
    return near.unionByName(two.join(v, "node", "left_semi").select("seed", "node", F.lit(2).alias("hops")))


def overview(nodes: DataFrame, dead: DataFrame, hot: DataFrame, top: int = 5) -> DataFrame:
    """Per repository: files, functions, dead files and its hottest files."""
    n = nodes.groupBy("repo").agg(F.count_distinct("file_path").alias("files"), F.count_if(F.col("kind") == "function").alias("functions"))
    d = dead.groupBy("repo").agg(F.count(F.lit(1)).alias("dead_files"))
    w = Window.partitionBy("repo").orderBy(F.desc("score"), "file_path")
    h = hot.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "file_path"))), lambda x: x["file_path"]), ",").alias("hotspots"))
    return n.join(d, "repo", "left").join(h, "repo", "left").select("repo", "files", "functions", F.coalesce("dead_files", F.lit(0)).cast("long").alias("dead_files"), F.coalesce("hotspots", F.lit("")).alias("hotspots"))


def divergence(refs: DataFrame) -> DataFrame:
    """Freshness of an index by its stored and current commit: no_change, incremental, rewritten or full."""
    state = F.when(F.col("stored_sha").isNull(), "full").when(F.col("stored_sha") == F.col("head_sha"), "no_change").when(F.col("stored_is_ancestor"), "incremental").otherwise("rewritten")
    return refs.withColumn("sync", state)


def range_changes(deltas: DataFrame) -> DataFrame:
    """(repo, file_path, status): what the deltas of a range of commits did to each file; a deletion outweighs an addition, that a change."""
    has = lambda k: F.bool_or(F.col("change_kind") == k)
    return deltas.groupBy("repo", "file_path").agg(F.when(has("deleted"), "deleted").when(has("added"), "added").otherwise("modified").alias("status"))


# Operators that defeat an index, and those that coerce types.
INDEX_DEFEATING = ("$where", "$nin", "$ne", "$not")
COERCING = ("$toString", "$toInt", "$convert", "$expr")


def filter_findings(queries: DataFrame, max_depth: int = 16) -> DataFrame:
    """Unsafe document-store filters: (repo, file_path, rule) for index-defeating operators, unanchored patterns, type coercions and null parents.

    ``queries``: repo, file_path, filter (JSON text). The filter is walked as a variant, a level a round,
    until no values are left or to ``max_depth``; what is no JSON has no findings.
    """
    level = queries.select("repo", "file_path", F.try_parse_json(F.col("filter")).alias("v")).where("v is not null")
    level = level.select(F.struct("repo", "file_path").alias("q"), "v")
    found = None
    for _ in range(max_depth):
        level.createOrReplaceTempView(view := f"filters_{uuid.uuid4().hex}")
        step = level.sparkSession.sql(f"select q, e.key as key, e.value as value from {view}, lateral variant_explode(v) e")
        text = F.col("value").cast("string")
        rules = F.array_compact(F.array(
            F.when(F.col("key").isin(*INDEX_DEFEATING), F.lit("index_defeat")), F.when((F.col("key") == "$regex") & ~text.startswith("^"), F.lit("unanchored_regex")),
            F.when(F.col("key").isin(*COERCING), F.lit("unsafe_coercion")), F.when(F.col("key").contains(".") & F.is_variant_null(F.col("value")), F.lit("null_parent")),
        ))
        step = cut(step.select("q", "value", rules.alias("rules")))
        here = step.select("q", F.explode("rules").alias("rule"))
        found = here if found is None else found.unionByName(here)
        level = step.where("schema_of_variant(value) like 'OBJECT%' or schema_of_variant(value) like 'ARRAY%'").select("q", F.col("value").alias("v"))
        if level.isEmpty():
            break
    return found.distinct().select("q.repo", "q.file_path", "rule")


def index_drift(declared: DataFrame, live: DataFrame) -> DataFrame:
    """(collection, name, drift): search indexes that are declared and not there, there and not declared, or defined otherwise."""
    d = diff(declared, live, ["collection", "name"], ["definition"]).where("change <> 'same'")
    return d.select("collection", "name", F.when(F.col("change") == "removed", "missing").when(F.col("change") == "added", "undeclared").otherwise("differs").alias("drift"))
