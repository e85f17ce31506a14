"""Traversals and fixpoints over typed edges: reach, impact, evidence, cycles, dead code, proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as X
from ..schema import CHAIN_SPECIFICITY, IMPACT_SPECIFICITY, PROOF_STRENGTH
from .kernels import _all, bfs, coding, drop, edge_filter, propagate, reach, reversed_edges, spread, stored, strong_components, top_k, undirected, valued

FAN_OUT = 256
#: Groups of repositories, of about as many edges each, that proofs are looked for in, one after another.
PROOF_GROUPS = 5
# Edge kinds of agent graphs, of data access and of use.
AI_KINDS = ["defines_agent_node", "graph_transitions_to", "composes_agent", "spawns_subagent", "binds_tool", "invokes_llm", "produces_ai_contract", "uses_prompt", "fetches_prompt_from", "retrieves_from", "embeds", "indexes_vector", "calls_mcp_tool", "exposes_mcp_tool"]
CRUD_KINDS = ["calls", "depends_on", "references", "persists_to", "consumes_api_from"]
USAGE_KINDS = ["calls", "imports", "references", "extends", "implements", "depends_on", "uses_shared", "uses_type_from", "uses_event_from", "uses_guard_from", "implements_contract_from", "consumes_hook_from"]


def _lookup(kind, table: dict[str, int], default: int):
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in table.items()), F.lit(default))


def traverse(edges: DataFrame, seeds: DataFrame, max_depth: int, kinds: list[str] | None = None, min_confidence: int | None = None) -> DataFrame:
    """Forward traversal with provenance: first path and depth, and how many edges lead into each node from what was reached (``in_paths``).

    ``depth_capped`` says that a node of the last depth has edges that were not followed, ``truncated``
    that a node has more than ``FAN_OUT`` edges, of which the first are followed.
    """
    e = edge_filter(edges, kinds, min_confidence)
    got = bfs(e, seeds, max_depth, fan_out=FAN_OUT)
    inner = got.where(F.col("depth") < max_depth).select("seed", F.col("node").alias("source")).unionByName(seeds.select(F.col("node").alias("seed"), F.col("node").alias("source")).distinct())
    into = inner.join(e.select("source", F.col("target").alias("node"), "kind").distinct(), "source").groupBy("seed", "node").agg(F.least(F.count(F.lit(1)), F.lit(FAN_OUT)).alias("in_paths"))
    out = e.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    flags = ((F.col("depth") == max_depth) & F.col("out").isNotNull()).alias("depth_capped"), (F.coalesce("out", F.lit(0)) > FAN_OUT).alias("truncated")
    return got.join(into, ["seed", "node"]).join(out, "node", "left").select("seed", "node", "depth", "path", "in_paths", *flags)


def callees(edges: DataFrame, seeds: DataFrame, depth: int = 1, limit: int = 50) -> DataFrame:
    """Called nodes up to depth 3, nearest first, with a flag where more were left out; ``limit`` is the only cap."""
    got = bfs(edge_filter(edges, ["calls"]), seeds, max(1, min(3, depth)))
    return top_k(got.select("seed", "node", "depth"), ["seed"], [F.col("depth"), F.col("node")], limit)


def callers(edges: DataFrame, seeds: DataFrame, depth: int = 1, limit: int = 50) -> DataFrame:
    return callees(reversed_edges(edges), seeds, depth, limit)


def trace_across_repos(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """Both directions from virtual nodes; a real node is reported for every edge that reaches it, and expanded once.

    (seed, repo, node, source, kind, confidence, depth), depth being that of the edge.
    """
    e = undirected(edges.select("source", "target", "kind", "confidence"))
    start = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"))
    reached = bfs(e, seeds, max_depth - 1).select("seed", "node", "depth").unionByName(start) if max_depth > 1 else start
    hops = reached.select("seed", F.col("node").alias("source"), (F.col("depth") + 1).alias("depth")).join(e, "source").select("seed", "source", F.col("target").alias("node"), "kind", "confidence", "depth")
    real = nodes.where(~F.col("is_virtual")).select(F.col("id").alias("node"), "repo")
    return hops.where("node <> seed").join(real, "node").select("seed", "repo", "node", "source", "kind", "confidence", "depth")


def trace_impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """The repositories that a trace of at most five steps meets, those of the strongest confidence first; a missing confidence is trusted."""
    hops = trace_across_repos(nodes, edges, seeds, max(1, min(5, max_depth)))
    g = hops.groupBy("seed", "repo").agg(F.count(F.lit(1)).alias("hops"), F.count_distinct("node").alias("nodes"), F.min("depth").alias("depth"), F.max(F.coalesce("confidence", F.lit(1000))).alias("strongest"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("strongest"), "repo")))


def shared_impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, weak_kinds: tuple[str, ...] = ("co_changes_with",)) -> DataFrame:
    """Unbounded reverse impact per seed, repository and file; weak edges only for repositories without structural ones.

    Every edge into what was reached counts for the file it comes from: least depth, kinds, whether it
    passes a serialisation or validation point, and the weight of all that.
    """
    n = nodes.select(F.col("id").alias("node"), "repo", "file_path", F.coalesce("external_id", F.lit("")).alias("x"))
    start = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct()

    def run(e: DataFrame, weak: bool) -> DataFrame:
        back = reversed_edges(e).select("source", "target", "kind", "confidence")
        got = bfs(back, seeds, None, paths=False).select("seed", "node", "depth").unionByName(start)
        hops = got.select("seed", F.col("node").alias("source"), (F.col("depth") + 1).alias("depth")).join(back, "source").select("seed", F.col("target").alias("node"), "kind", "depth").join(n, "node")
        serial = F.col("kind").isin("contract_on", "produces_event_for") | F.col("x").rlike("payload|schema")
        valid = (F.col("kind") == "uses_guard_from") | F.col("x").contains("validator")
        out = hops.groupBy("seed", "repo", "file_path").agg(
            F.min("depth").alias("depth"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max(_lookup(F.col("kind"), IMPACT_SPECIFICITY, 1)).alias("spec"), F.bool_or(serial).alias("serialization"), F.bool_or(valid).alias("validation"))
        weight = 65535 - F.col("depth") - (500 if weak else 0) + (F.col("spec") + 2 * F.col("serialization").cast("int") + F.col("validation").cast("int")) / 10.0
        return out.select("seed", "repo", "file_path", "depth", "kinds", F.lit(weak).alias("weak"), "serialization", "validation", weight.alias("weight"))

    strong = run(edges.where(~F.col("kind").isin(*weak_kinds)), False)
    only_weak = edges.where(F.col("kind").isin(*weak_kinds))
    return strong.unionByName(run(only_weak, True).join(strong.select("seed", "repo").distinct(), ["seed", "repo"], "left_anti"))


def evidence_chain(edges: DataFrame, pairs: DataFrame, half: int = 4) -> DataFrame:
    """Shortest undirected chain between pairs (a, b) by two searches that meet: length, meeting node and strongest edge kind's rank."""
    e = undirected(edges.select("source", "target", "kind", "confidence"))
    a = bfs(e, pairs.select(F.col("a").alias("node")), half).select(F.col("seed").alias("a"), "node", F.col("depth").alias("da"), F.col("path").alias("pa"))
    b = bfs(e, pairs.select(F.col("b").alias("node")), half).select(F.col("seed").alias("b"), "node", F.col("depth").alias("db"), F.col("path").alias("pb"))
    own = lambda c, d, p: pairs.select(F.col(c), F.col(c).alias("node"), F.lit(0).alias(d), F.lit("").alias(p)).distinct()
    a, b = a.unionByName(own("a", "da", "pa")), b.unionByName(own("b", "db", "pb"))
    met = pairs.join(a, "a").join(b, ["b", "node"])
    rank = lambda p: F.coalesce(F.array_max(F.transform(F.split(p, ">"), lambda k: _lookup(k, CHAIN_SPECIFICITY, 0))), F.lit(0))
    best = met.groupBy("a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("length"), -F.greatest(rank("pa"), rank("pb")), "node")).alias("m"))
    return best.select("a", "b", "m.length", F.col("m.node").alias("meeting"))


def cycles(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Cycles of two nodes and more: component, size, members, whether it crosses repositories; cycles inside one class are left out."""
    scc = strong_components(edge_filter(edges, kinds))
    prefix = F.when(F.col("name").contains("."), F.substring_index("name", ".", 1))
    n = nodes.select(F.col("id").alias("node"), "repo", prefix.alias("prefix"))
    members = stored(scc.join(n, "node"), "members")
    one = F.coalesce(F.min("prefix") == F.max("prefix"), F.lit(False)) & (F.count("prefix") == F.count(F.lit(1)))
    out = members.groupBy("component").agg(
        F.max("size").alias("size"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members"), F.coalesce(F.min("repo") != F.max("repo"), F.lit(False)).alias("cross_repo"), one.alias("one_class"))
    return out.where("not one_class").drop("one_class")


def _with_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with repository, file and virtuality of both ends (sr, sf, sv, tr, tf, tv); edges of unknown nodes fall away.

    A graph that is stored with these columns saves two joins of all edges with all nodes.
    """
    if {"sr", "sf", "sv", "tr", "tf", "tv"} <= set(edges.columns):
        return edges
    end = lambda c, x: nodes.select(F.col("id").alias(c), F.col("repo").alias(f"{x}r"), F.col("file_path").alias(f"{x}f"), F.col("is_virtual").alias(f"{x}v"))
    return edges.join(end("source", "s"), "source").join(end("target", "t"), "target")


def dead_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files no root reaches. Roots: paths that start programs, owners of surfaces, and files other repositories use.

    ``nodes`` has id, repo and file_path; edges between nodes become edges between files. Confidence is
    high, or medium for repositories without any root.
    """
    n = nodes.where(~F.col("is_virtual"))
    key = lambda r, f: F.concat_ws("\x00", r, f)
    surface = F.col("kind").isin("route", "service", "topic", "queue", "event")
    files = stored(n.groupBy("repo", "file_path").agg(F.bool_or(surface).alias("surface")).select("repo", "file_path", "surface", key("repo", "file_path").alias("node")), "files")
    code, names = coding(files.select("node"))
    drop(names)  # the files have theirs
    e = _with_files(nodes, edges).where("not sv and not tv and (sr <> tr or sf <> tf)")
    files = files.withColumn("node", code(F.col("node")))
    foreign = e.where("sr <> tr").select(code(key("tr", "tf")).alias("node"))
    roots = stored(files.where(F.col("surface") | X.is_root_path(F.concat(F.lit("/"), "file_path"))).select("node").union(foreign).distinct(), "roots")
    live = reach(e.select(code(key("sr", "sf")).alias("source"), code(key("tr", "tf")).alias("target")), roots)
    dead = files.where(~X.is_test_path(F.col("file_path"))).join(live, "node", "left_anti")
    has = files.join(roots, "node", "left_semi").select("repo").distinct().withColumn("h", F.lit(True))
    return dead.join(has, "repo", "left").select("repo", "file_path", F.when(F.col("h"), "high").otherwise("medium").alias("confidence"))


def unused_exports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported functions, classes, types, entities and services outside tests that no edge uses."""
    n = nodes.where(F.col("kind").isin("function", "class", "type", "entity", "service") & ~X.is_test_path(F.col("file_path")))
    exported = edges.where("kind = 'exports'").select(F.col("target").alias("id"))
    used = edges.where(F.col("kind").isin(*USAGE_KINDS)).select(F.col("target").alias("id"))
    return n.join(exported, "id", "left_semi").join(used, "id", "left_anti").select("id", "repo", "file_path", "name")


def zombie_dependencies(manifest: DataFrame, imports: DataFrame) -> DataFrame:
    """Packages a repository declares and never imports."""
    used = imports.select("repo", X.package_root(F.col("spec")).alias("package")).where("package is not null").distinct()
    return manifest.join(used, ["repo", "package"], "left_anti")


def mock_leakage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports of mock files by files that are neither tests nor mocks, within a repository."""
    n = nodes.select("id", "repo", "file_path")
    e = edges.where("kind = 'imports'").join(n.select(F.col("id").alias("source"), F.col("repo").alias("repo"), F.col("file_path").alias("importer")), "source").join(n.select(F.col("id").alias("target"), F.col("repo").alias("tr"), F.col("file_path").alias("mock")), "target")
    return e.where((F.col("repo") == F.col("tr")) & X.is_mock_path(F.col("mock")) & ~X.is_mock_path(F.col("importer")) & ~X.is_test_path(F.col("importer"))).select("repo", "importer", "mock").distinct()


def component_reuse(local: DataFrame, design: DataFrame) -> DataFrame:
    """Local components that bear a design-system component's name; of several such the first path counts."""
    first = design.groupBy("name").agg(F.min("file_path").alias("design_path"))
    return local.join(first, "name").select("name", "repo", "file_path", "design_path")


def participation(nodes: DataFrame, edges: DataFrame, virtual_kinds_in: tuple[str, ...] = ("publishes", "serves", "produces_event_for"), virtual_kinds_out: tuple[str, ...] = ("consumes", "consumes_api_from", "uses_event_from")) -> DataFrame:
    """(file, consumer_repo): repositories that depend on a file directly or through virtual nodes, spread to the files it depends on."""
    e = _with_files(nodes, edges)
    direct = e.where("not sv and not tv and sr <> tr").select(F.col("tf").alias("node"), F.col("sr").alias("value"))
    give = e.where(F.col("tv") & F.col("kind").isin(*virtual_kinds_in)).select("target", F.col("sf").alias("node"), F.col("sr").alias("own")).distinct()
    take = e.where(F.col("tv") & F.col("kind").isin(*virtual_kinds_out)).select("target", F.col("sr").alias("value")).distinct()
    through = give.join(take, "target").where("own <> value").select("node", "value")
    files = e.where("not sv and not tv and sr = tr and sf <> tf").select(F.col("sf").alias("source"), F.col("tf").alias("target"))
    return propagate(direct.unionByName(through), files, nodes.select(F.col("file_path").alias("node"))).select(F.col("node").alias("file_path"), F.col("value").alias("consumer_repo"))


def crud_trace(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 4) -> DataFrame:
    """From handlers along calls and persistence; each node's role: collection, entity, repository, database_hint or service."""
    keep = nodes.where(F.col("kind").isin("function", "class", "service", "entity")).select(F.col("id").alias("target"))
    e = edge_filter(edges, CRUD_KINDS).join(keep, "target", "left_semi")
    got = bfs(e.select("source", "target", "kind", "confidence"), seeds, max_depth, carry_confidence=True)
    low = F.lower(F.coalesce("qualified_name", "name"))
    role = (
        F.when(F.coalesce(F.col("external_id"), F.lit("")).startswith("__collection__") & (F.col("kind") == "entity"), "collection").when(F.col("kind") == "entity", "entity")
        .when(low.contains("repository") | F.lower("name").endswith("repo"), "repository").when(low.rlike("model|schema|injectmodel") | F.col("path").endswith("persists_to"), "database_hint").otherwise("service")
    )
    n = nodes.select(F.col("id").alias("node"), "kind", "name", "qualified_name", "external_id")
    return got.join(n, "node").select("seed", "node", "depth", "confidence", role.alias("role"))


def agent_trace(edges: DataFrame, seeds: DataFrame, max_depth: int = 8, limit: int | None = None) -> DataFrame:
    got = bfs(edge_filter(edges, AI_KINDS), seeds, max_depth, carry_confidence=True)
    return got if limit is None else top_k(got, ["seed"], [F.col("depth"), F.col("node")], limit)


def proofs(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 9, per_repo: int = 2) -> DataFrame:
    """Crossings into other repositories: inside the anchor's repository both directions are walked, and each edge that leaves it is a proof.

    ``max_depth`` counts the edge that leaves; the tool goes eight steps inside. The strongest ``per_repo`` of each
    target repository stay. Ends of edges are coded once. Steps inside a repository meet no
    other, so groups of repositories follow each other; in each what leaves a node spreads back to the
    seeds, which moves sets a node and never pairs of a seed and a node.
    """
    e = _with_files(nodes, edges).where("not sv and not tv")
    code, names = coding(nodes.where(~F.col("is_virtual")).select(F.col("id").alias("node")).union(seeds.select("node")))
    drop(names)  # the seeds have theirs
    start = stored(seeds.select(F.col("node").alias("seed"), code(F.col("node")).alias("node")).distinct(), "seeds")
    e = stored(e.select(code(F.col("source")).alias("source"), code(F.col("target")).alias("target"), "sr", "tr", "kind"), "ends")
    ends = e.select(F.col("sr").alias("repo")).unionAll(e.select("tr")).groupBy("repo").count()
    before = F.sum("count").over(Window.orderBy("repo")) - F.col("count") / 2
    groups = stored(ends.select("repo", F.floor(PROOF_GROUPS * before / F.sum("count").over(Window.partitionBy())).alias("g")), "groups")
    away, found = e.where("sr <> tr"), []
    back = {"source": F.col("target"), "sr": F.col("tr"), "tr": F.col("sr")}
    for i in range(PROOF_GROUPS):
        own = lambda df, i=i: df.join(groups.where(F.col("g") == i).select(F.col("repo").alias("sr")), "sr", "left_semi")
        facts = own(away.unionByName(away.withColumns(back))).select(F.col("source").alias("node"), F.struct("sr", "tr", "kind").alias("value"))
        for depth, state, values in spread(facts, own(e.where("sr = tr")), both=True, steps=max(0, max_depth - 1)):
            # merge: the seeds grow with the nodes
            fresh = state.where("fresh <> 0").join(start.hint("merge"), "node").select(F.col("seed").alias("node"), "chunk", F.col("fresh").alias("bits"))
            found.append(stored(valued(fresh, values).select(F.col("node_code").alias("seed"), F.col("value.sr").alias("source_repo"), F.col("value.tr").alias("target_repo"), F.col("value.kind").alias("kind"), F.lit(depth + 1).alias("hops")), "proofs"))
        drop(state)
    drop(start, e, groups)
    out = _all(found)
    strength = _lookup(F.col("kind"), {"calls": PROOF_STRENGTH["direct_call"], "uses_guard_from": PROOF_STRENGTH["guard_usage"], "publishes": PROOF_STRENGTH["event_producer_consumer"], "consumes": PROOF_STRENGTH["event_producer_consumer"], "uses_shared": PROOF_STRENGTH["shared_contract_consumer"], "serves": PROOF_STRENGTH["route_client_server"], "consumes_api_from": PROOF_STRENGTH["route_client_server"], "imports": PROOF_STRENGTH["import_bridge"]}, PROOF_STRENGTH["co_change_advisory"])
    out = out.withColumn("strength", strength)
    r = F.row_number().over(Window.partitionBy("seed", "target_repo").orderBy(F.desc("strength"), "kind", "source_repo"))
    return out.withColumn("r", r).where(F.col("r") <= per_repo).select("seed", "source_repo", "target_repo", "kind", "strength", "hops")


def who_consumes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(producer, consumer_repo, symbols) over all virtual links of real nodes."""
    n = nodes.select("id", "repo", "name")
    give = edges.where(F.col("kind").isin("publishes", "serves", "produces_event_for")).select(F.col("source").alias("producer"), "target")
    take = edges.where(F.col("kind").isin("consumes", "consumes_api_from", "uses_event_from")).join(n.select(F.col("id").alias("source"), F.col("repo").alias("consumer_repo")), "source").select("target", "consumer_repo").distinct()
    own = n.select(F.col("id").alias("producer"), F.col("repo").alias("own"))
    return give.join(take, "target").join(own, "producer").where("own <> consumer_repo").groupBy("producer", "consumer_repo").agg(F.count_distinct("target").alias("symbols"))


def deployed(nodes: DataFrame, edges: DataFrame, yes: bool = True) -> DataFrame:
    """Services with, or without, a deployment."""
    d = edges.where("kind = 'deployed_as'").select(F.col("source").alias("id"))
    return nodes.where("kind = 'service'").join(d, "id", "left_semi" if yes else "left_anti")


def deployed_without_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.where("kind = 'deployment'").join(edges.where("kind = 'deployed_as'").select(F.col("target").alias("id")), "id", "left_anti")


def env_consumers(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Who reads an environment variable, by name in any case or in canonical form."""
    v = nodes.where((F.col("kind") == "env_var") & ((F.lower("name") == name.lower()) | (X.topology_part(F.col("name")) == X.topology_part(F.lit(name))))).select(F.col("id").alias("target"))
    return edges.where("kind = 'reads_env'").join(v, "target", "left_semi").select("source", "target").distinct()


def shared_infra(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Databases and brokers with the number of services on each."""
    s = nodes.where("kind = 'service'").select(F.col("id").alias("source"))
    return edges.where(F.col("kind").isin("uses_database", "uses_broker")).join(s, "source", "left_semi").groupBy("target", "kind").agg(F.count_distinct("source").alias("services"))
