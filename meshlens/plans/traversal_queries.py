"""Queries over the projected code and call graphs: traversals and fixpoints.

Searches from given nodes start at every twentieth symbol (``sql.SEEDS``); everything else runs on all.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traversal as G
from ..operators.events import blast_radius
from ..operators.kernels import bfs, strong_components
from ..sources import projection as P
from . import sql
from .registry import query


def _code(spark, d):
    return P.code_nodes(spark, d), P.code_edges(spark, d)


def _seeds(spark, d):
    return P.code_nodes(spark, d).where("number % 20 = 0").select(F.col("id").alias("node"))


def _walk(edges: str, depth: int, seeds: str = sql.SEEDS) -> str:
    """Every walk from the seeds, then each node's least depth and, of the walks of that depth, the one with the smallest path."""
    return f"""e AS ({edges}), w AS (SELECT node AS seed, node, 0 AS depth, '' AS path, CAST(NULL AS INTEGER) AS conf FROM ({seeds}) UNION SELECT seed, target, depth + 1, CASE WHEN path = '' THEN kind ELSE path || '>' || kind END, CAST(coalesce(conf * confidence // 1000, conf, confidence) AS INTEGER) FROM w JOIN e ON node = source WHERE depth < {depth}),
  first AS (SELECT seed, node, depth, path, conf AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY depth, path) AS k, min(depth) OVER (PARTITION BY seed, node) AS least FROM w) WHERE k = 1 AND least > 0)"""


_ALL = "SELECT source, target, kind, confidence FROM code_edges"
_BOTH = "SELECT source, target, kind, confidence FROM code_edges UNION ALL SELECT target, source, kind, confidence FROM code_edges"


def _traversed(edges: str, depth: int) -> tuple[str, str]:
    return _walk(edges, depth) + f""", inner_nodes AS (SELECT seed, node FROM first WHERE depth < {depth} UNION SELECT node, node FROM ({sql.SEEDS})),
  i AS (SELECT seed, target AS node, count(DISTINCT (source, kind)) AS in_paths FROM inner_nodes JOIN e ON node = source GROUP BY 1, 2)""", "SELECT seed, node, depth, path, in_paths FROM first JOIN i USING (seed, node)"


@query("traverse", sql.code(*_traversed(_ALL, 4)))
def traverse(spark, d):
    return G.traverse(P.code_edges(spark, d), _seeds(spark, d), 4).drop("depth_capped", "truncated")


@query("traverse_confident", sql.code(*_traversed(_ALL + " WHERE kind IN ('calls', 'imports') AND (confidence IS NULL OR confidence >= 700)", 5)))
def traverse_confident(spark, d):
    return G.traverse(P.code_edges(spark, d), _seeds(spark, d), 5, ["calls", "imports"], 700).drop("depth_capped", "truncated")


@query("traverse_limits", sql.code(_walk(_ALL, 2) + ", o AS (SELECT source, count(DISTINCT target) AS n FROM e GROUP BY 1)",
  "SELECT seed, max(depth) AS depth, bool_or(depth = 2 AND n > 0) AS depth_capped, false AS truncated FROM first LEFT JOIN o ON node = source GROUP BY 1"))
def traverse_limits(spark, d):
    got = G.traverse(P.code_edges(spark, d), _seeds(spark, d), 2)
    return got.groupBy("seed").agg(F.max("depth").alias("depth"), F.bool_or("depth_capped").alias("depth_capped"), F.bool_or("truncated").alias("truncated"))


@query("callees", sql.code(_walk(_ALL + " WHERE kind = 'calls'", 3, "SELECT id AS node FROM code_nodes"), "SELECT seed, node, depth, CAST(r AS INTEGER) AS rank, n > 2 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS r, count(*) OVER (PARTITION BY seed) AS n FROM first) WHERE r <= 2"))
def callees(spark, d):
    return G.callees(P.code_edges(spark, d), P.code_nodes(spark, d).select(F.col("id").alias("node")), 9, 2)


@query("callers", sql.code(_walk("SELECT target AS source, source AS target, kind, confidence FROM code_edges WHERE kind = 'calls'", 2, "SELECT id AS node FROM code_nodes"), "SELECT seed, node, depth, CAST(row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS INTEGER) AS rank, false AS truncated FROM first"))
def callers(spark, d):
    return G.callers(P.code_edges(spark, d), P.code_nodes(spark, d).select(F.col("id").alias("node")), 2, 1000)


_TRACE = _walk(_BOTH, 1) + """, r AS (SELECT seed, node, depth FROM first UNION ALL SELECT seed, seed, 0 FROM (SELECT DISTINCT seed FROM w)),
  h AS (SELECT seed, n.repo, e.target AS node, e.source, e.kind, e.confidence, r.depth + 1 AS depth FROM r JOIN e ON r.node = e.source JOIN code_nodes n ON n.id = e.target WHERE e.target <> seed)"""


@query("trace_across_repos", sql.code(_TRACE, "SELECT seed, repo, node, source, kind, confidence, depth FROM h"))
def trace_across_repos(spark, d):
    return G.trace_across_repos(*_code(spark, d), _seeds(spark, d), 2)


@query("trace_impact", sql.code(_TRACE + ", g AS (SELECT seed, repo, count(*) AS hops, count(DISTINCT node) AS nodes, min(depth) AS depth, max(coalesce(confidence, 1000)) AS strongest FROM h GROUP BY 1, 2)", "SELECT seed, repo, hops, nodes, depth, strongest, CAST(row_number() OVER (PARTITION BY seed ORDER BY strongest DESC, repo) AS INTEGER) AS rank FROM g"))
def trace_impact(spark, d):
    return G.trace_impact(*_code(spark, d), _seeds(spark, d), 2)


@query("shared_impact", sql.code("""
  up AS (SELECT node AS seed, node, 0 AS depth FROM (""" + sql.SEEDS + """) UNION SELECT seed, source, depth + 1 FROM up JOIN code_edges ON node = target AND kind = 'references'), wk AS (SELECT node AS seed, node, 0 AS depth FROM (""" + sql.SEEDS + """) UNION SELECT seed, source, depth + 1 FROM wk JOIN code_edges ON node = target AND kind = 'calls'),
  s AS (SELECT seed, repo, file_path, min(depth) AS depth FROM up JOIN code_nodes ON id = node WHERE depth > 0 GROUP BY 1, 2, 3), k AS (SELECT seed, repo, file_path, min(depth) AS depth FROM wk JOIN code_nodes ON id = node WHERE depth > 0 GROUP BY 1, 2, 3)""",
  """SELECT seed, repo, file_path, depth, 'references' AS kinds, false AS weak, false AS serialization, false AS validation, CAST(65535 - depth + 0.2 AS DOUBLE) AS weight FROM s
  UNION ALL SELECT seed, repo, file_path, depth, 'co_changes_with', true, false, false, CAST(65535 - depth - 500 + 0.1 AS DOUBLE) FROM k WHERE (seed, repo) NOT IN (SELECT seed, repo FROM s)"""))
def shared_impact(spark, d):
    """References as structure, calls standing for files that change together: these count only for repositories that nothing refers from."""
    nodes, edges = _code(spark, d)
    e = edges.where("kind <> 'imports'").withColumn("kind", F.when(F.col("kind") == "calls", "co_changes_with").otherwise(F.col("kind")))
    return G.shared_impact(nodes, e, _seeds(spark, d))


@query("impact_unbounded", sql.code("""
  c AS (SELECT p, r, o, id, row_number() OVER (PARTITION BY p, r ORDER BY o) AS i, count(*) OVER (PARTITION BY p, r) AS n FROM sym), s AS (SELECT c.* FROM c JOIN (""" + sql.SEEDS + """) ON node = id)""",
  "SELECT s.id AS seed, repo, file_path, CAST((s.i - c.i + c.n - 1) % c.n + 1 AS INTEGER) AS depth, 'imports' AS kinds, false AS weak, false AS serialization, false AS validation, CAST(65535 - ((s.i - c.i + c.n - 1) % c.n + 1) + 0.1 AS DOUBLE) AS weight FROM s JOIN c USING (p, r) JOIN code_nodes x ON x.id = c.id WHERE c.n > 1"))
def impact_unbounded(spark, d):
    """Around whole rings of imports: how many steps against the ring each member is away, the seed itself once around."""
    nodes, edges = _code(spark, d)
    return G.shared_impact(nodes, edges.where("kind = 'imports'"), _seeds(spark, d))


@query("blast_radius", sql.code(_walk("SELECT source, target, 'consumes' AS kind, confidence FROM code_edges WHERE kind = 'imports' UNION ALL SELECT target, source, '<consumes', confidence FROM code_edges WHERE kind = 'imports'", 2), "SELECT seed, node, depth, path, confidence FROM first"))
def blast(spark, d):
    nodes, edges = _code(spark, d)
    return blast_radius(nodes, edges.where("kind = 'imports'").withColumn("kind", F.lit("consumes")), _seeds(spark, d), 2)


@query("confidence_chain", sql.code(_walk(_ALL + " WHERE kind = 'calls'", 6, "SELECT id AS node FROM code_nodes"), "SELECT seed, node, depth, confidence FROM first"))
def confidence_chain(spark, d):
    n, e = _code(spark, d)
    return bfs(e.where("kind = 'calls'"), n.select(F.col("id").alias("node")), 6, carry_confidence=True).drop("path")


def _rank(path: str) -> str:
    return f"CASE WHEN {path} LIKE '%calls%' THEN 3 WHEN {path} LIKE '%references%' THEN 2 WHEN {path} LIKE '%imports%' THEN 1 ELSE 0 END"


@query("evidence_chain", sql.code("pr AS (SELECT first(id ORDER BY p) AS a, last(id ORDER BY p) AS b FROM sym WHERE o % 20 = 0 GROUP BY o HAVING count(*) > 1)," + _walk(_BOTH, 3, "SELECT a AS node FROM pr UNION SELECT b FROM pr") + """,
  f0 AS (SELECT seed, node, depth, path FROM first UNION ALL SELECT DISTINCT seed, seed, 0, '' FROM w),
  m AS (SELECT a, b, x.node, x.depth + y.depth AS length, greatest(""" + _rank("x.path") + ", " + _rank("y.path") + """) AS rank FROM pr JOIN f0 x ON x.seed = a JOIN f0 y ON y.seed = b AND x.node = y.node)""",
  "SELECT a, b, length, node AS meeting FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY length, rank DESC, node) AS k FROM m) WHERE k = 1"))
def evidence_chain(spark, d):
    """From the first symbol to the last of every twentieth file."""
    part = F.substring_index("id", ".", -1).cast("long")
    n = P.code_nodes(spark, d).where("cast(substring_index(id, '.', 1) as long) % 20 = 0").groupBy("file_path").agg(F.min_by("id", part).alias("a"), F.max_by("id", part).alias("b"))
    return G.evidence_chain(P.code_edges(spark, d), n.where("a <> b").select("a", "b"), 3)


@query("cycles", sql.code("", "SELECT min(id) AS component, count(*) AS size, string_agg(id, ',' ORDER BY id) AS members, false AS cross_repo FROM sym GROUP BY p, r HAVING count(*) > 1"))
def cycles(spark, d):
    nodes, edges = _code(spark, d)
    return G.cycles(nodes, edges, ["imports"])


@query("strong_components", sql.code("g AS (SELECT p, r, min(id) AS component, count(*) AS size FROM sym GROUP BY 1, 2 HAVING count(*) > 1)", "SELECT id AS node, component, size FROM sym JOIN g USING (p, r)"))
def strong(spark, d):
    """The rings of imports."""
    return strong_components(P.code_edges(spark, d).where("kind = 'imports'"))


@query("dead_files", sql.code("""
  k AS (SELECT id, repo, repo || '/' || file_path AS f FROM code_nodes), fe AS (SELECT DISTINCT a.f AS s, b.f AS t, a.repo AS sr, b.repo AS tr FROM code_edges JOIN k a ON source = a.id JOIN k b ON target = b.id WHERE a.f <> b.f),
  roots AS (SELECT f FROM k WHERE f LIKE '%/bin/%' UNION SELECT t FROM fe WHERE sr <> tr), live AS (SELECT f FROM roots UNION SELECT t FROM live JOIN fe ON f = s),
  h AS (SELECT DISTINCT repo FROM k JOIN roots USING (f))""", "SELECT DISTINCT repo, file_path, CASE WHEN repo IN (FROM h) THEN 'high' ELSE 'medium' END AS confidence FROM code_nodes WHERE repo || '/' || file_path NOT IN (SELECT f FROM live) AND file_path NOT LIKE '%tests/%'"))
def dead_files(spark, d):
    return G.dead_files(P.code_nodes(spark, d), P.code_edges(spark, d, files=True))


@query("unused_exports", sql.code("", "SELECT id, repo, file_path, name FROM code_nodes WHERE file_path NOT LIKE '%tests/%' AND id NOT IN (SELECT target FROM code_edges)"))
def unused_exports(spark, d):
    nodes, edges = _code(spark, d)
    exports = nodes.select(F.col("file_path").alias("source"), F.col("id").alias("target"), F.lit("exports").alias("kind"))
    return G.unused_exports(nodes, edges.select("source", "target", "kind").unionByName(exports))


@query("zombie_dependencies", """
  WITH m AS (SELECT DISTINCT 'r' || (p_size % 10) AS repo, '@' || lower(p_brand) || '/core' AS package FROM part), i AS (SELECT DISTINCT 'r' || (p_size % 10) AS repo, '@' || lower(p_brand) || '/core' AS package FROM part WHERE p_partkey % 4 = 0)
  SELECT repo, package FROM m WHERE (repo, package) NOT IN (SELECT repo, package FROM i)""")
def zombie_dependencies(spark, d):
    p = P.table(spark, d, "part")
    repo, package = F.concat(F.lit("r"), F.col("p_size") % 10).alias("repo"), F.concat(F.lit("@"), F.lower("p_brand"), F.lit("/core"))
    return G.zombie_dependencies(p.select(repo, package.alias("package")).distinct(), p.where("p_partkey % 4 = 0").select(repo, F.concat(package, F.lit("/sub/x")).alias("spec")))


@query("mock_leakage", sql.code("", "SELECT DISTINCT a.repo, a.file_path AS importer, b.file_path AS mock FROM code_edges e JOIN code_nodes a ON source = a.id JOIN code_nodes b ON target = b.id WHERE e.kind = 'imports' AND a.repo = b.repo AND b.file_path LIKE '%mocks/%' AND a.file_path NOT LIKE '%mocks/%' AND a.file_path NOT LIKE '%tests/%'"))
def mock_leakage(spark, d):
    return G.mock_leakage(*_code(spark, d))


@query("component_reuse", sql.code("", "SELECT name, repo, file_path, design_path FROM code_nodes JOIN (SELECT name, min(file_path) AS design_path FROM code_nodes WHERE repo = 'r0' GROUP BY 1) USING (name) WHERE repo <> 'r0'"))
def component_reuse(spark, d):
    n = P.code_nodes(spark, d)
    return G.component_reuse(n.where("repo <> 'r0'"), n.where("repo = 'r0'"))


@query("participation", sql.code("""
  x AS (SELECT a.repo AS sr, b.repo AS tr, a.file_path AS sf, b.file_path AS tf FROM code_edges JOIN code_nodes a ON source = a.id JOIN code_nodes b ON target = b.id),
  f AS (SELECT tf AS file_path, sr AS consumer_repo FROM x WHERE sr <> tr UNION SELECT tf, consumer_repo FROM f JOIN x ON file_path = sf WHERE sr = tr AND sf <> tf)""", "SELECT file_path, consumer_repo FROM f"))
def participation(spark, d):
    return G.participation(P.code_nodes(spark, d), P.code_edges(spark, d, files=True))


@query("crud_trace", sql.code(_walk("SELECT source, target, kind, confidence FROM code_edges WHERE kind IN ('calls', 'references')", 4), "SELECT seed, node, depth, confidence, CASE WHEN kind = 'entity' THEN 'entity' ELSE 'service' END AS role FROM first JOIN (SELECT id, kind FROM code_nodes) ON node = id"))
def crud_trace(spark, d):
    return G.crud_trace(*_code(spark, d), _seeds(spark, d))


@query("agent_trace", sql.code(_walk("SELECT source, target, CASE kind WHEN 'calls' THEN 'graph_transitions_to' ELSE 'invokes_llm' END AS kind, confidence FROM code_edges WHERE kind <> 'imports'", 8), "SELECT seed, node, depth, path, confidence FROM first"))
def agent_trace(spark, d):
    """Calls as transitions of an agent graph, references as its model calls; imports are no agent edges and fall away."""
    kind = F.when(F.col("kind") == "calls", "graph_transitions_to").when(F.col("kind") == "references", "invokes_llm").otherwise(F.col("kind"))
    return G.agent_trace(P.code_edges(spark, d).withColumn("kind", kind), _seeds(spark, d))


@query("proofs", sql.code("""
  x AS (SELECT e.*, a.repo AS sr, b.repo AS tr FROM (""" + _BOTH + """) e JOIN code_nodes a ON source = a.id JOIN code_nodes b ON target = b.id),
  w AS (SELECT node AS seed, node, 0 AS depth FROM (""" + sql.SEEDS + """) UNION SELECT seed, target, depth + 1 FROM w JOIN x ON node = source WHERE sr = tr AND depth < 8), m AS (SELECT seed, node, min(depth) AS depth FROM w GROUP BY 1, 2),
  p AS (SELECT seed, sr AS source_repo, tr AS target_repo, kind, min(depth + 1) AS hops, CASE kind WHEN 'calls' THEN 85 WHEN 'imports' THEN 55 ELSE 25 END AS strength FROM m JOIN x ON node = source WHERE sr <> tr GROUP BY seed, sr, tr, kind),
  r AS (SELECT *, row_number() OVER (PARTITION BY seed, target_repo ORDER BY strength DESC, kind, source_repo) AS k FROM p)""", "SELECT seed, source_repo, target_repo, kind, strength, hops FROM r WHERE k <= 2"))
def proofs(spark, d):
    return G.proofs(P.code_nodes(spark, d), P.code_edges(spark, d, files=True), _seeds(spark, d))


@query("who_consumes", sql.graph("SELECT a.source AS producer, m.repo AS consumer_repo, count(DISTINCT a.target) AS symbols FROM edges a JOIN edges b ON a.target = b.target AND a.kind = 'publishes' AND b.kind = 'consumes' JOIN nodes n ON a.source = n.id JOIN nodes m ON b.source = m.id WHERE n.repo <> m.repo GROUP BY 1, 2"))
def who_consumes(spark, d):
    return G.who_consumes(P.nodes(spark, d), P.edges(spark, d))


_DEPLOY = """n AS (SELECT 'sv' || s_suppkey AS id, 'service' AS kind, s_name AS name FROM supplier UNION ALL SELECT 'dp' || s_suppkey, 'deployment', s_name FROM supplier UNION ALL SELECT 'ev' || n_nationkey, 'env_var', upper(n_name) FROM nation UNION ALL SELECT 'db' || r_regionkey, 'database', r_name FROM region),
  e AS (SELECT 'sv' || s_suppkey AS source, 'dp' || (s_suppkey + 1) AS target, 'deployed_as' AS kind FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'sv' || s_suppkey, 'ev' || s_nationkey, 'reads_env' FROM supplier UNION ALL SELECT 'sv' || s_suppkey, 'db' || n_regionkey, 'uses_database' FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _deploy(spark, d):
    s, n, r = (P.table(spark, d, t) for t in ("supplier", "nation", "region"))
    node = lambda df, p, k, kind, name: df.select(F.concat(F.lit(p), k).alias("id"), F.lit(kind).alias("kind"), name.alias("name"))
    nodes = node(s, "sv", "s_suppkey", "service", F.col("s_name")).unionByName(node(s, "dp", "s_suppkey", "deployment", F.col("s_name"))).unionByName(node(n, "ev", "n_nationkey", "env_var", F.upper("n_name"))).unionByName(node(r, "db", "r_regionkey", "database", F.col("r_name")))
    sv = F.concat(F.lit("sv"), "s_suppkey").alias("source")
    edges = s.where("s_suppkey % 3 <> 0").select(sv, F.concat(F.lit("dp"), F.col("s_suppkey") + 1).alias("target"), F.lit("deployed_as").alias("kind"))
    edges = edges.unionByName(s.select(sv, F.concat(F.lit("ev"), "s_nationkey").alias("target"), F.lit("reads_env").alias("kind")))
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return nodes, edges.unionByName(j.select(sv, F.concat(F.lit("db"), "n_regionkey").alias("target"), F.lit("uses_database").alias("kind")))


@query("where_deployed", f"WITH {_DEPLOY} SELECT id, name FROM n WHERE kind = 'service' AND id IN (SELECT source FROM e WHERE kind = 'deployed_as')")
def where_deployed(spark, d):
    return G.deployed(*_deploy(spark, d)).select("id", "name")


@query("undeployed_services", f"WITH {_DEPLOY} SELECT id, name FROM n WHERE kind = 'service' AND id NOT IN (SELECT source FROM e WHERE kind = 'deployed_as')")
def undeployed_services(spark, d):
    return G.deployed(*_deploy(spark, d), yes=False).select("id", "name")


@query("deployed_without_code", f"WITH {_DEPLOY} SELECT id, name FROM n WHERE kind = 'deployment' AND id NOT IN (SELECT target FROM e WHERE kind = 'deployed_as')")
def deployed_without_code(spark, d):
    return G.deployed_without_code(*_deploy(spark, d)).select("id", "name")


@query("env_consumers", f"WITH {_DEPLOY} SELECT DISTINCT source, target FROM e WHERE kind = 'reads_env' AND target IN (SELECT id FROM n WHERE kind = 'env_var' AND lower(name) = 'nation_3')")
def env_consumers(spark, d):
    return G.env_consumers(*_deploy(spark, d), "Nation_3")


@query("shared_infra", f"WITH {_DEPLOY} SELECT target, kind, count(DISTINCT source) AS services FROM e WHERE kind = 'uses_database' GROUP BY 1, 2")
def shared_infra(spark, d):
    return G.shared_infra(*_deploy(spark, d))
