"""Queries over the projected graph: counts, events, transports, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import counts, events
from ..operators.kernels import edge_filter
from ..schema import EDGE_KINDS, NODE_KINDS, NOT_INDEXED, SEMANTIC_BRIDGES, access_mechanism
from ..sources import projection as P
from . import sql
from .registry import query


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return P.nodes(spark, d), P.edges(spark, d)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x) for x in r) + ")" for r in rows)


_NODE_KINDS = f"kinds(code, kind, search_indexable) AS (VALUES {_values((i, k, k not in NOT_INDEXED) for i, k in enumerate(NODE_KINDS))})"
_EDGE_KINDS = f"edge_kinds(kind, access, bridge, consumer) AS (VALUES {_values((k, access_mechanism(k), k in SEMANTIC_BRIDGES, k not in ('defines', 'imports')) for k in EDGE_KINDS)})"


@query("event_repos", sql.graph("""
  SELECT a.repo AS producer_repo, b.repo AS consumer_repo, count(*) AS topics
  FROM (SELECT DISTINCT target, repo FROM edges JOIN nodes ON source = id WHERE edges.kind = 'publishes') a JOIN (SELECT DISTINCT target, repo FROM edges JOIN nodes ON source = id WHERE edges.kind = 'consumes') b USING (target) GROUP BY 1, 2"""))
def event_repos(spark, d):
    return events.producer_consumer_repos(*_graph(spark, d))


@query("event_trace", sql.graph_with("""
  s AS (SELECT target, CASE edges.kind WHEN 'publishes' THEN 'producer' ELSE 'consumer' END AS side, edges.kind, confidence, source, repo, file_path, name FROM edges JOIN nodes ON source = id WHERE edges.kind IN ('publishes', 'consumes')),
  u AS (SELECT DISTINCT 'e:' || l_partkey AS target, 'consumer' AS side, 'uses_event_from' AS kind, CAST(NULL AS INTEGER) AS confidence, 's:' || l_suppkey AS source FROM lineitem WHERE l_returnflag = 'A'),
  x AS (SELECT p_partkey AS k, lower(p_type || '.' || p_partkey) AS event FROM part), ev AS (SELECT u.target, u.side, u.kind, u.confidence, u.source, repo, file_path, name FROM u JOIN nodes ON source = id)""",
  """SELECT s.*, event, false AS truncated FROM s JOIN x ON target = 'p:' || k UNION ALL SELECT ev.*, event, false FROM ev JOIN x ON target = 'e:' || k
  UNION ALL SELECT 'e:' || k, s.side, s.kind, s.confidence, s.source, s.repo, s.file_path, s.name, event, false FROM s JOIN x ON target = 'p:' || k WHERE s.side = 'producer' OR 'e:' || k NOT IN (SELECT target FROM ev)"""))
def event_trace(spark, d):
    """All topics, and events of the same names that suppliers only use: the topics' publishers stand in for theirs."""
    nodes, edges = _graph(spark, d)
    p = P.table(spark, d, "part")
    ext = F.concat(F.lit("__event__"), "p_type", F.lit("."), "p_partkey")
    more = p.select(F.concat(F.lit("e:"), "p_partkey").alias("id"), F.lit("event").alias("kind"), F.lit("__virtual__").alias("repo"), ext.alias("file_path"), ext.alias("name"), ext.alias("qualified_name"), ext.alias("external_id"), F.lit(True).alias("is_virtual"))
    used = P.table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.concat(F.lit("s:"), "l_suppkey").alias("source"), F.concat(F.lit("e:"), "l_partkey").alias("target"), F.lit("uses_event_from").alias("kind"), F.lit(None).cast("int").alias("confidence")).distinct()
    return events.event_trace(nodes.unionByName(more), edges.select("source", "target", "kind", "confidence").unionByName(used))


@query("event_trace_limited", sql.graph_with("""
  s AS (SELECT target, CASE edges.kind WHEN 'publishes' THEN 'producer' ELSE 'consumer' END AS side, edges.kind, confidence, source, repo, file_path, name FROM edges JOIN nodes ON source = id WHERE edges.kind IN ('publishes', 'consumes') AND (confidence IS NULL OR confidence >= 900)),
  r AS (SELECT *, row_number() OVER (PARTITION BY target, side ORDER BY repo, file_path, name, source) AS k, count(*) OVER (PARTITION BY target, side) > 5 AS truncated FROM s)""",
  "SELECT target, side, source, kind, confidence, repo, file_path, name, truncated, lower(list_last(string_split(external_id, '__'))) AS event FROM r JOIN (SELECT id, external_id FROM nodes) n ON target = n.id WHERE k <= 5"))
def event_trace_limited(spark, d):
    return events.event_trace(*_graph(spark, d), min_confidence=900, limit=5)


@query("orphan_topics", sql.TOPICS + " SELECT * FROM orphans")
def orphan_topics(spark, d):
    return events.orphan_topics(*P.topic_graph(spark, d))


@query("transport_links", sql.graph("""SELECT 'publishes' AS transport, a.repo AS producer_repo, b.repo AS consumer_repo, count(*) AS targets, CAST(sum(a.n * b.n) AS BIGINT) AS links
  FROM (SELECT target, repo, count(*) AS n FROM edges JOIN nodes ON source = id WHERE edges.kind = 'publishes' GROUP BY 1, 2) a JOIN (SELECT target, repo, count(*) AS n FROM edges JOIN nodes ON source = id WHERE edges.kind = 'consumes' GROUP BY 1, 2) b USING (target) GROUP BY 2, 3"""))
def transport_links(spark, d):
    return events.transport_links(*_graph(spark, d))


@query("transport_pairs", sql.graph_with("""
  a AS MATERIALIZED (SELECT source, target FROM edges JOIN nodes ON source = id WHERE edges.kind = 'publishes' AND repo = 'NATION_3'), b AS MATERIALIZED (SELECT source, target FROM edges JOIN nodes ON source = id WHERE edges.kind = 'consumes' AND repo = 'NATION_7')""",
  "SELECT a.source AS producer, b.source AS consumer, 'NATION_3' AS producer_repo, 'NATION_7' AS consumer_repo, a.target, 'publishes' AS transport FROM a JOIN b USING (target)"))
def transport_pairs(spark, d):
    return events.transport_pairs(*_graph(spark, d), "NATION_3", "NATION_7")


@query("co_members", sql.graph_with("per AS (SELECT DISTINCT target, n.repo, e.kind FROM edges e JOIN nodes v ON e.target = v.id AND v.is_virtual JOIN nodes n ON e.source = n.id)",
  "SELECT a.repo, b.repo AS other, string_agg(DISTINCT b.kind, ',' ORDER BY b.kind) AS kinds, count(DISTINCT a.target) AS targets FROM (SELECT DISTINCT target, repo FROM per) a JOIN per b ON a.target = b.target AND a.repo <> b.repo GROUP BY 1, 2"))
def co_members(spark, d):
    return events.co_members(*_graph(spark, d))


@query("event_target_rank", sql.graph_with("e AS (SELECT id, kind, lower(list_last(string_split(external_id, '__'))) AS event FROM nodes WHERE is_virtual), i AS (SELECT target AS id, count(*) AS incoming FROM edges GROUP BY 1)",
  "SELECT e.id, e.kind, event, CAST(400 + CASE WHEN event = 'promo' THEN 500 ELSE 220 END + coalesce(incoming, 0) AS BIGINT) AS score FROM e LEFT JOIN i USING (id) WHERE event = 'promo' OR starts_with(event, 'promo.')"))
def event_target_rank(spark, d):
    return events.target_rank(*_graph(spark, d), query="PROMO")


@query("nodes_by_kind", f"WITH {sql.NODES}, {_NODE_KINDS} SELECT k.kind, count(n.id) AS n FROM kinds k LEFT JOIN nodes n ON n.kind = k.kind GROUP BY 1")
def nodes_by_kind(spark, d):
    return counts.nodes_by_kind(P.nodes(spark, d))


@query("edges_by_kind", sql.graph("SELECT kind, count(*) AS n FROM edges GROUP BY 1"))
def edges_by_kind(spark, d):
    return counts.edges_by_kind(P.edges(spark, d))


@query("repo_counts", sql.graph("""SELECT n.repo, nodes, functions, coalesce(edges, 0) AS edges FROM (SELECT repo, count(*) AS nodes, count(*) FILTER (kind = 'function') AS functions FROM nodes GROUP BY 1) n LEFT JOIN (SELECT repo, count(*) AS edges FROM edges JOIN nodes ON owner_file = id GROUP BY 1) e ON n.repo = e.repo"""))
def repo_counts(spark, d):
    return counts.repo_counts(*_graph(spark, d))


@query("cross_repo_counts", sql.graph("""SELECT count(*) AS edges, count(*) FILTER (a.repo <> b.repo) AS cross_repo, count(*) FILTER (a.repo <> b.repo AND a.repo <> '__virtual__' AND b.repo <> '__virtual__') AS true_cross_repo, count(*) FILTER (b.repo = '__virtual__' AND b.kind = 'author') AS history_ownership, count(*) FILTER (a.repo <> b.repo AND b.repo = '__virtual__' AND b.kind <> 'author') AS virtual_other FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id"""))
def cross_repo_counts(spark, d):
    return counts.cross_repo_counts(*_graph(spark, d))


@query("edges_attributed", sql.graph("SELECT a.repo AS source_repo, b.repo AS target_repo, edges.kind, count(*) AS n FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id GROUP BY 1, 2, 3"))
def edges_attributed(spark, d):
    return counts.attributed_edges(*_graph(spark, d)).groupBy("source_repo", "target_repo", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("confidence_filter", sql.graph("SELECT kind, count(*) AS n, count(confidence) AS known FROM edges WHERE kind IN ('publishes', 'consumes') AND (confidence IS NULL OR confidence >= 950) GROUP BY 1"))
def confidence_filter(spark, d):
    return edge_filter(P.edges(spark, d), ["publishes", "consumes"], 950).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("confidence").alias("known"))


@query("kind_predicates", f"WITH {sql.NODES}, {sql.EDGES}, {_EDGE_KINDS} SELECT k.access AS access_mechanism, bridge AS is_bridge, consumer AS is_consumer, count(*) AS n FROM edges JOIN edge_kinds k ON edges.kind = k.kind GROUP BY 1, 2, 3")
def kind_predicates(spark, d):
    from ..schema import edge_kinds

    return P.edges(spark, d).join(F.broadcast(edge_kinds(spark)), "kind").groupBy("access_mechanism", "is_bridge", "is_consumer").agg(F.count(F.lit(1)).alias("n"))


@query("anchor_scores", sql.graph_with("o AS (SELECT source, count(*) FILTER (kind IN ('publishes', 'consumes')) AS f FROM edges GROUP BY 1)",
  "SELECT id, kind, round(0.4 * least(coalesce(f, 0), 10) / 10 + CASE WHEN kind = 'topic' THEN 0.3 ELSE 0.0 END + 0.3 * least(coalesce(f, 0), 5) / 5, 6)::DOUBLE AS score FROM nodes LEFT JOIN o ON id = source"))
def anchor_scores(spark, d):
    return counts.anchor_scores(*_graph(spark, d))


@query("edge_scores", sql.graph_with("""
  x AS (SELECT e.*, a.repo AS sr, b.repo AS tr, a.is_virtual AS sv, b.is_virtual AS tv, e.kind <> 'defines' AS br FROM edges e JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id),
  y AS (SELECT target AS id, 1 AS i, 0 AS o, br, sv AS v, CASE WHEN sr <> tr AND sr <> '__virtual__' THEN sr END AS f FROM x UNION ALL SELECT source, 0, 1, br, tv, CASE WHEN sr <> tr AND tr <> '__virtual__' THEN tr END FROM x)""",
  "SELECT id, CAST(30 * least(sum(i), 6) + 20 * least(sum(o), 6) + 45 * least(count(*) FILTER (br), 6) + 35 * least(count(*) FILTER (v), 4) + 60 * least(count(DISTINCT f), 4) AS BIGINT) AS score FROM y GROUP BY 1"))
def edge_scores(spark, d):
    return counts.edge_scores(*_graph(spark, d))


@query("semantic_health", sql.graph_with("s AS (SELECT target AS id, max(CAST(kind = 'publishes' AS INT)) AS p, max(CAST(kind = 'consumes' AS INT)) AS c FROM edges WHERE kind IN ('publishes', 'consumes') GROUP BY 1)",
  "SELECT kind, count(*) AS total, count(*) FILTER (p = 1 AND c = 1) AS linked, count(*) - count(*) FILTER (p = 1 AND c = 1) AS unlinked, count(*) - count(DISTINCT external_id) AS ambiguous, round(count(*) FILTER (p = 1 AND c = 1) / count(*), 6)::DOUBLE AS coverage FROM nodes LEFT JOIN s USING (id) WHERE is_virtual GROUP BY 1"))
def semantic_health(spark, d):
    return counts.semantic_health(*_graph(spark, d))


@query("resolution_fingerprint", sql.graph_with("l AS (SELECT DISTINCT edges.kind, a.qualified_name || chr(9) || edges.kind || chr(9) || b.qualified_name || chr(9) || CASE WHEN weight > 1 THEN 'unique' ELSE '-' END || chr(9) || coalesce(CAST(confidence AS VARCHAR), '-') AS line FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id)",
  "SELECT kind, count(*) AS lines, CAST(sum(CAST('0x' || substr(md5(line), 1, 12) AS UBIGINT)) AS VARCHAR) AS digest FROM l GROUP BY 1"))
def resolution_fingerprint(spark, d):
    nodes, edges = _graph(spark, d)
    return counts.fingerprint(edges.withColumn("resolver", F.when(F.col("weight") > 1, "unique")), nodes)


@query("shared_usage", sql.graph("SELECT target AS v, repo, count(DISTINCT file_path) AS files FROM (SELECT source, target FROM edges WHERE kind IN ('publishes', 'consumes')) JOIN nodes ON source = id GROUP BY 1, 2"))
def shared_usage(spark, d):
    return counts.shared_usage(*_graph(spark, d))


@query("conventions", sql.graph_with("""
  b AS (SELECT 'files_under' AS pattern, repo, split_part(file_path, '/', 1) AS what, file_path AS example FROM nodes WHERE kind = 'file' AND contains(file_path, '/') UNION ALL SELECT 'virtual_surface', repo, kind, file_path FROM nodes WHERE is_virtual
    UNION ALL SELECT 'decorator', n_name, 'Dec' || (c_custkey % 3), 'f' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY pattern, repo, what ORDER BY example) AS k, count(*) OVER (PARTITION BY pattern, repo, what) AS n FROM b)""",
  "SELECT pattern, repo, what, n, string_agg(example, '; ' ORDER BY example) AS examples, CAST(CASE pattern WHEN 'files_under' THEN 0.7 WHEN 'decorator' THEN 0.8 ELSE 0.75 END AS DOUBLE) AS confidence FROM r WHERE k <= 3 AND n >= 2 GROUP BY 1, 2, 3, 4"))
def conventions(spark, d):
    nation = P.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("repo"))
    marks = P.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("repo", F.lit("decorator").alias("kind"), F.concat(F.lit("Dec"), F.col("c_custkey") % 3).alias("name"), F.concat(F.lit("f"), "c_custkey").alias("file_path"))
    return counts.conventions(P.nodes(spark, d).select(*marks.columns).unionByName(marks))


@query("node_labels", sql.graph("SELECT id, CASE WHEN kind = 'topic' THEN 'topic:' || list_last(string_split(external_id, '__')) ELSE name END AS label FROM nodes"))
def node_labels(spark, d):
    return counts.node_labels(P.nodes(spark, d))


@query("route_paths", r"""
  WITH b AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS x FROM pages)
  SELECT page_id, '/' || array_to_string(list_transform(list_filter(string_split(x, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^(:.+|\$.+|\{.+\}|\[.+\])$') THEN ':id' ELSE lower(s) END), '/') AS route FROM b""")
def route_paths(spark, d):
    return P.table(spark, d, "pages").select("page_id", X.route_path(F.col("url")).alias("route"))


@query("name_rules", r"""
  SELECT p_partkey, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9.:-]+', '_', 'g'), '_') AS topology, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, md5(p_name) AS digest,
    left(sha256(p_brand || chr(0) || p_type || chr(0) || 'topic' || chr(0) || p_name), 32) AS node_id, left(sha256('k' || p_name), 16) || '@redacted' AS redacted FROM part""")
def name_rules(spark, d):
    p = P.table(spark, d, "part")
    return p.select("p_partkey", X.topology_part(F.col("p_type")).alias("topology"), X.slug(F.col("p_name")).alias("slug"), F.md5("p_name").alias("digest"), X.node_id(F.col("p_brand"), F.col("p_type"), F.lit("topic"), F.col("p_name")).alias("node_id"), X.redact_email(F.col("p_name"), "k").alias("redacted"))
