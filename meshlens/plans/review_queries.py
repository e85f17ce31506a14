"""Queries of change-set review, over early and late halves of the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as R
from ..sources import projection as P
from ..sources.scans import fuzzy_score
from . import sql
from .registry import query

T = "TIMESTAMP '1998-07-01'"


def _half(spark, d, late: bool):
    t = F.lit("1998-07-01").cast("timestamp")
    line = P.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return line.where(F.col("l_shipdate") >= t if late else F.col("l_shipdate") < t)


_ROUTES = """x AS (SELECT l_shipdate >= {t} AS late, CASE l_linenumber % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, '/parts/' || l_partkey || '/:id' AS path, 'r' || (l_suppkey % 9) || ':f:s' || l_suppkey AS handler FROM lineitem),
  b AS (SELECT method, path, min(handler) AS h FROM x WHERE NOT late GROUP BY 1, 2), r AS (SELECT method, path, min(handler) AS h FROM x WHERE late GROUP BY 1, 2)""".format(t=T)


def _routes(spark, d, late):
    line = _half(spark, d, late)
    verb = F.when(F.col("l_linenumber") % 2 == 0, "get").otherwise("POST")
    ext = F.concat(F.lit("__route__"), verb, F.lit(" /Parts/"), "l_partkey", F.lit("/{id}/"))
    e = line.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), ext.alias("target"), F.lit("serves").alias("kind"), F.col("l_suppkey").alias("k")).distinct()
    routes = e.select(F.col("target").alias("id"), F.lit("route").alias("kind"), F.lit("__virtual__").alias("repo"), F.lit("v").alias("file_path"), F.col("target").alias("name"), F.col("target").alias("external_id"), F.lit(True).alias("is_virtual")).distinct()
    real = e.select(F.col("source").alias("id"), F.lit("function").alias("kind"), F.concat(F.lit("r"), F.col("k") % 9).alias("repo"), F.lit("f").alias("file_path"), F.col("source").alias("name"), F.lit(None).cast("string").alias("external_id"), F.lit(False).alias("is_virtual")).distinct()
    return routes.unionByName(real), e.drop("k")


@query("route_deltas", f"WITH {_ROUTES} SELECT method, path, b.h AS before_handler, r.h AS after_handler, CASE WHEN b.h IS NULL THEN 'added' WHEN r.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN r USING (method, path) WHERE b.h IS DISTINCT FROM r.h")
def route_deltas(spark, d):
    return R.route_deltas(_routes(spark, d, False), _routes(spark, d, True))


_SYM = "SELECT 'r' || (l_suppkey % 5) AS repo, 'q' || l_partkey AS qualified_name, min(l_returnflag) AS signature, 'public' AS visibility FROM lineitem WHERE l_shipdate {op} {t} AND l_suppkey % 2 = 0 GROUP BY 1, 2"


@query("symbol_deltas", f"WITH b AS ({_SYM.format(op='<', t=T)}), r AS ({_SYM.format(op='>=', t=T)}) SELECT repo, qualified_name, b.signature AS before_signature, r.signature AS after_signature, b.visibility AS before_visibility, r.visibility AS after_visibility, CASE WHEN b.signature IS NULL THEN 'added' WHEN r.signature IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN r USING (repo, qualified_name) WHERE b.signature IS DISTINCT FROM r.signature")
def symbol_deltas(spark, d):
    def n(late):
        return _half(spark, d, late).select(F.concat(F.lit("r"), F.col("l_suppkey") % 5).alias("repo"), F.concat(F.lit("q"), "l_partkey").alias("qualified_name"), F.col("l_returnflag").alias("signature"), F.when(F.col("l_suppkey") % 2 == 0, "public").otherwise("private").alias("visibility"), F.lit("function").alias("kind"), F.lit(False).alias("is_virtual"))

    return R.symbol_deltas(n(False), n(True))


_EV = """e AS (SELECT DISTINCT l_shipdate >= {t} AS late, l_partkey, l_linenumber % 2 = 0 AS gives, 's' || l_suppkey AS node FROM lineitem),
  s AS (SELECT late, 'topic' AS event_kind, lower(p_type) || '.' || l_partkey AS event, CASE WHEN gives THEN 'producer' ELSE 'consumer' END AS side, node FROM e JOIN part ON l_partkey = p_partkey)""".format(t=T)


@query("event_deltas", f"WITH {_EV}, b AS (FROM s WHERE NOT late), r AS (FROM s WHERE late) SELECT event_kind, event, side, node, CASE WHEN b.late IS NULL THEN 'added' ELSE 'removed' END AS change FROM b FULL JOIN r USING (event_kind, event, side, node) WHERE b.late IS NULL OR r.late IS NULL")
def event_deltas(spark, d):
    topics = P.nodes(spark, d).where("is_virtual")

    def g(late):
        line = _half(spark, d, late)
        kind = F.when(F.col("l_linenumber") % 2 == 0, "publishes").otherwise("consumes")
        return topics, line.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p:"), "l_partkey").alias("target"), kind.alias("kind")).distinct()

    return R.event_deltas(g(False), g(True))


_DEC = "SELECT DISTINCT 'r' || (l_suppkey % 5) AS repo, 'f' || l_suppkey AS file_path, CASE l_linenumber WHEN 1 THEN 'RolesAllowed' ELSE 'audit' END AS decorator, 'q' || l_partkey AS target_qn FROM lineitem WHERE l_shipdate {op} {t} AND l_linenumber IN (1, 2)"


@query("decorator_deltas", f"WITH b AS ({_DEC.format(op='<', t=T)}), r AS ({_DEC.format(op='>=', t=T)}) SELECT *, 'removed' AS change FROM (FROM b EXCEPT FROM r) UNION ALL SELECT *, 'added' FROM (FROM r EXCEPT FROM b)")
def decorator_deltas(spark, d):
    def n(late):
        line = _half(spark, d, late)
        dec = F.when(F.col("l_linenumber") == 1, "RolesAllowed").when(F.col("l_linenumber") == 2, "audit").otherwise("Log")
        return line.select(F.concat(F.lit("r"), F.col("l_suppkey") % 5).alias("repo"), F.concat(F.lit("f"), "l_suppkey").alias("file_path"), dec.alias("decorator"), F.concat(F.lit("q"), "l_partkey").alias("target_qn"))

    return R.decorator_deltas(n(False), n(True))


_DEP = "SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'deployment' WHEN 1 THEN 'env_var' ELSE 'secret' END AS kind, 'r' || (l_suppkey % 7) AS repo, 'n' || l_partkey AS name FROM lineitem WHERE l_shipdate {op} {t}"


@query("deployment_deltas", f"WITH b AS ({_DEP.format(op='<', t=T)}), r AS ({_DEP.format(op='>=', t=T)}) SELECT *, 'removed' AS change FROM (FROM b EXCEPT FROM r) UNION ALL SELECT *, 'added' FROM (FROM r EXCEPT FROM b)")
def deployment_deltas(spark, d):
    def n(late):
        kind = F.when(F.col("l_linenumber") % 3 == 0, "deployment").when(F.col("l_linenumber") % 3 == 1, "env_var").otherwise("secret")
        return _half(spark, d, late).select(kind.alias("kind"), F.concat(F.lit("r"), F.col("l_suppkey") % 7).alias("repo"), F.concat(F.lit("n"), "l_partkey").alias("name"))

    return R.deployment_deltas(n(False), n(True))


@query("impact_by_repo", sql.code("""c AS (SELECT target, repo, count(DISTINCT source) AS sources, 0::BIGINT AS read, 0::BIGINT AS write, count(*) FILTER (e.kind = 'calls') AS construct, count(*) FILTER (e.kind <> 'calls') AS unknown FROM code_edges e JOIN code_nodes n ON source = id GROUP BY 1, 2)""",
  "SELECT target, repo, sources, read, write, construct, unknown FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sources DESC, repo) AS r FROM c) WHERE r <= 3"))
def impact_by_repo(spark, d):
    n = P.code_nodes(spark, d)
    return R.impact_by_repo(n, P.code_edges(spark, d), n, 3)


_PROOFS = "p AS (SELECT 'r' || (l_suppkey % 6) AS source_repo, 'f' || (l_suppkey % 30) AS source_file, 'r' || l_orderkey AS target_repo, 'g' || (l_partkey % 40) AS target_file, l_returnflag AS kind, 'k' || l_linenumber AS edge_kind, CAST(20 + l_quantity AS INTEGER) AS strength FROM lineitem)"


def _proofs(spark, d):
    line = P.table(spark, d, "lineitem")
    c = lambda p, col, m: F.concat(F.lit(p), F.col(col) % m)
    return line.select(c("r", "l_suppkey", 6).alias("source_repo"), c("f", "l_suppkey", 30).alias("source_file"), F.concat(F.lit("r"), "l_orderkey").alias("target_repo"), c("g", "l_partkey", 40).alias("target_file"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("k"), "l_linenumber").alias("edge_kind"), (F.col("l_quantity") + 20).cast("int").alias("strength"))


@query("merge_proofs", f"""WITH {_PROOFS}, o AS (SELECT source_repo, source_file, target_repo, target_file, kind, string_agg(DISTINCT edge_kind, ',' ORDER BY edge_kind) AS edge_kinds, max(strength) AS strength FROM p GROUP BY 1, 2, 3, 4, 5)
  SELECT source_repo, source_file, target_repo, target_file, kind, edge_kinds, strength FROM (SELECT *, row_number() OVER (PARTITION BY target_repo ORDER BY strength DESC, kind, source_repo, source_file, target_file) AS r FROM o) WHERE r <= 2""")
def merge_proofs(spark, d):
    return R.merge_proofs(_proofs(spark, d))


@query("evidence_split", f"WITH {_PROOFS}, s AS (SELECT target_repo, max(strength) AS strength FROM p GROUP BY 1) SELECT target_repo, strength, CASE WHEN strength >= 67 THEN 'confirmed' WHEN strength < 33 THEN 'probable' ELSE 'possible' END AS class FROM s")
def evidence_split(spark, d):
    return R.evidence_split(_proofs(spark, d))


@query("reverse_dependents", "SELECT 'r' || (l_suppkey % 6) AS source_repo, 'f' || l_suppkey AS source_path, count(*) AS edges FROM lineitem WHERE l_partkey % 20 = 0 GROUP BY 1, 2")
def reverse_dependents(spark, d):
    line = P.table(spark, d, "lineitem")
    deps = line.groupBy(F.concat(F.lit("r"), F.col("l_suppkey") % 6).alias("source_repo"), F.concat(F.lit("f"), "l_suppkey").alias("source_path"), F.lit("t").alias("target_repo"), F.col("l_partkey").alias("target_path")).agg(F.count(F.lit(1)).alias("edge_count"))
    return R.dependents(deps, P.table(spark, d, "part").where("p_partkey % 20 = 0").select(F.lit("t").alias("repo"), F.col("p_partkey").alias("file_path")))


@query("unresolved_retry", "SELECT DISTINCT 'r' || (o_custkey % 4) AS repo, 'f' || o_orderkey AS file_path, o_totalprice AS payload FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 20 = 0)")
def unresolved_retry(spark, d):
    o = P.table(spark, d, "orders").select(F.concat(F.lit("r"), F.col("o_custkey") % 4).alias("repo"), F.concat(F.lit("f"), "o_orderkey").alias("file_path"), "o_orderkey", F.col("o_totalprice").alias("payload"))
    keys = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("candidate_key")).join(o, "o_orderkey").select("repo", "file_path", "candidate_key")
    changed = P.table(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("candidate_key"))
    return R.unresolved_retry(o.drop("o_orderkey"), keys, changed).distinct()


@query("shared_candidates", sql.code("""e AS (SELECT source, target FROM code_edges WHERE kind = 'imports'), s AS (SELECT id AS seed FROM code_nodes WHERE number % 20 = 0), v AS (SELECT DISTINCT 'v' || name AS id, lower(name) AS short FROM code_nodes)""",
  "SELECT seed, seed AS id FROM s UNION SELECT seed, target FROM s JOIN e ON seed = source UNION SELECT seed, source FROM s JOIN e ON seed = target UNION SELECT seed, v.id FROM s JOIN code_nodes n ON seed = n.id JOIN v ON short = lower(n.name)"))
def shared_candidates(spark, d):
    every = P.code_nodes(spark, d).withColumn("qualified_name", F.concat(F.lit("pkg::"), "name"))
    n = every.drop("number")
    v = n.select(F.concat(F.lit("v"), "name").alias("id"), F.lit("shared_symbol").alias("kind"), F.lit("__virtual__").alias("repo"), F.lit("v").alias("file_path"), "name", F.concat(F.lit("__shared__lib__"), "name").alias("qualified_name"), F.lit(None).cast("string").alias("external_id"), F.lit(True).alias("is_virtual")).distinct()
    e = P.code_edges(spark, d).where("kind = 'imports'").withColumn("kind", F.lit("uses_shared"))
    return R.shared_candidates(n.unionByName(v), e, every.where("number % 20 = 0").select(F.col("id").alias("node")))


_FIELD = "SELECT l_partkey, l_suppkey % 10 AS part, CASE WHEN l_partkey % 3 = 0 AND l_linenumber = 4 THEN 1 ELSE l_linenumber END AS k FROM lineitem"


@query("field_evidence", f"""WITH x AS ({_FIELD}), c AS (SELECT 'd' || l_partkey || '.' || part AS field, count(*) FILTER (k = 1) AS readers, count(*) FILTER (k = 2) AS writers, count(*) FILTER (k = 3) AS filters, count(*) FILTER (k = 4) AS indexes, count(*) FILTER (k >= 5) AS backfills FROM x GROUP BY 1)
  SELECT *, CASE WHEN filters > 0 AND indexes = 0 THEN 'filter_without_index' WHEN writers > 0 AND readers > 0 AND backfills = 0 THEN 'no_backfill' WHEN readers > 0 AND writers = 0 THEN 'read_only' ELSE 'none' END AS risk FROM c""")
def field_evidence(spark, d):
    n = F.when((F.col("l_partkey") % 3 == 0) & (F.col("l_linenumber") == 4), 1).otherwise(F.col("l_linenumber"))
    kind = F.when(n == 1, "reads_field").when(n == 2, "writes_field").when(n == 3, "filters_on_field").when(n == 4, "indexes_field").otherwise("backfills_field")
    e = P.table(spark, d, "lineitem").select(F.concat(F.lit("d"), "l_partkey", F.lit("."), F.col("l_suppkey") % 10).alias("target"), kind.alias("kind"))
    return R.field_evidence(e, e.select(F.col("target").alias("id")).distinct())


@query("optional_filter_risks", sql.contract("f AS (SELECT DISTINCT target_id, name FROM contract_fields WHERE optional AND field_conf >= 990)", "SELECT DISTINCT target_id, name, 'm' || (event_id % 9) AS file_path FROM contract_fields JOIN f USING (target_id, name)"))
def optional_filter_risks(spark, d):
    c = P.contracts(spark, d)
    f = c.withColumn("n", F.substring_index("id", ":", -1).cast("long")).select("target_id", F.explode("fields").alias("f"), "n").select("target_id", F.col("f.name").alias("name"), F.concat(F.lit("m"), F.col("n") % 9).alias("file_path"))
    return R.optional_filter_risks(c, f, 990).distinct()


@query("bridges", sql.graph_with("""s AS (SELECT id AS seed FROM nodes WHERE kind IN ('function', 'file') AND (repo = 'NATION_1' OR id LIKE '%/%')), e AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), v AS (SELECT id FROM nodes WHERE is_virtual),
  o AS (SELECT seed, target AS node FROM s JOIN e ON seed = source), n AS (SELECT DISTINCT seed, node FROM o JOIN v ON node = id)""",
  "SELECT seed, count(*) AS nodes, min(hops) AS hops FROM (SELECT seed, node, 1 AS hops FROM n UNION ALL SELECT DISTINCT o.seed, e.target, 2 FROM o JOIN e ON o.node = e.source JOIN v ON e.target = v.id WHERE o.seed NOT IN (SELECT seed FROM n)) GROUP BY 1"))
def bridges(spark, d):
    n = P.nodes(spark, d)
    seeds = n.where("kind in ('function', 'file') and (repo = 'NATION_1' or id like '%/%')").select(F.col("id").alias("node"))
    return R.bridges(n, P.edges(spark, d), seeds, ["publishes", "consumes", "defines"]).groupBy("seed").agg(F.count(F.lit(1)).alias("nodes"), F.min("hops").alias("hops"))


@query("repo_overview", sql.code("""h AS (SELECT repo, file_path, row_number() OVER (PARTITION BY repo ORDER BY length(name) * 1000 + number DESC, file_path) AS r FROM code_nodes)""",
  "SELECT n.repo, files, functions, dead_files, hotspots FROM (SELECT repo, count(DISTINCT file_path) AS files, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (number % 5 = 0) AS dead_files FROM code_nodes GROUP BY 1) n JOIN (SELECT repo, string_agg(file_path, ',' ORDER BY r) AS hotspots FROM h WHERE r <= 5 GROUP BY 1) h ON n.repo = h.repo"))
def repo_overview(spark, d):
    n = P.code_nodes(spark, d)
    hot = n.select("repo", "file_path", (F.length("name") * 1000 + F.col("number")).alias("score"))
    return R.overview(n, n.where("number % 5 = 0"), hot)


@query("index_freshness", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'no_change' WHEN 2 THEN 'incremental' ELSE 'rewritten' END AS sync FROM orders")
def index_freshness(spark, d):
    k = F.col("o_orderkey") % 4
    refs = P.table(spark, d, "orders").select("o_orderkey", F.when(k > 0, F.when(k == 1, "a").otherwise("b")).alias("stored_sha"), F.lit("a").alias("head_sha"), (k == 2).alias("stored_is_ancestor"))
    return R.divergence(refs).select("o_orderkey", "sync")


@query("filter_findings", """
  SELECT 'r' AS repo, 'f' || p_partkey AS file_path, CASE p_partkey % 5 WHEN 0 THEN 'index_defeat' WHEN 1 THEN 'unanchored_regex' WHEN 2 THEN 'unsafe_coercion' WHEN 3 THEN 'null_parent' END AS rule FROM part WHERE p_partkey % 5 < 4""")
def filter_findings(spark, d):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, '{"a": {"$nin": [1]}}').when(k == 1, '{"b": {"$regex": "x$"}}').when(k == 2, '{"$expr": {"$eq": ["$a", {"$toInt": "$b"}]}}').when(k == 3, '{"a.b": null}').otherwise('{"a": 1, "b": {"$regex": "^x"}}')
    return R.filter_findings(P.table(spark, d, "part").select(F.lit("r").alias("repo"), F.concat(F.lit("f"), "p_partkey").alias("file_path"), text.alias("filter")))


@query("fuzzy_names", """
  WITH x AS (SELECT DISTINCT lower(p_brand) AS a, lower(p_type) AS b FROM part), p AS (SELECT a, b, (SELECT count(*) FROM range(1, least(length(regexp_replace(a, '[^a-z0-9]', '', 'g')), length(regexp_replace(b, '[^a-z0-9]', '', 'g'))) + 1) t(i) WHERE left(regexp_replace(a, '[^a-z0-9]', '', 'g'), i) = left(regexp_replace(b, '[^a-z0-9]', '', 'g'), i)) AS pre,
    (SELECT sum(least(len(string_split(regexp_replace(a, '[^a-z0-9]', '', 'g'), c)) - 1, len(string_split(regexp_replace(b, '[^a-z0-9]', '', 'g'), c)) - 1)) FROM (SELECT DISTINCT unnest(string_split(regexp_replace(a, '[^a-z0-9]', '', 'g'), '')) AS c)) AS shared, greatest(length(regexp_replace(a, '[^a-z0-9]', '', 'g')), length(regexp_replace(b, '[^a-z0-9]', '', 'g'))) AS m FROM x)
  SELECT a, b, round((0.6 * pre / m + 0.4 * shared / m)::DOUBLE, 4) AS score FROM p""")
def fuzzy_names(spark, d):
    p = P.table(spark, d, "part").select(F.lower("p_brand").alias("a"), F.lower("p_type").alias("b")).distinct()
    return p.select("a", "b", F.round(fuzzy_score(F.col("a"), F.col("b")), 4).alias("score"))
