"""Queries of packs, briefs, plans and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import history
from ..sources import projection as P
from . import sql
from .registry import query


def _code(spark, d):
    return P.code_nodes(spark, d), P.code_edges(spark, d)


_PACK = """
  sd AS (SELECT id AS seed FROM code_nodes WHERE number % 20 = 0), c AS (SELECT source, target FROM code_edges WHERE kind = 'calls'),
  up AS (SELECT seed, seed AS node, 0 AS depth FROM sd UNION SELECT seed, source, depth + 1 FROM up JOIN c ON node = target WHERE depth < 2), dn AS (SELECT seed, seed AS node, 0 AS depth FROM sd UNION SELECT seed, target, depth + 1 FROM dn JOIN c ON node = source WHERE depth < 2),
  o AS (SELECT source, target, kind FROM code_edges UNION SELECT target, source, kind FROM code_edges),
  i AS (SELECT seed, 'callers' AS section, node AS id, min(depth) AS depth, 400 - 25 * min(depth) AS score FROM up GROUP BY seed, node HAVING min(depth) > 0 UNION ALL SELECT seed, 'callees', node, min(depth), 360 - 25 * min(depth) FROM dn GROUP BY seed, node HAVING min(depth) > 0
    UNION ALL SELECT DISTINCT seed, 'shared', target, 1, 295 FROM sd JOIN o ON seed = source WHERE kind = 'imports' AND target <> seed UNION ALL SELECT DISTINCT seed, 'events', target, 1, 275 FROM sd JOIN o ON seed = source WHERE kind = 'references' AND target <> seed)"""


@query("pack_items", sql.code(_PACK, "SELECT seed, section, id, CAST(depth AS INTEGER) AS depth, CAST(score AS INTEGER) AS score FROM i"))
def pack_items(spark, d):
    n, e = _code(spark, d)
    return A.pack_items(n, e, n.where("number % 20 = 0").select(F.col("id").alias("node")))


@query("context_pack", sql.code(_PACK + """, p AS (SELECT *, CASE section WHEN 'callers' THEN 0 WHEN 'shared' THEN 1 WHEN 'events' THEN 2 ELSE 3 END AS place FROM i), u AS (SELECT *, row_number() OVER (PARTITION BY seed, id ORDER BY score DESC, place) AS r FROM p),
  t AS (SELECT seed, section, id, depth, score - 10 * place AS score FROM u WHERE r = 1), b AS (SELECT *, sum(length('{"section":"items","id":"' || id || '","score":' || score || '}')) OVER (PARTITION BY seed ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM t)""", "SELECT seed, section, id, CAST(depth AS INTEGER) AS depth, CAST(score AS INTEGER) AS score, CAST(used AS BIGINT) AS used FROM b WHERE used <= 160"))
def context_pack(spark, d):
    n, e = _code(spark, d)
    return A.context_pack(n, e, n.where("number % 20 = 0").select(F.col("id").alias("node")), "review", 160)


@query("brief", sql.code("""x AS (SELECT e.kind, source, target, a.repo AS sr, b.repo AS tr FROM code_edges e JOIN code_nodes a ON source = a.id JOIN code_nodes b ON target = b.id), i AS (SELECT target AS id, count(*) AS fan_in, count(DISTINCT CASE WHEN sr <> tr THEN sr END) AS impacted_repos FROM x GROUP BY 1),
  o AS (SELECT source AS id, count(*) FILTER (kind = 'calls') AS callees, count(DISTINCT CASE WHEN sr <> tr THEN tr END) AS repo_deps FROM x GROUP BY 1),
  s AS (SELECT n.id, CAST((coalesce(fan_in, 0) >= 5)::INT + (coalesce(callees, 0) >= 3)::INT + 2 * (coalesce(impacted_repos, 0) > 0)::INT + (coalesce(repo_deps, 0) > 0)::INT AS INTEGER) AS risk_score FROM code_nodes n LEFT JOIN i USING (id) LEFT JOIN o USING (id))""", "SELECT id, risk_score, CASE WHEN risk_score <= 1 THEN 'low' WHEN risk_score <= 3 THEN 'medium' ELSE 'high' END AS risk FROM s"))
def brief(spark, d):
    return A.brief(*_code(spark, d)).select("id", "risk_score", "risk")


@query("qa_evidence", sql.code("t AS (SELECT b.file_path, count(DISTINCT a.file_path) AS tests FROM code_edges JOIN code_nodes a ON source = a.id JOIN code_nodes b ON target = b.id WHERE a.file_path LIKE '%tests/%' AND b.file_path NOT LIKE '%tests/%' GROUP BY 1)",
  "SELECT DISTINCT repo, file_path, coalesce(tests, 0) AS tests, CAST(least(1000, 400 * coalesce(tests, 0)) AS INTEGER) AS support FROM code_nodes LEFT JOIN t USING (file_path) WHERE file_path NOT LIKE '%tests/%'"))
def qa_evidence(spark, d):
    return A.qa_evidence(*_code(spark, d))


@query("change_impact_cap", "SELECT target, repo, weight, left_out, CASE WHEN left_out > 0 THEN 'too_many_repos' END AS reason FROM (SELECT l_partkey AS target, n_name AS repo, count(*) AS weight, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, n_name) AS r, greatest(0, count(*) OVER (PARTITION BY l_partkey) - 8) AS left_out FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2) WHERE r <= 8")
def change_impact_cap(spark, d):
    line = P.table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    s = P.table(spark, d, "supplier").join(P.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    i = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("target"), F.col("n_name").alias("repo")).agg(F.count(F.lit(1)).alias("weight"))
    return A.change_impact_cap(i)


@query("sibling_events", "SELECT a.p_partkey || 'a' AS id, b.p_partkey || 'b' AS sibling FROM part a JOIN part b ON a.p_partkey = b.p_partkey UNION ALL SELECT b.p_partkey || 'b', b.p_partkey || 'a' FROM part b")
def sibling_events(spark, d):
    p = P.table(spark, d, "part").select(F.explode(F.array(F.struct(F.lit("a").alias("s"), F.lit("topic").alias("kind"), F.lit("__topic__k__").alias("x")), F.struct(F.lit("b").alias("s"), F.lit("event").alias("kind"), F.lit("__event__").alias("x")))).alias("e"), "p_partkey")
    n = p.select(F.concat("p_partkey", "e.s").alias("id"), "e.kind", F.lit("n").alias("name"), F.concat("e.x", F.lit("E."), "p_partkey").alias("external_id"), F.lit(True).alias("is_virtual"))
    return A.sibling_events(n)


@query("tool_sessions", """
  WITH c AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), l AS (SELECT *, CASE WHEN t - lag(t) OVER w > 86400 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS s FROM l)
  SELECT user_id AS "user", min(t) AS start, count(*) AS calls, count(DISTINCT event_type) AS tools, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id, s""")
def tool_sessions(spark, d):
    e = P.table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), F.col("event_type").alias("tool"), (F.col("event_type") == "error").alias("error"), F.unix_timestamp("ts").alias("at"))
    return A.sessions(e, 86400)


@query("import_aliases", """
  SELECT DISTINCT 'r' || (p_size % 4) AS repo, CASE p_partkey % 3 WHEN 0 THEN '@app/ui/' WHEN 1 THEN '@app/' ELSE './' END || p_partkey AS spec, CASE p_partkey % 3 WHEN 0 THEN 'src/ui/' || p_partkey WHEN 1 THEN 'src/' || p_partkey ELSE './' || p_partkey END AS path FROM part""")
def import_aliases(spark, d):
    k = F.col("p_partkey") % 3
    i = P.table(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_size") % 4).alias("repo"), F.concat(F.when(k == 0, "@app/ui/").when(k == 1, "@app/").otherwise("./"), "p_partkey").alias("spec")).distinct()
    a = spark.createDataFrame([(f"r{r}", p, x) for r in range(4) for p, x in (("@app/", "src/"), ("@app/ui/", "src/ui/"))], "alias_repo string, prefix string, replacement string")
    return A.resolve_aliases(i, a)


@query("change_plan", "SELECT CAST(position AS INTEGER) AS position, section, CASE section WHEN 'events' THEN (SELECT count(*) FROM events) WHEN 'tests' THEN (SELECT count(*) FROM part WHERE p_partkey % 11 = 0) ELSE 0 END AS rows, section IN ('contracts', 'routes', 'data') AS gap FROM (VALUES (0, 'summary'), (1, 'targets'), (2, 'contracts'), (3, 'events'), (4, 'routes'), (5, 'shared_symbols'), (6, 'data'), (7, 'deployments'), (8, 'tests'), (9, 'rollout'), (10, 'risks'), (11, 'open_questions')) t(position, section)")
def change_plan(spark, d):
    found = P.table(spark, d, "events").select(F.lit("events").alias("section")).unionAll(P.table(spark, d, "part").where("p_partkey % 11 = 0").select(F.lit("tests")))
    return A.plan_change(spark, found)


@query("file_history", sql.history("", "SELECT sha, file_path, author_email FROM commits JOIN deltas USING (sha) WHERE file_path IN ('part/8', 'part/15', 'part/22')"))
def file_history(spark, d):
    r = spark.createDataFrame([("x", "part/8", "part/15", 1), ("x", "part/15", "part/22", 2), ("x", "part/3", "part/4", 1)], "repo string, old_path string, new_path string, date int")
    return history.file_history(P.commits(spark, d), P.deltas(spark, d), r, "part/22").select("sha", "file_path", "author_email")
