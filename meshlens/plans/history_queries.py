"""Queries over the projected history, contracts and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import diffs, history
from ..operators.kernels import diff, top_k
from ..sources import projection as P
from . import sql
from .registry import query

NOW = 996710400  # 2001-08-02, a day after the last order


def _history(spark, d):
    return P.commits(spark, d), P.deltas(spark, d)


@query("hotspots", sql.history("", f"""
  SELECT file_path, count(DISTINCT sha) AS total_commits, count(DISTINCT sha) FILTER (age <= 90) AS commits_90d, count(DISTINCT sha) FILTER (age <= 180) AS commits_180d, count(DISTINCT sha) FILTER (age <= 365) AS commits_365d, max(date) AS last_modified, round(sum(exp(-age / 90.0) * (insertions + deletions + 1)), 4) AS score
  FROM (SELECT *, greatest(0.0, ({NOW} - date) / 86400.0)::DOUBLE AS age FROM commits JOIN deltas USING (sha) WHERE change_kind <> 'deleted' AND date <= {NOW} + 300) GROUP BY 1"""))
def hotspots(spark, d):
    return history.hotspots(*_history(spark, d), NOW).withColumn("score", F.round("score", 4))


@query("co_changes", sql.history("f AS (SELECT DISTINCT sha, file_path FROM deltas)", f"""
  SELECT repo, a.file_path AS file_a, b.file_path AS file_b, count(*) AS occurrences, round(sum(exp(-greatest(0.0, ({NOW} - date) / 86400.0)::DOUBLE / 180.0)), 6) AS strength, max(date) AS last_seen
  FROM f a JOIN f b ON a.sha = b.sha AND a.file_path < b.file_path JOIN commits c ON a.sha = c.sha GROUP BY 1, 2, 3 HAVING count(*) >= 2"""))
def co_changes(spark, d):
    return history.co_changes(*_history(spark, d), NOW).withColumn("strength", F.round("strength", 6))


def _renamed(spark, d):
    """Every tenth part file took the next one's name."""
    c, f = _history(spark, d)
    p = P.table(spark, d, "part").where("p_partkey % 10 = 0")
    r = p.crossJoin(P.table(spark, d, "nation").select("n_name")).select(F.col("n_name").alias("repo"), F.concat(F.lit("part/"), "p_partkey").alias("old_path"), F.concat(F.lit("part/"), F.col("p_partkey") + 1).alias("new_path"), F.lit(1).alias("date"))  # 25 nations
    return c, history.canonical(c, f, history.rename_chain(r))


_NEW_NAMES = "f AS (SELECT sha, CASE WHEN CAST(substr(file_path, 6) AS BIGINT) % 10 = 0 THEN 'part/' || (CAST(substr(file_path, 6) AS BIGINT) + 1) ELSE file_path END AS file_path, change_kind, insertions, deletions FROM deltas)"


@query("hotspots_renamed", sql.history(_NEW_NAMES, f"""
  SELECT file_path, count(DISTINCT sha) AS total_commits, max(date) AS last_modified, round(sum(exp(-greatest(0.0, ({NOW} - date) / 86400.0)::DOUBLE / 90.0) * (insertions + deletions + 1)), 4) AS score FROM commits JOIN f USING (sha) WHERE change_kind <> 'deleted' AND date <= {NOW} + 300 GROUP BY 1"""))
def hotspots_renamed(spark, d):
    return history.hotspots(*_renamed(spark, d), NOW).select("file_path", "total_commits", "last_modified", F.round("score", 4).alias("score"))


@query("co_changes_renamed", sql.history(_NEW_NAMES + ", g AS (SELECT DISTINCT sha, file_path FROM f)", """
  SELECT repo, a.file_path AS file_a, b.file_path AS file_b, count(*) AS occurrences, max(date) AS last_seen FROM g a JOIN g b ON a.sha = b.sha AND a.file_path < b.file_path JOIN commits c ON a.sha = c.sha GROUP BY 1, 2, 3 HAVING count(*) >= 2"""))
def co_changes_renamed(spark, d):
    return history.co_changes(*_renamed(spark, d), NOW).drop("strength")


_OWNED = """w AS (SELECT file_path, author_email, CAST(sum(insertions + deletions + 1) AS BIGINT) AS weight FROM commits JOIN deltas USING (sha) GROUP BY 1, 2),
  o AS (SELECT *, weight / sum(weight) OVER (PARTITION BY file_path) AS pct, CAST(row_number() OVER (PARTITION BY file_path ORDER BY weight DESC, author_email) AS INTEGER) AS rank FROM w)"""


@query("ownership", sql.history(_OWNED, "SELECT file_path, author_email, weight, rank, round(pct, 6) AS pct FROM o"))
def ownership(spark, d):
    return history.ownership(*_history(spark, d)).withColumn("pct", F.round("pct", 6))


@query("bus_factor", sql.history(_OWNED + """, c AS (SELECT *, sum(weight) OVER (PARTITION BY file_path ORDER BY rank) * 1000 >= 800 * sum(weight) OVER (PARTITION BY file_path) AS enough FROM o)""",
  "SELECT file_path, min(rank) FILTER (enough) AS bus_factor, arg_min(author_email, rank) AS top_owner, round(max(pct), 6) AS top_owner_pct FROM c GROUP BY 1"))
def bus_factor(spark, d):
    return history.bus_factor(history.ownership(*_history(spark, d))).withColumn("top_owner_pct", F.round("top_owner_pct", 6))


@query("owner_risks", sql.history(_OWNED, "SELECT file_path, author_email AS top_owner, round(pct, 6) AS pct FROM o WHERE rank = 1 AND pct >= 0.15"))
def owner_risks(spark, d):
    f = history.owner_risks(history.bus_factor(history.ownership(*_history(spark, d))), 0.15)
    return f.select("file_path", "top_owner", F.round("top_owner_pct", 6).alias("pct"))


@query("history_edges", sql.history(_OWNED + """, f AS (SELECT DISTINCT sha, file_path FROM deltas),
  p AS (SELECT repo, a.file_path AS x, b.file_path AS y, count(*) AS n FROM f a JOIN f b ON a.sha = b.sha AND a.file_path < b.file_path JOIN commits c ON a.sha = c.sha GROUP BY 1, 2, 3 HAVING count(*) >= 2),
  q AS (SELECT x, y, n FROM p UNION ALL SELECT y, x, n FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS k FROM q)""",
  "SELECT file_path AS source, author_email AS target, 'owned_by' AS kind, CAST(weight AS INTEGER) AS weight, CAST(round(pct * 1000) AS INTEGER) AS confidence FROM o WHERE rank = 1 UNION ALL SELECT x, y, 'co_changes_with', CAST(n AS INTEGER), CAST(least(1000, n * 100) AS INTEGER) FROM r WHERE k <= 5"))
def history_edges(spark, d):
    c, f = _history(spark, d)
    return history.materialized_edges(history.ownership(c, f), history.co_changes(c, f, NOW))


@query("rename_chain", """
  WITH RECURSIVE r AS (SELECT CAST(p_size % 3 AS VARCHAR) AS repo, 'n' || p_partkey AS old, 'n' || (p_partkey + 7) AS new, p_partkey AS date FROM part WHERE p_partkey % 10 < 6),
  c AS (SELECT repo, old, new AS latest, date FROM r UNION ALL SELECT c.repo, c.old, r.new, r.date FROM c JOIN r ON c.repo = r.repo AND c.latest = r.old AND r.date > c.date)
  SELECT repo, old AS old_path, arg_max(latest, date) AS latest FROM c GROUP BY 1, 2""")
def rename_chain(spark, d):
    p = P.table(spark, d, "part").where("p_partkey % 10 < 6")
    return history.rename_chain(p.select((F.col("p_size") % 3).cast("string").alias("repo"), F.concat(F.lit("n"), "p_partkey").alias("old_path"), F.concat(F.lit("n"), F.col("p_partkey") + 7).alias("new_path"), F.col("p_partkey").alias("date")))


@query("version_mismatches", """
  WITH p AS (SELECT DISTINCT p_type AS package, p_brand AS repo, CAST(p_size % 4 AS VARCHAR) AS version FROM part), l AS (SELECT *, lag(version) OVER (PARTITION BY package ORDER BY repo, version) AS before FROM p),
  k AS (SELECT *, count(*) OVER (PARTITION BY package) AS n FROM l WHERE before IS NULL OR before <> version) SELECT package, repo, version FROM k WHERE n > 1""")
def version_mismatches(spark, d):
    return history.version_mismatches(P.table(spark, d, "part").select(F.col("p_type").alias("package"), F.col("p_brand").alias("repo"), (F.col("p_size") % 4).cast("string").alias("version")).distinct())


@query("message_rules", r"""
  WITH m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'feat(core)!: ' WHEN 1 THEN 'Fix: ' WHEN 2 THEN 'Merge pull request #' || conv_id || ' from x' ELSE 'we chose ' END || text || ' (#' || turn || ')' AS message FROM conversations),
  l AS (SELECT *, string_split(message, chr(10))[1] AS line FROM m)
  SELECT conv_id, turn, nullif(lower(regexp_extract(line, '(?i)^\s*(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(\([^)]*\))?!?:', 1)), '') AS class,
    CAST(coalesce(nullif(regexp_extract(line, '^Merge pull request #([0-9]+)', 1), ''), nullif(regexp_extract(line, '\(#([0-9]+)\)', 1), '')) AS INTEGER) AS pr,
    regexp_matches(lower(message), 'because|decided|trade-off|tradeoff|rationale|we chose') AS decision FROM l""")
def message_rules(spark, d):
    c = P.table(spark, d, "conversations")
    head = F.when(F.col("turn") % 4 == 0, F.lit("feat(core)!: ")).when(F.col("turn") % 4 == 1, F.lit("Fix: ")).when(F.col("turn") % 4 == 2, F.concat(F.lit("Merge pull request #"), "conv_id", F.lit(" from x"))).otherwise(F.lit("we chose "))
    m = c.withColumn("m", F.concat(head, "text", F.lit(" (#"), "turn", F.lit(")")))
    return m.select("conv_id", "turn", X.commit_class(F.col("m")).alias("class"), X.pr_number(F.col("m")).alias("pr"), X.decision_signal(F.col("m")).alias("decision"))


@query("contract_consolidation", sql.contract("", "SELECT target_id, side, name, CASE WHEN count(DISTINCT type_name) > 1 THEN 'mixed' ELSE min(type_name) END AS type_name, bool_and(optional) AS optional, min(field_conf) AS confidence FROM contract_fields GROUP BY 1, 2, 3"))
def contract_consolidation(spark, d):
    return diffs.consolidate(P.contracts(spark, d))


_DRIFT = """c AS (SELECT target_id, side, name, CASE WHEN count(DISTINCT type_name) > 1 THEN 'mixed' ELSE min(type_name) END AS type_name, bool_and(optional) AS optional, min(field_conf) AS confidence FROM contract_fields WHERE NOT (side = 'producer' AND name = 'value' AND starts_with(target_id, 'ev:click')) GROUP BY 1, 2, 3),
  j AS (SELECT coalesce(p.target_id, q.target_id) AS target_id, coalesce(p.name, q.name) AS name, p.type_name AS producer_type_name, q.type_name AS consumer_type_name, p.optional AS po, q.optional AS qo, least(p.confidence, q.confidence) AS confidence FROM (FROM c WHERE side = 'producer') p FULL JOIN (FROM c WHERE side = 'consumer') q ON p.target_id = q.target_id AND p.name = q.name),
  k AS (SELECT *, CASE WHEN consumer_type_name IS NULL THEN 'extra_field' WHEN producer_type_name IS NULL THEN 'missing_field' WHEN lower(producer_type_name) <> lower(consumer_type_name) THEN 'type' WHEN po <> qo THEN 'optionality' END AS drift FROM j WHERE target_id IN (SELECT target_id FROM c GROUP BY 1 HAVING count(DISTINCT side) = 2))"""


@query("contract_drift", sql.contract(_DRIFT, "SELECT target_id, name, drift, producer_type_name, consumer_type_name, confidence FROM k WHERE drift IS NOT NULL"))
def contract_drift(spark, d):
    c = P.contracts(spark, d)
    cut = (F.col("side") == "producer") & F.col("target_id").startswith("ev:click")
    return diffs.drift(c.withColumn("fields", F.when(cut, F.filter("fields", lambda f: f["name"] != "value")).otherwise(F.col("fields"))))


@query("breaking_candidates", sql.contract(_DRIFT, "SELECT target_id, name, drift FROM k WHERE drift IS NOT NULL AND target_id IN (SELECT target_id FROM contract_rows WHERE repo = 'repo1' AND confidence >= 990)"))
def breaking_candidates(spark, d):
    c = P.contracts(spark, d)
    cut = (F.col("side") == "producer") & F.col("target_id").startswith("ev:click")
    c = c.withColumn("fields", F.when(cut, F.filter("fields", lambda f: f["name"] != "value")).otherwise(F.col("fields")))
    return diffs.breaking_candidates(c, "repo1", 990).select("target_id", "name", "drift")


@query("contract_filter", sql.contract("", "SELECT 'pc:' || event_id AS id, repo, confidence FROM contract_rows WHERE repo = 'repo2' AND side = 'producer' AND confidence >= 800"))
def contract_filter(spark, d):
    return diffs.contract_filter(P.contracts(spark, d), 800, repo="repo2", side="producer", target_qn=None).select("id", "repo", "confidence")


@query("field_deltas", sql.contract("""
  b AS (SELECT repo, file_path, target_qn, side, name, max(type_name) AS t, bool_and(optional) AS o FROM contract_fields WHERE event_id % 3 <> 0 GROUP BY ALL), r AS (SELECT repo, file_path, target_qn, side, name, max(type_name) AS t, bool_and(optional) AS o FROM contract_fields WHERE event_id % 3 <> 1 GROUP BY ALL),
  j AS (SELECT coalesce(b.repo, r.repo) AS repo, coalesce(b.file_path, r.file_path) AS file_path, coalesce(b.target_qn, r.target_qn) AS target_qn, coalesce(b.side, r.side) AS side, coalesce(b.name, r.name) AS name,
    CASE WHEN b.repo IS NULL THEN 'added' WHEN r.repo IS NULL THEN 'removed' WHEN b.t IS DISTINCT FROM r.t THEN 'type_changed' WHEN b.o AND NOT r.o THEN 'now_required' WHEN NOT b.o AND r.o THEN 'now_optional' END AS delta FROM b FULL JOIN r ON b.repo = r.repo AND b.file_path = r.file_path AND b.target_qn = r.target_qn AND b.side = r.side AND b.name = r.name)""", "SELECT * FROM j WHERE delta IS NOT NULL"))
def field_deltas(spark, d):
    c = P.contracts(spark, d).withColumn("n", F.substring_index("id", ":", -1).cast("long"))
    return diffs.field_deltas(c.where("n % 3 <> 0"), c.where("n % 3 <> 1"))


@query("contract_alignment", sql.contract("""
  s AS (SELECT substr(target_id, 4) AS identity, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT e.event_id, e.target_id, f.name FROM contract_rows e JOIN (SELECT event_id, name FROM contract_fields) f USING (event_id) WHERE e.event_id % 11 <> 0 OR f.name <> 'value') GROUP BY event_id, target_id),
  m AS (SELECT identity, count(*) AS members, count(DISTINCT names) AS kinds FROM s GROUP BY 1)""", "SELECT identity || '_' AS identity, members, CASE WHEN kinds > 1 THEN 500 ELSE 1000 END AS confidence FROM m WHERE members >= 2 ORDER BY confidence, identity LIMIT 50"))
def contract_alignment(spark, d):
    c = P.contracts(spark, d).withColumn("n", F.substring_index("id", ":", -1).cast("long")).withColumn("target_qn", F.concat("target_qn", F.lit("_Request")))
    c = c.withColumn("fields", F.when(F.col("n") % 11 == 0, F.filter("fields", lambda f: f["name"] != "value")).otherwise(F.col("fields")))
    return diffs.alignment(c)


_SNAP = """b AS (SELECT l_suppkey, l_partkey, min(l_returnflag) AS flag FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01' GROUP BY 1, 2), r AS (SELECT l_suppkey, l_partkey, min(l_returnflag) AS flag FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01' GROUP BY 1, 2),
  j AS (SELECT coalesce(b.l_suppkey, r.l_suppkey) AS l_suppkey, coalesce(b.l_partkey, r.l_partkey) AS l_partkey, b.flag AS before_flag, r.flag AS after_flag, CASE WHEN b.l_suppkey IS NULL THEN 'added' WHEN r.l_suppkey IS NULL THEN 'removed' WHEN b.flag IS NOT DISTINCT FROM r.flag THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN r ON b.l_suppkey = r.l_suppkey AND b.l_partkey = r.l_partkey)"""


def _snapshots(spark, d):
    line = P.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_shipdate")
    t = F.lit("1998-07-01").cast("timestamp")
    part = lambda c: line.where(c).groupBy("l_suppkey", "l_partkey").agg(F.min("l_returnflag").alias("flag"))
    return part(F.col("l_shipdate") < t), part(F.col("l_shipdate") >= t)


@query("snapshot_diff", f"WITH {_SNAP} SELECT * FROM j")
def snapshot_diff(spark, d):
    return diff(*_snapshots(spark, d), ["l_suppkey", "l_partkey"], ["flag"])


@query("removed_surface_risks", f"""WITH {_SNAP}, s AS (SELECT s_suppkey, s_nationkey FROM supplier), c AS (SELECT l_partkey, o_custkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY 1, 2, 3),
  x AS (SELECT 's' || l_suppkey || 'p' || l_partkey AS id, l_partkey, CAST(s_nationkey AS VARCHAR) AS repo FROM j JOIN s ON l_suppkey = s_suppkey WHERE change = 'removed')
  SELECT id, repo, count(o_custkey) AS consumers, count(*) FILTER (CAST(c_nationkey AS VARCHAR) <> repo) AS "foreign", CASE WHEN count(o_custkey) = 0 THEN 'low' WHEN count(*) FILTER (CAST(c_nationkey AS VARCHAR) <> repo) > 0 THEN 'high' ELSE 'medium' END AS severity FROM x LEFT JOIN c USING (l_partkey) GROUP BY 1, 2""")
def removed_surface_risks(spark, d):
    supplier = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("repo"))
    gone = diff(*_snapshots(spark, d), ["l_suppkey", "l_partkey"], ["flag"]).where("change = 'removed'").join(supplier, "l_suppkey")
    gone = gone.select(F.concat(F.lit("s"), "l_suppkey", F.lit("p"), "l_partkey").alias("id"), "repo", "l_partkey")
    line = P.table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp")).select("l_orderkey", "l_partkey")
    o = P.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(P.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("r")), F.col("o_custkey") == F.col("c_custkey"))
    use = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", F.col("o_custkey").alias("source"), F.col("r").alias("repo")).distinct()
    c = gone.select("id", "l_partkey").join(use, "l_partkey").select(F.col("id").alias("target"), "source", "repo")
    return diffs.removed_risks(gone.select("id", "repo"), c)


@query("file_changes", """
  WITH s AS (SELECT source AS repo, 'd' || doc_id AS p, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT source AS repo, 'd' || doc_id AS p, md5(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0)
  SELECT coalesce(s.repo, n.repo) AS repo, coalesce(s.p, n.p) AS file_path, CASE WHEN s.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'deleted' WHEN s.h = n.h THEN 'unchanged' ELSE 'modified' END AS status FROM s FULL JOIN n ON s.repo = n.repo AND s.p = n.p""")
def file_changes(spark, d):
    t = P.table(spark, d, "documents").select("doc_id", F.col("source").alias("repo"), F.concat(F.lit("d"), "doc_id").alias("file_path"), "text")
    stored = t.where("doc_id % 7 <> 0").select("repo", "file_path", F.md5("text").alias("content_hash"))
    new = t.where("doc_id % 13 <> 0").select("repo", "file_path", F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("content_hash"))
    return diffs.file_changes(stored, new)


@query("affected_files", """
  WITH c AS (SELECT 'r' || (p_size % 5) AS repo, 'f' || p_partkey AS file_path FROM part WHERE p_partkey % 20 = 0), dep AS (SELECT DISTINCT 'r' || (b.p_size % 5) AS sr, 'f' || b.p_partkey AS sp, 'r' || (a.p_size % 5) AS tr, 'f' || a.p_partkey AS tp FROM part a JOIN part b ON b.p_partkey IN (a.p_partkey + 1, a.p_partkey + 2))
  SELECT repo, file_path FROM c UNION SELECT sr, sp FROM dep JOIN c ON tr = repo AND tp = file_path""")
def affected_files(spark, d):
    p = P.table(spark, d, "part").select("p_partkey", F.concat(F.lit("r"), F.col("p_size") % 5).alias("repo"), F.concat(F.lit("f"), "p_partkey").alias("file_path"))
    near = p.select(F.explode(F.array(F.col("p_partkey") + 1, F.col("p_partkey") + 2)).alias("k"), F.col("repo").alias("target_repo"), F.col("file_path").alias("target_path"))
    deps = near.join(p.select(F.col("p_partkey").alias("k"), F.col("repo").alias("source_repo"), F.col("file_path").alias("source_path")), "k")
    return diffs.affected_files(p.where("p_partkey % 20 = 0"), deps)


@query("cross_pr_drift", """
  WITH c AS (SELECT DISTINCT o_custkey % 20 AS pr, l_partkey || '.' || (l_suppkey % 10) AS target, CASE WHEN l_linenumber % 3 = 0 THEN 'consumer' ELSE 'producer' END AS side FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT DISTINCT pr, target FROM c WHERE side = 'producer' AND NOT EXISTS (SELECT 1 FROM c x WHERE x.side = 'consumer' AND x.target = c.target AND x.pr <> c.pr)""")
def cross_pr_drift(spark, d):
    o = P.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("pr"))
    line = P.table(spark, d, "lineitem").select("l_orderkey", F.concat("l_partkey", F.lit("."), F.col("l_suppkey") % 10).alias("target"), F.when(F.col("l_linenumber") % 3 == 0, "consumer").otherwise("producer").alias("side"))
    return diffs.cross_pr_drift(line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("pr", "target", "side"))


@query("affected_repos", """
  WITH u AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), r AS (SELECT DISTINCT string_split(path, '/')[1] AS root FROM u UNION SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] FROM u WHERE string_split(path, '/')[2] = 'en')
  SELECT path, arg_max(root, length(root)) AS repo FROM u JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY 1""")
def affected_repos(spark, d):
    u = P.table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")).distinct()
    host = F.substring_index("path", "/", 1)
    roots = u.select(host.alias("root")).union(u.where(F.get(F.split("path", "/"), F.lit(1)) == "en").select(F.concat(host, F.lit("/en")))).distinct()
    return diffs.affected_repos(u, roots.select("root", F.col("root").alias("repo")))


@query("value_mirrors", """
  WITH l AS (SELECT p_brand || (p_size % 10) AS value, 'r' || (p_partkey % 6) AS repo, 's' || p_partkey AS symbol, p_partkey % 9 = 0 AS authoritative, p_partkey % 17 = 0 AS guard FROM part),
  g AS (SELECT value FROM l GROUP BY 1 HAVING bool_or(authoritative) AND (count(DISTINCT repo) >= 2 OR bool_or(guard))), t AS (SELECT value, min(symbol) AS authority FROM l WHERE authoritative GROUP BY 1)
  SELECT value, repo, symbol, authority FROM l JOIN g USING (value) JOIN t USING (value) WHERE symbol <> authority""")
def value_mirrors(spark, d):
    p = P.table(spark, d, "part")
    return diffs.mirrors(p.select(F.concat("p_brand", F.col("p_size") % 10).alias("value"), F.concat(F.lit("r"), F.col("p_partkey") % 6).alias("repo"), F.concat(F.lit("s"), "p_partkey").alias("symbol"), (F.col("p_partkey") % 9 == 0).alias("authoritative"), (F.col("p_partkey") % 17 == 0).alias("guard")))


@query("report_parity", "SELECT p_brand, p_size, 'a' AS only_in FROM (SELECT p_brand, p_size FROM part WHERE p_partkey % 5 <> 0 EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_partkey % 5 <> 1) UNION ALL SELECT p_brand, p_size, 'b' FROM (SELECT p_brand, p_size FROM part WHERE p_partkey % 5 <> 1 EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_partkey % 5 <> 0)")
def report_parity(spark, d):
    p = P.table(spark, d, "part")
    return diffs.parity(p.where("p_partkey % 5 <> 0").select("p_brand", "p_size"), p.where("p_partkey % 5 <> 1").select("p_brand", "p_size"))


@query("graph_recall", """
  WITH e AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag AS kind FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <= 3), a AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag AS kind FROM lineitem WHERE l_returnflag IN (SELECT kind FROM e) AND l_linenumber >= 2)
  SELECT count(*) FILTER (x AND y) AS found, round(count(*) FILTER (x AND y) / count(x), 6)::DOUBLE AS recall, round(count(*) FILTER (x AND y) / count(y), 6)::DOUBLE AS precision FROM (SELECT *, true AS x FROM e) FULL JOIN (SELECT *, true AS y FROM a) USING (l_suppkey, l_partkey, kind)""")
def graph_recall(spark, d):
    line = P.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_returnflag").alias("kind"), "l_linenumber")
    return diffs.recall_precision(line.where("kind <> 'N' and l_linenumber <= 3"), line.where("l_linenumber >= 2"), ["l_suppkey", "l_partkey", "kind"])


@query("top_paths", "SELECT * FROM (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS INTEGER) AS rank, count(*) OVER (PARTITION BY l_partkey) > 3 AS truncated FROM lineitem) WHERE rank <= 3")
def top_paths(spark, d):
    return top_k(P.table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_partkey"], [F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
