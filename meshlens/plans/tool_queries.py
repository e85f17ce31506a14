"""Queries of tool bodies: orientation, symbols, dependencies, reviews, traces, versioned tables, source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import diffs, events, review
from ..operators import tools as T
from ..operators.kernels import diff, new_path
from ..schema import RESOLVERS
from ..sources import projection as P
from ..sources import scans, sinks
from . import sql
from .registry import query


def _code(spark, d):
    return P.code_nodes(spark, d), P.code_edges(spark, d)


@query("graph_schema", sql.graph("SELECT 'node' AS side, kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY 2"))
def graph_schema(spark, d):
    return T.graph_schema(P.nodes(spark, d), P.edges(spark, d))


@query("list_repos", sql.graph("SELECT repo, count(DISTINCT file_path) AS files, count(*) FILTER (kind <> 'file') AS symbols FROM nodes WHERE repo <> '__virtual__' GROUP BY 1"))
def list_repos(spark, d):
    return T.list_repos(P.nodes(spark, d))


@query("get_symbol", """
  WITH w AS (SELECT DISTINCT l_partkey AS k FROM lineitem UNION SELECT -p_partkey FROM part WHERE p_partkey > 0), d AS (SELECT l_partkey, string_agg(DISTINCT 'tag' || l_linenumber, ',' ORDER BY 'tag' || l_linenumber) AS x FROM lineitem GROUP BY 1)
  SELECT CAST(k AS VARCHAR) AS id, p_partkey IS NOT NULL AS found, CASE WHEN p_partkey IS NOT NULL THEN 'class' END AS kind, 'r' || (p_size % 10) AS repo, 'f' || p_partkey AS file_path, p_name AS name, CASE WHEN p_partkey IS NULL THEN '' ELSE coalesce(x, '') END AS decorators FROM w LEFT JOIN part ON p_partkey = k LEFT JOIN d ON l_partkey = k""")
def get_symbol(spark, d):
    p, line = P.table(spark, d, "part"), P.table(spark, d, "lineitem")
    nodes = p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("class").alias("kind"), F.concat(F.lit("r"), F.col("p_size") % 10).alias("repo"), F.concat(F.lit("f"), "p_partkey").alias("file_path"), F.col("p_name").alias("name"))
    edges = line.select(F.col("l_partkey").cast("string").alias("source"), F.concat(F.lit("tag"), "l_linenumber").alias("target"), F.lit("uses_decorator").alias("kind"))
    wanted = line.select(F.col("l_partkey").cast("string").alias("id")).union(p.where("p_partkey > 0").select((-F.col("p_partkey")).cast("string")))
    return T.get_symbol(nodes, edges, wanted)


@query("cross_repo_deps", sql.code("", "SELECT a.repo, b.repo AS other, string_agg(DISTINCT e.kind, ',' ORDER BY e.kind) AS edge_kinds, CAST(least(1000, count(*) * 10) AS INTEGER) AS support FROM code_edges e JOIN code_nodes a ON source = a.id JOIN code_nodes b ON target = b.id WHERE a.repo <> b.repo GROUP BY 1, 2"))
def cross_repo_deps(spark, d):
    return T.cross_repo_deps(*_code(spark, d))


@query("evidence_rows", sql.code("x AS (SELECT a.repo, b.repo AS other, least(1000, count(*) * 10) AS support FROM code_edges e JOIN code_nodes a ON source = a.id JOIN code_nodes b ON target = b.id WHERE a.repo <> b.repo GROUP BY 1, 2)",
  "SELECT left(sha256('cross_repo' || chr(0) || 'graph' || chr(0) || repo || ':' || other || chr(0) || other), 16) AS id, 'cross_repo' AS kind, 'graph' AS source, repo || ':' || other AS citation, other AS subject, CAST(support AS INTEGER) AS support FROM x"))
def evidence_rows(spark, d):
    return T.evidence_rows(T.cross_repo_deps(*_code(spark, d)), "cross_repo", "graph", ["repo", "other"], "other", "support")


@query("rendered_chains", sql.code("s AS (SELECT o, p, lead(p) OVER (PARTITION BY o ORDER BY p) AS q, row_number() OVER (PARTITION BY o ORDER BY p) AS i FROM sym)", "SELECT CAST(o AS VARCHAR) AS chain, '`Sym' || arg_min(p, i) || '`' || chr(10) || string_agg(' → calls `Sym' || q || '`', chr(10) ORDER BY i) AS text FROM s WHERE q IS NOT NULL GROUP BY o"))
def rendered_chains(spark, d):
    """The calls of each file as one chain."""
    e = P.code_edges(spark, d).where("kind = 'calls'")
    part = lambda c: F.concat(F.lit("Sym"), F.substring_index(c, ".", -1))
    steps = e.select(F.substring_index("source", ".", 1).alias("chain"), F.substring_index("source", ".", -1).cast("long").alias("step"), part("source").alias("source"), "kind", part("target").alias("target"))
    return T.render_chains(steps)


@query("non_actionable_calls", """
  WITH c AS (SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN true WHEN 6 THEN true WHEN 7 THEN false WHEN 8 THEN true WHEN 9 THEN true WHEN 10 THEN true ELSE false END AS non_actionable FROM part) SELECT * FROM c""")
def non_actionable_calls(spark, d):
    k = F.col("p_partkey") % 12
    cases = [("a/b.cy.ts", "run", "x.run"), ("a.ts", "fetch", None), ("a.ts", "setName", None), ("a.ts", "settle", None), ("a.ts", "post", "this.httpService.post"), ("a.ts", "emit", "this.eventBus.emit"), ("a.ts", "findOne", "userModel.findOne"), ("a.ts", "findOne", "users.findOne"), ("a.ts", "log", "console.log"), ("a/__mocks__/b.ts", "x", None), ("a.ts", "open", "Axios.open"), ("a.ts", "charge", "billing.charge")]
    pick = lambda j: F.coalesce(*(F.when(k == i, F.lit(c[j])) for i, c in enumerate(cases)))
    return P.table(spark, d, "part").select("p_partkey", T.non_actionable(pick(0), pick(1), pick(2), F.array(F.lit("Axios"))).alias("non_actionable"))


@query("unresolved_counts", "SELECT 'r' || (o_custkey % 4) AS repo, count(*) AS unresolved FROM orders GROUP BY 1")
def unresolved_counts(spark, d):
    return T.unresolved_counts(P.table(spark, d, "orders").select(F.concat(F.lit("r"), F.col("o_custkey") % 4).alias("repo")))


@query("pack_stats", "SELECT count(*) AS packs, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, CAST(sum(o_custkey % 5) AS BIGINT) AS hits FROM orders")
def pack_stats(spark, d):
    return T.pack_stats(P.table(spark, d, "orders").select(F.floor("o_totalprice").cast("long").alias("bytes"), (F.col("o_custkey") % 5).alias("hits")))


_AI = "SELECT l_suppkey || ':' || l_partkey AS id, min(l_returnflag) AS provider, max(l_linestatus) AS model, 'json' AS schema_format FROM lineitem WHERE l_shipdate {op} TIMESTAMP '1998-07-01' GROUP BY 1"


@query("ai_contract_deltas", f"""WITH b AS ({_AI.format(op='<')}), r AS ({_AI.format(op='>=')}), j AS (SELECT coalesce(b.id, r.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN r.id IS NULL THEN 'removed' ELSE 'changed' END AS change, b.provider AS bp, r.provider AS rp, b.model AS bm, r.model AS rm FROM b FULL JOIN r ON b.id = r.id)
  SELECT id, change, 'contract' AS facet, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after FROM j WHERE change <> 'changed' UNION ALL SELECT id, change, 'provider', bp, rp FROM j WHERE change = 'changed' AND bp <> rp UNION ALL SELECT id, change, 'model', bm, rm FROM j WHERE change = 'changed' AND bm <> rm""")
def ai_contract_deltas(spark, d):
    t = F.lit("1998-07-01").cast("timestamp")
    line = P.table(spark, d, "lineitem")

    def side(c):
        g = line.where(c).groupBy(F.concat_ws(":", "l_suppkey", "l_partkey").alias("id")).agg(F.min("l_returnflag").alias("provider"), F.max("l_linestatus").alias("model"))
        return g.select("*", F.lit(None).cast("double").alias("temperature"), F.lit("structured").alias("inference_kind"), F.lit("T").alias("source_type_name"), F.lit("json").alias("schema_format"))

    return T.ai_contract_deltas(side(F.col("l_shipdate") < t), side(F.col("l_shipdate") >= t))


_REVIEW = """x AS (SELECT DISTINCT l_shipdate >= TIMESTAMP '1998-07-01' AS late, 's' || l_suppkey || ':' || l_partkey AS key, l_linenumber % 3 AS s FROM lineitem),
  c AS (SELECT CASE s WHEN 0 THEN 'routes' WHEN 1 THEN 'events' ELSE 'symbols' END AS section, key, CASE WHEN bool_and(late) THEN 'added' WHEN bool_and(NOT late) THEN 'removed' END AS change FROM x GROUP BY 1, 2),
  k AS (SELECT DISTINCT 's' || l_suppkey || ':' || l_partkey AS key FROM lineitem WHERE l_returnflag = 'R'),
  r AS (SELECT section, c.key, change, CASE WHEN k.key IS NOT NULL AND change = 'removed' THEN 'high' WHEN change = 'added' THEN 'low' ELSE 'medium' END AS severity FROM c LEFT JOIN k ON c.key = k.key WHERE change IS NOT NULL)"""


def _review(spark, d):
    t = F.lit("1998-07-01").cast("timestamp")
    line = P.table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.concat_ws(":", "l_suppkey", "l_partkey")).alias("key"), "l_linenumber", "l_shipdate", "l_returnflag")

    def delta(n):
        part = line.where(F.col("l_linenumber") % 3 == n)
        return diff(part.where(F.col("l_shipdate") < t).select("key").distinct(), part.where(F.col("l_shipdate") >= t).select("key").distinct(), ["key"], []).where("change <> 'same'")

    sections = {"routes": delta(0), "events": delta(1), "symbols": delta(2)}
    removed = next(iter(sections.values())).where("change = 'removed'").unionByName(sections["events"].where("change = 'removed'")).unionByName(sections["symbols"].where("change = 'removed'"))
    used = line.where("l_returnflag = 'R'").select("key").distinct()
    # a key may be removed in one section and added in another: the risk is of the removal alone
    risks = removed.join(used, "key", "left_semi").select(F.col("key"), F.lit("high").alias("severity")).distinct()
    rows = T.pr_review({s: df.where("change = 'removed'") for s, df in sections.items()}, risks)
    none = risks.limit(0)
    return rows.unionByName(T.pr_review({s: df.where("change = 'added'") for s, df in sections.items()}, none))


@query("pr_review", f"WITH {_REVIEW} SELECT section, key, change, severity FROM r")
def pr_review(spark, d):
    return _review(spark, d)


@query("pr_review_summary", f"WITH {_REVIEW} SELECT section, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN 'blocked' WHEN count(*) FILTER (severity = 'medium') > 0 THEN 'attention' ELSE 'clear' END AS verdict FROM r GROUP BY 1")
def pr_review_summary(spark, d):
    return T.review_summary(_review(spark, d))


@query("pr_review_markdown", f"WITH {_REVIEW} SELECT '| ' || section || ' | ' || key || ' | ' || change || ' | ' || severity || ' |' AS line FROM r")
def pr_review_markdown(spark, d):
    return _review(spark, d).select(sinks.table_line(F.col("section"), F.col("key"), F.col("change"), F.col("severity")).alias("line"))


@query("pr_sets", """
  SELECT 'set' || c_custkey AS set_id, 'a' AS pr, 'repo' || c_nationkey AS repo, 'main' AS base, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x' END AS head, CASE WHEN c_custkey % 5 = 0 THEN 'unsupported version' WHEN c_custkey % 3 = 0 THEN 'empty field' WHEN c_custkey % 4 = 0 THEN 'duplicate id' END AS problem FROM customer
  UNION ALL SELECT 'set' || c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'a' ELSE 'b' END, 'repo' || c_nationkey, 'main', 'y', CASE WHEN c_custkey % 5 = 0 THEN 'unsupported version' WHEN c_custkey % 4 = 0 THEN 'duplicate id' WHEN c_custkey % 7 = 0 THEN 'unknown dependency' END FROM customer""")
def pr_sets(spark, d):
    k = F.col("c_custkey")
    entry = lambda name, head, deps: F.struct(name.alias("id"), F.concat(F.lit("repo"), "c_nationkey").alias("repo"), F.lit("main").alias("base"), head.alias("head"), deps.alias("depends_on"))
    none = F.array().cast("array<string>")
    prs = F.array(entry(F.lit("a"), F.when(k % 3 == 0, "").otherwise("x"), none), entry(F.when(k % 4 == 0, "a").otherwise("b"), F.lit("y"), F.when(k % 7 == 0, F.array(F.lit("z"))).otherwise(F.array(F.lit("a")))))
    return T.pr_set(P.table(spark, d, "customer").select(F.to_json(F.struct(F.when(k % 5 == 0, 3).otherwise(0).alias("version"), F.concat(F.lit("set"), k).alias("id"), prs.alias("prs"))).alias("json")))


_RESULTS = "SELECT 'b' || (p_partkey // 4) AS name, 'p' || (p_partkey // 4 % {m} // {k}) AS platform, 'm' || (p_partkey % 4) AS metric, p_retailprice * {f} AS value FROM part WHERE {w}"
_BASE, _NOW = _RESULTS.format(m=7, k=6, f="1.0", w="p_partkey // 4 % 9 <> 0"), _RESULTS.format(m=5, k=4, f="(1 + p_partkey % 3 * 0.08)", w="p_partkey // 4 % 11 <> 0 AND p_partkey % 13 <> 0")


@query("compare_results", f"""WITH a AS ({_BASE}), b AS ({_NOW}), x AS (SELECT coalesce(a.name, b.name) AS name, a.p AS ap, b.p AS bp FROM (SELECT name, max(platform) AS p FROM a GROUP BY 1) a FULL JOIN (SELECT name, max(platform) AS p FROM b GROUP BY 1) b ON a.name = b.name)
  SELECT name, CASE WHEN ap IS NULL THEN 'new' WHEN bp IS NULL THEN 'missing' WHEN ap <> bp THEN 'platform_mismatch' ELSE 'platforms_match' END AS status, CAST(NULL AS VARCHAR) AS metric FROM x
  UNION ALL SELECT a.name, CASE WHEN b.name IS NULL THEN 'metric_missing' ELSE 'regressed' END, a.metric FROM a JOIN x ON a.name = x.name AND bp IS NOT NULL LEFT JOIN b ON a.name = b.name AND a.metric = b.metric WHERE b.name IS NULL OR b.value > a.value * 1.1""")
def compare_results(spark, d):
    def side(m, n, f, w):
        k = F.expr("p_partkey div 4")
        return P.table(spark, d, "part").where(w).select(F.concat(F.lit("b"), k).alias("name"), F.concat(F.lit("p"), F.floor(k % m / n)).alias("platform"), F.concat(F.lit("m"), F.col("p_partkey") % 4).alias("metric"), (F.col("p_retailprice") * f).alias("value"))

    return T.compare_results(side(7, 6, F.lit(1.0), "p_partkey div 4 % 9 <> 0"), side(5, 4, 1 + F.col("p_partkey") % 3 * 0.08, "p_partkey div 4 % 11 <> 0 and p_partkey % 13 <> 0"))


@query("filter_fields", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a.b,status' WHEN 1 THEN 'x' ELSE '' END AS fields FROM part")
def filter_fields(spark, d):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, "{ status: 'x', \"a.b\": { $in: [1] }, status : 2 }").when(k == 1, "{ $or: [{ 'x': 1 }, { 'y z': 2 }] }").otherwise("{}")
    return P.table(spark, d, "part").select("p_partkey", F.array_join(T.filter_fields(text), ",").alias("fields"))


@query("redacted_args", "SELECT p_partkey, 'query=h:' || left(sha256(p_name), 8) || '|limit=' || p_size || '|mode=' || p_type || '|x.y[0]=h:' || left(sha256(p_brand), 8) || '|x.y[1]=true' AS summary FROM part")
def redacted_args(spark, d):
    p = P.table(spark, d, "part")
    args = F.concat(F.lit('{"query":"'), "p_name", F.lit('","limit":'), "p_size", F.lit(',"mode":"'), "p_type", F.lit('","x":{"y":["'), "p_brand", F.lit('",true]}}'))
    return T.redact_args(p.select("p_partkey", args.alias("args"))).select("p_partkey", "summary")


@query("path_rules", "SELECT p_partkey, 'src/' || p_type || '/' || p_partkey AS path, 'd' || chr(65533) || p_partkey AS display, CASE WHEN p_partkey % 2 = 0 THEN 'GET /a' || p_partkey WHEN p_partkey % 3 = 0 THEN 'POST /b' || p_partkey END AS route_key, CASE WHEN p_size >= 45 THEN 'strong' WHEN p_size >= 35 THEN 'medium' ELSE 'weak' END AS band, p_size % 2 = 0 AS env, left(sha256('topic' || chr(0) || p_name), 32) AS ref_id FROM part")
def path_rules(spark, d):
    k = F.col("p_partkey")
    ext = F.when(k % 2 == 0, F.concat(F.lit("__api_call__fetch__a"), k)).when(k % 3 == 0, F.concat(F.lit("__route__post__/b"), k)).otherwise(F.lit("__topic__x"))
    raw = F.concat(F.lit("d").cast("binary"), F.unhex(F.lit("FF")), k.cast("string").cast("binary"))
    return P.table(spark, d, "part").select(
        "p_partkey", X.path_separators(F.concat(F.lit("src\\"), "p_type", F.lit("\\"), k)).alias("path"), X.path_display(raw).alias("display"), X.route_key_of(ext).alias("route_key"), X.confidence_band(F.col("p_size") * 20).alias("band"),
        X.env_name(F.when(F.col("p_size") % 2 == 0, "A_b9").otherwise("9a")).alias("env"), X.ref_node_id(F.lit("topic"), F.col("p_name")).alias("ref_id"))


@query("resolver_weights", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in RESOLVERS.items()) + ") t(resolver, weight)")
def resolver_weights(spark, d):
    from ..schema import resolvers

    return resolvers(spark)


_ROUTES = """e AS (SELECT DISTINCT o_custkey % 40 AS h, l_partkey % 200 AS r, l_linenumber % 3 AS k, l_suppkey % 2 AS form FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("route_trace", f"WITH {_ROUTES} SELECT DISTINCT 'GET /r' || r AS route_key, CASE WHEN k = 0 THEN 'handler' ELSE 'caller' END AS side, 'n' || h AS source, CASE k WHEN 0 THEN 'serves' WHEN 1 THEN 'consumes' ELSE 'consumes_api_from' END AS kind, 'repo' || (h % 5) AS repo, 'name' || h AS name FROM e")
def route_trace(spark, d):
    """Routes and calls of one key are different nodes: the calls' say fetch and have no leading slash."""
    o = P.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("h"))
    e = P.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 200).alias("r"), (F.col("l_linenumber") % 3).alias("k"), (F.col("l_suppkey") % 2).alias("form")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("h", "r", "k", "form").distinct()
    kind = F.when(F.col("k") == 0, "serves").when(F.col("k") == 1, "consumes").otherwise("consumes_api_from")
    ext = F.when(F.col("form") == 0, F.concat(F.lit("__route__get__/r"), "r")).otherwise(F.concat(F.lit("__api_call__fetch__r"), "r"))
    node = lambda df, i, kind, repo, name, x: df.select(i.alias("id"), F.lit(kind).alias("kind"), repo.alias("repo"), name.alias("name"), name.alias("qualified_name"), x.alias("external_id")).distinct()
    nodes = node(e, ext, "route", F.lit("__virtual__"), ext, ext).unionByName(node(e, F.concat(F.lit("n"), "h"), "function", F.concat(F.lit("repo"), F.col("h") % 5), F.concat(F.lit("name"), "h"), F.lit(None).cast("string")))
    return events.route_trace(nodes, e.select(F.concat(F.lit("n"), "h").alias("source"), ext.alias("target"), kind.alias("kind")))


@query("orphan_page", sql.TOPICS + """, p AS (SELECT *, row_number() OVER (ORDER BY target) AS k, count(*) OVER () AS total FROM orphans), s AS (SELECT severity, count(*) AS n FROM p WHERE k > 30 GROUP BY 1)
  SELECT target, severity, total AS total_seen, (SELECT string_agg(severity || ':' || n, ',' ORDER BY severity || ':' || n) FROM s) AS skipped FROM p WHERE k <= 30""")
def orphan_page(spark, d):
    got = events.orphan_topics(*P.topic_graph(spark, d))
    return T.page_with_skips(got, [F.col("target")], F.col("severity"), 30).select("target", "severity", "total_seen", F.array_join("skipped", ",").alias("skipped"))


@query("annotated_hits", sql.code("""a AS (SELECT source AS id, least(count(*) FILTER (kind = 'calls'), 10) AS f FROM code_edges GROUP BY 1), x AS (SELECT b.file_path, a.repo FROM code_edges JOIN code_nodes a ON source = a.id JOIN code_nodes b ON target = b.id WHERE a.repo <> b.repo),
  u AS (SELECT file_path, string_agg(DISTINCT repo, ',' ORDER BY repo) AS c FROM x GROUP BY 1),
  h AS (SELECT name AS query, n.id, CAST(number % 100 AS DOUBLE) AS score, round(0.4 * coalesce(f, 0) / 10, 6)::DOUBLE AS anchor, u.c IS NOT NULL AS participates, coalesce(u.c, '') AS consumer_repos FROM code_nodes n LEFT JOIN a ON a.id = n.id LEFT JOIN u ON u.file_path = n.file_path),
  b AS (SELECT *, sum(strlen(id || consumer_repos)) OVER (PARTITION BY query ORDER BY anchor DESC, score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM h)""",
  "SELECT query, id, score, anchor, participates, consumer_repos, CAST(row_number() OVER (PARTITION BY query ORDER BY anchor DESC, score DESC, id) AS INTEGER) AS rank FROM b WHERE used <= 120"))
def annotated_hits(spark, d):
    n, e = _code(spark, d)
    r = n.select("id", "repo", "file_path")
    used = e.join(r.select(F.col("id").alias("source"), F.col("repo").alias("consumer_repo")), "source").join(r.select(F.col("id").alias("target"), "repo", "file_path"), "target").where("repo <> consumer_repo").select("file_path", "consumer_repo")
    hits = n.select(F.col("name").alias("query"), "id", (F.col("number") % 100).cast("double").alias("score"))
    return T.annotate_hits(hits, n, e, used, 120)


@query("versioned_docs", "SELECT doc_id, source AS repo, CASE WHEN source = 'src1' THEN upper(lang) ELSE lang END AS lang FROM documents WHERE source <> 'src2'")
def versioned_docs(spark, d):
    """A search table through its life: replaced by files, deleted by repository, one change rolled back."""
    docs = P.table(spark, d, "documents").select("doc_id", F.col("source").alias("repo"), "lang")
    t = sinks.VersionedTable(spark, new_path(spark, "docs"))
    t.stage(docs)
    t.commit()
    t.stage(t.read().where("false"))
    t.rollback()
    t.stage(sinks.replaced(t.read(), docs.where("repo = 'src1'").withColumn("lang", F.upper("lang")), ["doc_id"]))
    t.commit()
    t.stage(sinks.without_repos(t.read(), ["src2"]))
    t.commit()
    return t.read()


@query("workspace_packages", """
  SELECT n_name AS repo, 'packages/p' || s_suppkey AS dir, '@' || lower(n_name) || '/p' || s_suppkey AS package, CASE WHEN s_suppkey % 2 = 0 THEN 'lib/main.js' ELSE 'index.js' END AS entry FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def workspace_packages(spark, d):
    n, s = P.table(spark, d, "nation"), P.table(spark, d, "supplier")
    root = n.select(F.col("n_name").alias("repo"), F.lit("package.json").alias("file_path"), F.when(F.col("n_nationkey") % 2 == 0, '{"workspaces": ["packages/*"]}').otherwise('{"workspaces": {"packages": ["packages/*"]}}').alias("content"))
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("@"), F.lower("n_name"), F.lit("/p"), "s_suppkey")
    main = F.when(F.col("s_suppkey") % 2 == 0, F.lit(',"main":"lib/main.js"')).otherwise("")
    member = lambda folder: j.select(F.col("n_name").alias("repo"), F.concat(F.lit(folder), F.lit("/p"), "s_suppkey", F.lit("/package.json")).alias("file_path"), F.concat(F.lit('{"name":"'), name, F.lit('"'), main, F.lit("}")).alias("content"))
    return scans.workspace_packages(root.unionByName(member("packages")).unionByName(member("tools")).unionByName(member("packages/deep")))


@query("stream_backoff", """
  WITH e AS (SELECT user_id % 6 AS repo, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type = 'error' OR event_id % 4 <> 0 AS failed FROM events), w AS (SELECT *, count(*) FILTER (failed) OVER b AS n, max(t) OVER b AS latest FROM e WINDOW b AS (PARTITION BY repo ORDER BY t, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
  SELECT id, coalesce(n = 3 AND t - latest < 600, false) AS suppressed FROM w""")
def stream_backoff(spark, d):
    from ..streaming.upkeep import suppressed

    e = P.table(spark, d, "events").select((F.col("user_id") % 6).alias("repo"), F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("at"), ((F.col("event_type") == "error") | (F.col("event_id") % 4 != 0)).alias("failed"))
    return suppressed(e, 3, 600).select("id", "suppressed")


@query("change_notices", """
  WITH s AS (SELECT source AS repo, doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT source AS repo, doc_id, md5(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0),
  d AS (SELECT coalesce(s.repo, n.repo) AS repo, count(*) FILTER (n.repo IS NOT NULL) AS changed, count(*) FILTER (n.repo IS NULL) AS deleted FROM s FULL JOIN n ON s.repo = n.repo AND s.doc_id = n.doc_id WHERE s.h IS DISTINCT FROM n.h GROUP BY 1)
  SELECT 'all' AS subscriber, repo, changed, deleted FROM d UNION ALL SELECT 'one', repo, changed, deleted FROM d WHERE repo = 'src1'""")
def change_notices(spark, d):
    from ..streaming.upkeep import notices

    t = P.table(spark, d, "documents").select("doc_id", F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("file_path"), "text")
    before = t.where("doc_id % 7 <> 0").select("repo", "file_path", F.md5("text").alias("content_hash"))
    after = t.where("doc_id % 13 <> 0").select("repo", "file_path", F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("content_hash"))
    return notices(before, after, spark.createDataFrame([("all", None), ("one", "src1"), ("all", "src1")], "subscriber string, repo string"))


@query("mirror_risks", """
  WITH l AS (SELECT p_type || (p_partkey % 5) AS grp, 'v' || (p_partkey % 23) AS value, 's' || (p_size % 8) AS surface FROM part), a AS (SELECT DISTINCT grp, value FROM l), m AS (SELECT DISTINCT grp, surface FROM l)
  SELECT grp, surface, value FROM m JOIN a USING (grp) WHERE value = 'v3' AND NOT EXISTS (SELECT 1 FROM l WHERE l.grp = m.grp AND l.surface = m.surface AND l.value = a.value) AND EXISTS (SELECT 1 FROM l WHERE l.grp = m.grp AND l.surface = m.surface AND l.value <> 'v3')""")
def mirror_risks(spark, d):
    """Value v3 is the one that each group's authority gained."""
    p = P.table(spark, d, "part").select(F.concat("p_type", F.col("p_partkey") % 5).alias("grp"), F.concat(F.lit("v"), F.col("p_partkey") % 23).alias("value"), F.concat(F.lit("s"), F.col("p_size") % 8).alias("surface"))
    return diffs.mirror_risks(p.where("value = 'v3'").select("grp", "value").distinct(), p)


@query("search_documents", """
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS symbol_name, 'x.ts' AS file_name, 'src ' || lower(p_type) || ' x' AS path_tokens, p_brand || '::' || p_name AS qualified_name, CASE WHEN p_partkey % 5 = 0 THEN 'class' ELSE 'function' END AS kind, 'typescript' AS lang, p_partkey % 3 = 0 AS is_exported, p_partkey AS last_modified, p_name || ' ' || p_brand || '::' || p_name AS content FROM part WHERE p_partkey % 4 <> 1""")
def search_documents(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 1, "import").when(k % 5 == 0, "class").otherwise("function")
    n = P.table(spark, d, "part").select(k.cast("string").alias("id"), kind.alias("kind"), F.concat(F.lit("src/"), "p_type", F.lit("/x.ts")).alias("file_path"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("::"), "p_name").alias("qualified_name"), F.lit(None).cast("string").alias("signature"), (k % 3 == 0).alias("is_exported"), k.alias("last_modified"))
    from ..operators.search import documents_of

    return documents_of(n)


@query("file_ownership", sql.history("w AS (SELECT file_path, author_email, CAST(sum(insertions + deletions + 1) AS BIGINT) AS weight FROM commits JOIN deltas USING (sha) WHERE file_path = 'part/20' GROUP BY 1, 2)", "SELECT file_path, author_email, weight, CAST(row_number() OVER (ORDER BY weight DESC, author_email) AS INTEGER) AS rank FROM w"))
def file_ownership(spark, d):
    """The owners of one file: the filter reaches the scan."""
    from ..operators.history import ownership

    return ownership(P.commits(spark, d), P.deltas(spark, d).where("file_path = 'part/20'")).select("file_path", "author_email", "weight", "rank")


@query("selected_changes", "SELECT DISTINCT 'r' || (l_suppkey % 5) AS repo, 'f' || l_partkey AS file_path, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'deleted' WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'added' ELSE 'modified' END AS status FROM lineitem GROUP BY 1, 2")
def selected_changes(spark, d):
    """What a range of commits did to each file, as the last word of its deltas."""
    rows = P.table(spark, d, "lineitem").select(F.concat(F.lit("r"), F.col("l_suppkey") % 5).alias("repo"), F.concat(F.lit("f"), "l_partkey").alias("file_path"), F.when(F.col("l_returnflag") == "R", "deleted").when(F.col("l_returnflag") == "A", "added").otherwise("modified").alias("change_kind"))
    return review.range_changes(rows)
