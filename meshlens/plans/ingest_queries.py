"""Queries of sources, sinks and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import counts
from ..operators.kernels import new_path
from ..sources import projection as P
from ..sources import frameworks, scans, sinks
from ..streaming import upkeep as U
from . import sql
from .registry import query


_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@query("stream_debounce", """
  WITH e AS (SELECT event_type AS repo, ts, user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) >= INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT repo, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) + 1200 AS end, count(*) AS events, count(DISTINCT user_id) > 3 AS rescan FROM s GROUP BY repo, k""")
def stream_debounce(spark, d):
    """The whole event stream through one availableNow run. Bursts that it still holds at the end are told by the batch form, over the rows that no closed one has."""
    out = new_path(spark, "stream")
    changes = U.read_changes(spark, P.path(d, "events"), _EVENTS).select(F.col("event_type").alias("repo"), F.col("user_id").cast("string").alias("path"), "ts")
    bursts = U.debounce(changes, "20 minutes", max_hints=3)
    U.run_available(bursts, f"{out}/checkpoint", U.table_append(f"{out}/result"))
    names = ["repo", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "events", "rescan"]
    closed = spark.read.schema(bursts.schema).parquet(f"{out}/result/*")
    held = U.not_closed(P.table(spark, d, "events").select(F.col("event_type").alias("repo"), F.col("user_id").cast("string").alias("path"), "ts"), closed)
    return closed.unionByName(U.debounce(held, "20 minutes", max_hints=3)).select(*names)


@query("stream_latest_state", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream_latest_state(spark, d):
    out = new_path(spark, "stream")
    stream = U.read_changes(spark, P.path(d, "events"), _EVENTS).select("user_id", "event_type", "event_id")
    U.run_available(stream, f"{out}/checkpoint", U.table_upsert(f"{out}/state", ["user_id", "event_type"], "event_id"))
    return U.latest_state(spark, f"{out}/state", stream.schema)


@query("merge_pending", "SELECT event_type AS repo, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS paths, bool_or(value > 99) AS rescan FROM events WHERE value IS NOT NULL GROUP BY 1")
def merge_pending(spark, d):
    p = P.table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("repo"), F.col("user_id").cast("string").alias("path"), (F.col("value") > 99).alias("rescan"))
    return U.merge_pending(p).withColumn("paths", F.array_join("paths", ","))


_SNAP = """s AS (SELECT source AS repo, 'd' || doc_id AS p, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT source AS repo, 'd' || doc_id AS p, md5(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0),
  d AS (SELECT coalesce(s.repo, n.repo) AS repo, coalesce(s.p, n.p) AS p, n.p IS NULL AS gone FROM s FULL JOIN n ON s.repo = n.repo AND s.p = n.p WHERE s.h IS DISTINCT FROM n.h),
  dep AS (SELECT a.source AS sr, 'd' || a.doc_id AS sp, b.source AS tr, 'd' || b.doc_id AS tp FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""


@query("incremental_plan", f"WITH {_SNAP} SELECT repo, p AS file_path FROM (SELECT repo, p FROM d UNION SELECT sr, sp FROM dep JOIN d ON tr = d.repo AND tp = d.p) WHERE (repo, p) NOT IN (SELECT repo, p FROM d WHERE gone)")
def incremental_plan(spark, d):
    t = P.table(spark, d, "documents").select("doc_id", F.col("source").alias("repo"), F.concat(F.lit("d"), "doc_id").alias("file_path"), "text")
    stored = t.where("doc_id % 7 <> 0").select("repo", "file_path", F.md5("text").alias("content_hash"))
    new = t.where("doc_id % 13 <> 0").select("repo", "file_path", F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("content_hash"))
    k = t.select("doc_id", "repo", "file_path")
    deps = k.select((F.col("doc_id") + 1).alias("doc_id"), F.col("repo").alias("source_repo"), F.col("file_path").alias("source_path")).join(k.select("doc_id", F.col("repo").alias("target_repo"), F.col("file_path").alias("target_path")), "doc_id")
    return U.incremental_plan(stored, new, deps)


@query("drop_dangling", sql.code("k AS (SELECT id FROM code_nodes WHERE number % 7 <> 0)", "SELECT source, target, kind FROM code_edges WHERE source IN (FROM k) AND target IN (FROM k)"))
def drop_dangling(spark, d):
    return U.drop_dangling(P.code_nodes(spark, d).where("number % 7 <> 0"), P.code_edges(spark, d)).select("source", "target", "kind")


@query("virtual_dependents", sql.graph_with("c AS (SELECT external_id, id FROM nodes WHERE is_virtual AND CAST(substr(id, 3) AS BIGINT) % 20 = 0)", "SELECT DISTINCT c.external_id, n.repo, owner_file FROM edges JOIN c ON target = c.id JOIN nodes n ON source = n.id WHERE n.repo <> 'NATION_1'"))
def virtual_dependents(spark, d):
    nodes = P.nodes(spark, d)
    changed = nodes.where(F.col("is_virtual") & (F.substring_index("id", ":", -1).cast("long") % 20 == 0)).select("external_id", F.lit("NATION_1").alias("repo"))
    return U.virtual_dependents(nodes, P.edges(spark, d), changed)


@query("review_overlay", "SELECT c_custkey, c_nationkey, c_name FROM customer WHERE c_nationkey % 6 <> 0 UNION ALL SELECT c_custkey, c_nationkey, c_name || '!' FROM customer WHERE c_nationkey % 6 = 0 AND c_custkey % 2 = 0")
def review_overlay(spark, d):
    base = P.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    changed = base.where("c_nationkey % 6 = 0")
    return U.overlay(base, changed.where("c_custkey % 2 = 0").withColumn("c_name", F.concat("c_name", F.lit("!"))), changed.select("c_nationkey"), ["c_nationkey"])


@query("graph_round_trip", sql.graph("SELECT kind, count(*) AS n FROM edges GROUP BY 1"))
def graph_round_trip(spark, d):
    path = new_path(spark, "graph")
    sinks.write_graph(P.nodes(spark, d), P.edges(spark, d), path)
    return counts.edges_by_kind(sinks.read_graph(spark, path)[1])


@query("delta_report", """SELECT c_mktsegment AS section, '{"section":"' || c_mktsegment || '","key":"' || c_name || '","change":"a|b<c"}' AS json, '| ' || c_mktsegment || ' | ' || c_name || ' | a\\|b&lt;c |' AS markdown FROM customer""")
def delta_report(spark, d):
    return sinks.delta_report(P.table(spark, d, "customer").select(F.col("c_mktsegment").alias("section"), F.col("c_name").alias("key"), F.lit("a|b<c").alias("change")))


@query("codeowners", sql.history("""w AS (SELECT file_path, author_email, sum(insertions + deletions + 1) AS weight FROM commits JOIN deltas USING (sha) GROUP BY 1, 2),
  o AS (SELECT *, weight / sum(weight) OVER (PARTITION BY file_path) AS pct, row_number() OVER (PARTITION BY file_path ORDER BY weight DESC, author_email) AS r FROM w)""", "SELECT '/' || file_path || ' ' || author_email AS line FROM o WHERE r = 1 AND pct >= 0.1"))
def codeowners(spark, d):
    from ..operators.history import ownership

    return sinks.codeowners(ownership(P.commits(spark, d), P.deltas(spark, d)), 0.1)


@query("footprint", "SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] AS folder, count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes, round(sum(strlen(html)) / (SELECT sum(strlen(html)) FROM pages), 6) AS share FROM pages GROUP BY 1")
def footprint(spark, d):
    return sinks.footprint(P.table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length("html").cast("long").alias("size")))


@query("language_classes", "SELECT lang, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'java' END AS lang FROM part) GROUP BY 1")
def language_classes(spark, d):
    k = F.col("p_partkey") % 5
    ext = F.when(k == 0, ".TSX").when(k == 1, ".pyi").when(k == 2, ".go").when(k == 3, ".java").otherwise(".txt")
    return P.table(spark, d, "part").select(X.language(F.concat(F.lit("a.b/"), "p_name", ext)).alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("manifest_scan", """SELECT 'r' || (p_size % 10) AS repo, 'package.json' AS file_path, p_name AS package, 'dependencies' AS scope, lower(p_type) AS dependency, '^' || p_size AS version FROM part UNION ALL SELECT 'r' || (p_size % 10), 'package.json', p_name, 'devDependencies', 'dev-' || p_partkey, '1.0' FROM part""")
def manifest_scan(spark, d):
    content = F.to_json(F.struct(F.col("p_name").alias("name"), F.create_map(F.lower("p_type"), F.concat(F.lit("^"), "p_size")).alias("dependencies"), F.create_map(F.concat(F.lit("dev-"), "p_partkey"), F.lit("1.0")).alias("devDependencies")))
    return scans.manifests(P.table(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_size") % 10).alias("repo"), F.lit("package.json").alias("file_path"), content.alias("content")))


@query("deployment_scan", """
  SELECT 'r' AS repo, s_name || '/Dockerfile' AS file_path, 'dockerfile' AS artifact, 'base_image' AS fact, 'node:' || s_nationkey AS name FROM supplier UNION ALL SELECT 'r', s_name || '/Dockerfile', 'dockerfile', 'port', CAST(8000 + s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT 'r', s_name || '/Dockerfile', 'dockerfile', 'env_var', 'APP_KEY' FROM supplier
  UNION ALL SELECT 'r', s_name || '/.env', 'env_file', 'env_var', 'NATION_' || s_nationkey || '_URL' FROM supplier""")
def deployment_scan(spark, d):
    s = P.table(spark, d, "supplier")
    docker = s.select(F.lit("r").alias("repo"), F.concat("s_name", F.lit("/Dockerfile")).alias("file_path"), F.concat(F.lit("FROM node:"), "s_nationkey", F.lit(" AS b\nENV APP_KEY=x\nexpose "), F.col("s_nationkey") + 8000, F.lit("\n")).alias("content"))
    env = s.select(F.lit("r").alias("repo"), F.concat("s_name", F.lit("/.env")).alias("file_path"), F.concat(F.lit("# c\nexport NATION_"), "s_nationkey", F.lit("_URL=http://x\n9bad=1\n")).alias("content"))
    return scans.deployment_facts(docker.unionByName(env))


_PLAIN = "regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
_A, _B = _PLAIN.format(x="a"), _PLAIN.format(x="b")
#: The score of two names a and b as scans.fuzzy_score has it.
FUZZY = f"""(0.6 * (SELECT count(*) FROM range(1, least(length({_A}), length({_B})) + 1) t(i) WHERE left({_A}, i) = left({_B}, i)) / greatest(length({_A}), length({_B}))
  + 0.4 * (SELECT sum(least(len(string_split({_A}, c)) - 1, len(string_split({_B}, c)) - 1)) FROM (SELECT DISTINCT unnest(string_split({_A}, '')) AS c)) / greatest(length({_A}), length({_B})))::DOUBLE"""


@query("call_resolution", f"""
  WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'm' || (p_partkey % 30) AS module, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_partkey::VARCHAR END || p_name AS name FROM part),
  l AS (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey, l_linenumber FROM lineitem), c AS (SELECT l_orderkey || '-' || l_suppkey || '-' || l_partkey || '-' || l_linenumber AS call, 'm' || (l_suppkey % 30) AS module, CASE l_linenumber WHEN 1 THEN 'x.' || name WHEN 2 THEN name || 'zq' WHEN 3 THEN 'qqq' ELSE name END AS name FROM l JOIN s ON id = CAST(l_partkey AS VARCHAR)),
  i AS (SELECT DISTINCT 'm' || (p_partkey % 7) AS module, name, module AS target FROM s JOIN part ON id = CAST(p_partkey AS VARCHAR) WHERE p_partkey % 4 = 0), n AS (SELECT name, count(*) AS n, min(id) AS f FROM s GROUP BY 1),
  q AS (SELECT DISTINCT name AS a FROM c WHERE name NOT IN (SELECT name FROM n)), z AS (SELECT a, b, f, n, {FUZZY} AS score FROM q, (SELECT name AS b, f, n FROM n) WHERE left({_A}, 1) = left({_B}, 1)),
  y AS (SELECT a, count(*) AS n, arg_max(f, (score, b)) AS f, max(score) AS s FROM z WHERE score >= 0.72 GROUP BY 1),
  o AS (SELECT call, 0 AS t, s.id, 'import_map' AS strategy, 950 AS confidence FROM c JOIN i USING (module, name) JOIN s ON s.module = i.target AND s.name = c.name UNION ALL SELECT call, 1, s.id, 'same_module', 900 FROM c JOIN s USING (module, name)
    UNION ALL SELECT call, CASE WHEN n = 1 THEN 2 ELSE 5 END, f, CASE WHEN n = 1 THEN 'unique' ELSE 'fallback' END, CASE WHEN n = 1 THEN 750 ELSE (6000 + 9 + n) // (2 * (9 + n)) END FROM c JOIN n USING (name)
    UNION ALL SELECT call, 3, f, 'suffix', (11000 + 9 + n) // (2 * (9 + n)) FROM c JOIN n ON n.name = list_last(string_split(c.name, '.')) WHERE contains(c.name, '.') UNION ALL SELECT call, 4, f, 'fuzzy_name', CAST(round(400 * s / (1 + 0.1::DOUBLE * (n - 1))) AS INTEGER) FROM c JOIN y ON a = name)
  SELECT call, id, strategy, CAST(confidence AS INTEGER) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY call ORDER BY t, id) AS k FROM o) WHERE k = 1""")
def call_resolution(spark, d):
    """All six tiers: calls as written, dotted, misspelt and of nothing known, through imports."""
    p = P.table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_partkey").cast("string")), "p_name").alias("name"))
    symbols = p.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("m"), F.col("p_partkey") % 30).alias("module"), "name")
    line = P.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber").repartition("l_partkey").distinct()  # for the join with parts too
    n = F.col("l_linenumber")
    name = F.when(n == 1, F.concat(F.lit("x."), "name")).when(n == 2, F.concat("name", F.lit("zq"))).when(n == 3, "qqq").otherwise(F.col("name"))
    calls = line.join(p.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(F.concat_ws("-", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber").alias("call"), F.concat(F.lit("m"), F.col("l_suppkey") % 30).alias("module"), name.alias("name"))
    imports = p.where("p_partkey % 4 = 0").select(F.concat(F.lit("m"), F.col("p_partkey") % 7).alias("module"), "name", F.concat(F.lit("m"), F.col("p_partkey") % 30).alias("target_module")).distinct()
    return scans.resolve_calls(calls, symbols, imports, fuzzy=True)


@query("index_drift", "SELECT DISTINCT 'c' || (p_size % 10) AS collection, p_name AS name, 'missing' AS drift FROM part WHERE p_size % 4 = 0 UNION SELECT 'c' || (p_size % 10), p_name || '2', 'undeclared' FROM part")
def index_drift(spark, d):
    from ..operators.review import index_drift as drift

    p = P.table(spark, d, "part").select(F.concat(F.lit("c"), F.col("p_size") % 10).alias("collection"), F.col("p_name").alias("name"), "p_size").distinct()
    some = p.groupBy("collection", "name").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    declared = p.where("p_size % 4 = 0").select("collection", "name", F.lit("d").alias("definition")).distinct()
    return drift(declared, some.select("collection", F.concat("name", F.lit("2")).alias("name"), F.lit("d").alias("definition")))


@query("git_log_scan", "SELECT CAST(o_orderkey AS VARCHAR) AS sha, 'src/' || o_custkey || '.py' AS file_path, CAST(o_custkey AS INTEGER) AS insertions, CAST(NULL AS INTEGER) AS deletions, 'old/' || o_custkey || '.py' AS old_path FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'b.txt', 3, 4, NULL FROM orders")
def git_log_scan(spark, d):
    o = P.table(spark, d, "orders")
    record = F.concat(F.lit("commit x\n\n"), "o_custkey", F.lit("\t-\told/"), "o_custkey", F.lit(".py => src/"), "o_custkey", F.lit(".py\n3\t4\tb.txt"))
    return scans.git_log(o.select(F.col("o_orderkey").cast("string").alias("sha"), record.alias("record")))


def _source_files(spark, d):
    """A source file for every part, in four languages by its key."""
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    c = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    text = {
        "ts": c("// ", F.col("p_name"), " class No {}\n@Injectable({ a: no() })\nexport class P", k, " extends Base", z, " implements I", z, " {\n  run(a: string) { this.go('x()'); return help", z, "(a); }\n}\nexport const f", k, " = (a) => load", z, "(a);\n"),
        "go": c('package m\nimport "fmt"\ntype P', k, " struct {\n  Base", z, "\n}\nfunc (p *P", k, ") Run() { fmt.Println(`", F.col("p_name"), " no()`); help", z, "(p) }\n"),
        "java": c("import a.b.C", z, ";\n@Entity\npublic class P", k, " extends Base", z, " implements I", z, " {\n  public void run(int a) { new C", z, "(a); /* no() */ }\n}\n"),
        "rs": c("use a::{b, c::d};\npub struct P", k, " { n: u8 }\nimpl I", z, " for P", k, " { fn run(&self) { help", z, '::<u8>(self); say!("no()"); } }\n'),
    }
    at = F.col("p_partkey") % 4
    pick = lambda xs: F.coalesce(*(F.when(at == i, x) for i, x in enumerate(xs)))
    files = P.table(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_size") % 10).alias("repo"), F.concat(F.lit("src/p"), k, F.lit("."), pick([F.lit(x) for x in text])).alias("file_path"), pick(list(text.values())).alias("content"))
    return files.withColumn("lang", X.language(F.col("file_path")))


_SOURCES = """WITH p AS (SELECT 'r' || (p_size % 10) AS repo, p_partkey % 4 AS l, 'src/p' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.go' WHEN 2 THEN '.java' ELSE '.rs' END AS file_path, 'src/p' || p_partkey AS m, 'P' || p_partkey AS c, 'src/p' || p_partkey || '.P' || p_partkey AS q, 'src/p' || p_partkey || '.f' || p_partkey AS f, CASE p_partkey % 4 WHEN 1 THEN 'Run' ELSE 'run' END AS g, 'f' || p_partkey AS fn, CAST(p_size AS VARCHAR) AS z FROM part)"""


@query("parsed_symbols", _SOURCES + """
  SELECT repo, file_path, 'class' AS kind, c AS name, q AS qualified_name, CASE l WHEN 3 THEN 2 ELSE 3 END AS line FROM p
  UNION ALL SELECT repo, file_path, 'function', g, q || '.' || g, CASE l WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 4 ELSE 3 END FROM p
  UNION ALL SELECT repo, file_path, 'function', fn, f, 6 FROM p WHERE l = 0""")
def parsed_symbols(spark, d):
    return scans.parse_nodes(_source_files(spark, d))


@query("parsed_edges", _SOURCES + """, e AS (
  SELECT l, repo, file_path, m AS source, q AS target, 'defines' AS kind, CASE l WHEN 3 THEN 2 ELSE 3 END AS line FROM p
  UNION ALL SELECT l, repo, file_path, q, q || '.' || g, 'defines', CASE l WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 4 ELSE 3 END FROM p
  UNION ALL SELECT l, repo, file_path, m, f, 'defines', 6 FROM p WHERE l = 0 UNION ALL SELECT l, repo, file_path, m, f, 'exports', 6 FROM p WHERE l = 0 UNION ALL SELECT l, repo, file_path, m, q, 'exports', 3 FROM p WHERE l = 0
  UNION ALL SELECT l, repo, file_path, q, CASE l WHEN 0 THEN 'Injectable' ELSE 'Entity' END, 'uses_decorator', 2 FROM p WHERE l IN (0, 2)
  UNION ALL SELECT l, repo, file_path, q, 'Base' || z, 'extends', CASE l WHEN 1 THEN 4 ELSE 3 END FROM p WHERE l < 3
  UNION ALL SELECT l, repo, file_path, q, 'I' || z, 'implements', 3 FROM p WHERE l <> 1
  UNION ALL SELECT l, repo, file_path, q || '.' || g, CASE l WHEN 2 THEN 'C' ELSE 'help' END || z, 'calls', CASE l WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 4 ELSE 3 END FROM p
  UNION ALL SELECT l, repo, file_path, q || '.' || g, CASE l WHEN 0 THEN 'this.go' ELSE 'fmt.Println' END, 'calls', CASE l WHEN 0 THEN 4 ELSE 6 END FROM p WHERE l < 2
  UNION ALL SELECT l, repo, file_path, f, 'load' || z, 'calls', 6 FROM p WHERE l = 0
  UNION ALL SELECT l, repo, file_path, m, CASE l WHEN 1 THEN 'fmt' WHEN 2 THEN 'a.b.C' || z ELSE 'a::b' END, 'imports', CASE l WHEN 1 THEN 2 ELSE 1 END FROM p WHERE l > 0
  UNION ALL SELECT l, repo, file_path, m, 'a::c::d', 'imports', 1 FROM p WHERE l = 3)
  SELECT repo, file_path, source, target, kind, line FROM e""")
def parsed_edges(spark, d):
    return scans.parse_edges(_source_files(spark, d))


@query("tsconfig_aliases", """
  SELECT 's' || s_suppkey AS alias_repo, '@app/' AS prefix, 'apps/n' || s_nationkey || '/src/' AS replacement FROM supplier
  UNION ALL SELECT 's' || s_suppkey, '//n' || s_nationkey, 'apps/lib/,}.ts' FROM supplier""")
def tsconfig_aliases(spark, d):
    text = F.concat(F.lit('{ // "paths": {}\n  "compilerOptions": { /* a\n */ "baseUrl": "./",\n "paths": { "@app/*": ["n'), "s_nationkey", F.lit('/./src/*", "x"], "//n'), "s_nationkey", F.lit('": ["lib/,}.ts",], }, },\n}\n'))
    return scans.tsconfig_aliases(P.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("repo"), F.lit("apps/tsconfig.base.json").alias("file_path"), text.alias("content")))


@query("framework_facts", """WITH s AS (SELECT 'n' || s_nationkey AS repo, 's' || s_suppkey AS k FROM supplier)
  SELECT repo, k || '/api.py' AS file_path, 'fastapi' AS framework, 'route' AS fact, 'GET /' || k || '/{id}' AS name FROM s UNION ALL SELECT repo, k || '/api.py', 'kafka', 'publishes', 'topic.' || k FROM s
  UNION ALL SELECT repo, k || '/api.py', 'sqlalchemy', 'entity', k || '_rows' FROM s UNION ALL SELECT repo, 'web/app/' || k || '/[id]/route.ts', 'nextjs', 'route', v || ' /' || k || '/:id' FROM s, (VALUES ('GET'), ('DELETE')) t(v)
  UNION ALL SELECT repo, 'web/app/' || k || '/[id]/route.ts', 'mongoose', 'entity', 'M' || k FROM s UNION ALL SELECT repo, k || '.prisma', 'prisma', 'entity', 'P' || k FROM s""")
def framework_facts(spark, d):
    s = P.table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("repo"), F.concat(F.lit("s"), "s_suppkey").alias("k"))
    file = lambda path, *text: s.select("repo", F.format_string(path, "k").alias("file_path"), F.format_string("\n".join(text), *["k"] * "".join(text).count("%s")).alias("content"))
    py = file("%s/api.py", "import fastapi, kafka, sqlalchemy", "# @app.get('/no')", "@app.get('/%s/{id}')", "def f(): producer.send('topic.%s', 1)", "__tablename__ = '%s_rows'")
    ts = file("web/app/%s/[id]/route.ts", "import mongoose from 'mongoose'", "export async function GET() { return mongoose.model('M%s', x) }", "export const DELETE = GET", "function PUT() {}")
    return frameworks.framework_facts(py.unionByName(ts).unionByName(file("%s.prisma", "// model No {", "model P%s {", "}")))
