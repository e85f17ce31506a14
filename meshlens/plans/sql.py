"""The projections of ``sources.projection`` as SQL, for the oracles."""

NODES = """
real_functions AS (
  SELECT 's:' || s_suppkey AS id, n_name AS repo, 'f:' || n_name AS file_path, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 'c:' || c_custkey, n_name, 'f:' || n_name || '/' || c_mktsegment, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
nodes AS (
  SELECT id, 'function' AS kind, repo, file_path, name, repo || '::' || name AS qualified_name, CAST(NULL AS VARCHAR) AS external_id, false AS is_virtual FROM real_functions
  UNION ALL
  SELECT DISTINCT file_path, 'file', repo, file_path, file_path, repo || '::' || file_path, CAST(NULL AS VARCHAR), false FROM real_functions
  UNION ALL
  SELECT 'p:' || p_partkey, 'topic', '__virtual__', x, x, x, x, true FROM (SELECT *, '__topic__kafka__' || p_type || '.' || p_partkey AS x FROM part))
"""
EDGES = """
edges AS (
  SELECT 's:' || l_suppkey AS source, 'p:' || l_partkey AS target, 'publishes' AS kind, 1 AS weight, 1000 - min(CAST(round(l_discount * 1000) AS INTEGER)) AS confidence, 's:' || l_suppkey AS owner_file FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL
  SELECT 'c:' || o_custkey, 'p:' || l_partkey, 'consumes', CAST(count(*) AS INTEGER), CASE WHEN count(*) > 1 THEN CAST(least(1000, 600 + 100 * count(*)) AS INTEGER) END, 'c:' || o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
  UNION ALL
  SELECT file_path, id, 'defines', 1, NULL, file_path FROM nodes WHERE kind = 'function')
"""
COMMITS = """
commits AS (
  SELECT n_name AS repo, CAST(o_orderkey AS VARCHAR) AS sha, c_name AS author_email, CAST(epoch(o_orderdate) AS BIGINT) AS date, o_orderpriority AS message FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
deltas AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS sha, 'part/' || l_partkey AS file_path, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS change_kind, CAST(l_quantity AS INTEGER) AS insertions, l_linenumber AS deletions FROM lineitem)
"""
CONTRACTS = """
contract_rows AS (
  SELECT *, 'ev:' || event_type || '.' || (user_id // 2 % 25) AS target_id, '__event__' || event_type || '.' || (user_id // 2 % 25) AS target_qn, 'repo' || (user_id % 4) AS repo, 'file' || (user_id % 50) AS file_path, CASE WHEN user_id % 2 = 0 THEN 'producer' ELSE 'consumer' END AS side, CAST(600 + event_id % 400 AS INTEGER) AS confidence,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 = 0 THEN 'Number' ELSE 'number' END AS k_type, user_id % 5 = 0 AS k_optional, CAST(700 + event_id % 300 AS INTEGER) AS k_conf,
    CASE WHEN value > 50 THEN 'float' ELSE 'int' END AS v_type, value IS NULL AS v_optional FROM events),
contract_fields AS (
  SELECT event_id, target_id, target_qn, repo, file_path, side, confidence, 'k' AS name, k_type AS type_name, k_optional AS optional, k_conf AS field_conf FROM contract_rows
  UNION ALL
  SELECT event_id, target_id, target_qn, repo, file_path, side, confidence, 'value', v_type, v_optional, 900 FROM contract_rows)
"""


def graph(body: str) -> str:
    return f"WITH {NODES}, {EDGES} {body}"


def graph_with(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {NODES}, {EDGES}, {ctes} {body}"


def history(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {COMMITS}{', ' + ctes if ctes else ''} {body}"


def contract(ctes: str, body: str) -> str:
    return f"WITH {CONTRACTS}{', ' + ctes if ctes else ''} {body}"


CODE = """
sym AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_orderkey % 10 AS r, CAST(l_orderkey AS VARCHAR) || '.' || l_partkey AS id FROM lineitem),
code_nodes AS (
  SELECT id, CASE WHEN p % 5 = 0 THEN 'class' WHEN p % 7 = 0 THEN 'entity' ELSE 'function' END AS kind, 'r' || r AS repo,
    CASE WHEN o % 11 = 0 THEN 'src/tests/f' || o || '.test.ts' WHEN o % 11 = 1 THEN 'pkg/mocks/f' || o || '.ts' WHEN o % 22 = 2 THEN 'srv/bin/f' || o || '.ts' ELSE 'src/lib/f' || o || '.ts' END AS file_path, 'Sym' || p AS name, o + p AS number FROM sym),
links AS (
  SELECT o, p, id AS source, lead(id) OVER (PARTITION BY o ORDER BY p) AS calls, coalesce(lead(id) OVER (PARTITION BY p, r ORDER BY o), first_value(id) OVER (PARTITION BY p, r ORDER BY o)) AS imports, CASE WHEN p % 5 = 0 THEN lead(id) OVER (PARTITION BY p ORDER BY o) END AS refs FROM sym),
code_edges AS MATERIALIZED (
  SELECT source, target, kind, CASE WHEN (o + p) % 4 <> 0 THEN CAST(500 + (o + p) % 500 AS INTEGER) END AS confidence
  FROM (SELECT o, p, source, calls AS target, 'calls' AS kind FROM links UNION ALL SELECT o, p, source, imports, 'imports' FROM links UNION ALL SELECT o, p, source, refs, 'references' FROM links) WHERE target IS NOT NULL AND source <> target)
"""
#: Query sets of searches: every twentieth symbol.
SEEDS = "SELECT id AS node FROM code_nodes WHERE number % 20 = 0"


def code(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {CODE}{', ' + ctes if ctes else ''} {body}"


#: Topics by part and group of suppliers, which most often have one side only, and what is wrong with them.
TOPICS = """WITH topic_edges AS (
  SELECT 's:' || l_suppkey AS source, 't:' || l_partkey || '.' || (l_suppkey % 10) AS target, 'publishes' AS kind FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2
  UNION ALL SELECT 'c:' || o_custkey, 't:' || l_partkey || '.' || (l_suppkey % 10), 'consumes' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 1 GROUP BY 1, 2),
orphans AS (
  SELECT target, target AS name, 'topic' AS kind, count(*) FILTER (kind = 'publishes') AS publishers, count(*) FILTER (kind = 'consumes') AS consumers, CASE WHEN count(*) FILTER (kind = 'consumes') > 0 THEN 'high' ELSE 'medium' END AS severity
  FROM topic_edges GROUP BY target HAVING (count(*) FILTER (kind = 'publishes') > 0) <> (count(*) FILTER (kind = 'consumes') > 0))"""
