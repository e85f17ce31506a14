"""Queries of ranked search, packs, budgets and caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import packs as K
from ..operators import search as S
from ..operators.counts import anchor_scores, edge_scores
from ..operators.kernels import within_budget
from ..sources import projection as P
from . import sql
from .registry import query

# identifier boundaries as in scalars.identifier_text, then cut at everything else
_SPLIT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '([\p{{Ll}}])([\p{{Lu}}])', '\1 \2', 'g'), '([\p{{Lu}}])([\p{{Lu}}][\p{{Ll}}])', '\1 \2', 'g'), '([\p{{L}}])([0-9])', '\1 \2', 'g'), '([0-9])([\p{{L}}])', '\1 \2', 'g')"


def _tokens(x: str) -> str:
    return f"list_filter(string_split(lower(regexp_replace({_SPLIT.format(x=x)}, '[^\\p{{L}}0-9]+', ' ', 'g')), ' '), lambda t: t <> '' AND strlen(t) <= 80)"


_DOCS = f"""d AS (SELECT doc_id, source AS repo, lang, doc_id % 3 = 0 AS is_exported, {_tokens("string_split(text, chr(10))[1]")} AS name, {_tokens('text')} AS content FROM documents {{where}}),
  l AS (SELECT doc_id, 'symbol_name' AS field, len(name) AS dl, name AS t FROM d UNION ALL SELECT doc_id, 'content', len(content), content FROM d), m AS (SELECT field, avg(dl) AS mean, count(*) AS n FROM l GROUP BY 1),
  x AS (SELECT doc_id, field, dl, unnest(t) AS term FROM l), p AS (SELECT doc_id, field, term, count(*) AS tf, any_value(dl) AS dl FROM x WHERE {{test}} GROUP BY 1, 2, 3), f AS (SELECT field, term, count(*) AS df FROM p GROUP BY 1, 2),
  b AS (SELECT doc_id, term, CASE field WHEN 'symbol_name' THEN 3.0 ELSE 1.0 END::DOUBLE * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) AS s FROM p JOIN f USING (field, term) JOIN m USING (field)),
  w AS ({{words}}), h AS (SELECT doc_id, count(*) AS matched, sum(s) AS score FROM (SELECT doc_id, word, sum(s) AS s FROM b JOIN w USING (term) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= {{need}})"""


def _search(test: str, words: str, need: int, body: str, where: str = "") -> str:
    docs = _DOCS
    for k, v in (("test", test), ("words", words), ("need", str(need)), ("where", where)):
        docs = docs.replace("{" + k + "}", v)
    return f"WITH {docs} {body}"


_HIT = "SELECT doc_id, '{p}' AS pass, matched, round(score, 5) AS score FROM h"


@query("search_strict", _search("term IN ('the', 'nding')", "SELECT DISTINCT term, term AS word FROM p", 2, _HIT.format(p="strict")))
def search_strict(spark, d):
    return S.search(P.search_docs(spark, d), "theNding").withColumn("score", F.round("score", 5))


_NEAR = "damerau_levenshtein(term, '{w}') <= 1"


@query("search_fuzzy", _search(_NEAR.format(w="disgutsing"), "SELECT DISTINCT term, 'disgutsing' AS word FROM p", 1, _HIT.format(p="fuzzy")))
def search_fuzzy(spark, d):
    return S.search(P.search_docs(spark, d), "disgutsing").withColumn("score", F.round("score", 5))


_DELETE = "(" + " OR ".join(_NEAR.format(w=w) for w in ("delete", "remove", "destroy")) + ")"


@query("search_disjunctive", _search(_NEAR.format(w="worthless") + " OR " + _DELETE + " OR " + _NEAR.format(w="qqqqqzzz"), f"SELECT DISTINCT term, 'worthless' AS word FROM p WHERE {_NEAR.format(w='worthless')} UNION ALL SELECT DISTINCT term, 'delete' FROM p WHERE {_DELETE} UNION ALL SELECT DISTINCT term, 'qqqqqzzz' FROM p WHERE {_NEAR.format(w='qqqqqzzz')}", 1, "SELECT doc_id, matched, round(score, 5) AS score FROM h"))
def search_disjunctive(spark, d):
    docs = P.search_docs(spark, d)
    got = S.search_pass(docs, ["worthless", "delete"], "disjunctive")
    return got.withColumn("score", F.round("score", 5))


@query("search_filtered", _search("term IN ('the', 'and')", "SELECT DISTINCT term, term AS word FROM p", 2, _HIT.format(p="strict") + " ORDER BY h.score DESC, doc_id LIMIT 20", "WHERE source = 'src0' AND lang = 'en'"))
def search_filtered(spark, d):
    return S.search(P.search_docs(spark, d), "the and", (F.col("repo") == "src0") & (F.col("lang") == "en"), 20).withColumn("score", F.round("score", 5))


@query("search_rerank", _search("term IN ('the', 'and')", "SELECT DISTINCT term, term AS word FROM p", 2, """SELECT doc_id, 'strict' AS pass, round(score * CASE WHEN is_exported THEN 1.1::DOUBLE ELSE 1.0 END * (1 + 0.05::DOUBLE * score / (SELECT max(score) FROM h)) * CASE WHEN array_to_string(name, ' ') = 'the and' THEN 1.6::DOUBLE WHEN name[1] = 'the' THEN 1.3::DOUBLE ELSE 1.0 END * (1 + 0.25::DOUBLE * len(list_intersect(name, ['the', 'and'])) / 2.0::DOUBLE), 4) AS score FROM h JOIN d USING (doc_id)"""))
def search_rerank(spark, d):
    docs = P.search_docs(spark, d)
    return S.rerank(S.search(docs, "the and"), docs, "the and").withColumn("score", F.round("score", 4))


@query("identifier_tokens", f"SELECT p_partkey, array_to_string({_tokens('x')}, ' ') AS tokens, {_tokens('x')}[1] AS first FROM (SELECT p_partkey, 'get' || p_brand || 'HTTPServer' || p_size || 'x_' || p_type || 'ÉtéNoël' AS x FROM part)")
def identifier_tokens(spark, d):
    x = F.concat(F.lit("get"), "p_brand", F.lit("HTTPServer"), "p_size", F.lit("x_"), "p_type", F.lit("ÉtéNoël"))
    return P.table(spark, d, "part").select("p_partkey", F.array_join(X.tokens(x), " ").alias("tokens"), X.first_token(x).alias("first"))


_PACK_SCORE = """
  a AS (SELECT id, CAST(least(250, greatest(0, round(100 * round(0.4 * least(coalesce(f, 0), 10) / 10 + CASE WHEN kind = 'topic' THEN 0.3 ELSE 0.0 END + 0.3 * least(coalesce(f, 0), 5) / 5, 6)))) AS BIGINT) AS anchor FROM nodes LEFT JOIN (SELECT source, count(*) FILTER (kind IN ('publishes', 'consumes')) AS f FROM edges GROUP BY 1) ON id = source),
  x AS (SELECT e.*, n.repo AS sr, m.repo AS tr, n.is_virtual AS sv, m.is_virtual AS tv, e.kind <> 'defines' AS br FROM edges e JOIN nodes n ON source = n.id JOIN nodes m ON target = m.id),
  y AS (SELECT target AS id, 1 AS i, 0 AS o, br, sv AS v, CASE WHEN sr <> tr AND sr <> '__virtual__' THEN sr END AS f FROM x UNION ALL SELECT source, 0, 1, br, tv, CASE WHEN sr <> tr AND tr <> '__virtual__' THEN tr END FROM x),
  g AS (SELECT id, 30 * least(sum(i), 6) + 20 * least(sum(o), 6) + 45 * least(count(*) FILTER (br), 6) + 35 * least(count(*) FILTER (v), 4) + 60 * least(count(DISTINCT f), 4) AS es FROM y GROUP BY 1),
  s AS (SELECT nodes.id, repo, kind, CAST(300 + es + anchor + CASE kind WHEN 'topic' THEN 110 WHEN 'function' THEN 40 WHEN 'file' THEN -200 END + CASE WHEN contains(lower(repo), 'nation') THEN 70 ELSE 0 END + CASE WHEN contains(lower(file_path), 'nation') THEN 45 ELSE 0 END + CASE WHEN contains(lower(name), 'nation') THEN 25 ELSE 0 END AS BIGINT) AS score FROM nodes JOIN g USING (id) JOIN a USING (id))"""


def _scored(spark, d):
    nodes, edges = P.nodes(spark, d), P.edges(spark, d)
    n = nodes.join(edge_scores(nodes, edges).withColumnRenamed("score", "es"), "id").join(anchor_scores(nodes, edges).select("id", F.col("score").alias("anchor")), "id")
    return n.select("id", "repo", "kind", K.candidate_score(F.col("es"), F.col("anchor"), F.lit(0.0), ["nation"]).alias("score"))


@query("pack_scores", sql.graph_with(_PACK_SCORE, "SELECT id, score FROM s"))
def pack_scores(spark, d):
    return _scored(spark, d).select("id", "score")


@query("pack_targets", sql.graph_with(_PACK_SCORE + """, r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt, count(*) FILTER (score >= 250) OVER (PARTITION BY repo) AS c FROM s WINDOW w AS (PARTITION BY repo ORDER BY score DESC, id))""",
  "SELECT repo, id, score, score - coalesce(nxt, 0) AS margin, CASE WHEN score >= 500 AND score - coalesce(nxt, 0) >= 125 THEN 'high' WHEN score >= 425 AND score - coalesce(nxt, 0) >= 75 THEN 'medium' ELSE 'low' END AS certainty, greatest(c - 1, 0) AS alternates FROM r WHERE r = 1"))
def pack_targets(spark, d):
    return K.select_target(_scored(spark, d), ["repo"])


@query("pack_budget", "SELECT l_suppkey, l_orderkey, l_linenumber, used FROM (SELECT *, CAST(sum(CAST(l_quantity AS INTEGER)) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM lineitem) WHERE used <= 400")
def pack_budget(spark, d):
    line = P.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return within_budget(line, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], F.col("l_quantity").cast("int"), 400).select("l_suppkey", "l_orderkey", "l_linenumber", "used")


@query("pack_trim", """
  WITH i AS (SELECT n_name AS pack, CASE s_suppkey % 3 WHEN 0 THEN 'impact' WHEN 1 THEN 'items' ELSE 'bridges' END AS section, s_name AS id, CAST(s_suppkey % 50 AS INTEGER) AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  u AS (SELECT *, sum(strlen('{"section":"' || section || '","id":"' || id || '","score":' || score || '}')) OVER (PARTITION BY pack ORDER BY CASE section WHEN 'impact' THEN 0 WHEN 'bridges' THEN 3 ELSE 4 END, score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM i)
  SELECT pack, section, id, score, CAST(used AS BIGINT) AS used FROM u WHERE used <= 150""")
def pack_trim(spark, d):
    n = P.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("pack"))
    section = F.when(F.col("s_suppkey") % 3 == 0, "impact").when(F.col("s_suppkey") % 3 == 1, "items").otherwise("bridges")
    i = P.table(spark, d, "supplier").join(n, "s_nationkey").select("pack", section.alias("section"), F.col("s_name").alias("id"), (F.col("s_suppkey") % 50).cast("int").alias("score"))
    return K.trim(i, ["pack"], 150)


@query("cache_lru", "SELECT key, bytes, CAST(used AS BIGINT) AS used FROM (SELECT o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS bytes, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS used FROM orders) WHERE used <= 200000000")
def cache_lru(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("last_read"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return K.lru_keep(o, 200_000_000).select("key", "bytes", "used")


@query("cache_invalidate", "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 20 = 0 AND l_suppkey % 2 = 0)")
def cache_invalidate(spark, d):
    line = P.table(spark, d, "lineitem")
    files = line.select(F.col("l_orderkey").alias("key"), (F.col("l_suppkey") % 2).alias("repo"), F.col("l_partkey").alias("file_path"))
    changed = files.where("file_path % 20 = 0 and repo = 0").select("repo", "file_path").distinct()
    return K.invalidate(line.select(F.col("l_orderkey").alias("key")).distinct(), files, changed)


@query("call_log", "SELECT user_id AS target, event_type AS mode, count(*) AS calls, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_called FROM events GROUP BY 1, 2 ORDER BY calls DESC, last_called DESC, target, mode LIMIT 25")
def call_log(spark, d):
    e = P.table(spark, d, "events").select(F.col("user_id").alias("target"), F.col("event_type").alias("mode"), F.unix_timestamp("ts").alias("at"))
    return K.call_log(e, 25)


@query("upsert_latest", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, d):
    e = P.table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return K.upsert_latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("replace_slice", "SELECT c_custkey, c_nationkey, c_name FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 0) UNION ALL SELECT s_suppkey, s_nationkey, s_name FROM supplier WHERE s_suppkey % 9 = 0")
def replace_slice(spark, d):
    old = P.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    new = P.table(spark, d, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_name").alias("c_name"))
    return K.replace_slice(old, new, ["c_nationkey"])


@query("migration_siblings", """
  WITH m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t, l_suppkey % 40 AS f FROM lineitem), j AS (SELECT DISTINCT a.s AS migration, b.s AS sibling, a.t AS collection FROM m a JOIN m b ON a.t = b.t AND a.f <> b.f)
  SELECT migration, sibling, collection FROM (SELECT *, row_number() OVER (PARTITION BY migration ORDER BY collection, sibling) AS r FROM j) WHERE r <= 25""")
def migration_siblings(spark, d):
    m = P.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), (F.col("l_suppkey") % 40).alias("owner_file"), F.lit("migrates_collection").alias("kind")).distinct()
    return K.migration_siblings(m)


@query("brief_risk", """
  WITH c AS (SELECT p_partkey AS id, count(DISTINCT l_suppkey) AS fan_in, count(DISTINCT l_orderkey) % 5 AS callees, p_size % 3 AS impacted_repos, p_size % 2 AS repo_deps, CASE WHEN p_partkey % 4 = 0 THEN 'topic' ELSE 'function' END AS kind FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_size),
  s AS (SELECT *, CAST((fan_in >= 5)::INT + (callees >= 3)::INT + 2 * (impacted_repos > 0)::INT + (repo_deps > 0)::INT + (kind = 'topic')::INT AS INTEGER) AS risk_score FROM c) SELECT id, risk_score, CASE WHEN risk_score <= 1 THEN 'low' WHEN risk_score <= 3 THEN 'medium' ELSE 'high' END AS risk FROM s""")
def brief_risk(spark, d):
    line = P.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    p = P.table(spark, d, "part").select("p_partkey", "p_size")
    c = p.join(line, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_partkey", "p_size").agg(F.count_distinct("l_suppkey").alias("fan_in"), (F.count_distinct("l_orderkey") % 5).alias("callees"))
    c = c.select(F.col("p_partkey").alias("id"), "fan_in", "callees", (F.col("p_size") % 3).alias("impacted_repos"), (F.col("p_size") % 2).alias("repo_deps"), F.when(F.col("p_partkey") % 4 == 0, "topic").otherwise("function").alias("kind"))
    return K.brief_risk(c).select("id", "risk_score", "risk")


@query("ranking_metrics", """
  WITH r AS (SELECT l_suppkey AS query, l_partkey AS item, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2), g AS (SELECT DISTINCT l_suppkey AS query, l_partkey AS item FROM lineitem WHERE l_quantity >= 49),
  n AS (SELECT query, count(*) AS n FROM g GROUP BY 1), a AS (SELECT query, count(*) FILTER (g.item IS NOT NULL AND rank <= 3) AS hits, min(rank) FILTER (g.item IS NOT NULL) AS f FROM r LEFT JOIN g USING (query, item) GROUP BY 1)
  SELECT query, round(coalesce(hits, 0) / 3, 6)::DOUBLE AS precision, round(coalesce(hits, 0) / n, 6)::DOUBLE AS recall, round(coalesce(1 / f, 0), 6)::DOUBLE AS mrr, coalesce(f = 1, false) AS top1 FROM n LEFT JOIN a USING (query)""")
def ranking_metrics(spark, d):
    from pyspark.sql import Window

    line = P.table(spark, d, "lineitem")
    best = line.groupBy(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("item")).agg(F.max("l_extendedprice").alias("s"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "item")))
    good = line.where("l_quantity >= 49").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("item")).distinct()
    return K.ranking_metrics(ranked, good)


@query("query_shapes", """
  WITH q AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'GET /' || p_name WHEN 1 THEN 'orderPayload' WHEN 2 THEN lower(p_type) || '.created' WHEN 3 THEN 'useOrders' WHEN 4 THEN 'PermissionGuard' ELSE 'plain ' || p_partkey END AS t FROM part)
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'route' WHEN 1 THEN 'payload' WHEN 2 THEN 'event' WHEN 3 THEN 'hook' WHEN 4 THEN 'guard' ELSE 'generic' END AS shape FROM q""")
def query_shapes(spark, d):
    k = F.col("p_partkey") % 6
    t = F.when(k == 0, F.concat(F.lit("GET /"), "p_name")).when(k == 1, "orderPayload").when(k == 2, F.concat(F.lower("p_type"), F.lit(".created"))).when(k == 3, "useOrders").when(k == 4, "PermissionGuard").otherwise(F.concat(F.lit("plain "), "p_partkey"))
    return P.table(spark, d, "part").select("p_partkey", K.query_shape(t, F.array().cast("array<string>")).alias("shape"))


@query("page_after_cursor", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000 OFFSET 50")
def page_after_cursor(spark, d):
    """The second page of a ranking, by a signed cursor; 5,000 rows are asked for and clamped to 1,000."""
    cursor = S.make_cursor(b"key", 50, query="orders", repo=None)
    ranked = P.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return S.page(ranked, [F.desc("o_totalprice"), F.asc("o_orderkey")], S.read_cursor(b"key", cursor, query="orders", repo=None), 5000)


@query("batch_query", "SELECT 'parts' AS operation, count(*) AS rows, false AS failed FROM part UNION ALL SELECT 'no_such_column', CAST(NULL AS BIGINT), true UNION ALL SELECT 'orders', count(*), false FROM orders")
def batch_query(spark, d):
    """Three operations, of which one can't be built; the rows of the others are counted."""
    parts, orders = P.table(spark, d, "part"), P.table(spark, d, "orders")
    ran = K.batch([("parts", lambda: parts), ("no_such_column", lambda: parts.select("no_such_column")), ("orders", lambda: orders)])
    rows = [df.agg(F.count(F.lit(1)).alias("rows")) if error is None else spark.range(1).select(F.lit(None).cast("long").alias("rows")) for _, df, error in ran]
    return reduce(DataFrame.unionByName, [x.select(F.lit(name).alias("operation"), "rows", F.lit(error is not None).alias("failed")) for (name, _, error), x in zip(ran, rows)])
