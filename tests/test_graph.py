"""Graph operators on small literal graphs."""

import pytest
from pyspark.sql import functions as F

from meshlens.operators import counts, events, traversal
from meshlens.operators.kernels import bfs, diff, edge_filter, propagate, reach, strong_components, top_k, within_budget

NODE = "id string, kind string, repo string, file_path string, name string, qualified_name string, external_id string, is_virtual boolean"


def node(i, kind="function", repo="a", path=None, external=None):
    return (i, kind, "__virtual__" if external else repo, path or f"src/{i}.ts", i, external or f"{repo}::{i}", external, external is not None)


@pytest.fixture(scope="module")
def graph(spark):
    n = [node("pub"), node("pub2"), node("con", repo="b"), node("con2", repo="c"), node("lost", repo="b"), node("ev", "event", external="__event__Order.Created"), node("top", "topic", external="__topic__kafka__order.created"), node("solo", "topic", external="__topic__kafka__solo")]
    e = [("pub", "ev", "publishes", 900), ("pub2", "top", "publishes", None), ("con", "top", "consumes", 300), ("con2", "top", "consumes", 900), ("con", "top", "uses_event_from", 950), ("lost", "solo", "consumes", None), ("ghost", "solo", "publishes", None)]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(e, "source string, target string, kind string, confidence int").withColumn("owner_file", F.col("source"))


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind, None) for a, b in pairs], "source string, target string, kind string, confidence int")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_missing_confidence_passes(graph):
    _, e = graph
    assert {r.source for r in edge_filter(e, ["consumes"], 500).collect()} == {"con2", "lost"}
    assert edge_filter(e, None, None).count() == e.count()


def test_event_trace_falls_back_to_the_topic(graph):
    got = {(r.target, r.side, r.source) for r in events.event_trace(*graph).collect()}
    assert ("ev", "producer", "pub") in got and ("ev", "producer", "pub2") not in got
    assert {("ev", "consumer", "con"), ("ev", "consumer", "con2")} <= got  # no consumer of its own
    assert sum(t == "top" and s == "con" for t, _, s in got) == 1  # once a node


def test_event_trace_limit(graph):
    rows = events.event_trace(*graph, limit=1).where("target = 'top' and side = 'consumer'").collect()
    assert [(r.source, r.truncated) for r in rows] == [("con", True)]


def test_orphans(graph):
    got = {r.target: r.severity for r in events.orphan_topics(*graph).collect()}
    assert got == {"ev": "medium", "solo": "high"}  # the ghost publisher is no node


def test_counts(graph):
    n, e = graph
    kinds = {r.kind: r.n for r in counts.nodes_by_kind(n).collect()}
    assert kinds["function"] == 5 and kinds["route"] == 0 and len(kinds) == 41
    r = counts.cross_repo_counts(n, e).first()
    assert (r.edges, r.cross_repo, r.true_cross_repo, r.virtual_other) == (6, 6, 0, 6)


def test_bfs(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("x", "x")])
    got = {(r.node, r.depth) for r in bfs(e, seeds(spark, "a"), None).collect()}
    assert got == {("b", 1), ("d", 1), ("c", 2)}  # the start is not reached again
    assert {r.node for r in bfs(e, seeds(spark, "a"), 1).collect()} == {"b", "d"}
    assert bfs(e, seeds(spark, "zz"), 3).count() == 0
    assert bfs(e, seeds(spark, "a"), 5, fan_out=1).count() == 2  # a-b, b-c


def test_bfs_confidence(spark):
    e = spark.createDataFrame([("a", "b", "calls", 900), ("b", "c", "calls", None), ("c", "d", "calls", 333)], "source string, target string, kind string, confidence int")
    got = {r.node: r.confidence for r in bfs(e, seeds(spark, "a"), 4, carry_confidence=True).collect()}
    assert got == {"b": 900, "c": 900, "d": 299}


def test_strong_components(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "f"), ("g", "a")])
    got = {r.node: (r.component, r.size) for r in strong_components(e).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 3), "d": ("c", 3), "e": ("c", 3)}
    assert strong_components(edges(spark, [("a", "b")])).count() == 0


def test_cycles_inside_a_class_are_left_out(spark):
    n = spark.createDataFrame([("1", "A.x", "r"), ("2", "A.y", "r"), ("3", "B.x", "r"), ("4", "C.x", "s")], "id string, name string, repo string")
    e = edges(spark, [("1", "2"), ("2", "1"), ("3", "4"), ("4", "3")])
    assert [(r.members, r.cross_repo) for r in traversal.cycles(n, e).collect()] == [("3,4", True)]


def test_propagate(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "node string, value int")
    got = {(r.node, r.value) for r in propagate(facts, edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])).collect()}
    assert got == {(x, v) for x in "abc" for v in (1, 2)}


def test_diff_top_k_and_budget(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "x"), (2, None), (3, "z")], [(2, None), (3, "y"), (4, "w")]))
    assert {r.k: r.change for r in diff(a, b, ["k"], ["v"]).collect()} == {1: "removed", 2: "same", 3: "changed", 4: "added"}
    df = spark.createDataFrame([("g", 5), ("g", 4), ("g", 3), ("h", 1)], "g string, v int")
    assert sorted((r.g, r.v, r.truncated) for r in top_k(df, ["g"], [F.desc("v")], 2).collect()) == [("g", 4, True), ("g", 5, True), ("h", 1, False)]
    assert sorted((r.g, r.v) for r in within_budget(df, ["g"], [F.desc("v")], F.col("v"), 9).collect()) == [("g", 4), ("g", 5), ("h", 1)]


def test_dead_code(spark):
    n = [node("main", path="app/main.ts"), node("used"), node("dead"), node("t", path="src/tests/t.test.ts"), node("lib", repo="b"), node("alone", repo="c")]
    n = spark.createDataFrame(n, NODE)
    e = edges(spark, [("main", "used"), ("used", "lib"), ("t", "dead")])
    got = {(r.repo, r.file_path): r.confidence for r in traversal.dead_files(n, e).collect()}
    assert got == {("a", "src/dead.ts"): "high", ("c", "src/alone.ts"): "medium"}
    exports = e.unionByName(edges(spark, [("f", "dead"), ("f", "used"), ("f", "t")], "exports"))
    assert {r.id for r in traversal.unused_exports(n, exports).collect()} == set()
    assert {r.id for r in traversal.unused_exports(n, exports.where("not (kind = 'calls' and target = 'dead')")).collect()} == {"dead"}


def test_zombies_and_mocks(spark):
    m = spark.createDataFrame([("a", "@x/core"), ("a", "left-pad"), ("a", "react")], "repo string, package string")
    i = spark.createDataFrame([("a", "@x/core/sub/y"), ("a", "./react"), ("a", "left-pad")], "repo string, spec string")
    assert [r.package for r in traversal.zombie_dependencies(m, i).collect()] == ["react"]
    n = spark.createDataFrame([node("m", path="src/__mocks__/m.ts"), node("s"), node("t", path="src/s.test.ts"), node("o", repo="b")], NODE)
    e = edges(spark, [("s", "m"), ("t", "m"), ("o", "m")], "imports")
    assert [r.importer for r in traversal.mock_leakage(n, e).collect()] == ["src/s.ts"]


def test_impact_prefers_structure(spark):
    n = spark.createDataFrame([node("x"), node("y", repo="b"), node("z", repo="b", path="src/z.ts"), node("w", repo="c")], NODE)
    e = edges(spark, [("y", "x")], "references").unionByName(edges(spark, [("z", "x"), ("w", "x")], "co_changes_with"))
    got = {(r.repo, r.file_path): (r.weak, r.weight) for r in traversal.shared_impact(n, e, seeds(spark, "x")).collect()}
    assert got == {("b", "src/y.ts"): (False, 65534.2), ("c", "src/w.ts"): (True, 65034.1)}


def test_trace_reports_every_edge(spark):
    n = spark.createDataFrame([node("v", "topic", external="__topic__v"), node("p"), node("q", repo="b")], NODE)
    e = edges(spark, [("p", "v")], "publishes").unionByName(edges(spark, [("q", "v")], "consumes")).unionByName(edges(spark, [("p", "q")], "calls"))
    got = [(r.node, r.source, r.depth) for r in traversal.trace_across_repos(n, e, seeds(spark, "v"), 2).collect()]
    assert sorted(got) == [("p", "q", 2), ("p", "v", 1), ("q", "p", 2), ("q", "v", 1)]


def test_evidence_chain(spark):
    e = edges(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("e", "f")])
    pairs = spark.createDataFrame([("a", "d"), ("a", "f"), ("a", "b")], "a string, b string")
    assert {(r.a, r.b): r.length for r in traversal.evidence_chain(e, pairs).collect()} == {("a", "d"): 3, ("a", "b"): 1}


def test_callers_of_a_hot_symbol(spark):
    e = edges(spark, [(f"c{i:03}", "hot") for i in range(300)] + [("far", "c299")])
    got = traversal.callers(e, seeds(spark, "hot"), 2, 1000).collect()
    assert len(got) == 301 and not any(r.truncated for r in got)
    assert {r.node for r in got if r.depth == 2} == {"far"}  # behind the last caller
    cut = traversal.callers(e, seeds(spark, "hot"), 2, 300).collect()
    assert len(cut) == 300 and all(r.truncated for r in cut)
    down = edges(spark, [("hot", f"c{i:03}") for i in range(300)])
    assert traversal.callees(down, seeds(spark, "hot"), 1, 1000).count() == 300


def test_reach_and_long_cycles(spark):
    ring = [(f"n{i:03}", f"n{(i + 1) % 9:03}") for i in range(9)]
    e = edges(spark, ring + [("n000", "out"), ("in", "n000")])
    assert {r.node for r in reach(e, seeds(spark, "n005")).collect()} == {f"n{i:03}" for i in range(9)} | {"out"}
    got = strong_components(e).collect()
    assert {(r.component, r["size"]) for r in got} == {("n000", 9)} and len(got) == 9


def test_traverse_says_where_it_stopped(spark):
    e = edges(spark, [("s", f"t{i:03}") for i in range(300)] + [("t000", "u"), ("t001", "v"), ("u", "w")])
    got = {r.node: r for r in traversal.traverse(e, seeds(spark, "s"), 1).collect()}
    assert len(got) == traversal.FAN_OUT and got["t000"].depth_capped and not got["t002"].depth_capped
    assert not any(r.truncated for r in got.values())
    hub = {r.node: r for r in traversal.traverse(edges(spark, [("a", "s")]).unionByName(e), seeds(spark, "a"), 2).collect()}
    assert hub["s"].truncated and len(hub) == 1 + traversal.FAN_OUT


def test_impact_counts_points_on_the_way(spark):
    n = spark.createDataFrame([node("x"), node("y", repo="b", external="__payload_schema__y"), node("z", repo="c")], NODE).withColumn("repo", F.when(F.col("id") == "y", "b").otherwise(F.col("repo")))
    e = edges(spark, [("y", "x"), ("x", "y")], "references").unionByName(edges(spark, [("z", "y")], "uses_guard_from"))
    got = {r.repo: r for r in traversal.shared_impact(n, e, seeds(spark, "x")).collect()}
    assert (got["b"].depth, got["b"].serialization, got["b"].weight) == (1, True, 65534.4)
    assert (got["c"].depth, got["c"].validation, got["c"].weight) == (2, True, 65533.4)
    assert got["a"].depth == 2  # the seed's own file, around the ring


def test_transports(spark):
    n = spark.createDataFrame([node("v", "topic", external="__topic__v"), node("p"), node("q", repo="a"), node("c", repo="b")], NODE)
    e = edges(spark, [("p", "v"), ("q", "v")], "publishes").unionByName(edges(spark, [("c", "v")], "consumes"))
    assert [tuple(r) for r in events.transport_links(n, e).collect()] == [("publishes", "a", "b", 1, 2)]
    assert sorted(r.producer for r in events.transport_pairs(n, e, "a", "b").collect()) == ["p", "q"]
