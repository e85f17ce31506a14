"""Operators leave little in the shared folder, and ways that large tables need agree with plain ones."""

import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from meshlens.operators import kernels, traversal
from meshlens.sources import scans


def left_behind(spark, run):
    """Tables and checkpoints that ``run`` leaves in the shared folder, and its rows."""
    top = kernels.shared_dir(spark).removeprefix("file:")
    found = lambda: {f"{at}/{d}" for at, ds, _ in os.walk(top) for d in ds if d.startswith("rdd-") or "-" in d and at.rstrip("/") == top.rstrip("/")}
    before = found()
    rows = run().collect()
    return len(found() - before), rows


def components(pairs):
    """(node, smallest of its component, size), by reach from every node."""
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)

    def reached(x):
        seen, todo = {x}, [x]
        while todo:
            new = after[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    r = {x: reached(x) for p in pairs for x in p}
    own = {x: [y for y in r[x] if x in r[y]] for x in r}
    return sorted((x, min(c), len(c)) for x, c in own.items() if len(c) > 1)


def test_rings_leave_one_table(spark):
    rings = spark.range(3000).select(F.concat((F.col("id") - F.col("id") % 3).cast("string"), F.lit("."), F.col("id") % 3).alias("source"), F.concat((F.col("id") - F.col("id") % 3).cast("string"), F.lit("."), (F.col("id") + 1) % 3).alias("target"))
    n, rows = left_behind(spark, lambda: kernels.strong_components(rings.coalesce(1)))
    assert n == 1 and len(rows) == 3000 and {r["size"] for r in rows} == {3}


def test_components_across_blocks(spark, monkeypatch):
    contract = kernels._contract
    for seed, block in enumerate((7,)):
        draw = random.Random(seed)
        pairs = [(f"n{draw.randrange(40):02}", f"n{draw.randrange(40):02}") for _ in range(60)]
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(block))
        try:
            monkeypatch.setattr(kernels, "_contract", lambda b, at=block: contract(b, at))
            got = kernels.strong_components(spark.createDataFrame(pairs, "source string, target string").repartition(3)).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(tuple(r) for r in got) == components(pairs)


def test_cycles_leave_two_tables(spark):
    pairs = [(f"{i}.{j}", f"{i}.{(j + 1) % 3}") for i in range(30) for j in range(3)]
    nodes = spark.createDataFrame([(a, a.split(".")[1], "x") for a, _ in pairs], "id string, repo string, name string")
    n, rows = left_behind(spark, lambda: traversal.cycles(nodes, spark.createDataFrame([(*p, "imports") for p in pairs], "source string, target string, kind string").coalesce(1)))
    assert n <= 2 and len(rows) == 30 and all(r.cross_repo for r in rows)


def chain(spark, n):
    return spark.createDataFrame([(f"n{i}", f"n{i + 1}", "calls", None) for i in range(n)], "source string, target string, kind string, confidence int")


def test_dead_files_leave_few_tables(spark):
    ids = [*(f"n{i}" for i in range(5)), "gone"]
    nodes = spark.createDataFrame([(i, "function", "a", "bin/n0.ts" if i == "n0" else f"src/{i}.ts", False) for i in ids], "id string, kind string, repo string, file_path string, is_virtual boolean")
    n, rows = left_behind(spark, lambda: traversal.dead_files(nodes, chain(spark, 4)))
    assert [r.file_path for r in rows] == ["src/gone.ts"] and n <= 9


def test_many_values_spread_in_sets(spark):
    facts = spark.createDataFrame([("n0", f"v{i}") for i in range(150)] + [("n2", "own")], "node string, value string")
    n, rows = left_behind(spark, lambda: kernels.propagate(facts, chain(spark, 3)))
    assert {(r.node, r.value) for r in rows} == {(f"n{i}", f"v{j}") for i in range(4) for j in range(150)} | {("n2", "own"), ("n3", "own")} and n <= 3


def test_names_that_share_a_code_get_another_salt(spark, monkeypatch):
    plain = kernels.F.xxhash64
    monkeypatch.setattr(kernels.F, "xxhash64", lambda salt, c: plain(salt, c) if "1" in str(salt) else kernels.F.lit(7).cast("long"))
    code, table = kernels.coding(spark.createDataFrame([("a",), ("b",)], "node string"))
    assert table.select(code(F.col("node")) == F.col("code")).distinct().collect() == [(True,)] and table.select("code").distinct().count() == 2


def test_proofs_move_no_paths(spark):
    ids = ["s", "n0", "n1", "n2", "n3", "far"]
    nodes = spark.createDataFrame([(i, "b" if i == "far" else "a", f"src/{i}.ts", False) for i in ids], "id string, repo string, file_path string, is_virtual boolean")
    edges = chain(spark, 3).unionByName(spark.createDataFrame([("far", "n0", "imports", None), ("n3", "far", "calls", None)], "source string, target string, kind string, confidence int"))
    seeds = spark.createDataFrame([("n2",), ("n0",), ("s",)], "node string")
    n, rows = left_behind(spark, lambda: traversal.proofs(nodes, edges, seeds, 3))
    assert sorted((r.seed, r.target_repo, r.kind, r.hops) for r in rows) == [("n0", "b", "imports", 1), ("n2", "b", "calls", 2), ("n2", "b", "imports", 3)]


def test_symbols_of_one_name_do_not_multiply_calls(spark):
    symbols = spark.range(2000).select(F.format_string("%04d", "id").alias("id"), F.lit("m").alias("module"), F.lit("run").alias("name"))
    calls = spark.range(2000).select(F.col("id").cast("string").alias("call"), F.when(F.col("id") % 2 == 0, "m").otherwise("x").alias("module"), F.lit("run").alias("name"))
    got = scans.resolve_calls(calls, symbols, symbols.select(F.lit("x").alias("module"), "name", F.col("module").alias("target_module")))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # four million pairs before
    assert {tuple(r) for r in got.select("id", "strategy", "confidence", F.col("call").cast("int") % 2).collect()} == {("0000", "same_module", 900, 0), ("0000", "import_map", 950, 1)}


def test_no_side_of_call_resolution_is_broadcast(spark, monkeypatch):
    store, plans = scans.stored, []
    monkeypatch.setattr(scans, "stored", lambda df, label: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or store(df, label))
    from meshlens.plans import ingest_queries

    plans.append(ingest_queries.call_resolution(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 8 and not any("Broadcast" in p for p in plans)


def test_proofs_go_eight_steps_inside(spark):
    nodes = spark.createDataFrame([(f"n{i}", "b" if i == 10 else "a", f"src/{i}.ts", False) for i in range(11)], "id string, repo string, file_path string, is_virtual boolean")
    got = traversal.proofs(nodes, chain(spark, 10), spark.createDataFrame([("n0",), ("n1",)], "node string"))
    assert [(r.seed, r.target_repo, r.hops) for r in got.collect()] == [("n1", "b", 9)]


def test_proofs_query_is_not_cut_short(spark):
    from meshlens.plans import traversal_queries

    hops = {r.hops for r in traversal_queries.proofs(spark, "/root/testdata/sf0.001").select("hops").distinct().collect()}
    assert hops == set(range(1, 10))  # no more than four before
