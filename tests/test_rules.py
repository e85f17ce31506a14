"""Scalar rules, history, search, sources, sinks and streams on literals."""

import pytest
from pyspark.sql import functions as F

from meshlens import schema
from meshlens.functions import scalars as X
from meshlens.operators import diffs, history, kernels, packs, review, search
from meshlens.sources import braces, frameworks, scans, sinks
from meshlens.streaming import upkeep


def apply(spark, rule, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", rule(F.col("t")).alias("x")).orderBy("i").collect()]


def test_schema_tables():
    assert len(schema.NODE_KINDS) == 41 and len(schema.EDGE_KINDS) == 67
    assert schema.EDGE_KINDS["exposes_mcp_tool"] == 123 and len(schema.SEMANTIC_BRIDGES) == 26
    assert schema.SEMANTIC_BRIDGES <= set(schema.EDGE_KINDS) and all(k in schema.EDGE_KINDS for ks in schema.ACCESS.values() for k in ks.split())
    with pytest.raises(ValueError):
        schema.assert_version(3)


def test_names(spark):
    assert apply(spark, X.route_path, "https://h/Users/:uid/?q=1#x", "/a//B/{id}/", "/", "$x") == ["/users/:id", "/a/b/:id", "/", "/:id"]
    assert apply(spark, lambda t: X.route_key(F.lit("fetch"), t), "/A/") == ["GET /a"]
    assert apply(spark, X.package_root, "@s/p/x", "a/b", "./a", "lodash") == ["@s/p", "a", None, "lodash"]
    assert apply(spark, X.topology_part, "  Order Service!", "__", "a.b-c:d") == ["order_service", "unknown", "a.b-c:d"]
    assert apply(spark, lambda t: X.family_match(t, F.lit("order.*")), "order", "order.created", "orders") == [True, True, False]
    assert apply(spark, X.language, "a/b.TSX", "x.pyi", "Makefile", "v.1/x") == ["typescript", "python", None, None]
    assert apply(spark, X.sanitize_cell, "a|b\n`c` <d>", None) == ["a\\|b \\`c\\` &lt;d&gt;", ""]
    assert apply(spark, X.duration_seconds, "90s", "2h", "x") == [90, 7200, None]


def test_tokens(spark):
    cases = {"getHTTPServer2Go": "get http server 2 go", "snake_case-name": "snake case name", "": "", "ÉtéNoël": "été noël"}
    assert apply(spark, lambda t: F.array_join(X.tokens(t), " "), *cases) == list(cases.values())
    assert [" ".join(search.query_tokens(t)) for t in cases] == list(cases.values())
    assert apply(spark, lambda t: F.size(X.tokens(t)), "x" * 81) == [0]


def test_messages(spark):
    texts = ["feat(x)!: y", "FIX: z\nfeat: no", "Merge pull request #42 from a/b (#7)", "Add auth (#123)", "we chose this", "plain"]
    assert apply(spark, X.commit_class, *texts) == ["feat", "fix", None, None, None, None]
    assert apply(spark, X.pr_number, *texts) == [None, None, 42, 123, None, None]
    assert apply(spark, X.decision_signal, *texts)[4:] == [True, False]


def test_history(spark):
    day = 86400
    commits = spark.createDataFrame([("r", f"c{i}", "ann" if i < 8 else "bob", i * day) for i in range(10)] + [("r", "far", "bob", 99 * day)], "repo string, sha string, author_email string, date long")
    d = [(f"c{i}", "big.py", "modified", 10, None) for i in range(10)] + [("c1", "small.py", "modified", 1, 1), ("c2", "small.py", "deleted", 1, 1), ("far", "big.py", "modified", 1, 1)]
    deltas = spark.createDataFrame(d, "sha string, file_path string, change_kind string, insertions int, deletions int")
    hot = {r.file_path: r for r in history.hotspots(commits, deltas, 10 * day).collect()}
    assert hot["big.py"].total_commits == 10 and hot["small.py"].total_commits == 1 and hot["big.py"].score > hot["small.py"].score
    pairs = history.co_changes(commits, deltas, 10 * day).collect()
    assert [(r.file_a, r.file_b, r.occurrences) for r in pairs] == [("big.py", "small.py", 2)]
    assert history.co_changes(commits, deltas, 10 * day, max_files=1).count() == 0
    own = history.ownership(commits, deltas)
    f = {r.file_path: (r.bus_factor, r.top_owner) for r in history.bus_factor(own).collect()}
    assert f == {"big.py": (2, "ann"), "small.py": (1, "ann")}
    assert [r.file_path for r in history.owner_risks(history.bus_factor(own)).collect()] == ["small.py"]


def test_renames_and_versions(spark):
    r = spark.createDataFrame([("r", "a", "b", 1), ("r", "b", "c", 2), ("r", "c", "a", 3), ("r", "x", "y", 5), ("r", "y", "z", 4)], "repo string, old_path string, new_path string, date int")
    assert {x.old_path: x.latest for x in history.rename_chain(r).collect()} == {"a": "c", "b": "a", "c": "a", "x": "y", "y": "z"}
    p = spark.createDataFrame([("p", "A", "1"), ("p", "B", "2"), ("p", "C", "1"), ("q", "A", "1"), ("q", "B", "1")], "package string, repo string, version string")
    assert [(x.package, x.repo) for x in history.version_mismatches(p).orderBy("repo").collect()] == [("p", "A"), ("p", "B"), ("p", "C")]


def test_drift_needs_both_sides(spark):
    field = lambda n, t, o=False, c=900: (n, t, o, c)
    rows = [("t", "producer", [field("a", "int"), field("b", "String"), field("x", "int")]), ("t", "consumer", [field("a", "int", True), field("b", "string"), field("y", "int")]), ("t", "consumer", [field("a", "int", True)]), ("u", "producer", [field("a", "int")])]
    c = spark.createDataFrame(rows, "target_id string, side string, fields array<struct<name:string,type_name:string,optional:boolean,confidence:int>>")
    assert {(r.name, r.drift) for r in diffs.drift(c).collect()} == {("a", "optionality"), ("x", "extra_field"), ("y", "missing_field")}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "createOrder", "creates an order", True), (2, "removeOrder", "order goes", False), (3, "OrderService", "order order order", False), (4, "misc", "nothing here", False), (5, "loginUser", "session", False)]
    return spark.createDataFrame(rows, "doc_id int, symbol_name string, content string, is_exported boolean")


def test_search_passes(docs):
    top = search.search(docs, "createOrder", limit=1).first()
    assert (top.doc_id, top["pass"]) == (1, "strict")
    assert {(r.doc_id, r["pass"]) for r in search.search(docs, "oredr").collect()} == {(1, "fuzzy"), (2, "fuzzy"), (3, "fuzzy")}
    assert {(r.doc_id, r["pass"]) for r in search.search(docs, "destroy authenticate").collect()} == {(2, "disjunctive"), (5, "disjunctive")}
    assert search.search(docs, "destroy").count() == 0 and search.search(docs, "!!").count() == 0
    assert search.search(docs, "order", F.col("doc_id") > 2).count() == 1
    best = search.rerank(search.search(docs, "create order"), docs, "create order").orderBy(F.desc("score")).first()
    assert best.doc_id == 1


def test_cursor():
    c = search.make_cursor(b"k", 40, query="q", repo=None)
    assert search.read_cursor(b"k", c, query="q", repo=None) == 40
    for bad, request in ((c, {"query": "other", "repo": None}), (c[:-6] + "AAAAA=", {"query": "q", "repo": None}), ("v2:x", {"query": "q", "repo": None})):
        with pytest.raises(ValueError):
            search.read_cursor(b"k", bad, **request)


def test_packs(spark):
    s = spark.createDataFrame([("a", "x", 700), ("a", "y", 500), ("b", "x", 460), ("b", "y", 380), ("c", "x", 520), ("c", "y", 510)], "g string, id string, score int")
    assert {r.g: r.certainty for r in packs.select_target(s, ["g"]).collect()} == {"a": "high", "b": "medium", "c": "low"}
    assert [x[2] is None for x in packs.batch([("good", lambda: s), ("bad", lambda: s.select("nope"))])] == [True, False]
    with pytest.raises(ValueError):
        packs.batch([("x", lambda: s)] * 11)


def test_sources(spark, tmp_path):
    files = {
        "one/src/app.py": "import os\nfrom .x import y\nclass A(B):\n    @deco\n    def f(self):\n        return os.path.join('a')\n", "one/src/bad.py": "def (", "one/node_modules/z.py": "x = 1", "one/.hidden.py": "x = 1",
        "two/src/c.ts": "import { X } from '@s/lib';\n@Controller('orders')\nexport class C {\n  @Get(':id')\n  one() { fetch('/x'); this.bus.emit('order.created', 1); }\n}\nexport const go = async (a) => a;\n",
        "two/Dockerfile": "FROM node:20\nENV A=1\nEXPOSE 80\n", "two/.env": "KEY=secret\n", "two/docker-compose.yml": "services:\n  web:\n    image: nginx:1\n    environment:\n      - PORT=3\n",
        "two/k8s.yaml": "apiVersion: v1\nkind: Deployment\nspec:\n  image: x/y:1\n  env:\n    - name: DB_URL\n      valueFrom:\n        secretKeyRef:\n          name: db-secret\n", "two/.github/workflows/ci.yml": "jobs:\n  build:\n    steps:\n      - run: ${{ secrets.TOKEN }}\n",
        "two/package.json": '{"name": "two", "dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}',
    }
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    found = scans.scan_files(spark, f"file://{tmp_path}")
    assert {f"{r.repo}/{r.file_path}" for r in found.where("lang is not null").collect()} == {"one/src/app.py", "one/src/bad.py", "two/src/c.ts"}
    names = {(r.kind, r.name) for r in scans.parse_nodes(found).collect()}
    assert names == {("class", "A"), ("function", "f"), ("class", "C"), ("function", "one"), ("function", "go")}
    e = {(r.target, r.kind) for r in scans.parse_edges(found).collect()}
    assert {("os", "imports"), (".x.y", "imports"), ("B", "extends"), ("deco", "uses_decorator"), ("os.path.join", "calls"), ("@s/lib", "imports"), ("__route__GET /orders/:id", "serves"), ("__route__GET /x", "consumes_api_from"), ("__event__order.created", "publishes"), ("src/c.go", "exports"), ("Controller", "uses_decorator"), ("Get", "uses_decorator"), ("this.bus.emit", "calls")} <= e
    facts = {(r.artifact, r.fact, r.name) for r in scans.deployment_facts(scans.scan_files(spark, f"file://{tmp_path}", dotfiles=True)).collect()}
    assert {("dockerfile", "base_image", "node:20"), ("dockerfile", "port", "80"), ("env_file", "env_var", "KEY"), ("compose", "service", "web"), ("compose", "image", "nginx:1"), ("compose", "env_var", "PORT"), ("kubernetes", "resource", "Deployment"), ("kubernetes", "secret", "db-secret"), ("kubernetes", "env_var", "DB_URL"), ("github_actions", "job", "build"), ("github_actions", "secret", "TOKEN")} <= facts
    assert not any("secret" == x[2] for x in facts)  # names, never values
    assert {(r.dependency, r.scope) for r in scans.manifests(found).collect()} == {("a", "dependencies"), ("b", "devDependencies")}


def test_fuzzy_score(spark):
    df = spark.createDataFrame([("createOrder", "create_order"), ("abc", "xyz"), ("", ""), ("order", "orders")], "a string, b string")
    got = [round(r.s, 3) for r in df.select(scans.fuzzy_score(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [1.0, 0.0, 0.0, 0.833]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "repo string, v int")
    sinks.replace_repos(df, f"{tmp_path}/t")
    sinks.replace_repos(df.where("repo = 'b'").withColumn("v", F.lit(9)), f"{tmp_path}/t")
    assert {(r.repo, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("a", 1), ("b", 9)}


def test_stream_batches_may_run_again(spark, tmp_path):
    put = upkeep.table_upsert(f"{tmp_path}/s", ["k"], "at")
    one = spark.createDataFrame([("a", 1, 10), ("b", 1, 11)], "k string, at int, v int")
    two = spark.createDataFrame([("a", 2, 20), ("a", 0, 99)], "k string, at int, v int")
    put(one, 0)
    for _ in range(2):
        put(two, 1)
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/s/1").collect()} == {("a", 20), ("b", 11)}


def test_debounce(spark):
    c = spark.sql("select * from values ('r', 'a', timestamp'2024-01-01 00:00:00'), ('r', 'b', timestamp'2024-01-01 00:00:01'), ('r', 'c', timestamp'2024-01-01 00:00:09'), ('q', 'a', timestamp'2024-01-01 00:00:00') t(repo, path, ts)")
    got = sorted((r.repo, r.events, r.rescan) for r in upkeep.debounce(c, max_hints=1).collect())
    assert got == [("q", 1, False), ("r", 1, False), ("r", 2, True)]


def test_review(spark):
    p = spark.createDataFrame([("a", "f", "b", "g", "k", "e1", 70), ("a", "f", "b", "g", "k", "e2", 80), ("a", "f", "c", "g", "k", "e1", 20)], "source_repo string, source_file string, target_repo string, target_file string, kind string, edge_kind string, strength int")
    assert {(r.target_repo, r.edge_kinds, r.strength) for r in review.merge_proofs(p).collect()} == {("b", "e1,e2", 80), ("c", "e1", 20)}
    q = spark.createDataFrame([("r", "a", '{"a": {"$nin": [1]}}'), ("r", "b", "not json"), ("r", "c", None)], "repo string, file_path string, filter string")
    assert [(r.file_path, r.rule) for r in review.filter_findings(q).collect()] == [("a", "index_defeat")]


def test_call_tiers(spark):
    symbols = spark.createDataFrame([("1", "a", "run"), ("2", "b", "run"), ("3", "b", "only"), ("4", "c", "run"), ("5", "d", "createOrder"), ("6", "a", "load"), ("7", "b", "load")], "id string, module string, name string")
    calls = spark.createDataFrame([("i", "x", "run"), ("s", "b", "run"), ("u", "x", "only"), ("d", "x", "svc.only"), ("f", "x", "create_ordr"), ("m", "y", "load"), ("n", "x", "zzz")], "call string, module string, name string")
    imports = spark.createDataFrame([("x", "run", "c")], "module string, name string, target_module string")
    got = {r.call: (r.id, r.strategy, r.confidence) for r in scans.resolve_calls(calls, symbols, imports, fuzzy=True).collect()}
    assert got.pop("f")[:2] == ("5", "fuzzy_name")
    assert got == {"i": ("4", "import_map", 950), "s": ("2", "same_module", 900), "u": ("3", "unique", 750), "d": ("3", "suffix", 550), "m": ("6", "fallback", 273)}


def test_long_rename_chain(spark):
    rows = [("r", f"f{i}", f"f{i + 1}", i) for i in range(70)]
    got = {r.old_path: r.latest for r in history.rename_chain(spark.createDataFrame(rows, "repo string, old_path string, new_path string, date int")).collect()}
    assert got == {f"f{i}": "f70" for i in range(70)}


def test_streams_of_folders(spark, tmp_path):
    rows = [(i, i % 3, 1_700_000_000 + 60 * i) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k long, at long").select("id", "k", F.timestamp_seconds("at").alias("ts"))
    df.repartition(6).write.parquet(f"{tmp_path}/t.parquet")
    stream = upkeep.read_changes(spark, f"{tmp_path}/t.parquet", "id long, k long, ts timestamp", 2)
    upkeep.run_available(stream, f"{tmp_path}/c", upkeep.table_upsert(f"{tmp_path}/state", ["k"], "id"))
    assert sorted(r.id for r in upkeep.latest_state(spark, f"{tmp_path}/state", stream.schema).collect()) == [397, 398, 399]


def test_near_names_miss_none(spark):
    names = sorted({"".join(x) for x in __import__("itertools").product("ab", repeat=5)} | {"abcdefgh", "abcdexyz", "abcde", "Ab_cde", "abcd", "x", ""})
    df = spark.createDataFrame([(n,) for n in names], "asked string")
    found = df.select(F.col("asked").alias("found"), F.lit("i").alias("first"))
    got = {(r.asked, r.found) for r in scans._near_names(df, found).collect()}
    every = df.crossJoin(found).withColumn("s", scans.fuzzy_score(F.col("asked"), F.col("found"))).where("s >= 0.72")
    assert got == {(r.asked, r.found) for r in every.collect()}


def test_siblings_against_all_pairs(spark):
    import random

    rng = random.Random(7)
    rows = sorted({(f"s{rng.randrange(40):02}", f"c{rng.randrange(6)}", f"f{rng.randrange(5)}") for _ in range(160)})
    e = spark.createDataFrame(rows, "source string, target string, owner_file string").withColumn("kind", F.lit("migrates_collection"))
    want = []
    for m in sorted({r[0] for r in rows}):
        pairs = sorted({(b[1], b[0]) for a in rows for b in rows if a[0] == m and a[1] == b[1] and a[2] != b[2]})
        want += [(m, s, c) for c, s in pairs[:4]]
    assert sorted(tuple(r) for r in packs.migration_siblings(e, 4).collect()) == sorted(want)


def test_filters_are_walked(spark):
    texts = ['{"a.b":1,"c":null}', '{"a":{"b.c":null}}', '{"$or":[{"x":{"$regex":"y"}},{"z":{"$nin":[1]}}]}', "no json", None, '{"a":"$ne"}']
    q = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo string, file_path string, filter string")
    assert sorted((r.file_path, r.rule) for r in review.filter_findings(q).collect()) == [("1", "null_parent"), ("2", "index_defeat"), ("2", "unanchored_regex")]


def test_versions_are_whole(spark, tmp_path):
    a, b = (sinks.VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    a.stage(spark.range(3))
    assert a.commit() == 1
    a.stage(spark.range(5))
    b.stage(spark.range(9))
    assert b.read().count() == 3 and a.commit() == 2 and b.commit() == 3
    b.stage(spark.range(1))
    b.rollback()
    assert a.read().count() == 9 and a.versions() == [1, 2, 3]
    a.vacuum(1)
    assert a.versions() == [3]


def test_no_folder_on_a_cluster():
    from types import SimpleNamespace

    sc = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://x")
    with pytest.raises(ValueError):
        kernels.shared_dir(SimpleNamespace(sparkContext=sc, conf={}))


def _parsed(lang, text):
    nodes, edges = braces.symbols(lang, "m.x", text)
    return {(k, q) for k, _, q, _ in nodes}, {(a, b, k) for a, b, k, _ in edges if k != "defines"}


def test_script_files():
    nodes, edges = _parsed("typescript", """import { X } from './x'; // class No {}
const re = /class Nope \\{ f() {/g;
@Injectable({ a: f() })
export class A<T> extends ns.Base<T> implements I, J<K> {
  @Inject() private readonly svc: Svc;
  handler = async (a: string) => { this.run(a); };
  constructor(private x: X) { super(); init(); }
  @Get(':id') async run<T>(a: string): Promise<{ a: T }> { if (a) { this.svc.go("x()"); } return `v ${fmt(a)} {`; }
}
export const go = async (a) => helper(a);
function main(a = { b: 1 }) { go?.(a); new B(a); }
interface I2 extends I { f(): void }
type T1<A> = { a: A };
""")
    assert nodes == {("class", "m.A"), ("type", "m.I2"), ("type", "m.T1")} | {("function", f"m.{x}") for x in ("A.handler", "A.constructor", "A.run", "go", "main")}
    assert edges == {
        ("m.A", "Injectable", "uses_decorator"), ("m.A.run", "Get", "uses_decorator"), ("m.A", "ns.Base", "extends"), ("m.A", "I", "implements"), ("m.A", "J", "implements"), ("m.I2", "I", "extends"),
        ("m.A.handler", "this.run", "calls"), ("m.A.constructor", "init", "calls"), ("m.A.run", "this.svc.go", "calls"), ("m.A.run", "fmt", "calls"), ("m.go", "helper", "calls"), ("m.main", "go", "calls"), ("m.main", "B", "calls"),
    }


def test_go_files():
    nodes, edges = _parsed("go", """package m
import ( "fmt"
 x "a/b" )
type S struct {
  Base
  n int
}
type R interface { Read(p []byte) int }
func (s *S) Run(a int, f func(int) int) (int, error) { fmt.Println(`f(`); return helper(a), nil }
func helper[T any](a interface{ M() }) int { go s.x(); return g(1) }
""")
    assert nodes == {("class", "m.S"), ("type", "m.R"), ("function", "m.S.Run"), ("function", "m.helper")}
    assert edges == {("m", "fmt", "imports"), ("m", "a/b", "imports"), ("m.S", "Base", "extends"), ("m.S.Run", "fmt.Println", "calls"), ("m.S.Run", "helper", "calls"), ("m.helper", "s.x", "calls"), ("m.helper", "g", "calls")}


def test_java_files():
    nodes, edges = _parsed("java", """import a.b.C;
import static x.y.*;
@Entity(name = "x()")
public class A<T> extends B<T> implements C, d.D {
  @Id private int n = f();
  public A(int n) { this.n = n; init(); }
  @Override public <T> List<T> run(Map<String, T> m) throws X { return new Foo<>(m).bar(g(1)); }
  abstract void no();
  enum K { A(1), B; }
}
record P(int a) implements Q { }
""")
    assert nodes == {("class", "m.A"), ("type", "m.A.K"), ("class", "m.P"), ("function", "m.A.A"), ("function", "m.A.run"), ("function", "m.A.no")}
    assert edges == {
        ("m", "a.b.C", "imports"), ("m", "x.y.*", "imports"), ("m.A", "Entity", "uses_decorator"), ("m.A.run", "Override", "uses_decorator"), ("m.A", "B", "extends"), ("m.A", "C", "implements"), ("m.A", "d.D", "implements"), ("m.P", "Q", "implements"),
        ("m.A", "f", "calls"), ("m.A.A", "init", "calls"), ("m.A.run", "Foo", "calls"), ("m.A.run", "bar", "calls"), ("m.A.run", "g", "calls"),
    }


def test_rust_files():
    nodes, edges = _parsed("rust", """use std::{fs, io::{self, Read as R}};
/* a /* fn no() {} */ fn no2() {} */
#[derive(Debug)]
pub struct S<'a> { n: &'a str }
pub trait T: Base + Send { fn a(&self) -> i32; fn b(&self) { c() } }
impl<'a> T for S<'a> { fn a(&self) -> i32 { let x = '{'; helper::<u8>(1); self.n.len(); println!("f()"); S::new(2) } }
impl S<'_> { #[inline] pub fn new(x: impl Fn(i32) -> i32) -> Self where X: Y { Self { n: r#"f("{"# } } }
mod inner { pub fn z() { super::q() } }
""")
    assert nodes == {("class", "m.S"), ("type", "m.T")} | {("function", f"m.{x}") for x in ("T.a", "T.b", "S.a", "S.new", "inner.z")}
    assert edges == {
        ("m", "std::fs", "imports"), ("m", "std::io", "imports"), ("m", "std::io::Read", "imports"), ("m.S", "derive", "uses_decorator"), ("m.S.new", "inline", "uses_decorator"), ("m.T", "Base", "extends"), ("m.T", "Send", "extends"),
        ("m.S", "T", "implements"), ("m.T.b", "c", "calls"), ("m.S.a", "helper", "calls"), ("m.S.a", "self.n.len", "calls"), ("m.S.a", "S::new", "calls"), ("m.inner.z", "super::q", "calls"),
    }


def test_broken_files_give_what_was_read():
    for lang in ("typescript", "go", "java", "rust"):
        assert braces.symbols(lang, "m.x", "") == ([], [])
        for text in ("class A {{{ f(", "}}}) fn f(", "`${", "/* x", "\"", "'", "class " * 5000, "impl<" * 500):
            braces.symbols(lang, "m.x", text)


def test_framework_facts(spark):
    files = {
        "a/api.py": 'from fastapi import FastAPI\n# @app.get("/no")\n@app.get("/items/{id}")\ndef f(): ...\n@router.post(\n  path="")\ndef g(): ...\n',
        "a/web.py": "import flask\n@bp.route('/x', methods=['GET'])\ndef f(): ...\n",
        "a/k.py": "from kafka import KafkaConsumer\nc = KafkaConsumer('t1')\nc.subscribe(['t2'])\nproducer.send('t3', b'')\nproducer.send(topic, b'')\n",
        "a/db.py": "import sqlalchemy\nclass A(B):\n    __tablename__ = 'as'\n",
        "web/app/(shop)/cart/[id]/route.ts": "export async function GET() {}\nexport const POST = 1;\nfunction PUT() {}\n",
        "web/app/route.ts": "export function GET() {}", "web/pages/api/u/[...all].ts": "export default 1", "web/pages/api/index.js": "x", "web/pages/home.tsx": "x", "web/app/page.tsx": "export function GET() {}",
        "s.prisma": "model User {\n id Int\n}\n// model No {\nenum Role {\n A\n}\n",
        "m.ts": "import mongoose from 'mongoose';\nexport const M = mongoose.model<IUser>('User', s);\n@Schema({ collection: 'users' })\n",
        "t.ts": "import { Entity } from 'typeorm';\n@Entity('orders')\nclass A {}\n@Entity({ name: 'lines' })\nclass B {}\n@Entity()\nclass C {}\n",
        "d.ts": "import { pgTable } from 'drizzle-orm/pg-core';\nexport const u = pgTable('u', {});\n",
        "e.js": "const express = require('express');\napp.get('/h', f); router.all('/z', f); app.get('title');\n", "plain.ts": "app.get('/h'); pgTable('x')",
    }
    df = spark.createDataFrame([("r", p, t) for p, t in files.items()] + [("r", None, "x"), ("r", "x.py", None)], "repo string, file_path string, content string")
    got = sorted((r.framework, r.fact, r.name) for r in frameworks.framework_facts(df).collect())
    assert got == sorted([
        ("fastapi", "route", "GET /items/{id}"), ("fastapi", "route", "POST /"), ("flask", "route", "ANY /x"), ("kafka", "consumes", "t1"), ("kafka", "consumes", "t2"), ("kafka", "publishes", "t3"), ("sqlalchemy", "entity", "as"),
        ("nextjs", "route", "GET /cart/:id"), ("nextjs", "route", "POST /cart/:id"), ("nextjs", "route", "GET /"), ("nextjs", "route", "ANY /api/u/*all"), ("nextjs", "route", "ANY /api"),
        ("prisma", "entity", "User"), ("prisma", "enum", "Role"), ("mongoose", "entity", "User"), ("mongoose", "collection", "users"), ("typeorm", "entity", "orders"), ("typeorm", "entity", "lines"), ("drizzle", "entity", "u"),
        ("express", "route", "GET /h"), ("express", "route", "ANY /z"),
    ])


def test_tsconfig_strings_hold_no_comments(spark):
    text = r'{"compilerOptions": {"paths": {"@q\"//x/*": ["./a,}/*",], /* "no" */ "none": []}}} // end'
    df = spark.createDataFrame([("r", "d/tsconfig.json", text), ("r", "x/package.json", text), ("r", "tsconfig.json", None), ("r", "tsconfig.json", "{")], "repo string, file_path string, content string")
    assert [tuple(r) for r in scans.tsconfig_aliases(df).collect()] == [("r", '@q"//x/', "d/a,}/")]
