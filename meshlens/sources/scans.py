"""Scans of source trees, manifests, deployment files and logs into rows.

Files are read by Spark's own readers, so any store they reach will do. What SQL can express is
SQL; source code is parsed a file at a time in Arrow batches.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators.kernels import drop, stored
from . import braces

IGNORED = r"(^|/)(node_modules|dist|build|target|\.git|vendor|__pycache__)/"
#: Hidden files that are looked for in every repository.
HIDDEN = (".env*", ".github/workflows/*")
ROWS = "repo string, file_path string, kind string, name string, qualified_name string, line int"
EDGES = "repo string, file_path string, source string, target string, kind string, line int"


def scan_files(spark: SparkSession, root: str, languages: list[str] | None = None, exclude: str = IGNORED, dotfiles: bool = False, max_bytes: int = 1 << 20) -> DataFrame:
    """(repo, file_path, lang, size, content) of a tree; the first folder below the root is the repository."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    df = df.select("path", F.col("length").alias("size"), "content")
    if dotfiles:
        df = df.unionByName(_hidden_files(spark, root))
    rel = F.substring_index(F.col("path"), root.rstrip("/").split("://")[-1] + "/", -1)
    df = df.select(rel.alias("rel"), "size", "content")
    df = df.select(F.substring_index("rel", "/", 1).alias("repo"), F.regexp_replace("rel", r"^[^/]+/", "").alias("file_path"), "size", "content").withColumn("lang", X.language(F.col("file_path")))
    df = df.where((F.col("size") <= max_bytes) & ~F.col("file_path").rlike(exclude))
    if not dotfiles:
        df = df.where(~F.col("file_path").rlike(r"(^|/)\."))
    if languages:
        df = df.where(F.col("lang").isin(*languages))
    return df.withColumn("content_hash", F.sha2("content", 256)).withColumn("content", F.col("content").cast("string"))


def _hidden_files(spark: SparkSession, root: str) -> DataFrame:
    """Spark's listings pass hidden names over: these are listed by pattern and read by the executors."""
    found = []
    for pattern in HIDDEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{pattern}")
        found += [s.getPath().toString() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [] if s.isFile()]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            rows = []
            for p in b["path"]:
                store, name = fs.FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                with store.open_input_stream(name) as f:
                    rows.append((p, data := f.read(), len(data)))
            yield pd.DataFrame(rows, columns=["path", "content", "size"])

    paths = spark.createDataFrame([(p,) for p in found], "path string")
    return paths.mapInPandas(read, "path string, content binary, size bigint")


def selected_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load([f"{root}/{p}" for p in paths]).select("path", F.col("length").alias("size"), F.col("content").cast("string").alias("content"))


def manifests(files: DataFrame) -> DataFrame:
    """(repo, file_path, package, dependency, version, scope) of package manifests."""
    m = "map<string,string>"
    j = F.from_json("content", f"name string, dependencies {m}, devDependencies {m}, peerDependencies {m}")
    f = files.where(F.col("file_path").rlike(r"(^|/)package\.json$")).withColumn("j", j)
    scopes = F.array(*(F.struct(F.lit(s).alias("scope"), F.col(f"j.{s}").alias("d")) for s in ("dependencies", "devDependencies", "peerDependencies")))
    f = f.select("repo", "file_path", F.col("j.name").alias("package"), F.explode(scopes).alias("s"))
    return f.select("repo", "file_path", "package", "s.scope", F.explode("s.d").alias("dependency", "version"))


def workspace_packages(files: DataFrame) -> DataFrame:
    """(repo, dir, package, entry) of the packages that a repository's root manifest or pnpm workspace file names by pattern.

    A pattern's ``*`` stands for one folder, ``**`` for any number; ``!`` leaves folders out.
    """
    root = files.where("file_path = 'package.json'")
    both = F.coalesce(F.from_json("content", "workspaces array<string>")["workspaces"], F.from_json("content", "workspaces struct<packages:array<string>>")["workspaces"]["packages"])
    npm = root.select("repo", F.explode(both).alias("pattern"))
    listed = F.regexp_extract_all("content", F.lit(r"(?m)^\s*-\s*[\"']?([^\"'\s#]+)"), F.lit(1))
    patterns = npm.unionByName(files.where("file_path = 'pnpm-workspace.yaml'").select("repo", F.explode(listed).alias("pattern")))
    bare = F.regexp_replace(F.regexp_replace("pattern", r"^!", ""), r"/+$", "")
    quoted = F.regexp_replace(bare, r"([.+?()\[\]{}|^$])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]+")), F.lit("\x01"), F.lit(".+")), F.lit("$"))
    patterns = patterns.select("repo", regex.alias("regex"), F.col("pattern").startswith("!").alias("out")).groupBy("repo").agg(F.collect_set(F.when(~F.col("out"), F.col("regex"))).alias("ins"), F.collect_set(F.when(F.col("out"), F.col("regex"))).alias("outs"))
    j = F.from_json("content", "name string, main string")
    members = files.where("file_path like '%/package.json'").select("repo", F.regexp_replace("file_path", "/package.json$", "").alias("dir"), j.alias("j")).where("j.name is not null")
    hit = members.join(patterns, "repo").where(F.exists("ins", lambda r: F.regexp(F.col("dir"), r)) & ~F.exists("outs", lambda r: F.regexp(F.col("dir"), r)))
    return hit.select("repo", "dir", F.col("j.name").alias("package"), F.coalesce("j.main", F.lit("index.js")).alias("entry"))


def tsconfig_aliases(files: DataFrame) -> DataFrame:
    """(alias_repo, prefix, replacement) of the path aliases of compiler configurations, as ``assembly.resolve_aliases`` takes them.

    Comments and commas before a closing bracket are let pass. Of an alias's targets the first
    counts. ``.`` parts of a path go, ``..`` parts stay as they are; ``extends`` is not followed.
    """
    string = r'("(?:[^"\\]|\\.)*+")'
    plain = F.regexp_replace("content", string + r"|//[^\n]*|(?s:/\*.*?\*/)", "$1")
    plain = F.regexp_replace(plain, string + r"|,(?=\s*[}\]])", "$1")
    j = F.from_json(plain, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")
    f = files.where(F.col("file_path").rlike(r"(^|/)[jt]sconfig(\.[^/]+)?\.json$")).withColumn("j", j)
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]+$", 1)
    f = f.select(F.col("repo").alias("alias_repo"), folder.alias("folder"), F.col("j.compilerOptions.baseUrl").alias("base"), F.explode("j.compilerOptions.paths").alias("alias", "targets"))
    target = F.regexp_replace(F.get("targets", F.lit(0)), r"\*$", "")
    parts = F.filter(F.split(F.concat_ws("/", "folder", "base", target), "/"), lambda x: ~x.isin("", "."))
    f = f.where(F.size("targets") > 0).select("alias_repo", F.regexp_replace("alias", r"\*$", "").alias("prefix"), F.concat(F.array_join(parts, "/"), F.when(target.endswith("/"), "/").otherwise("")).alias("replacement"))
    return f.distinct()


def artifact_kind(path: Column, content: Column) -> Column:
    """What a deployment file is, by its name and then by what it holds."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"(^|/)dockerfile(\.[^/]+)?$"), "dockerfile").when(low.rlike(r"(^|/)(docker-)?compose[^/]*\.ya?ml$"), "compose").when(low.rlike(r"(^|/)kustomization\.ya?ml$"), "kustomize").when(low.rlike(r"(^|/)chart\.ya?ml$"), "helm")
        .when(low.rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"), "github_actions").when(low.rlike(r"(^|/)\.env(\.[^/]+)?$"), "env_file").when(low.rlike(r"\.ya?ml$") & content.rlike(r"(?m)^apiVersion:") & content.rlike(r"(?m)^kind:"), "kubernetes")
    )


def deployment_facts(files: DataFrame) -> DataFrame:
    """(repo, file_path, artifact, fact, name): base images, ports, services, jobs and names of variables; never values."""
    f = files.withColumn("artifact", artifact_kind(F.col("file_path"), F.col("content"))).where("artifact is not null")

    def facts(artifact: str, fact: str, pattern: str, group: int = 1) -> Column:
        found = F.regexp_extract_all("content", F.lit(pattern), F.lit(group))
        return F.when(F.col("artifact") == artifact, F.transform(found, lambda x: F.struct(F.lit(fact).alias("fact"), x.alias("name")))).otherwise(F.array().cast("array<struct<fact:string,name:string>>"))

    all_facts = F.concat(
        facts("dockerfile", "base_image", r"(?mi)^FROM[ \t]+([^ \t\n]+)"), facts("dockerfile", "port", r"(?mi)^EXPOSE[ \t]+([0-9]+)"), facts("dockerfile", "env_var", r"(?mi)^ENV[ \t]+([A-Za-z_][A-Za-z0-9_]*)"),
        facts("env_file", "env_var", r"(?m)^(?:export[ \t]+)?([A-Za-z_][A-Za-z0-9_]*)[ \t]*="),
        facts("compose", "service", r"(?m)^  ([A-Za-z0-9_.-]+):[ \t]*$"), facts("compose", "image", r"(?m)^[ ]+image:[ \t]*[\"']?([^\"'\s]+)"), facts("compose", "env_var", r"(?m)^[ ]+-[ ]([A-Z_][A-Z0-9_]*)="),
        facts("kubernetes", "resource", r"(?m)^kind:[ \t]*([A-Za-z]+)"), facts("kubernetes", "image", r"(?m)image:[ \t]*[\"']?([^\"'\s]+)"), facts("kubernetes", "secret", r"(?m)secretKeyRef:\s*\n\s*name:[ \t]*([A-Za-z0-9.-]+)"), facts("kubernetes", "config_map", r"(?m)configMapKeyRef:\s*\n\s*name:[ \t]*([A-Za-z0-9.-]+)"), facts("kubernetes", "env_var", r"(?m)^\s*-[ ]name:[ \t]*([A-Z_][A-Z0-9_]*)[ \t]*$"),
        facts("helm", "chart", r"(?m)^name:[ \t]*([A-Za-z0-9.-]+)"), facts("kustomize", "resource_file", r"(?m)^-[ \t]+([^\s]+\.ya?ml)"), facts("github_actions", "job", r"(?m)^  ([A-Za-z0-9_-]+):[ \t]*$"), facts("github_actions", "secret", r"secrets\.([A-Za-z_][A-Za-z0-9_]*)"),
    )
    return f.select("repo", "file_path", "artifact", F.explode(F.array_distinct(all_facts)).alias("x")).select("repo", "file_path", "artifact", "x.fact", "x.name")


def python_symbols(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Definitions and edges of one Python file; a file that doesn't parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    nodes, edges = [], []
    module = re.sub(r"\.pyi?$", "", path).replace("/", ".")

    def visit(node: ast.AST, owner: str) -> None:
        for x in ast.iter_child_nodes(node):
            here = owner
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                here = f"{owner}.{x.name}"
                kind = "class" if isinstance(x, ast.ClassDef) else "function"
                nodes.append((kind, x.name, here, x.lineno))
                edges.append((owner, here, "defines", x.lineno))
                for dec in x.decorator_list:
                    edges.append((here, ast.unparse(dec.func if isinstance(dec, ast.Call) else dec), "uses_decorator", dec.lineno))
                for base in getattr(x, "bases", []):
                    edges.append((here, ast.unparse(base), "extends", x.lineno))
            elif isinstance(x, ast.Import):
                edges.extend((owner, a.name, "imports", x.lineno) for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                edges.extend((owner, "." * x.level + (x.module or "") + "." + a.name, "imports", x.lineno) for a in x.names)
            elif isinstance(x, ast.Call):
                edges.append((owner, ast.unparse(x.func), "calls", x.lineno))
            visit(x, here)

    visit(tree, module)
    return nodes, edges


_TS_IMPORT = re.compile(r"(?:import|export)[^'\"\n;]*from\s*['\"]([^'\"]+)['\"]|require\(\s*['\"]([^'\"]+)['\"]\s*\)")
_TS_EXPORT = re.compile(r"^\s*export\s+(?:default\s+)?(?:abstract\s+|async\s+)?(?:class|function|const|let|interface|type|enum)\s*\*?\s*([A-Za-z_$][\w$]*)", re.M)
_CONTROLLER = re.compile(r"@Controller\(\s*['\"`]?([^'\"`)]*)['\"`]?\s*\)")
_ROUTE = re.compile(r"@(Get|Post|Put|Patch|Delete)\(\s*['\"`]?([^'\"`)]*)['\"`]?\s*\)")
_TOPIC = re.compile(r"@(EventPattern|MessagePattern)\(\s*['\"`]([^'\"`]+)['\"`]|\.(emit|publish|send)\(\s*['\"`]([^'\"`]+)['\"`]")
_FETCH = re.compile(r"\b(?:axios|http|client|api)\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)['\"`]|\bfetch\(\s*['\"`]([^'\"`]+)['\"`]")


def script_symbols(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Definitions, calls, inheritance, decorators, imports, exports, routes and events of one TypeScript or JavaScript file."""
    module = re.sub(r"\.[cm]?[jt]sx?$", "", path)
    line = lambda at: text.count("\n", 0, at) + 1
    nodes, edges = braces.symbols("typescript", path, text)
    edges += [(module, m[1] or m[2], "imports", line(m.start())) for m in _TS_IMPORT.finditer(text)]
    edges += [(module, f"{module}.{m[1]}", "exports", line(m.start(1))) for m in _TS_EXPORT.finditer(text)]
    base = m[1] if (m := _CONTROLLER.search(text)) else ""
    edges += [(module, f"__route__{m[1].upper()} /{'/'.join(x.strip('/') for x in (base, m[2]) if x.strip('/'))}", "serves", line(m.start())) for m in _ROUTE.finditer(text)]
    for m in _TOPIC.finditer(text):
        edges.append((module, f"__event__{m[2] or m[4]}", "consumes" if m[1] else "publishes", line(m.start())))
    edges += [(module, f"__route__{(m[1] or 'get').upper()} {m[2] or m[3]}", "consumes_api_from", line(m.start())) for m in _FETCH.finditer(text)]
    return nodes, edges


PARSERS = {"python": python_symbols, "typescript": script_symbols, "javascript": script_symbols} | {x: partial(braces.symbols, x) for x in ("go", "java", "rust")}


def _parse(files: DataFrame, edges: bool) -> DataFrame:
    schema = EDGES if edges else ROWS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            out = []
            for repo, path, lang, text in zip(b["repo"], b["file_path"], b["lang"], b["content"]):
                f = PARSERS.get(lang)
                if f and isinstance(path, str) and isinstance(text, str):
                    out += [(repo, path, *x) for x in f(path, text)[edges]]
            yield pd.DataFrame(out, columns=names)

    return files.select("repo", "file_path", "lang", "content").mapInPandas(run, schema)


def parse_nodes(files: DataFrame) -> DataFrame:
    return _parse(files, False)


def parse_edges(files: DataFrame) -> DataFrame:
    return _parse(files, True)


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, fuzzy: bool = False) -> DataFrame:
    """Each call's target by the first tier that has one, with a confidence in thousandths.

    Tiers: what the module imports under that name, the same module, a name that is unique, the last
    segment of a dotted name, a similar name, any of several symbols of that name. Confidence falls
    by a tenth of the base for each further candidate. ``calls``: call, module, name. ``symbols``:
    id, module, name. ``imports``: module, name, target_module. The similar-name tier takes only calls
    whose name no symbol bears.
    """
    def spread(base: int) -> Column:  # base / (1 + 0.1 (n - 1)), rounded, in whole numbers
        return F.expr(f"(20 * {base} + 9 + n) div (2 * (9 + n))")

    # merge joins throughout: every side grows with the symbols or the names, and none is put into the driver's memory
    # one row a module and name: a name that many symbols of a module bear must not multiply its calls
    own = stored(symbols.groupBy("module", "name").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "own")
    n = own.groupBy("name").agg(F.sum("n").alias("n"), F.min("id").alias("first"))
    near = own.select("module", "name", F.lit(1).alias("t"), "id")
    if imports is not None:
        via = imports.select(F.col("module").alias("from"), F.col("target_module").alias("module"), "name").join(own.hint("merge"), ["module", "name"]).select(F.col("from").alias("module"), "name", F.lit(0).alias("t"), "id")
        near = near.unionByName(via)
    near = stored(near.groupBy("module", "name").agg(F.min(F.struct("t", "id")).alias("b")).select("module", "name", "b.t", "b.id"), "near")
    # what a name alone tells, one row for each name that is called
    asked = stored(calls.select("name").distinct(), "asked")
    known = asked.join(n.hint("merge"), "name").select("name", F.when(F.col("n") == 1, 2).otherwise(5).alias("t"), F.col("first").alias("id"), F.when(F.col("n") == 1, F.lit(750)).otherwise(spread(300)).cast("int").alias("confidence"))
    last = asked.where(F.col("name").contains(".")).select("name", F.substring_index("name", ".", -1).alias("last"))
    tails = last.join(n.withColumnRenamed("name", "last").hint("merge"), "last").select("name", F.lit(3).alias("t"), F.col("first").alias("id"), spread(550).cast("int").alias("confidence"))
    told = known.unionByName(tails)
    if fuzzy:
        lost = asked.join(n.select("name").hint("merge"), "name", "left_anti").select(F.col("name").alias("asked"))
        pairs = _near_names(lost, n.select(F.col("name").alias("found"), "first"))
        best = pairs.groupBy("asked").agg(F.max_by(F.struct("first", "s"), F.struct("s", F.col("found"))).alias("b"), F.count(F.lit(1)).alias("n"))
        told = told.unionByName(best.select(F.col("asked").alias("name"), F.lit(4).alias("t"), F.col("b.first").alias("id"), F.round(400 * F.col("b.s") / (1 + 0.1 * (F.col("n") - 1))).cast("int").alias("confidence")))
    told = stored(told.groupBy("name").agg(F.min(F.struct("t", "id", "confidence")).alias("b")).select("name", "b.*"), "told")
    drop(own, asked)
    first = stored(calls.join(near.hint("merge"), ["module", "name"], "left"), "calls")
    got = first.where("id is not null").select("call", "t", "id", F.when(F.col("t") == 0, 950).otherwise(900).alias("confidence"))
    rest = first.where("id is null").select("call", "name").join(told.hint("merge"), "name").select("call", "t", "id", "confidence")
    out = stored(got.unionByName(rest), "resolved")
    drop(near, told, first)
    best = out.groupBy("call").agg(F.min(F.struct("t", "id", "confidence")).alias("b"))
    strategy = F.element_at(F.array(*(F.lit(x) for x in ("import_map", "same_module", "unique", "suffix", "fuzzy_name", "fallback"))), F.col("b.t") + 1)
    return best.select("call", "b.id", strategy.alias("strategy"), "b.confidence")


def _near_names(asked: DataFrame, found: DataFrame, least: float = 0.72) -> DataFrame:
    """Pairs of ``asked`` and ``found`` names that score ``least`` at least, with the score s.

    Shared letters give 0.4 at most, so the common prefix has (least - 0.4) / 0.6 of the longer name.
    The longer one offers its prefix of just that length, the shorter every prefix that long names
    could need: names meet by an equality, and none that is similar enough is missed.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    share = (least - 0.4) / 0.6

    def keys(df: DataFrame, name: str, longer: bool) -> DataFrame:
        n = F.length("p")
        need = F.ceil(n * share - 1e-9).cast("int")
        df = df.withColumn("p", plain(name)).where("p <> ''").withColumn("need", F.greatest(F.lit(1), need))
        ends = F.array("need") if longer else F.sequence("need", n)
        return df.withColumn("end", F.explode(ends)).withColumn("key", F.substring("p", F.lit(1), F.col("end"))).drop("p", "need", "end")

    pairs = keys(asked, "asked", True).join(keys(found, "found", False).hint("merge"), "key").unionByName(keys(asked, "asked", False).join(keys(found, "found", True).hint("merge"), "key"))
    return pairs.drop("key").distinct().withColumn("s", fuzzy_score(F.col("asked"), F.col("found"))).where(F.col("s") >= least)


def fuzzy_score(a: Column, b: Column) -> Column:
    """0.6 of the common prefix and 0.4 of the shared letters, over the longer length; names by letters and digits alone."""
    x, y = (F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in (a, b))
    longest = F.greatest(F.length(x), F.length(y))
    steps = F.sequence(F.lit(1), F.least(F.length(x), F.length(y)))
    prefix = F.size(F.filter(steps, lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i)))
    prefix = F.when(F.least(F.length(x), F.length(y)) > 0, prefix).otherwise(0)
    count = lambda s, c: F.size(F.split(s, c)) - 1
    letters = F.array_distinct(F.split(x, ""))
    shared = F.aggregate(letters, F.lit(0), lambda acc, c: acc + F.when(c == "", 0).otherwise(F.least(count(x, c), count(y, c))))
    return F.when(longest > 0, 0.6 * prefix / longest + 0.4 * shared / longest).otherwise(0.0)


def git_log(lines: DataFrame) -> DataFrame:
    """Rows of ``--numstat`` logs, a commit a text record: (sha, file_path, insertions, deletions, old_path); dashes are binary files."""
    body = F.explode(F.filter(F.split("record", "\n"), lambda x: x.rlike(r"^[0-9-]+\t[0-9-]+\t"))).alias("l")
    x = lines.select("sha", body).select("sha", F.split("l", "\t").alias("p"))
    number = lambda i: F.when(F.col("p")[i] != "-", F.col("p")[i]).cast("int")
    renamed = F.regexp_extract(F.col("p")[2], r"^(.*) => (.*)$", 1)
    new = F.when(renamed != "", F.regexp_extract(F.col("p")[2], r"^(.*) => (.*)$", 2)).otherwise(F.col("p")[2])
    return x.select("sha", new.alias("file_path"), number(0).alias("insertions"), number(1).alias("deletions"), F.when(renamed != "", renamed).alias("old_path"))
