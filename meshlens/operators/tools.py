"""Bodies of tools: orientation, symbols, repository dependencies, change-set reports, result comparison, traces."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as X
from .counts import anchor_scores
from .kernels import diff, within_budget

# Names of calls that no edge of a workspace can resolve, and what receivers mark them.
GLOBAL_CALLS = "settimeout cleartimeout setinterval clearinterval requestanimationframe cancelanimationframe parseint parsefloat encodeuricomponent decodeuricomponent isnan date promise map set resolve reject toisostring".split()
CLIENT_CALLS = (
    ("get post put patch delete head options request", "http api client fetch request"),
    ("emit send sendmessage publish produce", "bus client event kafka producer publisher"),
    ("create save find findone findall findmany findoneandupdate findoneanddelete findbyidandupdate findbyidanddelete updateone updatemany deleteone deletemany insertmany count aggregate exec", "model repository orm mongoose prisma typeorm sequelize"),
    ("createforclass", "schemafactory"),
)
RUNTIME_RECEIVERS = "cy. console. process. snackbar. document. window.location. observer. intl.datetimeformat object. array. json. math. date. promise. queryclient. theme. urlsearchparams".split()
UNCALLED_FILES = ("/cypress/", "/__tests__/", "/__mocks__/")
# Argument names whose strings are traced as they are.
VERBATIM = ("mode", "scope", "kind", "language", "direction", "strategy")
# What two AI contracts are compared by.
FACETS = ("provider", "model", "temperature", "inference_kind", "source_type_name", "schema_format")
PR_SET_VERSION = 0


# --- orientation and lookups ---------------------------------------------------------------------


def graph_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(side, kind, n) of the node and edge kinds that occur."""
    count = lambda df, side: df.groupBy(F.lit(side).alias("side"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return count(nodes, "node").unionByName(count(edges, "edge"))


def list_repos(nodes: DataFrame) -> DataFrame:
    """Files and symbols of each real repository."""
    n = nodes.where(X.is_real_repo(F.col("repo")))
    return n.groupBy("repo").agg(F.count_distinct("file_path").alias("files"), F.count_if(F.col("kind") != "file").alias("symbols"))


def get_symbol(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row for each wanted id, found or not, with its decorators."""
    d = edges.where("kind = 'uses_decorator'").groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("decorators"))
    n = nodes.select("id", "kind", "repo", "file_path", "name", F.lit(True).alias("found"))
    return wanted.select("id").distinct().join(n, "id", "left").join(d, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"), "kind", "repo", "file_path", "name", F.coalesce("decorators", F.lit("")).alias("decorators"))


def cross_repo_deps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, other, edge_kinds, support): repositories that a repository's edges lead to, with the kinds that lead there."""
    n = nodes.select("id", "repo")
    e = edges.join(n.select(F.col("id").alias("source"), "repo"), "source").join(n.select(F.col("id").alias("target"), F.col("repo").alias("other")), "target").where("repo <> other")
    return e.groupBy("repo", "other").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("edge_kinds"), F.least(F.lit(1000), F.count(F.lit(1)) * 10).cast("int").alias("support"))


def evidence_rows(found: DataFrame, kind: str, source: str, citation: list[str], subject: str, support: str) -> DataFrame:
    """Rows as evidence (id, kind, source, citation, subject, support): the id depends on all but the support, which lies in 0..1000."""
    cite = F.concat_ws(":", *citation)
    digest = F.substring(F.sha2(F.concat_ws("\x00", F.lit(kind), F.lit(source), cite, F.col(subject)), 256), 1, 16)
    return found.select(digest.alias("id"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), cite.alias("citation"), F.col(subject).alias("subject"), F.greatest(F.lit(0), F.least(F.lit(1000), F.col(support))).cast("int").alias("support"))


def inline_code(c: Column) -> Column:
    """Text as inline code that no backtick in it can end."""
    return F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("'")), F.lit("`"))


def render_chains(steps: DataFrame) -> DataFrame:
    """(chain, text): each chain's steps (chain, step, source, kind, target) as text, a line a step after the anchor's."""
    line = F.concat(F.lit(" → "), "kind", F.lit(" "), inline_code(F.col("target")))
    g = steps.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("s"), F.min_by("source", "step").alias("anchor"))
    return g.select("chain", F.concat_ws("\n", inline_code(F.col("anchor")), F.transform("s", lambda x: x["line"])).alias("text"))


# --- unresolved calls ----------------------------------------------------------------------------


def non_actionable(path: Column, name: Column, hint: Column, external: Column | None = None) -> Column:
    """Calls that cannot become edges inside a workspace: of test helpers, globals, setters, transports, stores and runtimes.

    ``hint`` is the call as written, ``external`` an array of names that come from outside.
    """
    low, told = F.lower(name), F.lower(F.coalesce(hint, F.lit("")))
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    rules = [any_of([path.contains(p) for p in UNCALLED_FILES]), path.rlike(r"\.(cy|stories)\.[jt]sx?$"), low.isin("fetch", *GLOBAL_CALLS), name.rlike(r"^set\p{Lu}"), name == "navigate"]
    rules += [low.isin(*names.split()) & any_of([told.contains(s) for s in segments.split()]) for names, segments in CLIENT_CALLS]
    rules += [any_of([told.startswith(r) for r in RUNTIME_RECEIVERS]), told.isin("promise", "date", "map")]
    if external is not None:
        head = F.coalesce(F.get(F.filter(F.split(F.coalesce(hint, F.lit("")), r"\."), lambda s: ~s.isin("", "this", "self")), F.lit(0)), F.lit(""))
        rules += [F.array_contains(external, name), F.array_contains(external, head)]
    return F.coalesce(any_of(rules), F.lit(False))


def unresolved_counts(candidates: DataFrame) -> DataFrame:
    """(repo, unresolved): calls that resolution left over."""
    return candidates.groupBy("repo").agg(F.count(F.lit(1)).alias("unresolved"))


def pack_stats(packs: DataFrame) -> DataFrame:
    """One row: packs, their bytes and their hits."""
    return packs.agg(F.count(F.lit(1)).alias("packs"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("hits"))


# --- change sets ---------------------------------------------------------------------------------


def ai_contract_deltas(baseline: DataFrame, review: DataFrame) -> DataFrame:
    """(id, change, facet, before, after): contracts that came or went, and for changed ones a row for each facet that differs."""
    d = diff(baseline, review, ["id"], list(FACETS)).where("change <> 'same'")
    pair = lambda f: F.when((F.col("change") != "changed") | ~F.col(f"before_{f}").eqNullSafe(F.col(f"after_{f}")), F.struct(F.lit(f).alias("facet"), F.col(f"before_{f}").cast("string").alias("before"), F.col(f"after_{f}").cast("string").alias("after")))
    whole = F.struct(F.lit("contract").alias("facet"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    facets = F.when(F.col("change") == "changed", F.array_compact(F.array(*(pair(f) for f in FACETS)))).otherwise(F.array(whole))
    return d.select("id", "change", F.explode(facets).alias("x")).select("id", "change", "x.facet", "x.before", "x.after")


def pr_review(sections: dict[str, DataFrame], risks: DataFrame) -> DataFrame:
    """A review's rows: section, key, change, severity. ``sections`` maps a name to (key, change); ``risks`` has key and severity.

    A change without a risk of its own is low if something was added and medium otherwise.
    """
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(s).alias("section"), "key", "change") for s, df in sections.items()))
    default = F.when(F.col("change") == "added", "low").otherwise("medium")
    return rows.join(risks.select("key", "severity").distinct(), "key", "left").select("section", "key", "change", F.coalesce("severity", default).alias("severity"))


def review_summary(rows: DataFrame) -> DataFrame:
    """Per section: changes by severity, and the verdict: blocked by a high one, attention by a medium one, else clear."""
    g = rows.groupBy("section").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")))
    return g.withColumn("verdict", F.when(F.col("high") > 0, "blocked").when(F.col("medium") > 0, "attention").otherwise("clear"))


def pr_set(manifests: DataFrame) -> DataFrame:
    """(set_id, pr, repo, base, head, problem) of PR-set manifests (column ``json``); a sound entry has no problem."""
    entry = "struct<id:string,repo:string,base:string,head:string,pr:bigint,depends_on:array<string>>"
    m = manifests.select(F.from_json("json", f"version int, id string, title string, prs array<{entry}>").alias("m")).select("m.*")
    known = F.transform("prs", lambda e: e["id"])
    x = m.select(F.col("id").alias("set_id"), "version", known.alias("known"), F.explode("prs").alias("e")).select("set_id", "version", "known", "e.*")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    problem = (
        F.when(F.coalesce("version", F.lit(-1)) != PR_SET_VERSION, "unsupported version").when(blank("set_id"), "empty set id").when(reduce(lambda a, b: a | b, (blank(c) for c in ("id", "repo", "base", "head"))), "empty field")
        .when(F.size(F.filter("known", lambda k: k == F.col("id"))) > 1, "duplicate id").when(F.size(F.array_except(F.coalesce("depends_on", F.array().cast("array<string>")), "known")) > 0, "unknown dependency")
    )
    return x.select("set_id", F.col("id").alias("pr"), "repo", "base", "head", problem.alias("problem"))


def compare_results(base: DataFrame, current: DataFrame) -> DataFrame:
    """(name, status, metric) of two result sets (name, platform, metric, value): new and missing results, unlike platforms, lost and worse metrics.

    A metric is worse if it is more than a tenth above the baseline's.
    """
    b, c = base.groupBy("name").agg(F.max("platform").alias("bp")), current.groupBy("name").agg(F.max("platform").alias("cp"))
    j = b.withColumn("b", F.lit(True)).join(c.withColumn("c", F.lit(True)), "name", "full_outer")
    whole = F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "missing").when(F.col("bp") != F.col("cp"), "platform_mismatch").otherwise("platforms_match")
    out = j.select("name", whole.alias("status"), F.lit(None).cast("string").alias("metric"))
    both = j.where("b and c").select("name")
    m = base.select("name", "metric", F.col("value").alias("bv")).join(both, "name", "left_semi").join(current.select("name", "metric", F.col("value").alias("cv"), F.lit(True).alias("has")), ["name", "metric"], "left")
    state = F.when(F.col("has").isNull() & F.col("bv").isNotNull(), "metric_missing").when(F.col("cv") > F.col("bv") * 1.1, "regressed")
    return out.unionByName(m.select("name", state.alias("status"), "metric").where("status is not null"))


# --- traces, filters, hits -----------------------------------------------------------------------


def filter_fields(text: Column) -> Column:
    """Sorted distinct field paths that a filter literal names as keys; operators are none."""
    found = F.regexp_extract_all(text, F.lit(r"""(?:'([^']*)'|"([^"]*)"|([A-Za-z_$][A-Za-z0-9_$.]*))\s*:"""), F.lit(0))
    keys = F.transform(found, lambda k: F.trim(F.regexp_replace(k, r"""^['"]|['"]?\s*:$""", "")))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.rlike(r"^[A-Za-z0-9_.]+$"))))


def redact_arg(text: Column) -> Column:
    return F.concat(F.lit("h:"), F.substring(F.sha2(text, 256), 1, 8))


def redact_args(traces: DataFrame, json_col: str = "args") -> DataFrame:
    """``traces`` with ``summary``: the arguments' leaves as ``path=value`` joined by bars, strings hashed but for names of fixed choices."""
    import hashlib

    def leaves(value: object, path: str) -> Iterator[str]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from leaves(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from leaves(v, f"{path}[{i}]")
        elif isinstance(value, str) and path not in VERBATIM:
            yield f"{path}=h:{hashlib.sha256(value.encode()).hexdigest()[:8]}"
        else:
            yield f"{path}={value if isinstance(value, str) else json.dumps(value)}"

    def one(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append("|".join(leaves(json.loads(t), "")))
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return traces.withColumn("summary", F.pandas_udf(one, "string")(F.col(json_col)))


def page_with_skips(df: DataFrame, order: list[Column], kind: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows in order with how many there were in all, and of each kind how many were left out (``skipped``, a map)."""
    first = df.orderBy(*order).limit(limit)
    all_kinds = df.groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    shown = first.groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("s"))
    left = all_kinds.join(shown, "k", "left").withColumn("left", F.col("n") - F.coalesce("s", F.lit(0)))
    note = left.agg(F.sum("n").alias("total_seen"), F.array_sort(F.collect_list(F.when(F.col("left") > 0, F.concat_ws(":", "k", F.col("left").cast("string"))))).alias("skipped"))
    return first.join(F.broadcast(note))  # one row


def annotate_hits(hits: DataFrame, nodes: DataFrame, edges: DataFrame, used_by: DataFrame, budget: int | None = None) -> DataFrame:
    """Search hits (query, id, score) with whether other repositories use their file, anchors first; within ``budget`` bytes a query.

    ``used_by`` has file_path and consumer_repo.
    """
    consumers = used_by.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("consumer_repo")), ",").alias("consumer_repos"))
    n = nodes.select("id", "repo", "file_path").join(anchor_scores(nodes, edges).select("id", F.col("score").alias("anchor")), "id")
    j = hits.join(n, "id").join(consumers, "file_path", "left").select("query", "id", "score", "anchor", F.col("consumer_repos").isNotNull().alias("participates"), F.coalesce("consumer_repos", F.lit("")).alias("consumer_repos"))
    order = [F.desc("anchor"), F.desc("score"), F.col("id")]
    if budget is not None:
        j = within_budget(j, ["query"], order, F.octet_length(F.concat("id", "consumer_repos")), budget).drop("used")
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))


def plan_violations(plan: dict, sections: tuple[str, ...], version: int) -> list[str]:
    """What is wrong with a change plan's contract; nothing if it is sound."""
    out = [] if plan.get("schema_version") == version else [f"schema version {plan.get('schema_version')} instead of {version}"]
    if tuple(plan.get("sections") or ()) != tuple(sections):
        out.append("sections differ from the fixed ones")
    return out if plan.get("excluded") else [*out, "nothing is recorded as excluded"]
