"""Set differences between two snapshots, contract consolidation and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as X
from .kernels import diff


def consolidate(contracts: DataFrame) -> DataFrame:
    """One field row per target and side: type ("mixed" if types differ), optional if all are, least confidence."""
    f = contracts.select("target_id", "side", F.explode("fields").alias("f")).select("target_id", "side", "f.*")
    return f.groupBy("target_id", "side", "name").agg(
        F.when(F.count_distinct("type_name") > 1, F.lit("mixed")).otherwise(F.min("type_name")).alias("type_name"), F.bool_and("optional").alias("optional"), F.min("confidence").alias("confidence"))


def drift(contracts: DataFrame) -> DataFrame:
    """Per field that producer and consumer hold differently: type, then optionality, extra and missing fields. Targets with one side only have none."""
    c = consolidate(contracts)
    both = c.groupBy("target_id").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("target_id")
    c = c.join(both, "target_id", "left_semi")
    side = lambda s: c.where(F.col("side") == s).select("target_id", "name", *(F.col(x).alias(f"{s}_{x}") for x in ("type_name", "optional", "confidence")))
    j = side("producer").join(side("consumer"), ["target_id", "name"], "full_outer")
    kind = (
        F.when(F.col("consumer_type_name").isNull(), "extra_field").when(F.col("producer_type_name").isNull(), "missing_field")
        .when(F.lower("producer_type_name") != F.lower("consumer_type_name"), "type").when(F.col("producer_optional") != F.col("consumer_optional"), "optionality")
    )
    return j.withColumn("drift", kind).where("drift is not null").select("target_id", "name", "drift", "producer_type_name", "consumer_type_name", F.least("producer_confidence", "consumer_confidence").alias("confidence"))


def contract_filter(contracts: DataFrame, min_confidence: int | None = None, **equal: str | None) -> DataFrame:
    """Contracts by optional equalities and a least confidence, most certain first."""
    for c, v in equal.items():
        if v is not None:
            contracts = contracts.where(F.col(c) == v)
    if min_confidence is not None:
        contracts = contracts.where(F.col("confidence") >= min_confidence)
    return contracts.orderBy(F.desc("confidence"), "repo", "file_path", "id")


def breaking_candidates(contracts: DataFrame, repo: str, min_confidence: int = 750) -> DataFrame:
    """Drift of the targets that a repository's contracts name."""
    named = contracts.where((F.col("repo") == repo) & (F.col("confidence") >= min_confidence)).select("target_id").distinct()
    return drift(contracts).join(named, "target_id", "left_semi")


def field_deltas(baseline: DataFrame, review: DataFrame) -> DataFrame:
    """Fields added, removed, made required or optional, or of another type, by (repo, file, target, side)."""
    keys = ["repo", "file_path", "target_qn", "side", "name"]

    def fields(c: DataFrame) -> DataFrame:
        f = c.where(F.col("target_qn").isNotNull()).select("repo", "file_path", "target_qn", "side", F.explode("fields").alias("f")).select("repo", "file_path", "target_qn", "side", "f.name", "f.type_name", "f.optional")
        return f.groupBy(*keys).agg(F.max("type_name").alias("type_name"), F.bool_and("optional").alias("optional"))

    d = diff(fields(baseline), fields(review), keys, ["type_name", "optional"])
    what = (
        F.when(F.col("change").isin("added", "removed"), F.col("change")).when(~F.col("before_type_name").eqNullSafe(F.col("after_type_name")), "type_changed")
        .when(F.col("before_optional") & ~F.col("after_optional"), "now_required").when(~F.col("before_optional") & F.col("after_optional"), "now_optional")
    )
    return d.withColumn("delta", what).where("delta is not null").select(*keys, "delta")


def alignment(contracts: DataFrame, limit: int = 50) -> DataFrame:
    """Groups of contracts of one identity: members and the least Jaccard similarity of their field names, in thousandths."""
    tail = F.substring_index("target_qn", "__", -1)
    identity = F.regexp_replace(F.lower(tail), r"(payload|request|response|input|body|dto)$", "")
    names = lambda f: F.array_sort(F.array_distinct(F.transform(f, lambda x: x["name"])))
    # equal field sets compare alike, so sets are compared, not members
    sets = contracts.select(identity.alias("identity"), F.array_join(names(F.col("fields")), ",").alias("names")).groupBy("identity", "names").agg(F.count(F.lit(1)).alias("members"))
    total = sets.groupBy("identity").agg(F.sum("members").alias("members")).where("members >= 2")
    a, b = sets.select("identity", F.split("names", ",").alias("a")), sets.select("identity", F.split("names", ",").alias("b"))
    j = a.join(b, "identity").select("identity", (F.size(F.array_intersect("a", "b")) * 1000 / F.size(F.array_union("a", "b"))).cast("int").alias("s"))
    return total.join(j.groupBy("identity").agg(F.min("s").alias("confidence")), "identity").orderBy("confidence", "identity").limit(limit)


def removed_risks(removed: DataFrame, consumers: DataFrame, event: bool = False) -> DataFrame:
    """Severity of removed surfaces: none consumed is low, a consumer elsewhere (or of any event) high, else medium.

    ``removed`` has id and repo; ``consumers`` has target, source and repo of edges whose source survives.
    """
    c = consumers.select(F.col("target").alias("id"), "source", F.col("repo").alias("consumer_repo"))
    j = removed.join(c, "id", "left").groupBy("id", "repo").agg(F.count("source").alias("consumers"), F.count_if(F.col("consumer_repo") != F.col("repo")).alias("foreign"))
    high = (F.col("consumers") > 0) if event else (F.col("foreign") > 0)
    return j.withColumn("severity", F.when(F.col("consumers") == 0, "low").when(high, "high").otherwise("medium"))


def file_changes(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Added, modified, deleted and unchanged files by hash."""
    d = diff(stored, snapshot, ["repo", "file_path"], ["content_hash"])
    return d.select("repo", "file_path", F.when(F.col("change") == "changed", "modified").when(F.col("change") == "removed", "deleted").when(F.col("change") == "same", "unchanged").otherwise("added").alias("status"))


def affected_files(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Changed files and, one hop back, the files that depend on them."""
    deps = dependencies.join(changed.select(F.col("repo").alias("target_repo"), F.col("file_path").alias("target_path")), ["target_repo", "target_path"], "left_semi")
    return changed.select("repo", "file_path").unionByName(deps.select(F.col("source_repo").alias("repo"), F.col("source_path").alias("file_path"))).distinct()


def cross_pr_drift(changes: DataFrame) -> DataFrame:
    """Producer changes of a target without a consumer change of it in another pull request. ``changes``: pr, target, side."""
    p, c = changes.where("side = 'producer'").select("pr", "target").distinct(), changes.where("side = 'consumer'").select(F.col("pr").alias("other"), F.col("target").alias("t")).distinct()
    return p.join(c, (F.col("target") == F.col("t")) & (F.col("pr") != F.col("other")), "left_anti")


def affected_repos(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Each changed file's repository by its longest path prefix: an equality join on the prefixes a path has."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    j = files.select("path", F.explode(prefixes).alias("root")).join(repos, "root")
    w = Window.partitionBy("path").orderBy(F.desc(F.length("root")), "repo")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select("path", "repo")


def mirrors(literals: DataFrame) -> DataFrame:
    """Groups of specific literals with an authoritative member and two repositories, or a guard: (value, repo, symbol, authority)."""
    literals = literals.where(X.mirror_is_specific(F.col("value")))
    g = literals.groupBy("value").agg(F.bool_or("authoritative").alias("a"), F.count_distinct("repo").alias("r"), F.bool_or("guard").alias("g")).where("a and (r >= 2 or g)").select("value")
    m = literals.join(g, "value", "left_semi")
    top = m.where("authoritative").groupBy("value").agg(F.min("symbol").alias("authority"))
    return m.join(top, "value").where(F.col("symbol") != F.col("authority")).select("value", "repo", "symbol", "authority")


def mirror_risks(gained: DataFrame, mirrors: DataFrame) -> DataFrame:
    """(grp, surface, value): surfaces that mirror other values of a group but not one that its authority gained. ``gained``: grp, value; ``mirrors``: grp, surface, value."""
    m = mirrors.select("grp", "surface", "value").distinct()
    wanted = m.select("grp", "surface").distinct().join(gained, "grp")
    lacks = wanted.join(m, ["grp", "surface", "value"], "left_anti")
    # a surface that lacks the value mirrors others of the group, since it is a surface of the group
    return lacks.select("grp", "surface", "value")


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two reports has, duplicates counted."""
    cols = a.columns
    b = b.select(*cols)
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def recall_precision(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Recall and precision of actual rows within the kinds that are expected."""
    kinds = expected.select("kind").distinct()
    actual = actual.join(kinds, "kind", "left_semi").select(*keys).distinct()
    expected = expected.select(*keys).distinct()
    j = expected.withColumn("e", F.lit(1)).join(actual.withColumn("a", F.lit(1)), keys, "full_outer")
    both = F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull())
    return j.agg(both.alias("found"), F.round(both / F.count("e"), 6).alias("recall"), F.round(both / F.count("a"), 6).alias("precision"))
