"""Commit-history analytics: hotspots, co-change, ownership, bus factor, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as X
from .kernels import cut


def touch_weight() -> Column:
    return F.coalesce(F.col("insertions"), F.lit(0)) + F.coalesce(F.col("deletions"), F.lit(0)) + 1


def touches(commits: DataFrame, deltas: DataFrame) -> DataFrame:
    """Deltas with their commit's repository, author and date."""
    return deltas.join(commits.select("repo", "sha", "author_email", "date"), "sha")


def hotspots(commits: DataFrame, deltas: DataFrame, now: int, tau_days: float = 90.0, complexity: DataFrame | None = None, by: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Per file: commits in all and in 90, 180 and 365 days, last date and decayed weight.

    Deleted and type-changed files do not count, nor do commits more than five minutes ahead of ``now``;
    missing line counts (binary files) are zero.
    """
    t = touches(commits, deltas).where(~F.col("change_kind").isin("deleted", "type_changed") & (F.col("date") <= now + 300))
    age = X.age_days(F.col("date"), F.lit(now))
    recent = lambda n: F.count_distinct(F.when(age <= n, F.col("sha"))).alias(f"commits_{n}d")
    out = t.groupBy(*by).agg(F.count_distinct("sha").alias("total_commits"), recent(90), recent(180), recent(365), F.max("date").alias("last_modified"), F.sum(X.decay(age, tau_days) * touch_weight()).alias("score"))
    if complexity is not None:
        out = out.join(complexity, list(by), "left").withColumn("score", F.col("score") * F.coalesce("complexity", F.lit(1.0))).drop("complexity")
    return out


def co_changes(commits: DataFrame, deltas: DataFrame, now: int, tau_days: float = 180.0, max_files: int = 128, min_occurrences: int = 2) -> DataFrame:
    """(repo, file_a, file_b, occurrences, strength, last_seen) of files changed together.

    Commits of more than ``max_files`` files say nothing of any two and are left out, which also
    bounds the pairs of a commit. Pairs are summed before they are shuffled.
    """
    files = deltas.select("sha", "file_path").distinct()
    small = files.groupBy("sha").agg(F.array_sort(F.collect_list("file_path")).alias("files")).where(F.size("files").between(2, max_files))
    at = small.join(commits.select("repo", "sha", "date"), "sha").where(F.col("date") <= now + 300)
    first = at.select("repo", "date", "files", F.posexplode("files").alias("i", "file_a"))
    pairs = first.select("repo", "date", "file_a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("file_b"))
    strength = F.sum(X.decay(X.age_days(F.col("date"), F.lit(now)), tau_days)).alias("strength")
    return pairs.groupBy("repo", "file_a", "file_b").agg(F.count(F.lit(1)).alias("occurrences"), strength, F.max("date").alias("last_seen")).where(F.col("occurrences") >= min_occurrences)


def ownership(commits: DataFrame, deltas: DataFrame, by: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Per file and author: weight, share of the file, rank (heaviest first, then by name)."""
    w = touches(commits, deltas).groupBy(*by, "author_email").agg(F.sum(touch_weight()).cast("long").alias("weight"))
    per = Window.partitionBy(*by)
    return w.withColumn("pct", F.col("weight") / F.sum("weight").over(per)).withColumn("rank", F.row_number().over(per.orderBy(F.desc("weight"), "author_email")))


def bus_factor(owned: DataFrame, by: tuple[str, ...] = ("file_path",), share: float = 0.8) -> DataFrame:
    """The fewest top authors that hold ``share`` of a file, with the first of them."""
    w = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("weight").over(Window.partitionBy(*by))
    cum = owned.withColumn("enough", F.sum("weight").over(w) * 1000 >= F.lit(int(share * 1000)) * total)
    return cum.groupBy(*by).agg(F.min(F.when(F.col("enough"), F.col("rank"))).alias("bus_factor"), F.min_by("author_email", "rank").alias("top_owner"), F.max("pct").alias("top_owner_pct"))


def owner_risks(factors: DataFrame, share: float = 0.8) -> DataFrame:
    return factors.where(F.col("top_owner_pct") >= share)


def rename_chain(renames: DataFrame) -> DataFrame:
    """(repo, old_path, latest): the name each old name ends at, however long the chain.

    ``renames`` has repo, old_path, new_path and date; a name's next rename is the first after the last
    one taken, so a name that is used again starts anew and cycles end. A round follows one rename of
    each chain that goes on.
    """
    edges = cut(renames.select("repo", F.col("old_path").alias("from"), F.col("new_path").alias("to"), "date"))
    at = edges.select("repo", F.col("from").alias("old_path"), F.col("to").alias("latest"), F.col("date").alias("since"), F.array("from", "to").alias("seen"))
    first = Window.partitionBy("repo", "old_path").orderBy("since", "latest")
    at = cut(at.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r"))
    done = None
    while True:
        a, e = at.alias("a"), edges.alias("e")
        j = a.join(e, F.expr("a.repo = e.repo and a.latest = e.`from` and e.date > a.since and not array_contains(a.seen, e.`to`)"), "left")
        j = j.select("a.repo", "old_path", "latest", "since", "seen", "to", "e.date")
        r = F.row_number().over(Window.partitionBy("repo", "old_path").orderBy(F.col("date").asc_nulls_last(), "to"))
        j = cut(j.withColumn("r", r).where("r = 1").drop("r"))
        ended = j.where("to is null").select("repo", "old_path", "latest")
        done = ended if done is None else done.unionByName(ended)
        at = j.where("to is not null").select("repo", "old_path", F.col("to").alias("latest"), F.col("date").alias("since"), F.array_append("seen", F.col("to")).alias("seen"))
        if at.isEmpty():
            return done


def canonical(commits: DataFrame, deltas: DataFrame, latest: DataFrame) -> DataFrame:
    """Deltas under the names that their files bear now; ``latest`` is as from :func:`rename_chain`."""
    names = latest.select("repo", F.col("old_path").alias("file_path"), "latest")
    j = deltas.join(commits.select("sha", "repo"), "sha").join(names, ["repo", "file_path"], "left")
    return j.withColumn("file_path", F.coalesce("latest", "file_path")).select(*deltas.columns)


def file_history(commits: DataFrame, deltas: DataFrame, renames: DataFrame, path: str) -> DataFrame:
    """Commits that touched a path under any of its names."""
    names = rename_chain(renames).where(F.col("latest") == path).select(F.col("old_path").alias("file_path"))
    names = names.unionByName(names.sparkSession.createDataFrame([(path,)], "file_path string")).distinct()
    return touches(commits, deltas.join(names, "file_path", "left_semi"))


def materialized_edges(owned: DataFrame, pairs: DataFrame, top: int = 5) -> DataFrame:
    """Ownership and the strongest co-changes as edges with weight and confidence."""
    o = owned.where("rank = 1").select(F.col("file_path").alias("source"), F.col("author_email").alias("target"), F.lit("owned_by").alias("kind"), F.col("weight").cast("int").alias("weight"), F.round(F.col("pct") * 1000).cast("int").alias("confidence"))
    both = pairs.select("file_a", "file_b", "occurrences", "strength").unionByName(pairs.select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b"), "occurrences", "strength"))
    r = F.row_number().over(Window.partitionBy("file_a").orderBy(F.desc("occurrences"), "file_b"))
    c = both.withColumn("r", r).where(F.col("r") <= top).select(F.col("file_a").alias("source"), F.col("file_b").alias("target"), F.lit("co_changes_with").alias("kind"), F.col("occurrences").cast("int").alias("weight"), F.least(F.lit(1000), F.col("occurrences") * 100).cast("int").alias("confidence"))
    return o.unionByName(c)


def version_mismatches(packages: DataFrame) -> DataFrame:
    """(package, repo, version) of packages with several versions; of neighbours in (repo, version) order equal versions collapse."""
    w = Window.partitionBy("package").orderBy("repo", "version")
    kept = packages.withColumn("before", F.lag("version").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("version")))
    return kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("package"))).where("n > 1").select("package", "repo", "version")
