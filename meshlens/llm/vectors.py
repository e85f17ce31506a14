"""Near-duplicate vectors by Euclidean p-stable hashing (operator 8).

Vectors are normalised in double precision; a cosine of 0.98 is a distance of 0.2. In each of
``TABLES`` tables ``ROWS`` Gaussian projections are shifted, cut into cells of ``CELL`` and hashed
together with the label. Vectors that share a table's bucket are compared exactly.

Equal vectors of a label are one class, represented by its smallest id, numbered, and weighted by
its size. Of buckets with the same members in several tables only the first is compared. A pair
counts in the first table whose bucket it shares, so no list of pairs is built or made distinct: a
bucket returns, for each member, the weight of its links and one link into its component. Buckets
above ``BLOCK`` members are dealt into pairs of blocks, each its own group.

Chance that a pair at cosine 0.98 shares no bucket: (1 - 0.84^10)^72 = 1e-6, less above it. Unrelated
vectors share one with a chance of 2e-6 a table, so buckets stay small as tables grow.

Defined results: vectors with a null label, null themselves, empty, of length zero or with null or
non-finite components link with nothing, as does a null id; each is kept; vectors of unequal
dimensions never link; labels may be of any atomic type and are equal as they are; repeated rows are
vectors of their own in the counts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .common import components, written

TABLES, ROWS, CELL, BLOCK = 72, 10, 1.0, 512
#: Groups up to this size are compared together, larger ones by a matrix product each.
SMALL = 48
SEED = 8128
SALTS = 32


def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * ROWS)), rng.random(TABLES * ROWS) * CELL


def bucket_keys(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A key for each vector and table."""
    a, shift = projections(unit.shape[1])
    cells = np.floor((unit @ a + shift) / CELL).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, ROWS)
    mul = np.random.default_rng(SEED + 1).integers(1, 1 << 63, (TABLES, ROWS), dtype=np.uint64) | np.uint64(1)
    h = (cells * mul).sum(axis=2, dtype=np.uint64) + label.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(unit.shape[1])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _pairs(cell: np.ndarray, own: np.ndarray, same: np.ndarray, label: np.ndarray, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell (rows are sorted by it) at ``least`` cosine; of a pair of blocks only pairs between the two."""
    edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(edge, len(cell)))
    out = []
    of = np.repeat(size, size)
    for d in range(1, min(SMALL, int(size.max()))):
        i = np.flatnonzero((cell[:-d] == cell[d:]) & (of[:-d] <= SMALL) & (same[:-d] | (own[:-d] != own[d:])))
        for part in np.array_split(i, 1 + len(i) // 100_000):
            out.append((part, part + d))
    for a, n in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist()):
        u = unit[a : a + n]
        hit = np.triu(u @ u.T >= least - 1e-9, 1)
        if not same[a]:
            hit &= own[a : a + n, None] != own[None, a : a + n]
        i, j = np.nonzero(hit)
        out.append((i + a, j + a))
    kept = []
    for i, j in out:  # one sum for all, whichever way a pair was found
        ok = (np.einsum("ij,ij->i", unit[i], unit[j]) >= least) & (label[i] == label[j])
        kept.append((i[ok], j[ok]))
    return (np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])) if kept else (np.empty(0, np.int64),) * 2


def _meet(batches: Iterator[pd.DataFrame], least: float, rows_at_once: int = 20_000) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by cell; whole cells are compared together. Returns each row's new link weight and the smallest id it is joined to."""

    def judge(df: pd.DataFrame) -> pd.DataFrame:
        parts = [judge_one(part) for _, part in df.groupby(df["unit"].map(len), sort=False)]
        return pd.concat(parts, ignore_index=True)

    def judge_one(df: pd.DataFrame) -> pd.DataFrame:
        unit, keys = np.stack(df["unit"].to_numpy()), np.stack(df["keys"].to_numpy())
        ids, copies, t = df["node"].to_numpy(np.int64), df["copies"].to_numpy(np.int64), df["t"].to_numpy()
        i, j = _pairs(df["cell"].to_numpy(), df["own"].to_numpy(), df["same"].to_numpy(bool), df["label"].to_numpy(np.int64), unit, least)
        fresh = np.empty(len(i), bool)
        for at in np.array_split(np.arange(len(i)), 1 + len(i) // 100_000):
            fresh[at] = ~((keys[i[at]] == keys[j[at]]) & (np.arange(keys.shape[1]) < t[i[at], None])).any(axis=1)
        i, j = i[fresh], j[fresh]
        weight = np.zeros(len(df), np.int64)
        np.add.at(weight, i, copies[j])
        np.add.at(weight, j, copies[i])
        order = np.argsort(ids, kind="stable")  # labels are places in id order, so the least label is the least id
        label = np.empty(len(df), np.int64)
        label[order] = np.arange(len(df))
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        some = weight > 0
        return pd.DataFrame({"node": ids[some], "weight": weight[some], "root": ids[order][label[some]]})

    held, n = [], 0
    for b in batches:
        if b.empty:
            continue
        held.append(b)
        n += len(b)
        if n >= rows_at_once:
            df = pd.concat(held, ignore_index=True)
            cut = int(df["cell"].searchsorted(df["cell"].iloc[-1]))
            if cut:
                yield judge(df.iloc[:cut])
                df = df.iloc[cut:]
            held, n = [df], len(df)
    if held:
        yield judge(pd.concat(held, ignore_index=True))


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    good &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    label = F.col(label_col) + 0.0 if isinstance(vectors.schema[label_col].dataType, (DoubleType, FloatType)) else F.col(label_col)  # -0.0 is 0.0
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), label.cast("string").alias("label"), F.coalesce(good, F.lit(False)).alias("good"))
    # 0.0 and -0.0 are one value in a sum of products, so they are one here
    rows = rows.withColumn("v", F.when(F.col("good"), F.transform("v", lambda x: x + 0.0)))
    said = F.concat_ws(",", F.col("label"), F.transform("v", lambda x: x.cast("string")))
    rows = written(rows.select("id", "v", F.xxhash64("label").alias("label"), "good", F.when(F.col("good"), F.unhex(F.sha2(said, 256))).alias("c")), "vectors", 50_000)
    groups = written(rows.where("good").groupBy("c").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = rows.where("good").join(groups, "c").where("id = rep").dropDuplicates(["c"]).select(F.monotonically_increasing_id().alias("node"), "c", "id", "v", "label", "copies")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(b["v"].map(len), sort=False):
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                unit = x / (np.abs(x).max(axis=1, keepdims=True))
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "c": part["c"].to_numpy(), "id": part["id"].array, "label": part["label"].to_numpy(), "copies": part["copies"].to_numpy(), "unit": list(unit), "keys": list(bucket_keys(unit, part["label"].to_numpy(np.int64)))})

    kind = vectors.schema[id_col].dataType.simpleString()
    reps = written(reps.mapInPandas(hashed, f"node bigint, c binary, id {kind}, label bigint, copies bigint, unit array<double>, keys array<bigint>"), "hashed", 20_000)
    tabled = reps.select("node", F.posexplode("keys").alias("t", "key"))
    many = tabled.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor")).where("n > 1")
    many = many.groupBy("n", "low", "high", "sum", "xor").agg(F.min(F.struct("t", "key")).alias("b")).select("b.t", "b.key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = tabled.join(many, ["t", "key"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # block i meets i..blocks-1 as the first of a pair, and 0..i as the second
    dealt = met.withColumn("own", block).select("node", "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("node", "t", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "own", (F.col("own") == F.col("other")).alias("same"))
    dealt = dealt.join(reps.drop("c", "id"), "node").select("cell", "t", "own", "same", "node", "label", "copies", "unit", "keys")

    got = dealt.repartition("cell").sortWithinPartitions("cell").mapInPandas(lambda it: _meet(it, least), "node bigint, weight bigint, root bigint")
    got = written(got, "links")
    weight = got.groupBy("node").agg(F.sum("weight").alias("weight"))
    comp = written(components(got.select(F.col("node").alias("a"), F.col("root").alias("b"))), "components")
    known = reps.select("node", "c", "id").join(comp, "node")
    # a component may hold most vectors: its name is sent to SALTS places
    smallest = known.groupBy("component").agg(F.min("id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    linked = salted.join(smallest, ["component", "salt"]).join(weight, "node").select("c", "component_id", "weight")
    out = rows.select("id", "c").join(groups, "c", "left").join(linked, "c", "left")
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("weight", F.lit(0))
    return out.select(F.col("id").alias(id_col), n_links.cast("long").alias("n_links"), F.coalesce("component_id", "rep", "id").alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
