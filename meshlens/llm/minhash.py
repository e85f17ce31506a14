"""b-bit MinHash near-duplicates (operator 4).

A document's sketch is the minimum of ``bands * ROWS`` hash functions over its word shingles, with
``bands`` from the threshold.
Bands of ``ROWS`` minima give candidates; the low two bits of each minimum, packed into words,
give their estimated similarity by bit counts, corrected for the quarter of bits that agree by
chance. Only candidates whose estimate lies within ``MARGIN`` of the threshold are compared on
their full sets, so neither sketch decides a link.

Documents with equal sets are one class; classes, not copies, are numbered and compared. No group's
pairs are listed: of a band's bucket each member is paired with the smallest one. Confirmed links
give components; where a bucket still holds several, the members of all but the largest are
compared with it and with each other, block by block, and return one link per member and component.

Chance of a lost candidate at a threshold of 0.85: (1 - 0.85^8)^40 = 3.0e-6, and that of a too low
estimate 2.9e-5; at 0.80: (1 - 0.8^8)^72 = 1.8e-6 and 9.8e-7. All fall fast above the threshold.

Defined results: null and wordless texts have no shingles, are linked with nothing and kept; fewer
words than a shingle has are one shingle; rows of one id with different texts are documents of their
own, linked by their texts; a null id is linked with nothing and kept; other columns are not read.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop, map_texts, written

BANDS, ROWS = 40, 8
LOST = 3e-6
MARGIN = 0.10
BROADCAST_ROWS = 1_000_000
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def bands_for(percent: int) -> int:
    """Bands, a multiple of four and at least ``BANDS``, that lose a candidate at the threshold with chance ``LOST`` at most."""
    if percent >= 100:
        return BANDS
    wanted = math.log(LOST) / math.log1p(-((percent / 100) ** ROWS))
    return max(BANDS, 4 * math.ceil(wanted / 4))


@cache
def _hashes(bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    mul = rng.integers(0, 1 << 31, bands * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * ROWS, dtype=np.uint32)
    return mul, add, rng.integers(0, 1 << 63, (bands, ROWS), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of n-word shingles; words are what ASCII white space separates, A-Z lower-cased."""
    import xxhash

    if not isinstance(text, str):
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    k = min(n, len(h))
    acc = h[: len(h) - k + 1] * _P + np.uint64(k)
    for i in range(1, k):
        acc = _mix(acc) * _R + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(acc))


def minima(s: np.ndarray, bands: int = BANDS, block: int = 512) -> np.ndarray:
    mul, add, _ = _hashes(bands)
    low = np.full(bands * ROWS, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), block):
        np.minimum(low, (x[i : i + block, None] * mul + add).min(axis=0), out=low)
    return low


def sketch(sets: list[np.ndarray], bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (docs x bands) and packed two-bit minima (docs x words of 64 bits) of non-empty sets."""
    m = np.stack([minima(s, bands) for s in sets]) if sets else np.empty((0, bands * ROWS), np.uint32)
    m64 = m.astype(np.uint64)
    keys = _mix((_mix(m64.reshape(-1, bands, ROWS) * _P) * _hashes(bands)[2]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
    low = _mix(m64) & np.uint64(3)
    shift = np.arange(0, 64, 2, dtype=np.uint64)
    packed = (low.reshape(-1, bands * ROWS // 32, 32) << shift).sum(axis=2, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two longs that stand for each set."""
    import xxhash

    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").reshape(-1, 2).astype(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int = BANDS) -> DataFrame:
    """id, size, c1, c2 (digest of the set), bands, sig. One pass, no shuffle."""

    def run(texts: list) -> list[list]:
        sets = [shingles(t, n) for t in texts]
        full = [i for i, s in enumerate(sets) if len(s)]
        keys, sig = sketch([sets[i] for i in full], bands)
        k, g = [None] * len(sets), [None] * len(sets)
        for j, i in enumerate(full):
            k[i], g[i] = keys[j], sig[j]
        c = digests(sets)
        return [[len(s) for s in sets], c[:, 0], c[:, 1], k, g]

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(ids, "text", ("id",), "size bigint, c1 bigint, c2 bigint, bands array<bigint>, sig array<bigint>", run, rows=500)


def estimate(a: Column, b: Column, bands: int = BANDS) -> Column:
    """Similarity from two packed sketches: the share of equal two-bit minima, less the chance share."""
    odd = 0x5555555555555555
    unequal = F.lit(0)
    for i in range(bands * ROWS // 32):
        x = a[i].bitwiseXOR(b[i])
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(odd)))
    return (1.0 - unequal / F.lit(float(bands * ROWS)) - 0.25) / 0.75


def _few(df: DataFrame) -> DataFrame:
    """Broadcast a written table of numbers only below BROADCAST_ROWS rows; beyond it the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def similar(q: int, members: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Estimates of row ``q`` of packed sketches against the rows ``members``; as :func:`estimate`."""
    x = sig[members] ^ sig[q]
    unequal = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
    return (1.0 - unequal / (32 * sig.shape[1]) - 0.25) / 0.75


def confirm(queries: DataFrame, members: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, query_block: int = 256, member_block: int = 1024, words: int = 1 << 20) -> DataFrame:
    """Links (a, b) by full sets between ``queries(g, node, comp)`` and ``members(g, node, comp)`` of one g.

    Of each query one link to each other component is returned, if there is any. Queries and
    members are dealt into blocks, of a number of rows and of shingles, and every pair of blocks is
    one task's group: a text goes to as many groups as the other side has blocks, whatever the number
    of pairs. Within a group sketches say which pairs need their sets compared.
    """
    size_of = reps.select("node", "size")

    def blocks(df: DataFrame, out: str, rows: int) -> DataFrame:
        return df.join(size_of, "node").groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("size") / words)).cast("int").alias(out))

    sizes = written(blocks(queries, "qn", query_block).join(blocks(members, "mn", member_block), "g"), "sizes")
    deal = lambda df, own, other: df.join(sizes, "g").select("g", "node", "comp", F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
    q = deal(queries, "qn", "mn").select(F.xxhash64("g", "own", "other").alias("key"), "g", "node", "comp", F.lit(True).alias("query"))
    m = deal(members, "mn", "qn").select(F.xxhash64("g", "other", "own").alias("key"), "g", "node", "comp", F.lit(False).alias("query"))
    ends = written(q.unionAll(m), "ends")
    wanted = written(ends.select("node").distinct().join(reps.select("node", "id", "c1", "c2", "sig"), "node"), "wanted", 50_000)
    # repeated rows are one; an id's other texts are told from a class's own by the digest of their sets
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(_few(wanted.select("id").distinct()), "id", "left_semi")
    texts = texts.repartition("id").groupBy("id", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).drop("h")
    texts = texts.join(wanted, "id").select("node", "c1", "c2", "sig", "text")
    floor = percent / 100 - MARGIN

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in df.groupby("g", sort=False):
            part = part.sort_values("node").reset_index(drop=True)
            sets = [shingles(t, n) for t in part["text"]]
            own = (digests(sets) == part[["c1", "c2"]].to_numpy(np.int64)).all(axis=1)
            part, sets = part[own].reset_index(drop=True), [s for s, o in zip(sets, own) if o]
            if part.empty:
                continue
            node, comp, query = part["node"].to_numpy(np.int64), part["comp"].to_numpy(np.int64), part["query"].to_numpy(bool)
            size = np.array([len(x) for x in sets])
            sig = np.stack(part["sig"].to_numpy()).astype(np.int64).view(np.uint64)
            mem = np.flatnonzero(~query)
            for q in np.flatnonzero(query).tolist():
                close = np.minimum(size[mem], size[q]) * 100 >= np.maximum(size[mem], size[q]) * percent
                todo = mem[close & (comp[mem] != comp[q])]
                est = similar(q, todo, sig)
                todo = todo[est >= floor][np.argsort(-est[est >= floor], kind="stable")]
                linked = set()
                for j in todo.tolist():  # likeliest first; one link a component is enough
                    if comp[j] in linked:
                        continue
                    at = np.searchsorted(sets[q], sets[j])
                    at[at == size[q]] = 0
                    both = int((sets[q][at] == sets[j]).sum())
                    if 100 * both >= percent * int(size[q] + size[j] - both):
                        linked.add(comp[j])
                        a.append(node[q])
                        b.append(node[j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    out = written(ends.join(texts, "node").groupBy("key").applyInPandas(compare, "a bigint, b bigint"), "confirmed")
    drop(sizes, ends, wanted)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 85) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    bands = bands_for(percent)
    sig = written(signatures(docs, id_col, text_col, n, bands), "signatures", 20_000)
    usable = sig.where("size > 0 and id is not null")
    # equal sets have equal sketches, so any row's will do
    groups = usable.groupBy("c1", "c2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    copied = written(groups.where("copies > 1").select("c1", "c2", F.col("id").alias("rep")), "copied")
    reps = usable.join(copied, ["c1", "c2"], "left").where("rep is null or rep = id").dropDuplicates(["c1", "c2"])
    reps = written(reps.select(F.monotonically_increasing_id().alias("node"), "id", "c1", "c2", "bands", "sig", "size"), "reps", 20_000)
    banded = reps.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    shared = written(banded.join(buckets, "key"), "shared")
    floor = percent / 100 - MARGIN

    def close(pairs: DataFrame) -> DataFrame:
        """(a, b, est) of the pairs that may be links by their sketches and sizes."""
        s = reps.select("node", "sig", "size")
        j = pairs.join(s.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("size").alias("nb")), "b").join(s.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("size").alias("na")), "a")
        j = j.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        return j.withColumn("est", estimate(F.col("sa"), F.col("sb"), bands)).where(F.col("est") >= floor).select("a", "b", "est")

    star = written(close(shared.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()), "star")
    best = star.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a"))
    alone = lambda c: best.select(F.xxhash64("a").alias("g"), F.col(c).alias("node"), F.col(c).alias("comp"))
    links = confirm(alone("b"), alone("a").distinct(), reps, docs, id_col, text_col, n, percent)
    found = written(components(links), "components")
    drop(star)

    # Buckets that still hold several components: members of all but the largest are compared with
    # it, and with each other. No list of pairs is made of either.
    placed = shared.select("key", "node").join(found.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = written(placed, "placed")
    per = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("key").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = written(placed.join(main, "key").select("key", "node", "comp", "main", "parts"), "mixed")
    # hashes that should collide would only make two groups one
    to_main, in_bucket = F.xxhash64(F.lit(0), "main"), F.xxhash64(F.lit(1), "key")
    minor = mixed.where("comp <> main")
    some = minor.where("parts > 2").select(in_bucket.alias("g"), "node", "comp")
    queries = minor.select(to_main.alias("g"), "node", "comp").distinct().unionAll(some)
    members = mixed.where("comp = main").select(to_main.alias("g"), "node", "comp").distinct().unionAll(some)
    more = confirm(queries, members, reps, docs, id_col, text_col, n, percent)
    if more.limit(1).count():
        first, found = found, written(components(links.unionAll(more)), "components")
        drop(first)
    drop(shared, placed, mixed)

    # a component is told by the smallest id of its classes
    named = found.join(reps.select("node", "id", "c1", "c2"), "node")
    least = named.groupBy("component").agg(F.min("id").alias("comp"))
    joined = written(named.join(least, "component").select("c1", "c2", "comp"), "joined")
    lone = copied.join(joined.select("c1", "c2"), ["c1", "c2"], "left_anti").select("c1", "c2", F.col("rep").alias("comp"))
    out = sig.join(joined.unionByName(lone), ["c1", "c2"], "left")
    comp = F.when((F.col("size") > 0) & F.col("id").isNotNull(), F.coalesce("comp", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), comp.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each group, all columns kept: five-word shingles, similarity 0.8 or more, unless told otherwise.

    Rows of one id stay or go together: they go if any of them is a copy of a smaller id. Rows without an id stay.
    """
    gone = written(classes(docs, id_col, text_col, n, percent).where("not kept").select(F.col(id_col)).distinct(), "gone")
    return docs.join(_few(gone), id_col, "left_anti").select(*docs.columns)
