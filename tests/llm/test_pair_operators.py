"""Operators 4 and 8 and the pipeline against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlens.llm import minhash, vectors


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_sets(rows, n):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def plain_classes(rows, n, percent):
    sets = plain_sets(rows, n)
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = closure(ids, links)
    comp[None] = None
    return sorted(str((i, len(sets[i]), comp[i], comp[i] == i)) for i, _ in rows)


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 4000, n)]


@pytest.fixture(scope="module")
def near():
    rng = np.random.default_rng(11)
    base = words(rng, 90)
    rows = [(i, " ".join(words(rng, int(rng.integers(1, 80))))) for i in range(100, 160)]
    for i in range(60):  # copies with 0 to 3 changed words: some link, some do only through others
        w = list(base)
        for _ in range(i % 4):
            w[int(rng.integers(0, 90))] = f"e{rng.integers(0, 9999)}"
        rows.append((200 + i, " ".join(w)))
    chain = words(rng, 120)
    for i in range(20):  # each links with its neighbours alone
        chain = chain[3:] + words(rng, 3)
        rows.append((400 - i, " ".join(chain)))
    same = " ".join(words(rng, 50))
    rows += [(500 + i, same.upper() if i % 2 else same) for i in range(30)]
    rows += [(600, None), (601, ""), (602, " \t"), (603, "one"), (604, "ONE"), (605, "one two"), (None, same), (607, "a b c " * 9000), (608, "a b c " * 9000 + "d"), (500, same), (609, "é\x85x y z"), (610, "É\x85x y z")]
    return rows


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_minhash(spark, near, n, percent):
    df = spark.createDataFrame(near, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("sig", F.lit("x")).repartition(3)
    got = minhash.classes(df, n=n, percent=percent).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_classes(near, n, percent)
    kept = minhash.deduplicate(df, n=n, percent=percent)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_minhash_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = minhash.classes(df).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_classes(rows, 3, 85)
    assert sum(not r.kept for r in got) > 20


def test_minhash_at_four_fifths(spark):
    # pairs of exactly 8 of 10 shingles that share none of 40 bands
    rows = []
    for i in (3473, 5392, 5432, 8611, 9985, 11319):
        w = [f"p{i}w{j}" for j in range(13)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:12], "x"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in minhash.deduplicate(df).collect()} == {i for i, _ in rows if i % 2 == 0}
    assert (1 - 0.8**minhash.ROWS) ** minhash.bands_for(80) <= 3e-6 and minhash.bands_for(85) == 40


def test_minhash_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.classes(empty).count() == 0 and minhash.deduplicate(empty).count() == 0


def test_estimate(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:340], rng.integers(0, 1 << 63, 60).astype(np.uint64)])
    _, sig = minhash.sketch([np.unique(a), np.unique(b), np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))])
    df = spark.createDataFrame([(sig[0].tolist(), sig[1].tolist(), sig[2].tolist())], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = df.select(minhash.estimate(F.col("a"), F.col("a")).alias("aa"), minhash.estimate(F.col("a"), F.col("b")).alias("ab"), minhash.estimate(F.col("a"), F.col("c")).alias("ac")).first()
    assert r.aa == 1.0 and abs(r.ab - 340 / 460) < 0.12 and abs(r.ac) < 0.15


def plain_links(rows, least=0.98):
    good = [(k, i, np.array(v, float) / max(map(abs, v)), l) for k, (i, v, l) in enumerate(rows) if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = {k: 0 for k in range(len(rows))}
    pairs = []
    for x, (k, i, v, l) in enumerate(good):
        for m, j, u, w in good[x + 1 :]:
            if l == w and len(v) == len(u) and (np.array_equal(v, u) or v @ u / np.sqrt((v @ v) * (u @ u)) >= least):
                n[k] += 1
                n[m] += 1
                pairs.append((i, j))
    comp = closure({r[0] for r in rows if r[0] is not None}, pairs)
    comp[None] = None
    return sorted(str((i, n[k], comp[i], comp[i] == i)) for k, (i, _, _) in enumerate(rows))


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist(), int(i % 3)) for i in range(150)]
    centre = rng.standard_normal(16)
    rows += [(1000 + i, (centre * rng.uniform(0.1, 9) + 0.045 * np.linalg.norm(centre) / 4 * 4 * rng.standard_normal(16) / 4).tolist(), i % 2) for i in range(120)]
    rows += [(2000 + i, [1.0] + [0.0] * 15, 1) for i in range(40)] + [(2100, [2.0] + [-0.0] * 15, 1)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [None] + [1.0] * 15, 1), (3004, [float("nan")] + [1.0] * 15, 1), (3005, [float("inf")] + [1.0] * 15, 1), (3006, [1.0] + [0.0] * 15, None), (None, [1.0] + [0.0] * 15, 1), (3008, [1.0, 0.0], 1), (3011, [1.0, 0.01], 1), (3012, [0.99, 0.0], 1), (3009, [1e-300] * 16, 1), (3010, [1e-300] * 16, 1), (2000, [1.0] + [0.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("keys", F.lit(2)).repartition(3)
    want = [str(x) for x in plain_links(rows)]
    assert sorted(str(tuple(r)) for r in vectors.links(df).collect()) == want
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "SMALL", 4)
    assert sorted(str(tuple(r)) for r in vectors.links(df).collect()) == want
    assert vectors.links(df.limit(0)).count() == 0


def test_vectors_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in df.collect()]
    assert sorted(str(tuple(r)) for r in vectors.links(df).collect()) == plain_links(rows)


def test_pipeline(spark):
    import hashlib

    from tokenizers import Tokenizer

    import corpus_pipeline
    from meshlens.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= seen.count()
        seen = out
    lib = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, seen, sf).collect()}
    for r in seen.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids == ids and got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((i, r.ids_sha256) for i, r in got.items())


def test_stages_survive_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    odd = spark.sql("""select cast(null as long) doc_id, cast(null as string) text, cast(null as string) lang, cast(null as string) source, cast(null as long) n_chars, 1.5d score, array('x') found, map('a', 1) sig, 'k' h, 9223372036854775807 id
        union all select 9223372036854775806, 'token: abcdefgh1234 x', 'en', 's', 3, null, null, null, null, null union all select 5, '', 'en', 's', 0, null, null, null, null, null
        union all select 5, '', 'en', 's', 0, null, null, null, null, null""")
    for docs in (odd, odd.limit(0)):
        seen = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = stage(spark, seen, sf).cache()
            assert seen.columns == docs.columns, name
        ids = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, seen, sf).collect()]
        assert sorted(ids, key=str) == sorted([r.doc_id for r in docs.collect()], key=str)
