"""Operator 6 against brute force over every window."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlens.llm import suffix


def plain(rows, span):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - span + 1):
            w = data[p : p + span]
            if seen.setdefault(w, (i, p)) != (i, p):
                gone[p : p + span] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    return sorted(map(str, out))


def check(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("start", F.lit("x")).repartition(3)
    got = suffix.remove_repeats(df, **k).collect()
    want = plain(list(dict.fromkeys(rows)), k.get("span", 100))
    assert want == sorted({str(tuple(r)) for r in got}) and len(got) == len(rows)


def test_blind_trie_and_deep_shallow():
    rng = np.random.default_rng(3)
    for width in (8, 40, 104):
        strings = [bytes(rng.integers(97, 99, width, dtype=np.uint8)) for _ in range(200)]
        strings += [s[: width // 2] + b"a" * (width - width // 2) for s in strings[:50]] + strings[:20]
        assert [strings[i] for i in suffix.blind_trie_order(strings)] == sorted(strings)
        group = rng.integers(0, 4, len(strings))
        chars = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, width)
        order, lcp = suffix.deep_shallow(group, chars, np.full(len(strings), width))
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings))
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            n = next((j for j in range(width) if a[j] != b[j]), width)
            assert lcp[k] == (n if group[order[k]] == group[order[k - 1]] else -1)


def test_planted(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, base = text(30), text(120)
    rows = [(i, text(20) + " " + line + text(20)) for i in range(12)]
    rows += [(20 + i, base[: 50 * i] + "X" + base[50 * i :]) for i in range(10)] + [(40, base), (41, base), (42, base + base), (43, "a" * 700), (44, "ab" * 300), (45, line[:60] * 9)]
    rows += [(50, None), (51, ""), (52, "short"), (None, text(40) + base), (53, base[:99]), (54, base[:100]), (55, base[:100]), (41, base)]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("ab é"), rng.integers(20, 260))) for _ in range(12)]
    rows = [(int(i), "".join(pool[j] for j in rng.integers(0, len(pool), rng.integers(1, 6)))) for i in rng.permutation(60)]
    check(spark, rows, span=40, gram=12)


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert suffix.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().n_removed == 0
