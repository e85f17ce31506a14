"""The methods themselves against plain versions, and the cases that rows of one id, odd labels and odd parts make."""

import math
import random

import numpy as np
import pyarrow as pa

from meshlens.llm import chat, licenses, minhash, secrets, toxicity, vectors
from meshlens.llm.common import portions


def test_verified_share_is_the_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice([b"x", b"y", b"z", b"w"]) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        n = best[-1][-1]
        assert math.isclose(licenses.verified_share(a, b), max(0.0, n / len(b) - 0.01 * (len(a) - n)))


def test_ftrl_against_a_plain_one():
    rng = random.Random(4)
    rows = [np.array([rng.randrange(16) for _ in range(rng.randrange(1, 6))]) for _ in range(60)]
    labels = [int(3 in r) for r in rows]
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        lam = 0.0 if i == 16 else 0.5
        return 0.0 if abs(z[i]) <= lam else -(z[i] - math.copysign(lam, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.7 + 1.0)

    for _ in range(3):
        for r, y in zip(rows, labels):
            at = [*sorted(set(r.tolist())), 16]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - y
            for i, x in zip(at, w):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7 * x
                n[i] += g * g
    at, w, bias = toxicity.ftrl(rows, labels, bits=4, alpha=0.7, l1=0.5, epochs=3)
    want = {i: weight(i) for i in range(16) if weight(i)}
    assert at.tolist() == sorted(want) and np.allclose(w, [want[i] for i in at.tolist()]) and math.isclose(bias, weight(16), rel_tol=1e-9)


def test_portions_are_bounded_by_rows_and_bytes():
    texts = pa.array(["a" * 10, None, "b" * 300, "c", "d", "e" * 90, "f" * 20])
    got = list(portions(texts, 3, 100))
    assert [i for i, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))] and sum(n for _, n in got) == 7
    assert all(n <= 3 and (n == 1 or sum(len(t.as_py() or "") for t in texts[i : i + n]) <= 100) for i, n in got)


def test_added_secrets():
    text = "Authorization: Bearer abcdefghijklmnopqrstuv https://u:hunter22@host/ ghp_" + "Zq" * 18
    assert [s[2] for s in secrets.scan(text)] == ["bearer", "urlcred", "ghtoken"]
    assert secrets.scan("Bearer short https://u:x@host ghp_abc") == []


def test_rows_of_one_id_are_documents_of_their_own(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t), (5, "quite another text than that"), (5, t + " more"), (5, t + " more"), (None, t)]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    by = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None)
    assert by == [(1, 58, 1), (5, 3, 5), (5, 59, 1), (5, 59, 1)]


def test_labels_are_equal_as_they_are(spark):
    v = [1.0, 2.0, 3.0]
    for kind, labels in (("double", [1.2, 1.7, 1.2, -0.0, 0.0]), ("string", ["a", "b", "a", "c", "c"])):
        df = spark.createDataFrame([(i, v, x) for i, x in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")
        assert [(r.vec_id, r.n_links, r.component_id) for r in vectors.links(df).orderBy("vec_id").collect()] == [(0, 1, 0), (1, 0, 1), (2, 1, 0), (3, 1, 3), (4, 1, 3)]


def test_placeholders_run_through_the_conversation(spark):
    part = lambda t, x=None, r=None, n=None: (t, x, r, n)
    rows = [(1, 0, "user", [part("text", "see <|image:0|> "), part("image", "alt", "a.png"), part("audio", None, "b.wav", 9)]), (1, 1, "assistant", [part("video", "clip", "c.mp4"), part("note", "plain")]), (1, 2, "user", [part("image", None, "d.png")]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chat(df, parts_col="parts").collect()}
    assert got[1].formatted == "### user:\nsee \\pimage:0|> <|image:0|><|audio:1|></turn>\n### assistant:\n<|video:2|>plain</turn>\n### user:\n<|image:3|></turn>\n"
    assert [(a.type, a.ref, a.tokens, a.text) for a in got[1].attachments] == [("image", "a.png", 256, "alt"), ("audio", "b.wav", 9, None), ("video", "c.mp4", 0, "clip"), ("image", "d.png", 256, None)]
    assert (got[1].media_tokens, got[2].formatted) == (521, "### user:\n</turn>\n")
    s = got[1].loss_spans[0]
    assert got[1].formatted[s.start : s.start + s.length] == "<|video:2|>plain"


def test_components_of_many_partitions(spark, monkeypatch):
    from meshlens.llm import common

    random.seed(5)
    pairs = [(i, i + 1) for i in range(60)] + [(random.randrange(100, 400), random.randrange(100, 400)) for _ in range(150)] + [(7, 7), (None, 3)]
    best = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is not None and a != b and best[a] != best[b]:
                best[a] = best[b] = min(best[a], best[b])
                changed = True
    whole = common.written
    for rows in (200_000, 30):  # one partition, and a file for every 30 rows
        monkeypatch.setattr(common, "written", lambda df, label, rows_per_file=0: whole(df, label, rows))
        got = common.components(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted(best.items())
    assert common.components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def test_local_stars_in_small_portions():
    import pandas as pd

    from meshlens.llm.common import _local_stars

    batches = [pd.DataFrame({"u": range(i + 1, i + 11), "v": range(i, i + 10)}) for i in range(0, 100, 10)]
    out = pd.concat(_local_stars(iter(batches), at_once=15))
    assert sorted(set(out["u"])) == list(range(1, 101)) and (out["u"] > out["v"]).all()
    one = pd.concat(_local_stars(iter(batches)))
    assert (one["v"] == 0).all() and len(one) == 100
    assert list(_local_stars(iter([]))) == []
