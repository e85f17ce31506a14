"""Suffix-array removal of repeated byte strings, sorted deep and shallow (operator 6).

A byte goes if a string of ``span`` bytes over it also starts earlier: in a smaller document, or
earlier in the same one. Sorting every suffix of a corpus moves it ``span`` times over, so
suffixes meet only where they can share ``span`` bytes:

1. Anchors. Of the ``span - gram + 1`` grams in each window of ``span`` bytes the one with the
   smallest hash, leftmost on ties, is the window's anchor. Equal windows have equal anchors at
   equal offsets. Windows in a row with one anchor form a run of less than ``2 * span`` bytes.
2. Runs meet by the hash of their anchor. Of runs with equal bytes all but the first are covered
   whole; a task does this for its own runs before the shuffle, so thousands of copies send one
   row for each task. Anchors whose runs are all equal are then done.
3. For the rest, the runs' bytes are fetched, and two suffix arrays are built over each anchor:
   of what stands from the anchor on, and of what stands before it, read backwards. Sorting is
   multikey quicksort on eight-byte characters down to ``SHALLOW`` bytes; groups that still tie
   go into a blind trie, which branches on single bytes and compares bytes once per suffix. With
   the neighbours' common prefixes, windows at offset d are equal if they fall in one class of
   the left array at depth d and in one class of the right array at depth span - d.

Equal gram hashes only bring runs together; what is removed depends on bytes, except that runs of
one anchor count as one key before the sort if their lengths and two 64-bit hashes of their bytes agree:
such copies are never compared byte by byte. What is left to the sort are the distinct runs of anchors
that have several.

Defined results: a null text counts as empty; texts below ``span`` bytes keep all; rows with equal
ids are one document, at equal places of which neither is earlier; a null id sorts before all
others; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import NO_ID, with_null, written

SPAN, GRAM = 100, 24
SHALLOW = 32
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 20


def _power(n: int) -> np.uint64:
    return U(pow(BASE, n, 1 << 64))


def window_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of all windows of each size, built by doubling."""
    todo = sorted(set(sizes))
    out: dict[int, np.ndarray] = {}
    power_of_two, n = {1: data.astype(np.uint64) + U(1)}, 1
    while n * 2 <= todo[-1]:
        h = power_of_two[n]
        power_of_two[2 * n] = h[:-n] * _power(n) + h[n:]
        n *= 2
    for size in todo:
        acc, have = None, 0
        for bit in sorted(power_of_two, reverse=True):
            if size & bit:
                h = power_of_two[bit]
                if acc is None:
                    acc, have = h, bit
                else:
                    tail = h[have:]
                    m = min(len(acc), len(tail))
                    acc = acc[:m] * _power(bit) + tail[:m]
                    have += bit
        out[size] = acc
    return [out[s] for s in sizes]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def runs(data: np.ndarray, doc: np.ndarray, begin: np.ndarray, span: int = SPAN, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor over texts laid end to end.

    ``doc`` and ``begin`` give each byte's document number and the place where it starts. Returns
    anchor hash, run hash, document number, start in the document, windows, anchor offset.
    """
    n = len(data) - span + 1
    empty = {k: np.empty(0, t) for k, t in (("mh", np.int64), ("sh", np.int64), ("doc", np.int64), ("start", np.int64), ("nwin", np.int64), ("off", np.int64))}
    if n <= 0:
        return empty
    g, whole = window_hashes(data, (gram, span))
    g = mix(g)
    key = (g & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    width, have, low = span - gram + 1, 1, key
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: n], low[width - have : width - have + n])
    anchor = (low[:n] & U(0xFFFFFFFF)).astype(np.int64)
    inside = doc[:n] == doc[span - 1 :][:n]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] & ~inside[:-1])
    new &= inside
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    # a run ends where the next one starts or where its document ends
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    at = anchor[first]
    nwin = stop - first + 1
    sh = mix(mix(whole[first]) * U(3) + mix(whole[stop] + U(7)) * U(5) + nwin.astype(np.uint64))
    return {"mh": g[at].view(np.int64), "sh": sh.view(np.int64), "doc": doc[first], "start": first - begin[first], "nwin": nwin, "off": at - first}


# --- one task's share: runs of its own texts -----------------------------------------------------


def _unite(doc: np.ndarray, start: np.ndarray, nwin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of window starts, merged where they touch."""
    if not len(doc):
        return doc, start, nwin
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], (start + nwin)[o]
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    number = np.zeros(len(doc), np.int64)
    number[at[1:]] = 1
    shift = np.cumsum(number) * (int(end.max()) + 2)  # documents apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, (start + shift)[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - shift[last] - start[first]


def _runs_of(texts: list[tuple[int, bytes]], span: int, gram: int) -> dict[str, np.ndarray]:
    n = np.array([len(t) for _, t in texts])
    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    r = runs(data, np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n), span, gram)
    r["doc"] = np.array([i for i, _ in texts], np.int64)[r["doc"]]
    return r


def _split_runs(batches: Iterator[pd.DataFrame], span: int, gram: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        got, cur, size = [], [], 0
        for i, t in zip(b["__doc"].to_numpy(np.int64), b["text"]):
            if not isinstance(t, str) or len(t) * 4 < span:
                continue
            cur.append((i, t.encode("utf-8", "surrogatepass")))
            size += len(cur[-1][1])
            if size >= BLOCK:
                got.append(_runs_of(cur, span, gram))
                cur, size = [], 0
        if cur:
            got.append(_runs_of(cur, span, gram))
        if not got:
            continue
        r = {k: np.concatenate([g[k] for g in got]) for k in got[0]}
        if not len(r["mh"]):
            continue
        o = np.lexsort((r["start"], r["doc"], r["sh"], r["mh"]))
        r = {k: v[o] for k, v in r.items()}
        head = np.append(True, (r["mh"][1:] != r["mh"][:-1]) | (r["sh"][1:] != r["sh"][:-1]))
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (r["doc"] != r["doc"][first]) | (r["start"] != r["start"][first])
        doc, start, nwin = _unite(r["doc"][later], r["start"][later], r["nwin"][later])
        own = {k: v[~later] for k, v in r.items()}
        spread = mix(doc.view(np.uint64) * U(31) + start.view(np.uint64)).view(np.int64)
        yield pd.DataFrame({"mh": own["mh"], "sh": own["sh"], "doc": own["doc"], "start": own["start"], "nwin": own["nwin"], "off": own["off"].astype(np.int16)})
        if len(doc):
            yield pd.DataFrame({"mh": spread, "sh": spread, "doc": doc, "start": start, "nwin": nwin, "off": np.full(len(doc), -1, np.int16)})


# --- suffix arrays: shallow by multikey quicksort, deep by blind tries ---------------------------


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """The order of equally long strings. Inserting walks by branching bytes alone, compares with one leaf, and walks again to the place."""
    width = len(strings[0])
    root = None
    for i, s in enumerate(strings):
        if root is None:
            root = [i]
            continue
        node = root
        while type(node) is tuple:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[0]]
        x = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        if not x:
            node.append(i)
            continue
        at = width - (x.bit_length() + 7) // 8
        parent, node = None, root
        while type(node) is tuple and node[0] < at:
            parent, node = node, node[1][s[node[0]]]
        if type(node) is tuple and node[0] == at:
            node[1][s[at]] = [i]
        else:
            fork = (at, {other[at]: node, s[at]: [i]})
            if parent is None:
                root = fork
            else:
                parent[1][s[parent[0]]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is tuple:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def multikey_quicksort(group: np.ndarray, word: np.ndarray, depth: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their first ``depth`` words within their groups, and the number of the tied segment that each place belongs to.

    All open segments are split at once, each around the median of three of its words at its own
    depth: what is less and what is greater stays at that depth, what is equal goes one deeper.
    """
    m = len(group)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    size, level = np.diff(np.append(first, m)), np.zeros(len(first), np.int64)
    rng = np.random.default_rng(seed)
    done = []
    while True:
        live = (size > 1) & (level < depth)
        done.append(first[~live])
        first, size, level = first[live], size[live], level[live]
        if not len(first):
            break
        seg = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        rows = order[place]
        key = word[rows, level[seg]]
        begin = np.cumsum(size) - size
        three = np.sort(key[begin[:, None] + (rng.random((len(first), 3)) * size[:, None]).astype(np.int64)], axis=1)
        pivot = three[:, 1][seg]
        side = 3 * seg + (key > pivot) + (key >= pivot)
        order[place] = rows[np.argsort(side, kind="stable")]
        n = np.bincount(side, minlength=3 * len(first))
        start = np.repeat(first, 3) + (np.cumsum(n.reshape(-1, 3), axis=1) - n.reshape(-1, 3)).ravel()
        deeper = np.repeat(level, 3)
        deeper[1::3] += 1
        first, size, level = start[n > 0], n[n > 0], deeper[n > 0]
    head = np.zeros(m, bool)
    head[np.concatenate(done)] = True
    return order, np.cumsum(head)


def deep_shallow(group: np.ndarray, chars: np.ndarray, length: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of zero-padded strings within their groups, and each one's common prefix with its predecessor (-1 at a group's first).

    ``chars`` is a matrix whose width is a multiple of 8. Of strings that differ in length alone the shorter comes first.
    """
    m, width = chars.shape
    if m == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = chars.view(">u8").astype(np.uint64)
    order, part = multikey_quicksort(group, word, min(shallow, width) // 8)
    edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), m)
    for a, b in zip(edge[:-1][np.diff(edge) > 1], edge[1:][np.diff(edge) > 1]):
        rows = order[a:b]
        rows = rows[np.argsort(length[rows], kind="stable")]
        order[a:b] = rows[blind_trie_order([chars[r, shallow:].tobytes() for r in rows])] if width > shallow else rows
    x, y = chars[order[1:]], chars[order[:-1]]
    same = x == y
    common = np.where(same.all(1), width, same.argmin(1)) if m > 1 else np.empty(0, np.int64)
    common = np.minimum(common, np.minimum(length[order[1:]], length[order[:-1]]))
    common = np.where(group[order[1:]] == group[order[:-1]], common, -1)
    return order, np.append(-1, common).astype(np.int64)


def repeated_windows(group: np.ndarray, doc: np.ndarray, start: np.ndarray, nwin: np.ndarray, off: np.ndarray, side: np.ndarray, text: list[bytes], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs that share an anchor within each group, the windows that also start earlier: documents, starts and window counts."""
    half = (span - gram) // 2
    far = span - gram
    wr, wl = -(-span // 8) * 8, -(-far // 8) * 8

    def matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width), n

    def nearest(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        best = np.empty(len(order), np.int64)
        best[order] = np.maximum(lcp, np.append(lcp[1:], -1))
        return best

    right = matrix([t[o : o + span] for t, o in zip(text, off)], wr)
    left = matrix([t[:o][::-1][:far] for t, o in zip(text, off)], wl)
    ro, rl = deep_shallow(group, *right)
    lo, ll = deep_shallow(group, *left)
    live = np.flatnonzero(nearest(ro, rl) + nearest(lo, ll) >= span)
    none = np.empty(0, np.int64)
    if not len(live):
        return none, none, none
    place = start + off
    by = np.lexsort((place, doc))
    rank = np.empty(len(doc), np.int64)
    rank[by] = np.cumsum(np.append(True, (doc[by][1:] != doc[by][:-1]) | (place[by][1:] != place[by][:-1])))
    live = live[np.argsort(rank[live], kind="stable")]
    out_d, out_s = [], []
    for d in range(far + 1):
        # a window at offset d is judged on the side that d belongs to, and lies inside its run
        ok = (side[live] == (d > half)) & (d <= off[live]) & (d > off[live] - nwin[live])
        at = live[ok]
        if len(at) < 2:
            continue
        cl, cr = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
        cl[lo], cr[ro] = np.cumsum(ll < d) if d else np.cumsum(ll < 0), np.cumsum(rl < span - d)
        key = cl[at] * (len(doc) + 1) + cr[at]
        o = np.argsort(key, kind="stable")
        at, key = at[o], key[o]
        head = np.append(True, key[1:] != key[:-1])
        first = at[head][np.cumsum(head) - 1]
        later = rank[at] > rank[first]
        out_d.append(doc[at[later]])
        out_s.append(place[at[later]] - d)
    if not out_d:
        return none, none, none
    d, s = np.concatenate(out_d), np.concatenate(out_s)
    return _unite(d, s, np.ones(len(d), np.int64))


def _meet(batches: Iterator[pd.DataFrame], span: int, gram: int, rows_at_once: int = 60_000) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by key; whole groups are judged together."""
    held, n = [], 0

    def judge(df: pd.DataFrame) -> pd.DataFrame:
        size = df.groupby(["key", "side"])["doc"].transform("size")
        df = df[size > 1]
        if df.empty:
            return pd.DataFrame({"doc": [], "start": [], "nwin": []}).astype(np.int64)
        group = df.groupby(["key", "side"], sort=False).ngroup().to_numpy(np.int64)
        d, s, w = repeated_windows(group, *(df[c].to_numpy(np.int64) for c in ("doc", "start", "nwin", "off")), df["side"].to_numpy(np.int64), list(df["run"]), span, gram)
        return pd.DataFrame({"doc": d, "start": s, "nwin": w})

    for b in batches:
        if b.empty:
            continue
        held.append(b)
        n += len(b)
        if n >= rows_at_once:
            df = pd.concat(held, ignore_index=True)
            cut = df["key"].searchsorted(df["key"].iloc[-1])
            if cut:
                yield judge(df.iloc[:cut])
                df = df.iloc[cut:]
            held, n = [df], len(df)
    if held:
        yield judge(pd.concat(held, ignore_index=True))


# --- the operator --------------------------------------------------------------------------------


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc, start, nwin): starts of ``span``-byte windows that also start earlier, as intervals; ids as long, null as the smallest long."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__doc"), F.col(text_col).alias("text"))
    cols = "mh bigint, sh bigint, doc bigint, start bigint, nwin bigint, off smallint"
    found = texts.mapInPandas(lambda it: _split_runs(it, span, gram), cols).repartition("mh")
    same = Window.partitionBy("mh", "sh").orderBy("doc", "start")
    found = found.withColumn("later", (F.first("doc").over(same) != F.col("doc")) | (F.first("start").over(same) != F.col("start")))
    anchor = Window.partitionBy("mh")
    found = found.withColumn("mixed", F.min("sh").over(anchor) != F.max("sh").over(anchor))
    found = written(found.where("off < 0 or later or mixed").select("mh", "doc", "start", "nwin", "off", "later"), "runs")
    whole = found.where("off < 0 or later").select("doc", "start", "nwin")

    open_runs = found.where("off >= 0 and not later").groupBy("doc").agg(F.collect_list(F.struct("mh", "start", "nwin", "off")).alias("runs"))
    half = (span - gram) // 2

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            out = []
            for doc, text, rs in zip(b["doc"], b["text"], b["runs"]):
                data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                for r in rs:
                    s, n, o = r["start"], r["nwin"], r["off"]
                    run = data[s : s + n + span - 1]
                    if len(run) < n + span - 1:
                        continue
                    # windows up to offset half share their bytes from the anchor on; the others those around it
                    if o - n + 1 <= half:
                        out.append((xxhash.xxh3_64_intdigest(run[o : o + span - half], r["mh"] & 0xFFFFFFFF), 0, doc, s, n, o, run))
                    if o > half:
                        out.append((xxhash.xxh3_64_intdigest(run[o - half - 1 : o + gram], 1 + (r["mh"] & 0xFFFFFFFF)), 1, doc, s, n, o, run))
            df = pd.DataFrame(out, columns=["key", "side", "doc", "start", "nwin", "off", "run"])
            df["key"] = df["key"].astype(np.uint64).to_numpy().view(np.int64)
            yield df

    bytes_of = texts.join(open_runs, F.col("__doc") == F.col("doc")).select("doc", "text", "runs").mapInPandas(fetch, "key bigint, side int, doc bigint, start bigint, nwin bigint, off int, run binary")
    met = bytes_of.repartition("key").sortWithinPartitions("key").mapInPandas(lambda it: _meet(it, span, gram), "doc bigint, start bigint, nwin bigint")
    return whole.unionAll(met)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, kept_bytes: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and with ``kept_bytes`` the bytes that stay."""
    gone = repeated(docs, id_col, text_col, span, gram).groupBy("doc").agg(F.collect_list(F.struct("start", "nwin")).alias("gone"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__doc"), F.col(text_col).alias("__text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, gone in zip(b["__text"], b["gone"]):
                data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                keep, at, n = [], 0, 0
                if gone is not None:
                    s = np.array([g["start"] for g in gone], np.int64)
                    w = np.array([g["nwin"] for g in gone], np.int64) + span - 1
                    _, s, w = _unite(np.zeros(len(s), np.int64), s, w)
                    for x, y in zip(s.tolist(), w.tolist()):
                        keep.append(data[at:x])
                        at, n = x + y, n + 1
                keep.append(data[at:])
                left = b"".join(keep)
                out.append((len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest()) + (left,) * kept_bytes)
            df = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept_bytes)
            df.insert(0, "__doc", b["__doc"].to_numpy(np.int64))
            yield df

    out = "__doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept_bytes
    got = rows.join(gone, F.col("__doc") == F.col("doc"), "left").select("__doc", "__text", "gone").mapInPandas(cut, out)
    return got.select(with_null(got, "__doc", docs, id_col), *got.columns[1:])
