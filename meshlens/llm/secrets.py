"""Secret scans with corpus-wide ownership frequency (operator 9).

Detection finds candidate spans in whole texts. A candidate's value is hashed, and the corpus is
asked how many distinct repositories and owners hold that hash: widely copied values are
examples, values of few owners are live-looking credentials. Counts are exact and combined
before each shuffle, so one value in a third of all rows is no hot key.

Defined results: a null text counts as empty; rows with a null repository or owner count as one
unnamed repository or owner; repeated rows each give their own row; nothing is dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")
#: Kinds the method adds: (kind, pattern, group that holds the value).
ADDED = (
    ("bearer", re.compile(r"\b[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,}=*)"), 1),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    ("pem", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), 0),
    ("ghtoken", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"), 0),
    ("urlcred", re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:([^\s/:@]{6,128})@"), 1),
)
KINDS = ("assign", "access", "hex", *(k for k, _, _ in ADDED))


def scan(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, value start, value end) of all spans, by start, then kind as in KINDS. Code points, end exclusive."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            out.append((m.start(), m.end(), "assign", m.start(2), m.end(2)))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            out.append((m.start(), m.end(), kind, m.start(), m.end()))
    for kind, pattern, g in ADDED:
        for m in pattern.finditer(text):
            out.append((m.start(), m.end(), kind, m.start(g), m.end(g)))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return out


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


SPAN = "struct<start:int,end:int,kind:string,value_start:int,value_end:int,value_hash:string,entropy:double>"


def find(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "found") -> DataFrame:
    """The ``keep`` columns and ``out``: the array of candidate spans. One pass, no shuffle."""

    def run(texts: list) -> list[list]:
        rows = []
        for text in texts:
            spans = []
            for s, e, kind, vs, ve in scan(text) if text else ():
                v = text[vs:ve]
                spans.append({"start": s, "end": e, "kind": kind, "value_start": vs, "value_end": ve, "value_hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32], "entropy": entropy(v)})
            rows.append(spans)
        return [rows]

    return map_texts(docs, text_col, keep, f"`{out}` array<{SPAN}>", run)


def ownership(found: DataFrame, repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """(value_hash, n_repos, n_owners, n_uses): exact distinct repositories and owners of each candidate value."""
    pairs = found.select(F.explode("found").alias("s"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"))
    per = pairs.groupBy(F.col("s.value_hash").alias("value_hash"), "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    a = per.groupBy("value_hash", "repo").agg(F.sum("n").alias("n")).groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("n").alias("n_uses"))
    if owner_col == repo_col:
        return a.select("value_hash", "n_repos", F.col("n_repos").alias("n_owners"), "n_uses")
    o = per.groupBy("value_hash", "owner").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return a.join(o, "value_hash").select("value_hash", "n_repos", "n_owners", "n_uses")


def classify(spans: DataFrame, owners: DataFrame, max_owners: int = 2, min_entropy: float = 2.5) -> DataFrame:
    """Exploded spans with ``status``: example (more than ``max_owners`` owners), weak (few bits a character) or live."""
    return spans.join(owners, "value_hash", "left").withColumn(
        "status", F.when(F.col("n_owners") > max_owners, "example").when(F.col("entropy") < min_entropy, "weak").otherwise("live")
    )


def scan_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", max_owners: int = 2, min_entropy: float = 2.5) -> DataFrame:
    """One row per input row: id, found, live (hashes), and the counts n_live, n_example and n_weak of its spans
    and the most owners (widest) and repositories (most_repos) that one of its values has.

    Texts are scanned once; what was found is written, and the rest works on that. Only rows with
    candidates take part in the joins. Rows are told apart by a digest of what was found, so
    repeated rows cost one lookup and each keep their row.
    """
    keep = tuple(dict.fromkeys((id_col, repo_col, owner_col)))
    found = written(find(docs, text_col, keep), "found")
    owners = ownership(found.where(F.size("found") > 0), repo_col, owner_col)
    row_key = F.xxhash64(F.col(id_col), F.to_json("found")).alias("__row")
    keyed = found.where(F.size("found") > 0).select(F.col(id_col), "found", row_key)
    spans = keyed.select("__row", F.explode("found").alias("s")).select("__row", "s.value_hash", "s.entropy").distinct()
    marks = classify(spans, owners, max_owners, min_entropy).groupBy("__row").agg(
        F.sort_array(F.collect_set(F.when(F.col("status") == "live", F.col("value_hash")))).alias("live"),
        *(F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in ("live", "example", "weak")),
        F.max("n_owners").alias("widest"),
        F.max("n_repos").alias("most_repos"),
    )
    none = F.lit(0).cast("long")
    empty = found.where(F.size("found") == 0).select(F.col(id_col), "found", F.array().cast("array<string>").alias("live"), *(none.alias(c) for c in ("n_live", "n_example", "n_weak", "widest", "most_repos")))
    full = keyed.join(marks, "__row").select(F.col(id_col), "found", "live", "n_live", "n_example", "n_weak", *(F.coalesce(c, none).alias(c) for c in ("widest", "most_repos")))
    return full.unionByName(empty)


def joined(found, kinds=None):
    """``kind:start:end`` of spans, comma-joined."""
    spans = found if kinds is None else F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text_col: str = "text", repo_col: str = "source", owner_col: str = "source", max_owners: int = 2, min_entropy: float = 2.5, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with the values of live-looking credentials replaced by ``mark``; all columns and rows stay."""
    cols = docs.columns
    if len(set(cols)) != len(cols):
        raise ValueError("column names must differ")
    kinds = {f.name: f.dataType for f in docs.schema}
    # texts without a candidate, nearly all, pass in one scan; the few others are written and looked up
    spanned = find(docs, text_col, tuple(cols), "__found")
    dirty = written(spanned.where(F.size("__found") > 0), "found")
    owners = ownership(dirty.select(F.col("__found").alias("found"), F.col(repo_col), *([F.col(owner_col)] if owner_col != repo_col else [])), repo_col, owner_col)
    common = owners.where(F.col("n_owners") > max_owners).select("value_hash")
    clean = spanned.where(F.size("__found") == 0).select(*cols)
    row_key = F.xxhash64(*[F.col(c) if not kinds[c].simpleString().startswith("map") else F.to_json(F.col(c)) for c in cols])
    dirty = dirty.withColumn("__row", row_key)
    hashes = dirty.select("__row", F.explode("__found").alias("s")).select("__row", "s.value_hash").distinct()
    shared = hashes.join(common, "value_hash").groupBy("__row").agg(F.collect_set("value_hash").alias("__common"))
    full = dirty.join(shared, "__row", "left").withColumn("__common", F.coalesce("__common", F.array().cast("array<string>")))
    live = F.filter("__found", lambda s: ~F.array_contains(F.col("__common"), s["value_hash"]) & (s["entropy"] >= min_entropy))
    full = full.withColumn("__live", F.array_sort(F.transform(live, lambda s: F.struct(s["value_start"].alias("s"), s["value_end"].alias("e")))))
    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("p"))
    text = F.col(text_col)

    def step(acc, s):
        # overlapping spans: only the part past the last end is new, and it gets no second mark
        return F.when(s["s"] >= acc["p"], F.struct(F.concat(acc["t"], F.substring(text, acc["p"] + 1, s["s"] - acc["p"]), F.lit(mark)).alias("t"), s["e"].alias("p"))).otherwise(F.struct(acc["t"].alias("t"), F.greatest(acc["p"], s["e"]).alias("p")))

    new = F.aggregate("__live", zero, step, lambda acc: F.concat(acc["t"], F.substring(text, acc["p"] + 1, F.length(text))))
    fixed = full.withColumn(text_col, new).select(*cols)
    return clean.unionByName(fixed)
