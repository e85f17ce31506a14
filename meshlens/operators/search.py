"""Ranked text search: tokens, BM25 over weighted fields, three passes, reranking and cursors.

Only postings of query tokens leave the token scan, so what is shuffled grows with matches, not
with texts; document lengths and counts are map-side sums.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..schema import node_kinds

K1, B = 1.2, 0.75
FIELDS = {"symbol_name": 3.0, "content": 1.0}


def documents_of(nodes: DataFrame) -> DataFrame:
    """Search documents of the nodes whose kind is indexed: symbol and file name, path tokens, qualified name, kind, language, export flag, age and text."""
    n = nodes.join(F.broadcast(node_kinds(nodes.sparkSession).where("search_indexable").select("kind")), "kind", "left_semi")
    file = F.substring_index("file_path", "/", -1)
    path = F.array_join(X.tokens(F.regexp_replace("file_path", r"\.[^./]*$", "")), " ")
    return n.select("id", F.col("name").alias("symbol_name"), file.alias("file_name"), path.alias("path_tokens"), "qualified_name", "kind", X.language(F.col("file_path")).alias("lang"), "is_exported", "last_modified", F.concat_ws(" ", "name", "qualified_name", "signature").alias("content"))


def query_tokens(text: str) -> list[str]:
    """As :func:`scalars.tokens` does for columns; a query of several identifier words becomes its tokens."""
    for p, r in ((r"([^\W\d_A-Z])([A-Z])", r"\1 \2"), (r"([A-Z])([A-Z][a-z])", r"\1 \2"), (r"([^\W\d_])([0-9])", r"\1 \2"), (r"([0-9])([^\W\d_])", r"\1 \2")):
        text = re.sub(p, r, text)
    return [t for t in re.split(r"[\W_]+", text.lower()) if t and len(t.encode()) <= 80]


def swaps(token: str) -> list[str]:
    """The token with two neighbours exchanged; counts as one edit."""
    return sorted({token[:i] + token[i + 1] + token[i] + token[i + 2 :] for i in range(len(token) - 1)} - {token})


def near(term: Column, token: str) -> Column:
    """Within one edit."""
    return (F.levenshtein(term, F.lit(token), 1) >= 0) | term.isin(*(swaps(token) or [token]))


def synonyms(token: str) -> list[str]:
    return next((list(g) for g in X.SYNONYMS if token in g), [token])


def postings(docs: DataFrame, keep: Column, id_col: str = "doc_id", fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """(id, field, term, tf, dl) of terms for which ``keep`` (over ``term``) holds."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), X.tokens(F.col(f)).alias("t")) for f in fields))
    d = docs.select(F.col(id_col), F.explode(each).alias("x")).select(id_col, "x.field", F.col("x.t").alias("t"))
    d = d.select(id_col, "field", F.size("t").alias("dl"), F.explode("t").alias("term")).where(keep)
    return d.groupBy(id_col, "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def averages(docs: DataFrame, fields: tuple[str, ...] = tuple(FIELDS)) -> dict[str, float]:
    """Documents and mean length of each field: a row to the driver."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.size(X.tokens(F.col(f)))).alias(f) for f in fields)).first()
    return {"n": r["n"]} | {f: (r[f] or 0) / r["n"] if r["n"] else 0.0 for f in fields}


def bm25(posted: DataFrame, stats: dict[str, float], word: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, word, score): ``word`` names the query word that a term answers; a word's terms add up."""
    df = posted.groupBy("field", "term").agg(F.count_distinct(id_col).alias("df"))
    j = posted.join(df, ["field", "term"])
    boost = reduce(lambda a, f: a.when(F.col("field") == f, F.lit(FIELDS[f])), FIELDS, F.when(F.lit(False), 1.0))
    mean = reduce(lambda a, f: a.when(F.col("field") == f, F.lit(float(stats[f] or 1.0))), FIELDS, F.when(F.lit(False), 1.0))
    idf = F.log(1 + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    return j.select(id_col, F.explode(word).alias("word"), s.alias("s")).groupBy(id_col, "word").agg(F.sum("s").alias("score"))


def search_pass(docs: DataFrame, words: list[str], mode: str = "strict", id_col: str = "doc_id", stats: dict | None = None) -> DataFrame:
    """(id, matched, score) of one pass: strict needs every word, fuzzy every word within an edit, disjunctive half of them or their synonyms."""
    words = list(dict.fromkeys(words))
    term = F.col("term")
    if mode == "strict":
        test = {w: term == w for w in words}
    elif mode == "fuzzy":
        test = {w: near(term, w) for w in words}
    else:
        test = {w: reduce(lambda a, s: a | near(term, s), synonyms(w), term == w) for w in words}
    need = math.ceil(len(words) / 2) if mode == "disjunctive" else len(words)
    posted = postings(docs, reduce(lambda a, b: a | b, test.values()), id_col)
    answered = F.array_compact(F.array(*(F.when(c, F.lit(w)) for w, c in test.items())))
    scored = bm25(posted, stats or averages(docs), answered, id_col)
    return scored.groupBy(id_col).agg(F.count(F.lit(1)).alias("matched"), F.sum("score").alias("score")).where(F.col("matched") >= need)


def search(docs: DataFrame, query: str, filters: Column | None = None, limit: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """The first pass with hits, filtered before ranking; one word never reaches the disjunctive pass. (id, pass, matched, score)."""
    if filters is not None:
        docs = docs.where(filters)
    words = list(dict.fromkeys(query_tokens(query)))
    if not words:
        return search_pass(docs, ["\x00"], "strict", id_col).withColumn("pass", F.lit("none"))
    stats = averages(docs)
    for mode in ("strict", "fuzzy", "disjunctive")[: 2 if len(words) < 2 else 3]:
        got = search_pass(docs, words, mode, id_col, stats).withColumn("pass", F.lit(mode))
        if mode == ("fuzzy" if len(words) < 2 else "disjunctive") or not got.isEmpty():
            break
    return got if limit is None else got.orderBy(F.desc("score"), id_col).limit(limit)


def rerank(hits: DataFrame, docs: DataFrame, query: str, id_col: str = "doc_id") -> DataFrame:
    """Multiply scores by what the hit is: exported, not an exact pass, near the best score, named by the query, covering its words."""
    words = list(dict.fromkeys(query_tokens(query)))
    name = X.tokens(F.col("symbol_name"))
    j = hits.join(docs.select(id_col, "symbol_name", "is_exported"), id_col)
    # the best score by an aggregate: a window over all rows would put them in one task
    top = hits.agg(F.max("score").alias("top"))
    j = j.join(F.broadcast(top))  # one row
    exact = F.when(F.array_join(name, " ") == " ".join(words), 1.6).when(F.get(name, F.lit(0)) == (words[0] if words else ""), 1.3).otherwise(1.0)
    covered = F.size(F.array_intersect(name, F.array(*(F.lit(w) for w in words)))) / float(max(1, len(words)))
    boost = F.when(F.col("is_exported"), 1.10).otherwise(1.0) * F.when(F.col("pass") == "strict", 1.0).otherwise(0.98) * (1 + 0.05 * F.col("score") / F.col("top")) * exact * (1 + 0.25 * covered if len(words) > 1 else F.lit(1.0))
    return j.select(id_col, "pass", (F.col("score") * boost).alias("score"))


def make_cursor(secret: bytes, offset: int, **request: str | None) -> str:
    """An opaque, signed place in a result; it fits only the request that made it."""
    body = f"{offset}|" + "|".join(f"{k}={request[k] or ''}" for k in sorted(request))
    mac = hmac.new(secret, body.encode(), hashlib.sha256).digest()
    return "v1:" + base64.urlsafe_b64encode(f"{offset}|".encode() + mac).decode()


def read_cursor(secret: bytes, cursor: str, **request: str | None) -> int:
    if not cursor.startswith("v1:"):
        raise ValueError("unknown cursor version")
    offset = base64.urlsafe_b64decode(cursor[3:]).partition(b"|")[0]
    if not offset.isdigit() or not hmac.compare_digest(make_cursor(secret, int(offset), **request), cursor):
        raise ValueError("the cursor does not belong to this request")
    return int(offset)


def page(ranked: DataFrame, order: list[Column], offset: int, limit: int, most: int = 1000) -> DataFrame:
    """Rows of a page in order; limits are clamped."""
    return ranked.orderBy(*order).offset(offset).limit(max(1, min(limit, most)))
