"""Toxicity scores by FTRL-proximal logistic regression (operator 7).

Features are hashed words, word pairs and pairs that skip one word, each once per text. Training
goes over a bounded sample of labelled rows in a fixed order, with a learning rate of its own for
each coordinate, and L1 keeps most weights at zero, so what is broadcast is a short list of
(coordinate, weight), never more than the hash space. Scoring is one pass over all texts without a
shuffle. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have the score of the intercept alone; rows without a usable
label are not trained on; a document labelled more than once is toxic if any label says so, and of one
with several texts the smallest trains; without
training rows every score is 0.5 at most and predicts 0; repeated rows each keep their row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, worker_cache

BITS = 20
#: Most labelled rows that training reads; a bound on the sample, not on what is scored.
SAMPLE = 12_000
WORDS = re.compile(r"[^\W_]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def held_out(id_col: str) -> Column:
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5) == 0


class Features:
    """Hashed features of texts. The word cache is bounded."""

    def __init__(self, bits: int = BITS, cache: int = 200_000):
        self.shift, self.limit, self.seen = np.uint64(64 - bits), cache, {}

    def word_hashes(self, text: str) -> np.ndarray:
        import xxhash

        seen, found = self.seen, WORDS.findall(text.lower())
        try:
            out = [seen[w] for w in found]
        except KeyError:
            if len(seen) > self.limit:
                seen.clear()
            out = []
            for w in found:
                h = seen.get(w)
                if h is None:
                    h = seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                out.append(h)
        return np.array(out, dtype=np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        """Coordinates, with repeats."""
        if not isinstance(text, str) or not text:
            return np.empty(0, dtype=np.int64)
        h = self.word_hashes(text)
        with np.errstate(over="ignore"):
            parts = [h * _A]
            if len(h) > 1:
                parts.append((h[:-1] * _A ^ (h[1:] + _C)) * _B)
            if len(h) > 2:
                parts.append((h[:-2] * _B ^ (h[2:] + _A)) * _C)
            x = np.concatenate(parts)
            x ^= x >> np.uint64(29)
            x *= _B
        return (x >> self.shift).astype(np.int64)


def ftrl(rows: Iterable[np.ndarray], labels: list[int], bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, intercept). The intercept is the last coordinate and is not shrunk."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        lam = np.where(i == size, 0.0, l1)
        w = -(zi - np.sign(zi) * lam) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= lam, 0.0, w)

    rows = [np.append(np.unique(r), size).astype(np.int32) for r in rows]
    for _ in range(epochs):
        for i, y in zip(rows, labels):
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            old = n[i]
            sigma = (np.sqrt(old + g * g) - np.sqrt(old)) / alpha
            z[i] += g - sigma * w
            n[i] = old + g * g
    w = weights(np.arange(size + 1))
    at = np.nonzero(w[:size])[0]
    return at, w[at], float(w[size])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``sample`` labelled documents that are not held out.

    Labels meet the ids of the documents first; the sample is the smallest of those by a hash of the
    id, and only its texts are then fetched. One task fits, over ``sample`` texts at most.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(label_col).alias("y")).join(docs.select(id_col), id_col, "left_semi").orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(known), id_col)  # at most ``sample`` pairs of numbers
    rows = rows.groupBy(id_col, "y").agg(F.min(text_col).alias(text_col))  # before they meet in one task
    rows = rows.select(F.lit(0).alias("g"), F.xxhash64(id_col, F.lit("order")).alias("at"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), "y")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        f = Features(bits)
        at, w, b = ftrl((f.of(t) for t in pdf["text"]), [int(y > 0) for y in pdf["y"]], bits)
        return pd.DataFrame({"at": np.append(at, -1), "w": np.append(w, b)})

    got = rows.groupBy("g").applyInPandas(fit, "at bigint, w double").toPandas()  # at most 2^bits + 1 rows
    inner = got[got["at"] >= 0]
    bias = got.loc[got["at"] < 0, "w"]
    return inner["at"].to_numpy(np.int64), inner["w"].to_numpy(np.float64), float(bias.iloc[0]) if len(bias) else -1e-9


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), bits: int = BITS, out: str = "score") -> DataFrame:
    """The ``keep`` columns and the score of every row, named ``out``."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(texts: list) -> list[list]:
        dense, live, f = worker_cache(("toxicity", key), lambda: _scorer(sent.value, bits))
        bias, z = sent.value[2], []
        for text in texts:
            x = f.of(text)
            x = x[live[x]]
            z.append(bias + (dense[np.unique(x)].sum() if len(x) else 0.0))
        return [(1.0 / (1.0 + np.exp(-np.clip(np.array(z, dtype=np.float64), -35, 35)))).tolist()]

    return map_texts(docs, text_col, keep, f"`{out}` double", run)


def _scorer(model: tuple, bits: int) -> tuple:
    """Dense weights, those that aren't zero, and a word cache."""
    dense = np.zeros(1 << bits, dtype=np.float64)
    dense[model[0]] = model[1]
    return dense, dense != 0, Features(bits)
