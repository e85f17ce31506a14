"""Benchmark decontamination by winnowing (operator 10), with built-in functions only.

A text's fingerprints are the smallest k-gram hashes of each ``window - k + 1`` consecutive
k-grams, so any ``window`` words two texts share give both the same fingerprint. Fingerprints
fold case more widely than words do, which only adds candidates. Documents that share a
fingerprint with the benchmark are candidates; only their windows are compared word for word,
which extends the hits. Items shorter than a window are compared whole, by the lengths
that the benchmark has.

The benchmark's fingerprints and windows are broadcast only if all its windows written out take
``broadcast_bytes`` at most, which is measured first; beyond it the joins shuffle. Matches are combined by
distinct document and window before they meet items.

Defined results: null and wordless texts have no words and are never hit; items of null or wordless
text have no window; repeated items count once by item_id; items without an item_id have windows
and hits, and are in no list; rows are told apart by id and text, so repeated rows each keep their
row; an empty benchmark hits nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textcols import folded_words, gram_hashes, grams, once, words

WINDOW, K = 13, 5


def winnow(h: Column, window: int = WINDOW, k: int = K) -> Column:
    """Of k-gram hashes, the smallest of each ``window - k + 1`` in a row."""
    span = window - k + 1
    n = F.size(h) - span + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_min(F.slice(h, i, span)))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, keep: list[str], lengths: list[int], window: int = WINDOW, k: int = K) -> DataFrame:
    """``keep``, n_words and the distinct fingerprints of the texts in ``__text``; for each of ``lengths`` also all hashes of that many words."""
    w = once(df, folded_words(F.col("__text")), "__w", *keep)
    h = once(w, gram_hashes(F.col("__w"), k), "__h", *keep, "__w")

    def whole_of(n: int) -> Column:
        return F.transform(gram_hashes(F.col("__w"), n), lambda x: F.xxhash64(x, F.lit(n)))

    whole = [whole_of(n) for n in lengths]
    return h.select(*keep, F.size("__w").cast("long").alias("n_words"), F.array_distinct(F.concat(winnow(F.col("__h"), window, k), *whole)).alias("fps"))


def match(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, k: int = K, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """Per document row: id, __key (row key), n_words, n_hit, n_items, items (sorted item ids as strings).

    Texts are cut into words once; fingerprints and counts are written, and texts are read again
    for candidates alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    base = docs.select(F.col(id_col), key.alias("__key"), text.alias("__text"))
    texts = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("__text"))
    items = once(texts, words(F.col("__text")), "__w", "item", "__text").where("size(__w) > 0")
    n = F.size("__w")
    # a word of an item stands in ``window`` of its windows at most, each of which is a row with its id
    bytes_of = F.octet_length("__text") * window + n * (F.coalesce(F.octet_length("item"), F.lit(0)) + 64)
    size, lengths = items.agg(F.coalesce(F.sum(bytes_of.cast("long")), F.lit(0)), F.collect_set(F.when(n < window, n))).first()
    small = F.broadcast if size <= broadcast_bytes else (lambda df: df)
    lengths = sorted(lengths)

    marked = written(fingerprints(base, [id_col, "__key"], lengths, window, k), "fingerprints", 10_000)
    fps = [fingerprints(items.where(n >= window).select("__text"), [], [], window, k).select(F.explode("fps").alias("fp"))]
    fps += [items.where(n == x).select(F.xxhash64(F.xxhash64(folded_words(F.col("__text"))), F.lit(x)).alias("fp")) for x in lengths]
    fps = reduce(DataFrame.unionAll, fps).distinct()
    found = marked.select("__key", F.explode("fps").alias("fp")).join(small(fps), "fp", "left_semi").select("__key").distinct()
    candidates = written(found, "candidates")

    near = base.join(candidates, "__key", "left_semi").dropDuplicates(["__key"])
    near = once(near, words(F.col("__text")), "__w", "__key")
    windows = [items.where(F.size("__w") >= window).select("item", F.explode(grams(F.col("__w"), window)).alias("gram"), F.lit(window).alias("len"))]
    windows += [items.where(F.size("__w") == n).select("item", F.concat_ws(" ", "__w").alias("gram"), F.lit(n).alias("len")) for n in lengths]
    windows = reduce(DataFrame.unionAll, windows).distinct()
    places = [near.select("__key", F.posexplode(grams(F.col("__w"), n)).alias("pos", "gram"), F.lit(n).alias("len")) for n in [window, *lengths]]
    hits = reduce(DataFrame.unionAll, places).join(small(windows.select("gram", "len").distinct()), ["gram", "len"], "left_semi")
    hits = written(hits, "hits")

    def cover(acc: Column, p: Column) -> Column:
        end = p["pos"] + p["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], p["pos"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = hits.groupBy("__key").agg(F.aggregate(F.array_sort(F.collect_set(F.struct("pos", "len"))), start, cover, lambda a: a["n"]).cast("long").alias("n_hit"))
    of_items = hits.select("__key", "gram", "len").distinct().join(small(windows.where("item is not null")), ["gram", "len"]).select("__key", "item").distinct().groupBy("__key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    marks = covered.join(of_items, "__key", "left")
    return marked.select(id_col, "__key", "n_words").join(marks, "__key", "left").select(
        id_col, "__key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated() -> Column:
    """At least a twentieth of the words lie in benchmark windows."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept."""
    bad = match(docs, benchmark, id_col, text_col).where(is_contaminated()).select("__key").distinct()
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))
    return docs.withColumn("__key", key).join(bad, "__key", "left_anti").select(*docs.columns)
