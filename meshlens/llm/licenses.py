"""License scans by diagonal voting (operator 3).

Every k words of a text are joined, by two rolling hashes, to the positions of those words in the
templates. A match votes for the diagonal text position - template position; votes are summed by
(document, template, diagonal), and neighbouring diagonals merge, since a word put in or left out
moves a text to the next one. A merged span of enough votes is a candidate: its text is read again
and its words are compared with the template's in order; the share of the template's words that it
has, less a hundredth for each of its own that the template lacks, decides. Short phrases are
templates too: they count where every one of their k-grams voted on one diagonal, which is where
their words stand one after another.

The template table is fixed by a parameter and broadcast if small; nothing of a text but its votes
is shuffled, votes are combined before the shuffle, and only texts with candidates are read again.

Defined results: a null or wordless text has no words, places or labels and score 0; a span starts and
ends where its first and last votes do; rows are told
apart by id and text, so repeated rows each keep their row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import with_null, without_null, written

K = 3
#: Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Opening notices of public licenses and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("this work is licensed under the creative commons attribution", "cc-by"),
)
#: The template table is broadcast up to this many k-grams, and shuffled beyond.
MAX_BROADCAST = 1_000_000


#: Every byte outside words becomes a blank; bytes above ASCII are parts of words.
_BLANKS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The row that carries a text's number of words meets this row of the template table.
_MARK = (-1, 0, 0)


def word_hashes(text: str) -> np.ndarray:
    import xxhash

    return np.array(list(map(xxhash.xxh3_64_intdigest, text_words(text))), np.uint64)


def rolled(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every k words: the join key, and the one that verifies it."""
    n = max(0, len(h) - k + 1)
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        a = (a ^ (a >> np.uint64(29))) * _A + h[i : i + n]
        b = (b ^ (b >> np.uint64(31))) * _B + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(17)))
    return a.view(np.int64), b.view(np.int64)


def template_rows(k: int = K) -> list[tuple]:
    """(template, label, is phrase, position, two hashes of the k-gram, number of k-grams), and the mark."""
    out = [(_MARK[0], "", False, 0, _MARK[1], _MARK[2], 1)]
    for t, (text, label) in enumerate((*PHRASES, *TEMPLATES)):
        a, b = rolled(word_hashes(text), k)
        if not len(a):
            raise ValueError(f"a template needs {k} words at least: {text}")
        out += [(t, label, t < len(PHRASES), i, int(a[i]), int(b[i]), len(a)) for i in range(len(a))]
    return out


def text_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_BLANKS).split()


def verified_share(words: list[bytes], template: list[bytes]) -> float:
    """The share of the template's words that stand in ``words`` in order, less a hundredth for each word more than those."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << i
    full = row = (1 << len(template)) - 1
    for w in words:  # the longest common subsequence, a bit for each template word
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    both = len(template) - row.bit_count()
    return max(0.0, both / len(template) - 0.01 * (len(words) - both))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, gap: int = 4, min_votes: float = 0.3, min_share: float = 0.5) -> DataFrame:
    """One row per input row: id, n_words, places (array of phrase, label, start), spans (array of label, start, end, share)."""
    spark = docs.sparkSession
    ids = docs.select(without_null(docs, id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = ids.select("id", F.xxhash64("text").alias("h"), "text")
    kind = ids.schema["id"].dataType.simpleString()

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, hashes, at, size = batch["id"].array, batch["h"].to_numpy(np.int64), [], 0

            def rows(at: list, ids=ids, hashes=hashes) -> pd.DataFrame:
                who = np.repeat([x[0] for x in at], [len(x[1]) for x in at])
                # ids keep their type and nulls
                return pd.DataFrame({"id": ids.take(who), "h": hashes[who], "pos": np.concatenate([x[1] for x in at]), "a": np.concatenate([x[2] for x in at]), "b": np.concatenate([x[3] for x in at])})

            for i, t in enumerate(batch["text"]):
                w = word_hashes(t)
                a, b = rolled(w, k)
                pos = np.append(np.arange(len(a), dtype=np.int32), np.int32(len(w)))
                at.append((i, pos, np.append(a, _MARK[1]), np.append(b, _MARK[2])))
                size += len(pos)
                if size >= 200_000:
                    yield rows(at)
                    at, size = [], 0
            if at:
                yield rows(at)

    grams = template_rows(k)
    table = spark.createDataFrame(grams, "template int, label string, phrase boolean, tpos int, a bigint, b bigint, n int")
    every = ids.mapInPandas(roll, f"id {kind}, h bigint, pos int, a bigint, b bigint")
    hits = every.join(F.broadcast(table) if len(grams) <= MAX_BROADCAST else table, ["a", "b"])
    # repeated rows have one key: sets of positions, not counts, and the number of marks for the rows
    votes = hits.groupBy("id", "h", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("n").alias("n"), F.collect_set("tpos").alias("tposes"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end"), F.count(F.lit(1)).alias("rows"))
    by = Window.partitionBy("id", "h", "template").orderBy("diagonal")
    votes = votes.withColumn("new", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by), F.lit(gap + 1)) > gap).cast("int"))
    # a phrase counts by single diagonals, a template by merged ones
    votes = votes.withColumn("cluster", F.when(F.col("phrase") | (F.col("template") < 0), F.col("diagonal").cast("long")).otherwise(F.sum("new").over(by)))
    merged = votes.groupBy("id", "h", "template", "cluster").agg(
        F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("tposes")))).alias("voted"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("rows").alias("rows"))
    place = F.when(F.col("phrase") & (F.col("voted") == F.col("n")), F.struct(F.col("template").alias("phrase"), "label", "start"))
    candidate = F.when(~F.col("phrase") & (F.col("template") >= 0) & (F.col("voted") >= min_votes * F.col("n")), F.struct("template", "label", "start", "end"))
    mark = F.when(F.col("template") < 0, F.struct("start", "rows"))
    out = merged.groupBy("id", "h").agg(F.max(mark).alias("mark"), F.array_sort(F.collect_list(place)).alias("places"), F.array_sort(F.collect_list(candidate)).alias("candidates"))
    out = written(out, "votes", 50_000)

    wanted = out.where(F.size("candidates") > 0).select(F.col("id").alias("i"), F.col("h").alias("j"), "candidates")
    again = ids.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))).select("id", "h", "text", "candidates").dropDuplicates(["id", "h"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [text_words(t) for t, _ in (*PHRASES, *TEMPLATES)]
        for b in batches:
            spans = []
            for text, found in zip(b["text"], b["candidates"]):
                w, good = text_words(text), []
                for c in found:
                    share = verified_share(w[c["start"] : c["end"]], known[c["template"]])
                    if share >= min_share:
                        good.append({"label": c["label"], "start": c["start"], "end": c["end"], "share": share})
                spans.append(good)
            yield pd.DataFrame({"i": b["id"].array, "j": b["h"].to_numpy(np.int64), "spans": spans})

    verified = again.mapInPandas(verify, f"i {kind}, j bigint, spans array<struct<label:string,start:int,end:int,share:double>>").where(F.size("spans") > 0)
    got = out.join(verified, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<label:string,start:int,end:int,share:double>>")).alias("spans")
    got = got.select("id", "mark", "places", spans)
    return got.select(with_null(got, "id", docs, id_col), F.col("mark.start").cast("long").alias("n_words"), "places", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mark.rows"))).alias("__copy")).drop("__copy")
