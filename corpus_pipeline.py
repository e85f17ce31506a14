"""Corpus cleaning: toxicity, near-duplicates, benchmark passages, secrets, then token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows its predecessor kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshlens.llm import bpe, decontam, minhash, secrets, toxicity
from meshlens.llm.common import drop, written
from meshlens.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=tuple(docs.columns), out="__score").where("__score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_path(), outputs=("ids", "digests"))


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("encoding", encode)]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}", 10_000)
            if before is not None:
                drop(before)
            before = docs
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
