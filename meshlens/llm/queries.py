"""The queries opN_* over the fixed tables, with the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, licenses, minhash, secrets, suffix, toxicity, vectors, warc
from .oracles import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The vocabulary's place: a folder named by MESHLENS_TOKENIZERS, or the installed public files."""
    if folder := os.environ.get("MESHLENS_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(table(spark, sf_dir, "pages"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    both = F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"])))  # spans verified word for word
    shares = F.array_max(F.transform("spans", lambda s: s["share"]))
    return got.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"), F.concat_ws(",", F.array_sort(both)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(shares, F.lit(0.0)))).alias("score"))


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    got = chat.format_chat(turns.unionByName(planted))
    back = got.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query
def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns carry an image, an audio, a document or an unknown part between two texts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    k = F.pmod("turn", F.lit(5))
    kind = F.when(k == 0, "image").when(k == 1, "audio").when(k == 2, "document").when(k == 3, "video").otherwise("text")
    part = lambda t, x, r, n: F.struct(t.alias("type"), x.alias("text"), r.alias("ref"), n.cast("int").alias("tokens"))
    none, text = F.lit(None).cast("string"), F.lit("text")
    middle = part(kind, F.when(k == 4, "</turn>"), F.when(k != 4, F.concat(F.lit("media:"), "turn")), F.when(k == 2, F.lit(7)))
    parts = F.array(part(text, F.col("text"), none, F.lit(None)), middle, part(text, F.lit("<|end"), none, F.lit(None)))
    got = chat.format_chat(turns.withColumn("parts", parts), parts_col="parts")
    refs = F.array_join(F.transform("attachments", lambda a: F.concat_ws(" ", a["type"], a["ref"], a["tokens"].cast("string"))), ",")
    return got.select("conv_id", "n_turns", "media_tokens", refs.alias("attachments"), F.sha2(F.col("formatted").cast("binary"), 256).alias("formatted_sha256"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an owner's texts of one language stand for a repository
    docs = table(spark, sf_dir, "documents").withColumn("repository", F.concat_ws("/", "source", "lang"))
    got = secrets.scan_corpus(docs, repo_col="repository", owner_col="source")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = secrets.joined(F.col("found"), ("assign", "access", "hex"))
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"), "n_live", "n_example", "n_weak", "widest", "most_repos")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), decontam.is_contaminated().alias("contaminated"))


@query
def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


@query
def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.links(table(spark, sf_dir, "embeddings"))
