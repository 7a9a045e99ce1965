"""The registered queries of this package's operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiewise.llm import ann, bpe, chat, dedup, lm, packing, pii, quality, token_store, toxicity
from tiewise.llm.frames import read_table



def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file; looked up when a query runs, so that the other queries don't need it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_vocabulary() -> str:
    return vocabulary("byte_bpe_50k.json")


def word_vocabulary() -> str:
    return vocabulary("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), byte_vocabulary())


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), word_vocabulary())


def quality_rules(spark: SparkSession, sf_dir: str) -> list[quality.Rule]:
    return quality.learn(quality.labelled_statistics(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"), quality_rules(spark, sf_dir))
    return judged.select("doc_id", *(F.col("_quality")[c].alias(c) for c in (*quality.STATISTICS, "base_failed", "kept")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.train(documents, read_table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", "predicted")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(read_table(spark, sf_dir, "documents"))
    return scored.select(F.col("id").alias("doc_id"), "n_words", F.round("log_score", 4).alias("log_score"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(read_table(spark, sf_dir, "documents"), word_vocabulary())


QUERIES = {"op1_bpe": op1_bpe, "op2_pii": op2_pii, "op3_ann": op3_ann, "op4_token_store": op4_token_store, "op5_chat": op5_chat, "op6_packing": op6_packing, "op7_quality": op7_quality, "op8_minhash": op8_minhash, "op9_toxicity": op9_toxicity, "op10_lm": op10_lm}

QUERY_SQL: dict[str, str] = {"op5_chat": chat.SQL, "op10_lm": lm.SQL}
