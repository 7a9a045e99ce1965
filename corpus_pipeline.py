"""The corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the
folder that driver and executors share and the next stage reads it. All but the last return the columns
of `documents`. Extra columns are carried; null texts and ids, repeated rows and empty tables have the
results that each operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiewise.llm import dedup, packing, pii, quality, toxicity
from tiewise.llm.frames import read_table, stored
from tiewise.llm.queries import word_vocabulary


def __getattr__(name: str) -> str:
    """WORD_VOCABULARY, the path of the vocabulary that the last stage packs with."""
    if name == "WORD_VOCABULARY":
        return word_vocabulary()
    raise AttributeError(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule fails and the learned decision list keeps."""
    rules = quality.learn(quality.labelled_statistics(docs, read_table(spark, sf_dir, "labels")))
    into = "_quality"
    while into in docs.columns:
        into += "_"
    return quality.judge(docs, rules, into=into).where(F.col(into)["kept"]).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return toxicity.rejected(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; of rows that share an id, the one with the smallest hash of all columns.

    Rows without an id are not grouped and stay.
    """
    ids = dedup.near_duplicates(docs).where("kept and id is not null").groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("_n"))
    once, repeated = ids.where("_n = 1").select("doc_id"), ids.where("_n > 1").select("doc_id")
    ranked = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("r")).select("r.*")
    return (
        docs.join(once, "doc_id", "left_semi").select(*docs.columns)
        .unionByName(ranked)
        .unionByName(docs.where("doc_id is null"))
    )


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars set anew."""
    return pii.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, word_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: learned rules, trained scores and tokenizer ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
QUERY_SQL: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
