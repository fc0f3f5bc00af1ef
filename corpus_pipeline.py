"""A training corpus from raw documents: stages of ledgerloom.llm, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import benchmark, language, passages, pieces, simhash
from ledgerloom.llm.queries import tokenizer
from ledgerloom.llm.store import Workspace, unused


def accepted_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language the classifier accepts; it learns from their own labels. `lang` stays as it is.

    Rejected: null texts, texts without a letter, scores below the calibrated threshold.
    """
    into = unused(docs, "_language")
    found = language.scored(docs, language.fit(docs), into=into)
    return found.where(F.col(into).getField("accepted")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, whole."""
    return simhash.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without passages of 20 or more words that stand earlier; those with no word left go."""
    left = passages.without_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return benchmark.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of what is left, with an end id."""
    rows = pieces.encoded(docs, tokenizer("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", accepted_language),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("decontamination", decontaminated),
    ("token ids", token_ids),
]

# The stages train a model, hash with XXH64 and align passages, which SQL cannot express; tests/llm holds the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages over the documents table of `folder`; the last one's rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    done: Workspace | None = None
    for name, stage in STAGES:
        work = Workspace(spark, f"stage-{name.replace(' ', '-')}")
        docs = work.keep(stage(spark, docs, folder), "docs")
        if done:
            done.remove()
        done = work
    return docs
