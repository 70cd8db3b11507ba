"""A training corpus from raw documents: the stages in order, each over all that its predecessor kept.

The filtering stages learn from their own input, decide about every row of it and return the columns of
``documents``; the last one returns the pieces of the packed sequences. The first two decide about a row as it passes, the deduplications
number the rows of their input and decide by these numbers, so rows whose doc_id is null or repeated stay or go each on its own merits.

Defined results: null and empty texts have no letter and go in the first stage; repeated rows are equal texts, of which one stays; very long
texts are judged and packed whole; an empty table gives no rows; further columns are kept until the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import language_id as languages
from lamella.llm import toxicity as toxic
from lamella.llm._scratch import Scratch
from lamella.llm.exact_dedup import drop_copies
from lamella.llm.minhash_dedup import drop_near
from lamella.llm.packing import pack

#: A text goes where no language explains it, or two do about equally.
LEAST_LANGUAGE_SCORE = 0.5
TOXIC_SCORE = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose best language has a posterior below one half."""
    return docs.where(languages.language_score(docs["text"], languages.train(docs)) >= LEAST_LANGUAGE_SCORE)  # und scores 0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return docs.where(toxic.toxic_score(docs["text"], toxic.train(docs, labels)) < TOXIC_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest original stays."""
    return drop_copies(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component over five-word shingles and a similarity of 0.8."""
    return drop_near(docs, width=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a row is a piece of a document in its sequence, with the token ids."""
    return pack(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("minhash_near_dedup", minhash_near_dedup), ("packing", packing)]

#: Learned models decide in the first two stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
