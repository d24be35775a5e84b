"""A corpus pipeline of five of the training-data operators.

Each stage takes the documents that the stage before it kept and returns those that it keeps, with the columns of
``documents``; the last one writes the token files and returns what it reads back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pertgrid.llm import decontamination, language_id, minhash, mixing, token_output
from pertgrid.llm.common import stored, table
from pertgrid.llm.queries import tokenizer_path


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier accepts.  Rows of a null doc_id stay only with an accepted text."""
    dictionaries = language_id.fit(docs.where(~language_id.is_held_out(F.col("doc_id"))))
    return language_id.keep_accepted(docs, dictionaries)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.without_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the token files."""
    return token_output.token_output(docs, tokenizer_path())


STAGES = [
    ("language_id", identified),
    ("minhash_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_output", tokens),
]
#: Sketches, compressors and tokenizers have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
