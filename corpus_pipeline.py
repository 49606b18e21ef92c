"""The training-data pipeline: five stages over documents, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps with their columns; the
last returns the mix itself, one row a drawn piece of a document.  A stage's input and scratch tables
are deleted when its output has been written (the last stage's stay, as its rows are read later).

Defined cases, in every stage: null and empty texts are documents without a word; null ids, repeated
rows and extra columns (left out) are allowed; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, mixing, simhash, substrings, toxicity
from corpuslens.llm.common import bucket_of, delete, durable_path, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier marks go.  It learns from labelled documents of this stage's input; without
    labels of both kinds nothing is marked unless all are toxic.  Texts without a word are scored like any other."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id", 3) != 1)
    scored = toxicity.score(docs, model, keep=("text", "lang", "source", "n_chars"))
    return scored.where(F.col("score") < toxicity.CUT).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, five-word shingles and a similarity of 0.8: of each component one document stays, the one with the smallest id
    (of equal ids one row).  Texts without a word are one component.  Rows without an id cannot be told apart from each other: of a
    group of them without any id one stays."""
    return simhash.one_of_each(docs.select(*COLUMNS), similarity=0.8, shingle=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: repeated windows go from the texts; documents left without a word go, those that had none stay."""
    out = substrings.remove_repeats(docs, keep=("lang", "source"))
    out = out.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the mix, one row a drawn piece.  Documents without a word give no piece."""
    return mixing.mix_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: the classifier, the tree of random draws and rolling hashes have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{durable_path(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(path)
    return docs
