"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromatile.llm import exact_dedup, language_id, mixing, ngram_join, packing
from chromatile.llm._common import materialise
from chromatile.llm.queries import tokenizer_path


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, with it: null texts and texts without a letter go.

    ``lang`` is what is found where a document had none; labels that are there stay. If no row that is not held
    out has a label, no language can be learned; then all texts with a letter stay as they are.
    """
    model = language_id.train(docs)
    if not model.languages:
        return language_id.with_letter(docs)
    found = language_id.identify(docs, model, lang_col="_lang", score_col="_score")
    return found.filter(F.col("_lang") != language_id.UNKNOWN).withColumn("lang", F.coalesce("lang", "_lang")).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language ID and packing cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
