"""The queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ball_kmeans, decontamination, exact_dedup, language_id, mixing, neighbours, ngram_join, packing, quality, secrets, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents."""
    return exact_dedup.find_copies(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all documents."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all documents."""
    return ngram_join.find_groups(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all documents: counts, then the counts after masking all runs of three digits or more."""
    docs = _table(spark, sf_dir, "documents")
    trees = token_counts.build_trees(docs, tokenizer_path()).withColumnRenamed("n_tokens", "n_tokens_before")
    edited = token_counts.pattern_edits(trees, "[0-9]{3,}", "000")
    after = token_counts.apply_edits(edited.withColumn("doc_id", F.struct("doc_id", "n_tokens_before")), tokenizer_path())
    return after.select("doc_id.*", F.col("n_tokens").alias("n_tokens_after"), "n_edits", "n_chars_encoded")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all documents: sequences of at most 1024 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents."""
    return secrets.digests(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all documents."""
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: every twentieth embedding against all embeddings."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all pages."""
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over all documents."""
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over all embeddings."""
    return ball_kmeans.cluster(_table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: all documents against all benchmark items."""
    return decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_ngram_join, op4_token_counts, op5_packing, op6_secrets, op7_language_id, op8_nearest_neighbours, op9_quality, op10_warc, op11_alignment, op12_ball_kmeans, op13_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op2_mixing": mixing.OP2_SQL, "op3_ngram_join": ngram_join.OP3_SQL, "op12_ball_kmeans": ball_kmeans.OP12_SQL, "op13_decontamination": decontamination.OP13_SQL}
