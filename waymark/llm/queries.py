"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import lm_score, sharding, vector_links


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.7)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.lm_score import score_documents

    out = score_documents(table(spark, sf_dir, "documents"), order=3)
    return out.withColumn("log_score", F.round("log_score", 3)).withColumn("mean_log_score", F.round("mean_log_score", 6))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from waymark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: Bytes of text that a shard may hold.
SHARD_LIMIT = 32 << 20


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.licenses import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), SHARD_LIMIT)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.decontaminate import find_leaks

    out = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.suffix_dedup import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), 400, "none")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return out.select("doc_id", n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.vector_links import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_lm_score, op3_packing, op4_licenses, op5_sharding, op6_decontamination, op7_html, op8_suffix, op9_vectors, op10_jaccard)}
ORACLES: dict[str, str] = {"op2_lm_score": lm_score.oracle(), "op5_sharding": sharding.oracle(SHARD_LIMIT), "op9_vectors": vector_links.oracle(0.93)}
