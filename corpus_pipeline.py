"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``. :func:`run` applies them to ``documents``, writing each stage's result as
Parquet in the shared folder and reading it back, so a lost executor costs one stage at most.

No stage fails on nulls, empty or repeated rows: a null text is kept by the filters (nothing speaks
against it) and packed as an empty one; rows with null ids are judged by their texts alone and never
merged.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from waymark.plans.storage import drop, save

TOXIC_SCORE = 0.7
SHINGLE_WORDS, NEAR_PERCENT = 5, 80
REPEAT_WORDS = 51
SEQUENCE_TOKENS = 4096
#: Whole texts travel to the workers: 10,000 of them, Spark's default, are tens of MB on both sides of each task.
BATCH_ROWS, BATCH_CONF = 2048, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(stage: Callable) -> Callable:
    """The stage, with at most BATCH_ROWS rows in a batch; the setting stays, for results are lazy."""

    @functools.wraps(stage)
    def with_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
            spark.conf.set(BATCH_CONF, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return with_batches


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labels that are not held out, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.score(docs, toxicity.fit(docs, labels), TOXIC_SCORE).where("predicted = 0").select(*docs.columns)


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id; of rows equal in id and text one."""
    comp = jaccard_join.jaccard_components(docs, SHINGLE_WORDS, NEAR_PERCENT)
    ids = save(comp.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays")), "stays")
    once = docs.join(jaccard_join.sent(ids.where("not stays or n > 1").select("doc_id")), "doc_id", "left_anti")
    again = docs.join(jaccard_join.sent(ids.where("stays and n > 1").select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


@small_batches
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of passages of 51 words and more; texts of which no word stays go.

    Words stand between ASCII white space and are compared without the ASCII signs around them.
    """
    cut = suffix_dedup.dedup_substrings(docs, REPEAT_WORDS, "first", unit="words")
    touched = F.size("spans") > 0
    left = F.when(touched, F.col("kept").cast("string")).otherwise(F.col("text"))
    new = cut.select(*(left.alias("text") if c == "text" else F.col(c) for c in docs.columns), touched.alias("touched"))
    new = new.where(~F.col("touched") | F.col("text").rlike(r"[^\x00-/:-@\[-`{-\x7f]"))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("touched"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)


@small_batches
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(docs, items).where(F.size("leaks") == 0).select(*docs.columns)


@small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", drop_repeated_passages),
    ("benchmark leaks", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Word shingle components, byte repeats and tokenizers are beyond SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        new = save(stage(spark, docs, sf_dir), f"stage-{k}")
        drop(docs)  # the table of the stage before; `documents` itself is left alone
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
