import pytest
from conftest import SF, duck, same
from pyspark.sql import functions as F

from waymark.llm.sharding import assign_shards, oracle


@pytest.mark.parametrize("limit", [40_000, 300_000, 10**9])
def test_matches_duckdb(spark, limit):
    same(assign_shards(spark.read.parquet(f"{SF}/documents.parquet"), limit), duck(), oracle(limit))


def test_limit_holds_for_copies_nulls_and_long_texts(spark):
    rows = [(1, "x" * 30)] * 50 + [(None, "é" * 10)] * 5 + [(2, None), (3, ""), (4, "y" * 500), (4, "z")]
    docs = spark.createDataFrame([(*r, 7, "h") for r in rows], "doc_id bigint, text string, h int, cell string")
    out = assign_shards(docs, 100).cache()
    assert out.count() == len(rows)
    shards = out.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.max("oversized").alias("o")).collect()
    assert all(r.b <= 100 or (r.n == 1 and r.o) for r in shards)
    assert sum(r.o for r in shards) == 1


def test_empty_table_and_bad_limit(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert assign_shards(docs, 10).collect() == []
    with pytest.raises(ValueError):
        assign_shards(docs, 0)
