import math
from collections import Counter

import pytest
from conftest import SF, duck, same
from pyspark.sql import functions as F

from waymark.llm.lm_score import ALPHA, oracle, score_documents


def brute(docs, order):
    texts = [(t or "").encode().lower().split() for _, t in docs]
    count = [Counter(tuple(t[i : i + k]) for t in texts for i in range(len(t) - k + 1)) for k in range(1, order + 1)]
    total, out = sum(map(len, texts)), []
    for (doc, _), t in zip(docs, texts):
        own = [Counter(tuple(t[i : i + k]) for i in range(len(t) - k + 1)) for k in range(1, order + 1)]
        rest = lambda g: count[len(g) - 1][g] - own[len(g) - 1][g]
        log, by = 0.0, [0] * (order + 1)
        for i in range(len(t)):
            top = min(i + 1, order)
            k = next((k for k in range(top, 0, -1) if rest(tuple(t[i - k + 1 : i + 1])) > 0), 0)
            n = max(1, total - len(t))
            s = 0.5 / n if k == 0 else rest((t[i],)) / n if k == 1 else rest(tuple(t[i - k + 1 : i + 1])) / rest(tuple(t[i - k + 1 : i]))
            log += math.log(s) + math.log(ALPHA) * (top - max(k, 1))
            by[k] += 1
        out.append((doc, len(t), round(log, 6), *by))
    return sorted(out, key=str)


def got(df, order):
    return sorted(((r.doc_id, r.n_words, round(r.log_score, 6), r.n_unknown, *(r[f"n_{k}"] for k in range(1, order + 1))) for r in df.collect()), key=str)


@pytest.mark.parametrize("order, block", [(1, 1 << 20), (2, 50), (3, 200), (4, 1 << 20)])
def test_against_brute_force(spark, order, block):
    docs = [(i, " ".join("abcde"[(i * j * j + j) % 5] + ("x" if j % 7 == i % 7 else "") for j in range(i % 40))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, " \n"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (203, "Zz zZ only\tHERE é"), (204, "a " * 2000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as block", "2 as n_1")
    assert got(score_documents(df, order, block), order) == brute(docs, order)


def test_matches_duckdb_and_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = score_documents(docs, 3, 100_000).withColumn("log_score", F.round("log_score", 3)).withColumn("mean_log_score", F.round("mean_log_score", 6))
    same(out, duck(), oracle(), 6)
    assert score_documents(docs.limit(0)).collect() == []
