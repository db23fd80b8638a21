import random

import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import decontaminate
from waymark.llm.decontaminate import Index, find_leaks, item_postings, overlap, question_answer, words_of


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("abcdefghij"), st.floats(0.01, 1), min_size=1), min_size=1, max_size=90), st.sets(st.sampled_from("abcdefghijk")), st.floats(0.2, 1))
def test_wand_retrieves_exactly_what_reaches_the_threshold(items, query, threshold):
    rows = [(i, t, w / sum(x.values())) for i, x in enumerate(items) for t, w in x.items()]
    index = Index(rows, threshold)
    score = {}
    for i, t, w in rows:
        if t in query:
            score[i] = score.get(i, 0) + w
    want = {i for i, s in score.items() if s >= threshold - 1e-9}
    got = index.search(set(query))
    assert {i for i, _ in got} == want and len(got) == len(want)
    assert all(abs(s - score[i]) < 1e-9 for i, s in got)
    assert not want or index.possible(set(query))
    assert {i for t in index.possible(set(query)) for i, _ in index.essential[t]} >= want


def test_question_and_answer():
    assert question_answer("What is it? It is red.") == (["what", "is", "it"], ["it", "is", "red"])
    assert question_answer("a b c d e f") == (list("abcd"), list("ef"))
    assert overlap(list("abcd"), list("xabcdx")) == 1 and overlap(list("abcd"), list("dcba")) == 0


def rows_of(df):
    return sorted((r.doc_id, x.item_id) for r in df.collect() for x in r.leaks)


@pytest.mark.parametrize("index_rows", [10**6, 200])
def test_planted_items_and_clean_documents(spark, monkeypatch, index_rows):
    monkeypatch.setattr(decontaminate, "INDEX_ROWS", index_rows)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    known = [tuple(r) for r in items.collect()]
    rng = random.Random(1)
    vocab = words_of(" ".join(t for _, t in known))
    docs, want = [], []
    for d in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 400))]
        if d % 3 == 0:
            i, t = rng.choice(known)
            part = t.split()
            if d % 2 and len(part) > 25:
                part[len(part) // 3] = "other"
            k = rng.randrange(len(words))
            words[k:k] = part
            want.append((d, i))
        docs.append((d, " ".join(words), 1))
    docs += [(900, None, 1), (901, "", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, leaks int")
    assert rows_of(find_leaks(df, items)) == sorted(want)


def test_table_against_verbatim_search(spark):
    df, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = [(r.item_id, " ".join(words_of(r.text))) for r in items.collect()]
    want = sorted((r.doc_id, i) for r in df.collect() for i, t in bench if f" {t} " in f" {' '.join(words_of(r.text or ''))} ")
    assert rows_of(find_leaks(df, items)) == want


def test_impacts_sum_to_one_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c c."), (1, "a b c c."), (2, "a"), (3, None), (4, "!!")], "item_id bigint, text string")
    sums = item_postings(items, "item_id", "text").groupBy("item_id").sum("impact").collect()
    assert sorted(r[0] for r in sums) == [1, 2] and all(abs(r[1] - 1) < 1e-9 for r in sums)
    docs = spark.createDataFrame([(1, "a b c c"), (None, "a b c c")], "doc_id bigint, text string")
    assert [[x.item_id for x in r.leaks] for r in find_leaks(docs, items.limit(0)).collect()] == [[], []]
    assert find_leaks(docs.limit(0), items).count() == 0
