import random
import re
import zlib

import pyarrow as pa
import pytest
from conftest import SF
from test_decontaminate import words_of
from test_jaccard_join import components
from test_suffix_dedup import brute_words as repeats

from waymark.llm import shingles, toxicity

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, held = docs.columns, {r.doc_id: r.text for r in docs.collect()}

    got = pipeline.drop_toxic(spark, docs, SF)
    assert got.columns == cols
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out())
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
    held = {i: t for i, t in held.items() if i not in bad}
    assert {r.doc_id: r.text for r in got.collect()} == held

    got = pipeline.drop_near_copies(spark, got, SF)
    assert got.columns == cols
    sets = {}
    for i, t in held.items():
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(ids, pairs)
    held = {i: held[i] for i in ids if comp[i] == i}
    assert {r.doc_id: r.text for r in got.collect()} == held

    got = pipeline.drop_repeated_passages(spark, got, SF)
    assert got.columns == cols
    kept = {i: (spans, k.decode()) for i, (spans, k) in repeats(sorted(held.items()), 51, True).items()}
    rows = {r.doc_id: r for r in got.collect()}
    assert any(spans for spans, _ in kept.values())
    assert {i: r.text for i, r in rows.items()} == {i: k for i, (spans, k) in kept.items() if not spans or re.search(r"[^\W_]", k)}
    assert all(r.n_chars == len(r.text) for r in rows.values())

    items = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    last = pipeline.drop_benchmark_leaks(spark, got, SF)
    assert last.columns == cols
    want = {i for i, r in rows.items() if not any(f" {t} " in f" {' '.join(words_of(r.text))} " for t in items)}
    assert {r.doc_id for r in last.collect()} == want
    pieces = pipeline.pack_sequences(spark, last, SF).collect()
    assert {r.doc_id for r in pieces} == want and all(r.ids_crc32 >= 0 for r in pieces)


def test_repeated_rows_and_nulls(spark):
    row = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A B c d e f", None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (4, None, "en", "s", 0)], row)
    out = docs
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a b c d e f"), (None, None), (3, ""), (4, None)], key=str)
    pieces = pipeline.pack_sequences(spark, out, SF).collect()
    assert len(pieces) == 4 and len({r.sequence_id for r in pieces}) == 1
    assert sum(r.ids_crc32 == zlib.crc32(b"\1\0\0\0") for r in pieces) == 3


def test_passages_of_51_words_go(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgèß") for _ in range(n))
    prose = lambda n: " ".join(word(5) for _ in range(n))
    shared, short, tiny, long = prose(51), prose(50), " ".join(word(1) for _ in range(51)), word(450)
    assert 300 <= len(shared.encode()) < 400
    docs = [(1, f"{prose(30)} {shared} {prose(30)}"), (2, f"é ({shared}), end"), (3, f"x {short} y"), (4, f"z {short} w"), (5, f"one {tiny} two"), (6, f"three\n{tiny}\nfour"), (7, f"v {long}"), (8, f"u {long}"), (9, shared), (10, None)]
    frame = spark.createDataFrame([(i, t, t and len(t)) for i, t in docs], "doc_id bigint, text string, n_chars bigint")
    rows = {r.doc_id: r for r in pipeline.drop_repeated_passages(spark, frame, SF).collect()}
    want = dict(docs) | {2: "é (), end", 6: "three\n\nfour"}
    del want[9]
    assert {i: r.text for i, r in rows.items()} == want
    assert all(r.n_chars == (r.text and len(r.text)) for r in rows.values())


def test_hot_groups(spark):
    """A third of the rows are one text, a third near copies of another, and the rest share a passage."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one, near, passage = prose(80), prose(120).split(), prose(60)
    docs = [(i, one) for i in range(200)]
    docs += [(1000 + i, " ".join([*near[: i % 110], prose(1), *near[i % 110 :]])) for i in range(200)]
    docs += [(2000 + i, f"{prose(70)} {passage} {prose(70)}") for i in range(200)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = frame
    for _, stage in pipeline.STAGES[1:3]:
        out = stage(spark, out, SF)
    rows = {r.doc_id: r.text for r in out.collect()}
    assert set(rows) == {0, 1000, *(2000 + i for i in range(200))}
    assert [i for i, t in rows.items() if passage in t] == [2000]


def test_whole_texts_travel_in_small_batches(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5000)], "doc_id bigint, text string").coalesce(1)
    before = spark.conf.get(pipeline.BATCH_CONF)
    try:
        kept = pipeline.drop_benchmark_leaks(spark, docs, SF)
        sizes = kept.select("doc_id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n bigint")
        got = [r.n for r in sizes.collect()]
        assert sum(got) == 5000 and max(got) <= 2048
    finally:
        spark.conf.set(pipeline.BATCH_CONF, before)


def test_workers_give_freed_memory_back():
    left = []

    @shingles.task("test")
    def run(batches):
        held = [b"x" * 4000 + bytes([i % 256]) for i in range(25_000)]  # 100 MB
        left.append(held[-1])  # what stays lies above what is freed
        yield len(held)

    shingles.give_back()
    before = shingles.resident()
    if not before:
        pytest.skip("the system does not tell")
    assert list(run([])) == [25_000]
    assert shingles.resident() < before + (30 << 20)
