import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm.packing import WordEncoder, nnls, pack, plan_histogram

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(hist, capacity):
    runs, n = plan_histogram(hist, capacity)
    spans = defaultdict(list)
    for length, rs in runs.items():
        at = 0
        for first, k, seq, offset, per in rs:
            assert first == at
            at += k
            for i in range(k):
                spans[seq + i // per].append((offset + i % per * length, length))
        assert at == hist[length]
    assert sorted(spans) == list(range(n))
    for got in spans.values():
        end = 0
        for start, length in sorted(got):
            assert start == end
            end += length
        assert end <= capacity
    return n


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
def test_plans_are_gapless_and_whole(hist):
    check_plan(hist, 64)


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(3)
    hist = Counter(np.minimum(4096, rng.lognormal(6, 1.2, 5000).astype(int) + 1).tolist())
    assert check_plan(hist, 4096) <= 1.005 * sum(k * v for k, v in hist.items()) / 4096 + 1


def test_nnls_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    a, h = rng.random((12, 30)), rng.random(12)
    x = nnls(a, h)
    grad = a.T @ (h - a @ x)
    assert x.min() >= 0 and grad.max() < 1e-6 and abs(grad[x > 0]).max() < 1e-6


def test_ids_are_the_tokenizer_s():
    enc = WordEncoder(PATH)
    texts = ["don't stop'S it's.", "a.,b ... x,y. É, é. ÀÉ. İstanbul ΑΣ ΑΣ.", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|> A.", "x y　z\x85w\x1c. \xa0", "", None, " ", "é a ́b", "123 4,5. 6.", "ok " * 300]
    texts += ["Ñandú ßtz, à Å. " + t for t in texts if t]
    for view in (pa.array(texts), pa.array(["é", *texts]).slice(1)):
        for t, got in zip(texts, enc.encode(view), strict=True):
            assert list(got) == enc.tok.encode(t or "", add_special_tokens=False).ids


def test_pack_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x y"), (-3, "word " * 9000), (-4, "a"), (-4, "a")], "doc_id bigint, text string")
    docs = docs.unionByName(odd).selectExpr("*", "1 as length", "2 as part")
    rows = pack(docs, PATH, 4096, 1).collect()
    enc = WordEncoder(PATH)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*enc.tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[(r.doc_id, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for got in seqs.values():
        end = 0
        for start, length in sorted(got):
            assert start == end
            end += length
        assert end <= 4096
    assert len(seqs) <= 1.02 * sum(r.length for r in rows) / 4096 + 2
    assert pack(docs.limit(0), PATH).count() == 0
