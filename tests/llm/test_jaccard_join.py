import re

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import jaccard_join
from waymark.llm.jaccard_join import jaccard_components, linked, metric_join, prefix, required, voronoi


def shingles(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(ids, pairs):
    comp = {i: i for i in ids}
    for _ in ids:
        changed = False
        for a, b in pairs:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
        if not changed:
            break
    return comp


def brute(docs, percent):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(ids, pairs)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def got(df):
    rows = df.collect()
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(out) == len(rows)
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 40), st.integers(0, 2**32), st.sampled_from([50, 80, 85, 95]))
def test_linked_sets_share_enough_of_their_prefixes(n, out, extra, seed, percent):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = np.unique(np.concatenate([a[min(out, len(a) - 1) :], rng.integers(0, 2**63, extra).astype(np.uint64)]))
    inter = len(np.intersect1d(a, b))
    if not linked(np.int64(inter), np.int64(len(a)), np.int64(len(b)), percent):
        return
    for share in (0, 0.3, 0.9, 1):
        some = np.unique(np.concatenate([a, b]))
        some = np.sort(some[rng.random(len(some)) < share])
        common = len(set(prefix(a, percent, some).tolist()) & set(prefix(b, percent, some).tolist()))
        assert common >= max(required(len(a), percent), required(len(b), percent))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([0.05, 0.15, 0.2, 0.5]))
def test_linked_texts_meet_in_a_cell(seed, radius):
    """Points of a plane stand for texts: any two within the radius share a cell."""
    rng = np.random.default_rng(seed)
    at = rng.random((60, 2)) * rng.choice([0.3, 1, 2])
    apart = np.minimum(1, np.abs(at[:, None] - at[None]).max(2))
    cells, beyond = voronoi(apart[:, :5], radius)
    assert (cells.any(1) | beyond).all()
    for i, j in zip(*np.nonzero(apart <= radius), strict=True):
        assert (cells[i] & cells[j]).any() or beyond[i] and beyond[j]


def family(rng, n, size, change):
    base = rng.integers(0, 2**40, size)
    out = []
    for _ in range(n):
        s = base.copy()
        hit = rng.random(size) < rng.random() * change
        s[hit] = rng.integers(0, 2**40, hit.sum())
        out.append(np.unique(s.astype(np.uint64)))
    return out


@pytest.mark.parametrize("change", [0.1, 0.3, 0.9])
def test_metric_join_is_exact(change):
    rng = np.random.default_rng(5)
    sets = family(rng, 260, 60, change) + family(rng, 150, 40, change)
    want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if linked(np.int64(len(np.intersect1d(sets[i], sets[j]))), len(sets[i]), len(sets[j]), 85)]
    assert components(range(len(sets)), metric_join(sets, 85)) == components(range(len(sets)), want)


def test_table_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(jaccard_components(df)) == brute([(r.doc_id, r.text) for r in df.collect()], 85)


def near_copies():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for f in range(6):
        base = rng.choice(words, 90).tolist()
        for _ in range(40):
            t = base.copy()
            for _ in range(rng.integers(0, 6)):
                t[rng.integers(0, len(t))] = str(rng.choice(words))
            docs.append((len(docs), " ".join(t[: rng.integers(80, 91)])))
        docs += [(len(docs) + i, " ".join(base[:k])) for i, k in enumerate((1, 2, 3, 4, 5, 90, 90))]
    docs += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "A b\tC"), (5004, "a  B c"), (5005, "É é é é é"), (5006, "é é é é é"), (5007, "x " * 3000)]
    return docs


@pytest.mark.parametrize("texts, steps", [(20, ("pivots",)), (20, jaccard_join.STEPS), (20, ("rare",)), (20, ())])
def test_regions_of_any_size(spark, monkeypatch, texts, steps):
    monkeypatch.setattr(jaccard_join, "REGION_TEXTS", texts)
    monkeypatch.setattr(jaccard_join, "STEPS", steps)
    docs = near_copies()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as node", "'r' as region")
    assert got(jaccard_components(df)) == brute(docs, 85)


def test_sets_whose_digests_begin_alike(spark, monkeypatch):
    docs = [(1, "a b c d"), (2, "e f g h"), (3, "a b c d"), (4, "i j k l")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    sets = jaccard_join._sets(df, 4).selectExpr("n_shingles", "cast(7 as bigint) as node", "c2")
    assert jaccard_join._collided(sets) == {7} and jaccard_join._collided(sets.limit(1)) == frozenset()
    first = {r.node for r in jaccard_join._sets(df, 4).collect()}
    monkeypatch.setattr(jaccard_join, "_collided", lambda sets: frozenset(first))
    assert got(jaccard_components(df)) == brute(docs, 85)


def test_ids_dealt_where_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SENT_IDS", 0)
    docs = near_copies()
    assert got(jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string"))) == brute(docs, 85)


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A B C D"), (None, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard_components(df).collect()), key=str) == sorted([(1, 1, 1), (1, 1, 1), (None, 1, None), (2, 1, 1), (None, 0, None)], key=str)
    assert jaccard_components(df.limit(0)).collect() == []
