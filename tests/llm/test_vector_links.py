import numpy as np
from conftest import SF, duck, same

from waymark.llm.vector_links import link_vectors, oracle


def brute(rows, t):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, comp = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    adj = {r[0]: set() for r in rows}
    for x, (i, v, la) in enumerate(ok):
        for j, w, lb in ok[x + 1 :]:
            if la == lb and len(v) == len(w) and (v * w).sum() / np.sqrt((v * v).sum() * (w * w).sum()) >= t:
                n[i] += 1
                n[j] += 1
                adj[i].add(j)
                adj[j].add(i)
    for s in sorted(adj):
        if comp[s] == s:
            todo = [s]
            while todo:
                for q in adj[todo.pop()]:
                    if comp[q] > s:
                        comp[q] = s
                        todo.append(q)
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_table_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    for t in (0.93, 0.3):
        assert got(link_vectors(df, t, tile=64)) == brute(rows, t)


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(3, 20))
    rows = [(i, (base[i % 3] + 0.2 * rng.normal(size=20)).tolist(), i % 2) for i in range(60)]
    rows += [(100 + i, base[0].tolist(), 1) for i in range(5)] + [(110, [1.0, 2.0], 1), (111, [2.0, 4.0], 1)]
    rows += [(200, None, 1), (201, [0.0] * 20, 1), (202, [float("nan")] * 20, 1), (203, base[0].tolist(), None), (204, [None] * 20, 0), (205, [], 0), (206, [float("inf")] + [1.0] * 19, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, rep int")
    assert got(link_vectors(df, 0.93, tile=16)) == brute(rows, 0.93)
    assert link_vectors(df.limit(0)).collect() == []


def test_extreme_lengths_and_null_ids(spark):
    rows = [(1, [1e-200, 2e-200], 1), (2, [1e200, 2e200], 1), (3, [3.0, 6.0], 1), (4, [-1e200, 1e200], 1), (5, [5e-324, 1e-323], 1), (6, [1.7e308, 1.7e308], 2), (7, [1e308, 1e308], 2), (None, [3.0, 6.0], 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    out = link_vectors(df, 0.93).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1), 6: (1, 6), 7: (1, 6)}
    assert [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, True)] * 2


def test_matches_duckdb(spark):
    same(link_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), 0.93), duck(), oracle(0.93))
