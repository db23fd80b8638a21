"""Links between embeddings of equal label by exact cosine, tile against tile in PCA order.

Equal vectors are first merged into classes, so a group of copies is one row. The classes of a label
are rotated to principal axes, ordered along the first and cut into tiles of bounded size. Two tiles
meet only if their ranges on the first axis come near enough for the threshold. Within a pair of
tiles the products of the leading dimensions are accumulated first; a pair of vectors is dropped as
soon as its sum plus the product of the remaining norms cannot reach the threshold. Each tile pair
returns link counts and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.components import connected_components
from waymark.plans.storage import save

#: Vectors that the principal axes are fitted on; the axes change speed only, never the result.
AXES_SAMPLE = 10_000
#: Distance from the threshold within which the decision is taken on the vectors as given.
NEAR = 1e-9


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Positions of links that join the same nodes as all links (a, b)."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    # labels first, by whole-array rounds; only links between different labels are walked one by one
    for k in range(len(a)):
        x, y = find(a[k]), find(b[k])
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return keep


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def tile_links(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool, step: int = 16, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in x, j in y) with cosine >= threshold, in blocks; ``same``: x is y, and i < j."""
    u, v = x / np.sqrt((x * x).sum(1))[:, None] @ axes, y / np.sqrt((y * y).sum(1))[:, None] @ axes
    d = u.shape[1]
    tail = lambda m: np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], 1)[:, ::-1]))
    tu, tv = tail(u), tail(v)
    for r in range(0, len(u), rows):
        block = u[r : r + rows]
        s = block[:, :step] @ v[:, :step].T
        if d > step:
            ok = s + np.outer(tu[r : r + rows, step], tv[:, step]) >= threshold - NEAR
        else:
            ok = np.ones_like(s, bool)
        if same:
            ok &= np.arange(r, r + len(block))[:, None] < np.arange(len(v))[None, :]
        i, j = np.nonzero(ok)
        if len(i) > 0.02 * ok.size:  # most pairs go on: all at once is cheaper
            if d > step:
                s = s + block[:, step:] @ v[:, step:].T
            s = s[i, j]
        else:
            s = s[i, j]
            for k in range(step, d, step):
                s = s + np.einsum("ij,ij->i", block[i, k : k + step], v[j, k : k + step])
                if k + step < d:
                    go = s + tu[r + i, k + step] * tv[j, k + step] >= threshold - NEAR
                    i, j, s = i[go], j[go], s[go]
        yes = s >= threshold + NEAR
        near = np.flatnonzero(~yes & (s >= threshold - NEAR))
        for c in range(0, len(near), 1 << 16):
            q = near[c : c + (1 << 16)]
            yes[q] = _exact(x[r + i[q]], y[j[q]]) >= threshold
        yield r + i[yes], j[yes]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once; a column read in a lambda would be for each component."""
    return F.transform(F.array(value), body)[0]


def _scaled(v: Column) -> Column:
    """``v / 2 ** k`` for the exponent ``k`` of its largest component, in two steps, as the power alone may be out of range."""
    top = F.floor(F.log2(F.array_max(F.transform(v, lambda x: F.abs(x)))))
    powers = _let(top, lambda k: F.struct(F.pow(F.lit(2.0), -F.floor(k / 2)).alias("p"), F.pow(F.lit(2.0), F.floor(k / 2) - k).alias("q")))
    return _let(powers, lambda s: F.transform(v, lambda x: x * s["p"] * s["q"]))


def link_vectors(vectors: DataFrame, threshold: float = 0.93, tile: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine
    in double precision is at least ``threshold`` (over 0). Null, empty and zero vectors, and those
    with null or non-finite components, link with nothing. Repeated rows count as vectors of their
    own, linked to each other. Vectors are scaled by powers of two first, so no finite length is too great
    or too small; components below 1e-300 of the largest may vanish. A row with a null id takes no part:
    its id and component are null, it is kept and has no links. Other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    vec = F.col(vector_col)
    sound = F.col(label_col).isNotNull() & vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(F.coalesce(sound, F.lit(False)), _let(F.transform(vec, lambda x: x.cast("double") + F.lit(0.0)), _scaled)).alias("v"))
    # scaled by a power of two, which changes no cosine and no digit: squares neither vanish nor overflow
    rows = rows.withColumn("c1", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))).withColumn("c2", F.xxhash64(F.lit(1), "v", "label"))
    classes = save(rows.where("v is not null and vec_id is not null").groupBy("c1", "c2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").cast("string").alias("label"), F.first("v").alias("v")), "vector-classes")

    axes: dict[int, np.ndarray] = {}
    sample = classes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(AXES_SAMPLE).toPandas()
    for d, part in sample.groupby(sample["v"].map(len)) if len(sample) else ():
        m = np.stack(part["v"].to_numpy())
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        axes[int(d)] = np.linalg.eigh(m.T @ m)[1][:, ::-1]

    def first_axis(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = [float(np.dot(v, axes[len(v)][:, 0]) / np.linalg.norm(v)) if len(v) in axes else 0.0 for v in pdf["v"]]
            yield pd.DataFrame({"label": pdf["label"] + [f"/{len(v)}" for v in pdf["v"]], "t": t, "rep": pdf["rep"], "copies": pdf["copies"], "v": pdf["v"]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows of a range into tiles; a tile holds one label and never more than ``tile`` rows."""

        def packed(label: str, rest: list[tuple]) -> pd.DataFrame:
            t, rep, copies, v = zip(*rest, strict=True)
            return pd.DataFrame({"label": [label], "lo": [t[0]], "hi": [t[-1]], "first": [min(rep)], "rep": [np.array(rep, np.int64).tobytes()], "copies": [np.array(copies, np.int64).tobytes()], "v": [np.stack(v).tobytes()]})

        label, rest = None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if rest and (row.label != label or len(rest) == tile):
                    yield packed(label, rest)
                    rest = []
                label = row.label
                rest.append((row.t, row.rep, row.copies, row.v))
        if rest:
            yield packed(label, rest)

    ordered = classes.mapInPandas(first_axis, "label string, t double, rep bigint, copies bigint, v array<double>").repartitionByRange("label", "t", "rep").sortWithinPartitions("label", "t", "rep")
    tiles = save(ordered.mapInPandas(cut, "label string, lo double, hi double, first bigint, rep binary, copies binary, v binary"), "vector-tiles")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + NEAR  # unit vectors this near or nearer may link
    heads = tiles.select("label", "lo", "hi", "first")
    a = heads.select("label", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("first").alias("a"))
    b = heads.select("label", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("first").alias("b"))
    pairs = a.join(b, "label").where((F.col("a") <= F.col("b")) & (F.col("lo_a") <= F.col("hi_b") + reach) & (F.col("lo_b") <= F.col("hi_a") + reach)).select("a", "b")
    blob = tiles.select("first", "rep", "copies", "v")
    both = pairs.join(blob.toDF("a", "rep_a", "copies_a", "v_a"), "a").join(blob.toDF("b", "rep_b", "copies_b", "v_b"), "b").repartition("a", "b")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ia, ib = np.frombuffer(r.rep_a, np.int64), np.frombuffer(r.rep_b, np.int64)
                ca, cb = np.frombuffer(r.copies_a, np.int64), np.frombuffer(r.copies_b, np.int64)
                x, y = np.frombuffer(r.v_a).reshape(len(ia), -1), np.frombuffer(r.v_b).reshape(len(ib), -1)
                same, d = r.a == r.b, x.shape[1]
                na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
                ends = ([], [])
                for i, j in tile_links(x, y, axes.get(d, np.eye(d)), threshold, same):
                    na += np.bincount(i, cb[j], len(ia)).astype(np.int64)
                    nb += np.bincount(j, ca[i], len(ib)).astype(np.int64)
                    p, q = (i, j) if same else (i, j + len(ia))
                    if len(p):
                        keep = _forest(p, q, len(ia) + len(ib))
                        ends[0].append(p[keep])
                        ends[1].append(q[keep])
                if not ends[0]:
                    continue
                ids = np.concatenate([ia, ib])
                p, q = np.concatenate(ends[0]), np.concatenate(ends[1])
                keep = _forest(p, q, len(ids))
                n = np.concatenate([na, nb])
                at = np.flatnonzero(n)
                yield pd.DataFrame({"a": ids[at], "b": ids[at], "n": n[at]})
                yield pd.DataFrame({"a": ids[p[keep]], "b": ids[q[keep]], "n": 0})

    found = save(both.mapInPandas(links, "a bigint, b bigint, n bigint"), "vector-links")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = connected_components(found).withColumnsRenamed({"node": "rep"})
    known = classes.select("c1", "c2", "rep", "copies").join(counts, "rep", "left").join(comp, "rep", "left")
    known = known.select("c1", "c2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    keys = rows.select("vec_id", *(F.when(F.col("vec_id").isNotNull(), F.col(c)).alias(c) for c in ("c1", "c2")))
    out = keys.join(known, ["c1", "c2"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component")), F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def oracle(threshold: float = 0.93, table: str = "embeddings") -> str:
    """The same in DuckDB, for tables without null ids, repeated ids and extreme lengths: all pairs of a label, and reachability."""
    return f"""
    WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM {table} WHERE label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= {threshold}),
    r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
    m AS (SELECT a, min(c) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.c, vec_id)::BIGINT AS component_id, coalesce(m.c, vec_id) = vec_id AS kept
    FROM {table} e LEFT JOIN m ON m.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
