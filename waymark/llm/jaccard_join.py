"""Exact Jaccard self-join of word-shingle sets in metric space, by pivots and Voronoi regions.

Jaccard distance is a metric. In a region of texts, pivots are drawn and every text learns its
distance to each. It links with pivots within the radius; it goes to the cell of its nearest pivot
and, where the triangle inequality cannot exclude a partner there (its distance to a pivot is within
twice the radius of its least distance), to that cell too. Texts far from every pivot go to a cell of
their own, which overlaps the others by one radius, so that no linked pair is parted. Cells are joined
in the same way, recursively, down to small ones that are compared directly. A region whose texts are
already in one component needs no further comparison, so a group of near copies costs little more
than its pivots.

Most texts of a corpus are at distance one from every other, and a Voronoi partition of them would
replicate each everywhere. They are set aside first, exactly: linked sets share most of their
shingles, so of a prefix of either's shingles in one fixed order they share a known number, and a text
that has fewer of its prefix in common with all others together links with none. Of what stays, texts
that share a prefix shingle, directly or through others, form the regions where the metric join begins.

Where pivots part nothing, a text's rarest shingles within the region (so many that a linked text must
share one) do. Regions over ``REGION_BYTES`` or ``REGION_TEXTS`` are split by the same steps as
distributed jobs; one that no step shrinks is compared block against block. Only stars, a component's
first text with its others, leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.shingles import shingle_sets, task, texts_of
from waymark.operators.components import connected_components
from waymark.plans.storage import drop, save

#: Sets of a region that one task may hold, in bytes and in number; larger regions are split by distributed jobs.
REGION_BYTES, REGION_TEXTS = 24 << 20, 512
#: Texts compared directly, pivots of a step, and keys a task holds before it passes them on.
LEAF, PIVOTS, KEYS_AT_ONCE = 48, 16, 1 << 20
SALTS = 16
#: What splits large regions, one after the other; what is large still is compared block against block.
STEPS = ("pivots", "rare", "pivots", "pivots")
#: Cells that the texts of a region may go to on average; regions where pivots part less are split otherwise.
SPREAD = 4
#: Of a hundred shingles, those that a prefix holds beyond the fewest that could do, and so many it must share.
EXTRA = 16
#: Texts sampled for frequent shingles, and frequent shingles kept, at most.
SAMPLE, FREQUENT = 8_192, 500_000
#: Different sets whose digests begin alike that are told apart, at most (at 25 billion sets, about 17).
COLLIDED = 100_000
#: Ids that are sent to every task; with more, texts and ids are dealt by id.
SENT_IDS = 1_000_000


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """100 * |A & B| >= percent * |A | B|, in whole numbers."""
    return 100 * inter >= percent * (a + b - inter)


# ---- prefixes -----------------------------------------------------------------------------------


def shared_least(n, percent: int):
    """Sets linked with one of ``n`` shingles have at least so many in common with it."""
    return -(-n * percent // 100)


def beyond(n):
    """Shingles of a prefix beyond the first that linked sets must share."""
    return np.maximum(1, n * EXTRA // 100)


def prefix(hashes: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a set in the order (frequent last, hash).

    Of two linked sets, the k-th common shingle lies in the prefixes of both while k is at most
    ``beyond`` of the smaller set. A partner of a set of ``n`` has ``shared_least(n)`` shingles or
    more, so a set shares ``required(n)`` shingles of its prefix with the prefixes of any partner.
    ``frequent`` is any sorted choice of shingles, the same for all sets.
    """
    n = len(hashes)
    size = int(n - shared_least(n, percent) + beyond(n))
    if frequent is None or not len(frequent):
        return hashes[:size]
    pos = np.searchsorted(frequent, hashes)
    pos[pos == len(frequent)] = 0
    often = frequent[pos] == hashes
    return np.concatenate([hashes[~often], hashes[often]])[:size]


def required(n, percent: int):
    return beyond(shared_least(n, percent))


# ---- regions within a task ----------------------------------------------------------------------


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)

    def one(self, members: np.ndarray) -> bool:
        first = self.find(int(members[0]))
        return all(self.find(int(m)) == first for m in members[1:])

    def stars(self) -> list[tuple[int, int]]:
        """The root of each member's component, with each member that is not a root."""
        return [(r, x) for x in range(len(self.root)) if (r := self.find(x)) != x]


def intersections(sets: list[np.ndarray], few: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of ``sets`` with each of ``few``, by products of bounded 0/1 tables."""
    out = np.zeros((len(sets), len(few)), np.int64)
    left = 0
    while left < len(few):
        right, size = left, 0
        while right < len(few) and (right == left or (size + len(few[right])) * (right - left + 1) <= 1 << 22):
            size += len(few[right])
            right += 1
        space = np.unique(np.concatenate(few[left:right]))
        has = np.zeros((len(space), right - left), np.float32)
        for k in range(left, right):
            has[np.searchsorted(space, few[k]), k - left] = 1
        at = 0
        while at < len(sets):
            end = min(len(sets), at + max(1, (1 << 22) // len(space)))
            flat = np.concatenate(sets[at:end])
            of = np.repeat(np.arange(end - at), [len(s) for s in sets[at:end]])
            pos = np.searchsorted(space, flat)
            pos[pos == len(space)] = 0
            hit = space[pos] == flat
            rows = np.zeros((end - at, len(space)), np.float32)
            rows[of[hit], pos[hit]] = 1
            out[at:end, left:right] = np.rint(rows @ has)
            at = end
        left = right
    return out


def rare_prefixes(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, set) for the rarest shingles of each set, so many that linked sets share one of them."""
    size = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), size)
    _, shingle, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((shingle, often[shingle], of))
    rank = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    keep = order[rank < np.repeat(prefix_length(size, percent), size)]
    keep = keep[often[shingle[keep]] > 1]
    return shingle[keep], of[keep]


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """Linked sets share at least ``percent`` of either; so many of a set's shingles cannot all be missing."""
    return size - -(-size * percent // 100) + 1


def voronoi(far: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For distances (text, pivot): which cells each text goes to, and whether to the cell beyond all pivots.

    If one of two linked texts is within ``1 - 3 * radius`` of a pivot, both are within
    ``1 - 2 * radius`` and meet in the first one's nearest cell; if neither is, they meet beyond.
    """
    least = far.min(1, keepdims=True)
    cells = (far <= least + 2 * radius + 1e-9) & (least <= 1 - 2 * radius + 1e-9)
    return cells, least[:, 0] > 1 - 3 * radius - 1e-9


def metric_join(sets: list[np.ndarray], percent: int, seed: int = 7) -> list[tuple[int, int]]:
    """Pairs that connect whatever links of the sets connect, exactly: the first of a component with each other. No set may be empty."""
    forest = Forest(len(sets))
    size = np.array([len(s) for s in sets])
    radius = (100 - percent) / 100
    todo = [(np.arange(len(sets)), "pivots")]
    rng = np.random.default_rng(seed)

    def compare(group: np.ndarray, some: np.ndarray) -> np.ndarray:
        inter = intersections([sets[i] for i in group], [sets[i] for i in some])
        i, j = np.nonzero(linked(inter, size[group][:, None], size[some][None, :], percent))
        forest.join(group[i], some[j])
        return inter

    while todo:
        group, how = todo.pop()
        if len(group) < 2 or forest.one(group):
            continue
        if len(group) <= LEAF:
            compare(group, group)
            continue
        if how == "pivots":
            pivots = rng.choice(group, PIVOTS, replace=False)
            inter = compare(group, pivots)
            if forest.one(group):
                continue
            far = 1 - inter / (size[group][:, None] + size[pivots][None, :] - inter)
            cells, beyond_all = voronoi(far, radius)
            near = np.flatnonzero(cells.any(1))
            if cells.sum(0).max(initial=0) <= 0.7 * len(near):
                todo += [(group[cells[:, k]], "pivots") for k in range(len(pivots))]
            else:
                todo.append((group[near], "rare"))
            todo.append((group[beyond_all], "pivots" if beyond_all.sum() <= 0.7 * len(group) else "rare"))
            continue
        # pivots that part nothing: texts far from each other, which their rarest shingles can part
        shingle, of = rare_prefixes([sets[i] for i in group], percent)
        order = np.argsort(shingle, kind="stable")
        shared = np.split(of[order], np.flatnonzero(np.diff(shingle[order])) + 1) if len(of) else []
        shared = [g for g in shared if len(g) > 1]
        parts = Forest(len(group))
        for g in shared:
            parts.join(g[:-1], g[1:])
        roots = np.array([parts.find(k) for k in range(len(group))])
        order = np.argsort(roots, kind="stable")
        cells = np.split(order, np.flatnonzero(np.diff(roots[order])) + 1)
        if max(map(len, cells)) <= 0.7 * len(group):
            todo += [(group[c], "pivots") for c in cells]
            continue
        for g in sorted(shared, key=len):  # texts that share a rare shingle, if not yet of one component
            own = group[g]
            name = np.array([forest.find(int(m)) for m in own])
            main = np.bincount(np.unique(name, return_inverse=True)[1]).argmax()
            rest = own[name != np.unique(name)[main]]
            for at in range(0, len(rest), 128):
                compare(own, rest[at : at + 128])
    return forest.stars()


# ---- the distributed join -----------------------------------------------------------------------


def _halves(s: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _node(s: np.ndarray, collided: frozenset[int]) -> int:
    """The number of a set: half of its digest, the other half where different sets begin alike."""
    a, b = _halves(s)
    return b if a in collided else a


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Of every document: its id, set size and a digest of the set in two halves."""

    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_of(batch, 1):
                n, c = [], []
                for s in shingle_sets(texts, k):
                    n.append(len(s))
                    c.append(_halves(s))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), *(pa.array([x[i] for x in c], pa.int64()) for i in (0, 1))], names=["doc_id", "n_shingles", "node", "c2"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint, c2 bigint")


def _frequent(docs: DataFrame, classes: DataFrame, k: int) -> np.ndarray:
    """Shingles that several texts of a bounded sample share, sorted; they change speed only, never the result."""
    picked = classes.orderBy("node").limit(SAMPLE).select(F.col("rep").alias("doc_id"))

    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in texts_of(batch, 0):
                found = [s for s in shingle_sets(texts, k) if len(s)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    rows = docs.join(F.broadcast(picked), "doc_id").select("text").mapInArrow(run, "shingle bigint")  # SAMPLE ids are sent
    best = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle")
    return np.sort(best.toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))


def _matches(docs: DataFrame, k: int, percent: int, frequent: np.ndarray, collided: frozenset[int]) -> DataFrame:
    """Prefix shingles of sets that another set's prefix has too: ``key, node``.

    A task sends a shingle that several of its texts have once (kind 1); the other texts' rows
    (kind 2), known to match already, are dealt by text, so that no shingle, however common, gathers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT numbers at most

    def dealt(key: list[np.ndarray], node: list[int]) -> Iterator[pa.RecordBatch]:
        keys, nodes = np.concatenate(key).view(np.int64), np.repeat(np.array(node, np.int64), [len(x) for x in key])
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], nodes[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        alone = np.concatenate([new[1:], [True]])
        kind = np.where(new, np.where(alone, 0, 1), 2).astype(np.int8)
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in (keys, nodes, kind)], names=["key", "node", "kind"])

    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, held, seen = [], [], 0, set()
        for batch in batches:
            for _, texts in texts_of(batch, 1):
                for s in shingle_sets(texts, k):
                    if not len(s) or (me := _node(s, collided)) in seen:
                        continue
                    seen.add(me)
                    key.append(prefix(s, percent, shared.value))
                    node.append(me)
                    held += len(key[-1])
                if held >= KEYS_AT_ONCE:
                    yield from dealt(key, node)
                    key, node, held, seen = [], [], 0, set()
        if held:
            yield from dealt(key, node)

    def matched(key: np.ndarray, node: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])]))
        key, node, kind = key[first], node[first], np.maximum.reduceat(kind, first)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        keep = (kind > 0) | ~new | ~np.concatenate([new[1:], [True]])
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], names=["key", "node"])

    @task("jaccard")
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key and node; the last key of a batch waits for the next."""
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)]
        for batch in batches:
            if batch.num_rows:
                held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
                end = int(np.searchsorted(held[0], held[0][-1]))
                if end:
                    yield matched(*(h[:end] for h in held))
                    held = [h[end:] for h in held]
        if len(held[0]):
            yield matched(*held)

    rows = docs.mapInArrow(run, "key bigint, node bigint, kind tinyint")
    rows = rows.repartition(F.when(F.col("kind") == 2, F.col("node")).otherwise(F.col("key"))).sortWithinPartitions("key", "node")
    return rows.mapInArrow(scan, "key bigint, node bigint")


def _first_regions(matches: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``node, region`` of the sets that share enough of their prefixes with others, and the table behind it.

    Of the prefix shingles that a set has in common with others, ``required`` are common to it and any
    one partner. The rarest of them, in order of how many sets have them, are enough to find that
    partner when all but ``required - 1`` are looked at, so common passages join no regions.
    """
    least = F.ceil(F.col("n_shingles") * percent / 100)
    need = F.greatest(F.lit(1), F.floor(least * EXTRA / 100)).cast("int")
    sizes = classes.select("node", need.alias("need"))
    own = Window.partitionBy("node")
    rows = matches.repartition("node").dropDuplicates(["node", "key"]).withColumn("hits", F.count(F.lit(1)).over(own))
    live = save(rows.join(sizes, "node").where("hits >= need").select("key", "node", "need"), "jaccard-live")
    often = live.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    rows = live.join(often, "key").repartition("node")
    rows = rows.withColumns({"hits": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("often", "key"))})
    rare = save(rows.where("hits >= need and rank <= hits - need + 1").select("key", "node"), "jaccard-rare")
    lead = rare.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("key", "lead")
    links = rare.join(lead, "key").where("node <> lead").select("lead", "node").distinct()
    comp = connected_components(links, "lead", "node")
    drop(live)
    drop(rare)
    return comp.select("node", F.col("component").cast("string").alias("region")), comp


def _load(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in raw]


def _links_batch(links: list[tuple[int, int]], nodes: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], names=["a", "b"])


def _join_small(rows: DataFrame, percent: int) -> DataFrame:
    """Links within regions that fit a task. Rows arrive region by region and are joined as each ends."""

    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, nodes, sets = None, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r, n, s in zip(*(c.slice(at, 256).to_pylist() for c in batch.columns), strict=True):
                    if r != region and nodes:
                        yield _links_batch(metric_join(_load(sets), percent), nodes)
                        nodes, sets = [], []
                    region = r
                    nodes.append(n)
                    sets.append(s)
        if nodes:
            yield _links_batch(metric_join(_load(sets), percent), nodes)

    return rows.select("region", "node", "set").repartition("region").sortWithinPartitions("region", "node").mapInArrow(run, "a bigint, b bigint")


def _pivot_step(rows: DataFrame, percent: int) -> DataFrame:
    """One distributed Voronoi step: ``region, node, set, cells, links`` (pivots within the radius)."""
    # the pivots are the classes of least hash; they are found per salt first
    rank = F.xxhash64("region", "node")
    salted = rows.select("region", "node", rank.alias("rank"), F.pmod(F.xxhash64("node"), F.lit(SALTS * 16)).alias("salt"))
    top = Window.partitionBy("region", "salt").orderBy("rank", "node")
    some = salted.withColumn("at", F.row_number().over(top)).where(F.col("at") <= PIVOTS)
    pick = some.withColumn("at", F.row_number().over(Window.partitionBy("region").orderBy("rank", "node"))).where(F.col("at") <= PIVOTS).select("region", "node")
    pivots = rows.join(pick, ["region", "node"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    texts = rows.select("region", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("text"), "node", "set")
    both = pivots.select("region", "salt", F.lit(0).alias("text"), "node", "set").unionByName(texts)
    radius = (100 - percent) / 100

    def judged(region: str, pivots: list[tuple[int, bytes]], some: list[tuple[int, bytes]]) -> pa.RecordBatch:
        sets, few = _load([s for _, s in some]), _load([s for _, s in pivots])
        inter = intersections(sets, few)
        a, b = np.array([len(s) for s in sets])[:, None], np.array([len(s) for s in few])[None, :]
        near = linked(inter, a, b, percent)
        own, beyond_all = voronoi(1 - inter / (a + b - inter), radius)
        links = [[pivots[p][0] for p in np.flatnonzero(row) if pivots[p][0] != node] for row, (node, _) in zip(near, some, strict=True)]
        cells = [[f"{region}.{p}" for p in np.flatnonzero(row)] + [f"{region}.r"] * bool(r) for row, r in zip(own, beyond_all, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([region] * len(some)), pa.array([n for n, _ in some], pa.int64()), pa.array([s for _, s in some], pa.binary()), pa.array(cells, pa.list_(pa.string())), pa.array(links, pa.list_(pa.int64()))], names=["region", "node", "set", "cells", "links"])

    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of region and salt, pivots before texts."""
        key, pivots, some = None, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for region, salt, text, node, raw in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if key != (region, salt):
                        if some:
                            yield judged(key[0], pivots, some)
                        key, pivots, some = (region, salt), [], []
                    (some if text else pivots).append((node, raw))
                    if len(some) == 64:
                        yield judged(region, pivots, some)
                        some = []
        if some:
            yield judged(key[0], pivots, some)

    both = both.repartition("region", "salt").sortWithinPartitions("region", "salt", "text", "node")
    return both.mapInArrow(run, "region string, node bigint, set binary, cells array<string>, links array<bigint>")


def _rare_step(rows: DataFrame, percent: int) -> DataFrame:
    """Regions parted by the rarest shingles of their texts; texts that share none with another are left out."""

    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = _load(part.column(2).to_pylist())
                need = prefix_length(np.array([len(s) for s in sets]), percent)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(need), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["region", "place", "need", "shingles"])

    rows = rows.withColumn("place", F.xxhash64("region", "node"))  # a text may be in several regions
    each = rows.select("region", "place", "set").mapInArrow(run, "region string, place bigint, need bigint, shingles array<bigint>")
    each = each.select("region", "place", "need", F.explode("shingles").alias("shingle"))
    often = each.groupBy("region", "shingle").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("region", "place").orderBy("often", "shingle"))
    kept = save(each.join(often, ["region", "shingle"]).withColumn("rank", rank).where("rank <= need and often > 1").select("region", "place", "shingle"), "rare")
    lead = kept.groupBy("region", "shingle").agg(F.min("place").alias("lead"))
    comp = connected_components(kept.join(lead, ["region", "shingle"]).where("place <> lead").select("place", "lead"), "place", "lead")
    new = F.concat_ws("~", "region", F.col("component").cast("string"))
    out = save(rows.join(comp.withColumnRenamed("node", "place"), "place").select(new.alias("region"), "node", "set"), "regions")
    drop(kept)
    drop(comp)
    return out


def _large(rows: DataFrame) -> DataFrame:
    """Bytes and texts of the regions that no task may hold."""
    sizes = rows.groupBy("region").agg(F.sum(F.length("set")).alias("bytes"), F.count(F.lit(1)).alias("texts"))
    return sizes.where((F.col("bytes") > REGION_BYTES) | (F.col("texts") > REGION_TEXTS))


def _blocks(bytes_: Column, texts: Column, parts: int) -> Column:
    return F.greatest(F.ceil(bytes_ * parts / REGION_BYTES), F.ceil(texts * parts / REGION_TEXTS)).cast("int")


def _join_blocks(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links within regions of any size: every block of a region meets every other in a task of bounded size."""
    blocks = sizes.select("region", _blocks(F.col("bytes"), F.col("texts"), 4).alias("blocks"))
    rows = rows.join(blocks, "region").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.concat_ws("/", "region", F.least("mine", "other"), F.greatest("mine", "other"))
    return _join_small(rows.select(name.alias("region"), "node", "set"), percent)


def _judged(cut: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of a Voronoi step whose region is not yet one component, with what is to become of them.

    Where few texts are outside the region's main component (``strays``), only these have to meet the
    rest, in ``blocks``; else texts go on to their cells, unless these hardly part them (``stuck``).
    """
    marked = cut.select("region", "node", F.length("set").alias("bytes"), F.size("cells").alias("cells")).join(comp, "node", "left")
    marked = marked.withColumn("part", F.coalesce("component", "node"))
    parts = marked.groupBy("region", "part").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("texts"), F.sum("cells").alias("cells"))
    top = F.struct("texts", "part")
    regions = parts.groupBy("region").agg(F.max_by("part", top).alias("main"), F.sum("bytes").alias("all_bytes"), F.sum("texts").alias("all_texts"), (F.sum("bytes") - F.max_by("bytes", top)).alias("bytes"), (F.sum("texts") - F.max("texts")).alias("texts"), F.sum("cells").alias("cells")).where("texts > 0")
    few = (F.col("bytes") <= REGION_BYTES // 4) & (F.col("texts") <= REGION_TEXTS // 4)
    fate = F.when(few, "strays").when(F.col("cells") > SPREAD * F.col("all_texts"), "stuck").otherwise("cells")
    regions = regions.select("region", "main", fate.alias("fate"), _blocks(F.col("all_bytes"), F.col("all_texts"), 2).alias("blocks"))
    return cut.join(marked.select("region", "node", "part"), ["region", "node"]).join(regions, "region").withColumn("stray", F.col("part") != F.col("main"))


def _join_regions(rows: DataFrame, percent: int) -> DataFrame:
    """Components of the links of all regions: small ones joined in their tasks, large ones split by pivots first."""
    found: list[DataFrame] = []
    made: list[DataFrame] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        made.append(save(df, label))
        return made[-1]

    def link(df: DataFrame) -> None:
        found.append(kept(df, "region-links"))

    for step in STEPS:
        large = kept(_large(rows), "region-sizes")
        if large.isEmpty():
            break
        link(_join_small(rows.join(large, "region", "left_anti"), percent))
        rest = rows.join(large.select("region"), "region", "left_semi")
        if step == "rare":
            rows = _rare_step(rest, percent)
            made.append(rows)
            continue
        cut = save(_pivot_step(rest, percent), "region-step")
        link(cut.select(F.col("node").alias("a"), F.explode("links").alias("b")))
        comp = connected_components(_union(found))
        made.append(comp)
        found = [comp.select(F.col("node").alias("a"), F.col("component").alias("b"))]
        left = kept(_judged(cut, comp), "region-judged")
        drop(cut)
        mine = F.when(F.col("stray"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
        meet = left.where("fate = 'strays'").withColumn("block", F.explode(mine)).select(F.concat_ws("/", "region", "block").alias("region"), "node", "set")
        link(_join_small(meet, percent))
        on = F.when(F.col("fate") == "cells", F.col("cells")).otherwise(F.array("region"))
        rows = kept(left.where("fate <> 'strays'").select(F.explode(on).alias("region"), "node", "set"), "regions")
    large = kept(_large(rows), "region-sizes")
    link(_join_small(rows.join(large, "region", "left_anti"), percent))
    if not large.isEmpty():
        link(_join_blocks(rows.join(large.select("region"), "region", "left_semi"), large, percent))
    comp = connected_components(_union(found))
    for df in made:
        drop(df)
    return comp


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sent(ids: DataFrame) -> DataFrame:
    """Ids for a join with texts: sent to every task where they are few, else dealt by id as the texts are."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids.hint("merge")


def _collided(sets: DataFrame) -> frozenset[int]:
    """First halves of digests that different sets share: a few in a corpus of any real size."""
    same = sets.where("n_shingles > 0").groupBy("node").agg(F.min("c2").alias("lo"), F.max("c2").alias("hi")).where("lo <> hi").select("node")
    out = frozenset(r.node for r in same.limit(COLLIDED + 1).collect())
    if len(out) > COLLIDED:
        raise RuntimeError(f"over {COLLIDED} digests of different sets begin alike")
    return out


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct
    ``words``-word shingles (the whole sequence where there are fewer words). Null and empty texts,
    and texts of white space, have empty sets and link with nothing. A row with a null id links with
    nothing either and has a null component. Repeated rows keep their places; rows of one id with
    different texts are judged apart, each getting its own component. Other columns are ignored.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sets = save(_sets(docs, words), "shingle-classes")
    collided = _collided(sets)
    node = F.when(F.col("node").isin(list(collided)), F.col("c2")).otherwise(F.col("node")) if collided else F.col("node")
    sets = sets.select("doc_id", "n_shingles", node.alias("node"))
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"))
    known = docs.where("doc_id is not null and text is not null")
    matches = save(_matches(known, words, percent, _frequent(known, classes, words), collided), "jaccard-matches")
    region, table = _first_regions(matches, classes, percent)
    wanted = save(region.join(classes, "node").select(F.col("rep").alias("doc_id"), "region", "node"), "jaccard-wanted")
    drop(matches)
    drop(table)

    @task("jaccard")
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_of(batch, 1):
                rows = []
                for r, n, s in zip(batch.column(2).slice(at, len(texts)).to_pylist(), batch.column(3).slice(at, len(texts)).to_pylist(), shingle_sets(texts, words), strict=True):
                    if _node(s, collided) == n:
                        rows.append((r, n, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["region", "node", "set"])

    texts = known.join(sent(wanted), "doc_id").select("doc_id", "text", "region", "node")
    rows = save(texts.mapInArrow(collect, "region string, node bigint, set binary").dropDuplicates(["region", "node"]), "regions")
    drop(wanted)
    comp = _join_regions(rows, percent)
    drop(rows)
    least = classes.join(comp, "node").groupBy("component").agg(F.min("rep").alias("least"))
    final = classes.join(comp, "node", "left").join(least, "component", "left").select("node", F.coalesce("least", "rep").alias("component_id"))
    keyed = sets.withColumn("node", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")))
    return keyed.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
