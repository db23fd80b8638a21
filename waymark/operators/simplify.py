"""Street graph simplification: chain contraction, clustering of near nodes, merging of parallel segments.

Chains are contracted by pointer doubling over half-edges: a half-edge that arrives at a node of
degree two is followed by the half-edge that leaves it by the other segment; doubling these
successors reaches the end of every chain of n segments in log2(n) rounds of one equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.graph import StreetGraph
from waymark.operators.components import connected_components
from waymark.operators.spatial import close_pairs, parallel_pairs
from waymark.plans.dense import dense_ids
from waymark.plans.storage import drop, save

#: First id of nodes that stand for merged parallel segments.
PARALLEL_NODE_IDS = 10_000_000
SEGMENTS = ["segment_id", "node_start", "node_end", "x1", "y1", "x2", "y2"]


def adjacency(segments: DataFrame) -> DataFrame:
    """Both directions of every segment, with multiplicity: ``a, b``."""
    ends = segments.select(F.col("node_start").cast("bigint").alias("a"), F.col("node_end").cast("bigint").alias("b"))
    return ends.union(ends.select("b", "a"))


def degrees(segments: DataFrame) -> DataFrame:
    """``node_id, degree``: segment ends at each node that occurs in segments (a loop counts twice)."""
    return adjacency(segments).groupBy(F.col("a").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


def undirected(segments: DataFrame) -> DataFrame:
    """One row for each unordered pair of ends, with the least segment id: ``node_a, node_b, segment_id``."""
    a, b = F.least("node_start", "node_end").alias("node_a"), F.greatest("node_start", "node_end").alias("node_b")
    return segments.select(a, b, "segment_id").groupBy("node_a", "node_b").agg(F.min("segment_id").alias("segment_id"))


def known_segments(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments whose two ends are in ``nodes``."""
    ids = nodes.select("node_id").distinct()
    return segments.join(ids.withColumnRenamed("node_id", "node_start"), "node_start", "left_semi").join(ids.withColumnRenamed("node_id", "node_end"), "node_end", "left_semi")


def chains(segments: DataFrame, kept: DataFrame, stubs: DataFrame | None = None) -> DataFrame:
    """Chains from a kept node through others to the next kept node (or stub).

    ``kept(node_id)``; every other node must have degree two to be passed. ``stubs(node_id)`` end a
    chain without being kept. Returns each chain once from either side: ``node_start, node_end,
    first_seg, last_seg, hops`` (one hop: a direct segment). Segment ids must be unique.
    """
    seg = segments.select(F.col("segment_id").cast("bigint").alias("s"), F.col("node_start").cast("bigint").alias("u"), F.col("node_end").cast("bigint").alias("v"))
    half = seg.select((F.col("s") * 2).alias("he"), "s", F.col("u").alias("tail"), F.col("v").alias("head")).union(seg.select((F.col("s") * 2 + 1).alias("he"), "s", F.col("v").alias("tail"), F.col("u").alias("head")))
    ends = kept.select("node_id").distinct()
    if stubs is not None:
        ends = ends.union(stubs.select("node_id")).distinct()
    stop = ends.select(F.col("node_id").alias("head"), F.lit(True).alias("stop"))
    # at a passed node: the half-edge that leaves by another segment end than the one arrived at
    leaving = half.select(F.col("tail").alias("head"), F.col("he").alias("next"))
    other = half.join(stop, "head", "left_anti").join(leaving, "head").where("next <> he + 1 - 2 * (he % 2)").select("he", "next")
    start = kept.select(F.col("node_id").alias("tail"), F.lit(True).alias("first")).distinct()
    table = half.join(other, "he", "left").join(stop, "head", "left").join(start, "tail", "left")
    table = table.select("he", F.col("tail").alias("node_start"), F.col("s").alias("first_seg"), F.col("head").alias("node_end"), F.col("s").alias("last_seg"), F.lit(1).cast("bigint").alias("hops"), F.when(F.col("stop").isNull(), F.col("next")).alias("next"), F.col("stop").isNotNull().alias("done"), F.col("first").isNotNull().alias("first"))
    table = save(table, "half-edges")
    while not table.where("first and not done and next is not null").isEmpty():
        step = table.select(F.col("he").alias("next"), F.col("node_end").alias("e"), F.col("last_seg").alias("l"), F.col("hops").alias("h"), F.col("next").alias("n"), F.col("done").alias("d"))
        more = ~F.col("done") & F.col("e").isNotNull()
        pick = lambda new, old: F.when(more, F.col(new)).otherwise(F.col(old)).alias(old)
        new = table.join(step, "next", "left").select("he", "node_start", "first_seg", pick("e", "node_end"), pick("l", "last_seg"), F.when(more, F.col("hops") + F.col("h")).otherwise(F.col("hops")).alias("hops"), F.when(more, F.col("n")).otherwise(F.col("next")).alias("next"), F.when(more, F.col("d")).otherwise(F.col("done")).alias("done"), "first")
        new = save(new, "half-edges")
        drop(table)
        table = new
    return table.where("first and done").select("node_start", "node_end", "first_seg", "last_seg", "hops")


def _with_coordinates(pairs: DataFrame, nodes: DataFrame, order: list[str], drop_unknown: bool = True) -> DataFrame:
    """Segments with ids in the given order and the coordinates of their end nodes."""
    at = nodes.groupBy("node_id").agg(F.min(F.struct("x", "y")).alias("at"))
    how = "inner" if drop_unknown else "left"
    a = at.select(F.col("node_id").alias("node_start"), F.col("at.x").alias("x1"), F.col("at.y").alias("y1"))
    b = at.select(F.col("node_id").alias("node_end"), F.col("at.x").alias("x2"), F.col("at.y").alias("y2"))
    return dense_ids(pairs.join(a, "node_start", how).join(b, "node_end", how), order, "segment_id").select(*SEGMENTS)


def simplify_topological(graph: StreetGraph, variant: str = "table", drop_stubs: bool = False) -> StreetGraph:
    """Contract chains of degree-two nodes.

    ``variant="table"``: isolated nodes go, parallel chains stay apart, a graph without degree-two
    nodes (or without nodes or segments) is returned as it is, and a two-way dead end leaves a segment
    to its removed node unless ``drop_stubs``. ``variant="native"``: isolated nodes stay, one segment
    per pair of ends, segments with unknown ends are skipped, no dead-end segments.
    """
    if variant not in ("table", "native"):
        raise ValueError("variant must be 'table' or 'native'")
    nodes, segments = graph.nodes, graph.segments
    if variant == "native":
        kept = _native_kept(nodes, segments)
        known = known_segments(nodes, segments)
        pairs = _pairs(chains(known, kept), None)
        return StreetGraph(nodes.join(kept, "node_id", "left_semi"), _with_coordinates(pairs, nodes, ["node_start", "node_end"]))
    if nodes.isEmpty() or segments.isEmpty():
        return graph
    degree = save(degrees(segments), "degrees")
    kept = degree.where("degree <> 2").select("node_id")
    if kept.count() == nodes.count():
        return graph
    single = adjacency(segments).groupBy(F.col("a").alias("node_id")).agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo = hi")
    stubs = degree.where("degree = 2").join(single, "node_id", "left_semi").select("node_id")
    found = save(chains(segments, kept, stubs).where("node_start <> node_end"), "chains")
    lo, hi = F.least("node_start", "node_end").alias("node_start"), F.greatest("node_start", "node_end").alias("node_end")
    first = F.least("first_seg", "last_seg").alias("seg")
    direct = found.where("hops = 1").select(lo, hi, "first_seg").groupBy("node_start", "node_end").agg(F.min("first_seg").alias("seg"))
    long = found.where("hops > 1").select(lo, hi, first).distinct()
    pairs = direct.unionByName(long)
    if drop_stubs:
        pairs = pairs.join(stubs.withColumnRenamed("node_id", "node_start"), "node_start", "left_anti").join(stubs.withColumnRenamed("node_id", "node_end"), "node_end", "left_anti")
    return StreetGraph(nodes.join(kept, "node_id", "left_semi"), _with_coordinates(pairs, nodes, ["node_start", "node_end", "seg"]))


def _native_kept(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    degree = degrees(known_segments(nodes, segments))
    return nodes.select("node_id").distinct().join(degree, "node_id", "left").where("coalesce(degree, 0) <> 2").select("node_id")


def _pairs(found: DataFrame, names: DataFrame | None) -> DataFrame:
    """Distinct unordered pairs of chain ends, under new ``names(node_id, name)`` if given."""
    if names is not None:
        found = found.join(names.select(F.col("node_id").alias("node_start"), F.col("name").alias("a")), "node_start").join(names.select(F.col("node_id").alias("node_end"), F.col("name").alias("b")), "node_end")
        found = found.select(F.col("a").alias("node_start"), F.col("b").alias("node_end"))
    return found.where("node_start <> node_end").select(F.least("node_start", "node_end").alias("node_start"), F.greatest("node_start", "node_end").alias("node_end")).distinct()


def clusters(nodes: DataFrame, threshold: float, merge_coincident: bool = True) -> DataFrame:
    """``node_id, cluster_id``: single-linkage clusters at ``threshold``, named by their least node.

    Without ``merge_coincident``, of nodes at one place only that of the largest id takes part.
    """
    rows = nodes.select(F.col("node_id").cast("bigint").alias("node_id"), "x", "y")
    part = rows if merge_coincident else rows.groupBy("x", "y").agg(F.max("node_id").alias("node_id"))
    comp = connected_components(close_pairs(part, threshold)).withColumnRenamed("node", "node_id")
    return rows.select("node_id").join(comp.hint("merge"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("cluster_id"))


def centroids(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster_id, x, y, n``: mean position and size of each cluster."""
    return nodes.join(labels.hint("merge"), "node_id").groupBy("cluster_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def simplify_geometric(graph: StreetGraph, threshold: float = 10.0, variant: str = "table", merge_coincident: bool = True) -> StreetGraph:
    """Contract chains and merge intersections within ``threshold``, clusters standing at their centroids.

    ``variant="table"`` keeps one segment per contracted chain; ``variant="native"`` clusters the
    intersections of the original graph, numbers them from 0 by least member, and keeps one segment
    per pair.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    if variant == "native":
        kept = _native_kept(graph.nodes, graph.segments)
        if kept.isEmpty():
            return simplify_topological(graph, "native")
        own = graph.nodes.join(kept, "node_id", "left_semi")
        labels = save(clusters(own, threshold, merge_coincident), "clusters")
        middle = dense_ids(centroids(own, labels), ["cluster_id"], "name")
        names = labels.join(middle.select("cluster_id", "name"), "cluster_id").select("node_id", "name")
        nodes = middle.select(F.col("name").alias("node_id"), "x", "y")
        found = chains(known_segments(graph.nodes, graph.segments), kept)
        return StreetGraph(nodes, _with_coordinates(_pairs(found, names), nodes, ["node_start", "node_end"]))
    topo = simplify_topological(graph)
    if topo.nodes.isEmpty():
        return topo
    labels = save(clusters(topo.nodes, threshold, merge_coincident), "clusters")
    nodes = centroids(topo.nodes, labels).select(F.col("cluster_id").alias("node_id"), "x", "y")
    a, b = labels.select(F.col("node_id").alias("node_start"), F.col("cluster_id").alias("a")), labels.select(F.col("node_id").alias("node_end"), F.col("cluster_id").alias("b"))
    moved = topo.segments.join(a, "node_start").join(b, "node_end").where("a <> b").select(F.col("segment_id").alias("was"), F.col("a").alias("node_start"), F.col("b").alias("node_end"))
    return StreetGraph(nodes, _with_coordinates(moved, nodes, ["was"]))


def simplify_parallel(graph: StreetGraph, distance_threshold: float = 10.0, angle_threshold_deg: float = 5.0, passthrough: bool = False) -> StreetGraph:
    """Merge groups of near and nearly parallel segments into one node each, and retrace the rest.

    Segments within the distance whose directions differ by less than the angle are one group; its end
    nodes become one node at their centroid, numbered from 10,000,000 in order of the group's least
    segment. A node in several groups goes with the last. Other nodes of degree other than two stay.
    With ``passthrough`` the graph is returned as it is.
    """
    if passthrough:
        return graph
    nodes, segments = graph.nodes, known_segments(graph.nodes, graph.segments)
    if segments.isEmpty():
        return StreetGraph(nodes.limit(0), graph.segments.limit(0))
    at = nodes.groupBy("node_id").agg(F.max(F.struct("x", "y")).alias("at"))
    ends = segments.select("segment_id", "node_start", "node_end").join(at.select(F.col("node_id").alias("node_start"), F.col("at.x").alias("x1"), F.col("at.y").alias("y1")), "node_start").join(at.select(F.col("node_id").alias("node_end"), F.col("at.x").alias("x2"), F.col("at.y").alias("y2")), "node_end")
    groups = save(connected_components(parallel_pairs(ends, distance_threshold, angle_threshold_deg)).select(F.col("node").alias("segment_id"), F.col("component").alias("group")), "groups")
    member = segments.select("segment_id", F.explode(F.array("node_start", "node_end")).alias("node_id")).join(groups, "segment_id").select("node_id", "group").distinct()
    new = dense_ids(groups.select("group").distinct(), ["group"], "name", PARALLEL_NODE_IDS)
    member = save(member.join(new, "group"), "members")
    middle = member.join(at, "node_id").groupBy("name").agg(F.avg("at.x").alias("x"), F.avg("at.y").alias("y"))
    names = member.groupBy("node_id").agg(F.max("name").alias("name"))
    rest = _native_kept(nodes, segments).join(names, "node_id", "left_anti")
    merged = save(middle.select(F.col("name").alias("node_id"), "x", "y").unionByName(nodes.join(rest, "node_id", "left_semi").select("node_id", "x", "y")), "merged-nodes")
    names = save(names.unionByName(rest.withColumn("name", F.col("node_id"))), "names")
    found = chains(segments, names.select("node_id"))
    return StreetGraph(merged, _with_coordinates(_pairs(found, names), merged, ["node_start", "node_end"]))
