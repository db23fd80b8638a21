"""Neighbour-smoothed counts, their robust scale, and the buffers a renderer draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.ramp import DEFAULT, ramp
from waymark.graph import StreetGraph
from waymark.operators.simplify import adjacency
from waymark.plans.dense import dense_ids


def counts(assignments: DataFrame, column: str = "assigned_node_id", name: str = "cnt") -> DataFrame:
    """Rows per value, nulls left out."""
    return assignments.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))


def smoothed_counts(graph: StreetGraph, assignments: DataFrame, neighbor_influence: float = 0.5) -> DataFrame:
    """``node_id, cnt, smoothed``: own count plus a share of the neighbours' counts, with multiplicity."""
    own = counts(assignments).withColumnRenamed("assigned_node_id", "node_id")
    near = adjacency(graph.segments).join(own.select(F.col("node_id").alias("b"), "cnt"), "b").groupBy(F.col("a").alias("node_id")).agg(F.sum("cnt").alias("near"))
    rows = graph.nodes.select("node_id").join(own, "node_id", "left").join(near, "node_id", "left")
    cnt = F.coalesce("cnt", F.lit(0))
    return rows.select("node_id", cnt.cast("bigint").alias("cnt"), (cnt + F.lit(float(neighbor_influence)) * F.coalesce("near", F.lit(0))).alias("smoothed"))


def intensity_cap(smoothed: DataFrame, outlier_percentile: float = 99.0) -> DataFrame:
    """One row ``cap``: the percentile of all nodes' smoothed counts, 1 where that is 0 or there are no nodes."""
    cap = F.percentile("smoothed", outlier_percentile / 100.0)
    return smoothed.agg(cap.alias("cap")).select(F.when(F.coalesce("cap", F.lit(0.0)) == 0, 1.0).otherwise(F.col("cap")).alias("cap"))


def node_colors(graph: StreetGraph, assignments: DataFrame | None = None, neighbor_influence: float = 0.5, outlier_percentile: float = 99.0) -> DataFrame:
    """``node_id, smoothed, r, g, b, a``: colours of all nodes; without assignments all have the default."""
    plain = [F.lit(v).cast("float") for v in DEFAULT]
    if assignments is None:
        return graph.nodes.select("node_id", F.lit(0.0).alias("smoothed"), *(c.alias(n) for c, n in zip(plain, "rgba", strict=True)))
    rows = smoothed_counts(graph, assignments, neighbor_influence)
    rows = rows.crossJoin(F.broadcast(intensity_cap(rows, outlier_percentile)))  # a single row
    share = F.least("smoothed", "cap") / F.col("cap")
    colors = [F.when(F.col("smoothed") > 0, c).otherwise(p).alias(n) for c, p, n in zip(ramp(share), plain, "rgba", strict=True)]
    return rows.select("node_id", "smoothed", *colors)


def node_vertices(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))


def segment_vertices(segments: DataFrame) -> DataFrame:
    """Two rows per segment: ``segment_id, segment_index, vertex_index, x, y``, indices in order of id."""
    rows = dense_ids(segments.select("segment_id", "node_start", "node_end", "x1", "y1", "x2", "y2"), ["segment_id"], "segment_index")
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    rows = rows.select("segment_id", "segment_index", F.posexplode(ends).alias("pos", "v"))
    return rows.select("segment_id", "segment_index", (F.col("segment_index") * 2 + F.col("pos")).alias("vertex_index"), F.col("v.x").cast("float").alias("x"), F.col("v.y").cast("float").alias("y"))


def segment_connectivity(segments: DataFrame) -> DataFrame:
    """``segment_id, first, second``: vertex indices of each segment."""
    rows = dense_ids(segments.select("segment_id"), ["segment_id"], "i")
    return rows.select("segment_id", (F.col("i") * 2).cast("int").alias("first"), (F.col("i") * 2 + 1).cast("int").alias("second"))


def segment_colors(segments: DataFrame, colors: DataFrame) -> DataFrame:
    """Two rows per segment: ``segment_id, pos, r, g, b, a`` of its end nodes; all zero if either end is unknown."""
    c = colors.select(F.col("node_id").cast("bigint").alias("n"), F.struct("r", "g", "b", "a").alias("c"))
    rows = segments.select("segment_id", "node_start", "node_end")
    rows = rows.join(c.toDF("node_start", "c1"), "node_start", "left").join(c.toDF("node_end", "c2"), "node_end", "left")
    both = F.col("c1").isNotNull() & F.col("c2").isNotNull()
    rows = rows.select("segment_id", F.posexplode(F.array("c1", "c2")).alias("pos", "c"), both.alias("known"))
    return rows.select("segment_id", "pos", *(F.when(F.col("known"), F.col(f"c.{k}")).otherwise(F.lit(0.0).cast("float")).alias(k) for k in "rgba"))


def render_data(graph: StreetGraph, assignments: DataFrame | None = None, neighbor_influence: float = 0.5, outlier_percentile: float = 99.0) -> dict[str, DataFrame]:
    """All buffers of a view, as lazy tables."""
    colors = node_colors(graph, assignments, neighbor_influence, outlier_percentile)
    return {
        "node_vertices": node_vertices(graph.nodes),
        "node_colors": colors,
        "segment_vertices": segment_vertices(graph.segments),
        "segment_colors": segment_colors(graph.segments, colors),
        "segment_connectivity": segment_connectivity(graph.segments),
    }
