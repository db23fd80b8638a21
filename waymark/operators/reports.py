"""Summaries of assignments and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.operators.density import counts
from waymark.operators.simplify import degrees


def points_per(assignments: DataFrame, column: str) -> DataFrame:
    """``column, cnt, pct``: rows per value and their share of all counted rows, in per cent."""
    rows = counts(assignments, column)
    total = rows.agg(F.sum("cnt").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(column, "cnt", (F.col("cnt") * 100.0 / F.nullif(F.col("total"), F.lit(0))).alias("pct"))  # one row of totals


def top_values(assignments: DataFrame, k: int = 10, column: str = "assigned_node_id") -> DataFrame:
    """The ``k`` most frequent values; of equal counts the smaller value first."""
    return counts(assignments, column).orderBy(F.desc("cnt"), column).limit(k)


def first_rows(points: DataFrame, k: int = 5, order: str = "point_id") -> DataFrame:
    return points.orderBy(order).limit(k)


def distance_stats(assignments: DataFrame) -> DataFrame:
    """One row: number, mean, median, least and greatest distance."""
    d = F.col("distance")
    return assignments.agg(F.count(d).alias("n"), F.avg(d).alias("mean_distance"), F.median(d).alias("median_distance"), F.min(d).alias("min_distance"), F.max(d).alias("max_distance"))


def count_stats(assignments: DataFrame, column: str = "assigned_node_id") -> DataFrame:
    """One row over the values that occur: how many, and mean, greatest and least count."""
    return counts(assignments, column).agg(F.count(F.lit(1)).alias("n_values"), F.avg("cnt").alias("mean_count"), F.max("cnt").alias("max_count"), F.min("cnt").alias("min_count"))


def active_values(assignments: DataFrame, column: str = "assigned_node_id") -> DataFrame:
    """One row: distinct values, nulls left out."""
    return assignments.agg(F.count_distinct(column).alias("n_active"))


def bounding_box(nodes: DataFrame, padding: float = 0.0) -> DataFrame:
    """One row ``min_x, max_x, min_y, max_y``, widened by a share of the extent on each side."""
    rows = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    px, py = (F.col("x1") - F.col("x0")) * padding, (F.col("y1") - F.col("y0")) * padding
    return rows.select((F.col("x0") - px).alias("min_x"), (F.col("x1") + px).alias("max_x"), (F.col("y0") - py).alias("min_y"), (F.col("y1") + py).alias("max_y"))


def degree_distribution(segments: DataFrame, first: int | None = None) -> DataFrame:
    """``degree, nodes``, ascending; with ``first`` the degrees after so many are one row of degree null."""
    rows = degrees(segments).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))
    if first is None:
        return rows.orderBy("degree")
    # a row per distinct degree: few, whatever the graph
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy("degree")))
    return ranked.groupBy(F.when(F.col("rank") <= first, F.col("degree")).alias("degree")).agg(F.sum("nodes").alias("nodes"))


def average_degree(segments: DataFrame) -> DataFrame:
    return degrees(segments).agg(F.avg("degree").alias("avg_degree"))


def reduction(before: int, after: int) -> float:
    """Per cent by which a size fell."""
    return (before - after) * 100.0 / before if before else 0.0
