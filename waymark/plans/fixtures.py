"""A street grid and points on it, derived from the driver's tables in Spark and in SQL alike.

The tables have no coordinates of their own. All coordinates are whole numbers, so squared distances
are exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.graph import StreetGraph

#: Streets of the grid, their spacing, and the largest extent of points from west to east.
COLUMNS, SPACING, WIDTH = 40, 100, 4000


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("bigint")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("node_id"))
    x = (F.col("node_id") % COLUMNS) * SPACING + (F.col("node_id") * 7919) % 37
    y = F.expr(f"node_id div {COLUMNS}") * SPACING + (F.col("node_id") * 104729) % 41
    return rows.select("node_id", x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("node_id")
    east = (k % COLUMNS < COLUMNS - 1) & ((k * 31) % 5 != 0)
    link = lambda i, a, b: F.struct((k * 4 + i).alias("segment_id"), a.alias("node_start"), b.alias("node_end"))
    made = F.array(
        F.when(east, link(0, k, k + 1)),
        F.when((k * 17) % 3 == 0, link(1, k, k + COLUMNS)),
        F.when(east & ((k * 13) % 7 == 0), link(2, k + 1, k)),
    )
    at = nodes(spark, sf_dir)
    rows = at.select(F.explode(made).alias("s")).where("s is not null").select("s.*")
    a, b = at.toDF("node_start", "x1", "y1"), at.toDF("node_end", "x2", "y2")
    return rows.join(a, "node_start").join(b, "node_end").select("segment_id", "node_start", "node_end", "x1", "y1", "x2", "y2")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("bigint").alias("point_id"), F.col("event_type").alias("crime_type"))
    top = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey")).first()[0] or 0
    high = SPACING * (top // COLUMNS + 1)
    x, y = (F.col("point_id") * 6151) % WIDTH, (F.col("point_id") * 12289) % F.lit(high)
    return rows.select("point_id", "crime_type", x.cast("double").alias("x"), y.cast("double").alias("y"))


def graph(spark: SparkSession, sf_dir: str) -> StreetGraph:
    return StreetGraph(nodes(spark, sf_dir), segments(spark, sf_dir))


#: The same tables as common table expressions of DuckDB.
SQL = f"""
nodes AS MATERIALIZED (SELECT p_partkey::BIGINT AS node_id,
    ((p_partkey % {COLUMNS}) * {SPACING} + (p_partkey::BIGINT * 7919) % 37)::DOUBLE AS x,
    ((p_partkey // {COLUMNS}) * {SPACING} + (p_partkey::BIGINT * 104729) % 41)::DOUBLE AS y FROM part),
made AS (SELECT 4 * node_id AS segment_id, node_id AS node_start, node_id + 1 AS node_end FROM nodes WHERE node_id % {COLUMNS} < {COLUMNS - 1} AND (node_id * 31) % 5 <> 0
    UNION ALL SELECT 4 * node_id + 1, node_id, node_id + {COLUMNS} FROM nodes WHERE (node_id * 17) % 3 = 0
    UNION ALL SELECT 4 * node_id + 2, node_id + 1, node_id FROM nodes WHERE node_id % {COLUMNS} < {COLUMNS - 1} AND (node_id * 31) % 5 <> 0 AND (node_id * 13) % 7 = 0),
segments AS MATERIALIZED (SELECT segment_id, node_start, node_end, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
    FROM made JOIN nodes a ON a.node_id = node_start JOIN nodes b ON b.node_id = node_end),
points AS MATERIALIZED (SELECT event_id::BIGINT AS point_id, event_type AS crime_type, ((event_id::BIGINT * 6151) % {WIDTH})::DOUBLE AS x,
    ((event_id::BIGINT * 12289) % (SELECT {SPACING} * (max(p_partkey) // {COLUMNS} + 1) FROM part))::DOUBLE AS y FROM events)
"""
