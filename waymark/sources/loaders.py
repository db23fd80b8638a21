"""Street graphs from tables, files and map extracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.graph import StreetGraph
from waymark.plans.dense import dense_ids

NETWORK_TYPES = ("drive", "walk", "bike", "all")


def load_graph(nodes: DataFrame, segments: DataFrame) -> StreetGraph:
    """A graph from two tables, checked for the columns it needs."""
    return StreetGraph(nodes, segments)


def read_graph(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> StreetGraph:
    """A graph from ``path/nodes`` and ``path/segments`` in any format Spark reads."""
    read = lambda name: spark.read.format(fmt).options(**options).load(f"{path}/{name}")
    return StreetGraph(read("nodes"), read("segments"))


def write_graph(graph: StreetGraph, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    graph.nodes.write.mode(mode).format(fmt).save(f"{path}/nodes")
    graph.segments.write.mode(mode).format(fmt).save(f"{path}/segments")


def cache_key(city: str, network_type: str) -> str:
    return f"{city.replace(' ', '_').replace(',', '')}_{network_type}"


def utm_zone(lon: float) -> int:
    return min(60, max(1, int((lon + 180) // 6) + 1))


def graph_from_extract(nodes: DataFrame, ways: DataFrame, project: bool = True) -> StreetGraph:
    """A graph from an extract: ``nodes(osm_id, lon, lat)`` and directed ``ways(u, v)``.

    Nodes get ids 0, 1, ... in order of ``osm_id`` and coordinates in the UTM zone of the extract's
    middle; each directed way becomes one straight segment in order of its ends. Ways with unknown
    ends are left out.
    """
    ids = dense_ids(nodes.select(F.col("osm_id").cast("bigint").alias("osm_id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")), ["osm_id"], "node_id")
    x, y = F.col("lon"), F.col("lat")
    if project:
        mid = ids.agg(((F.min("lon") + F.max("lon")) / 2).alias("lon"), ((F.min("lat") + F.max("lat")) / 2).alias("lat")).first()
        if mid["lon"] is not None:
            x, y = G.utm(x, y, utm_zone(mid["lon"]), mid["lat"] < 0)
    placed = ids.select("osm_id", "node_id", x.alias("x"), y.alias("y"))
    a = placed.select(F.col("osm_id").alias("u"), F.col("node_id").alias("node_start"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = placed.select(F.col("osm_id").alias("v"), F.col("node_id").alias("node_end"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    edges = dense_ids(ways.select("u", "v").join(a, "u").join(b, "v").drop("u", "v"), ["node_start", "node_end"], "segment_id")
    return StreetGraph(placed.select("node_id", "x", "y"), edges.select("segment_id", "node_start", "node_end", "x1", "y1", "x2", "y2"))


def load_map(spark: SparkSession, city: str, cache_dir: str = "./cache", network_type: str = "drive", loader: Callable[[str, str], tuple[DataFrame, DataFrame]] | None = None) -> StreetGraph:
    """A city's street graph, from the Parquet cache or else from ``loader(city, network_type)``.

    The loader returns an extract (see :func:`graph_from_extract`); what it raises becomes a
    ``ValueError``. A cached city is read without it, however old it is.
    """
    if network_type not in NETWORK_TYPES:
        raise ValueError(f"network_type must be one of {', '.join(NETWORK_TYPES)}")
    path = f"{cache_dir}/{cache_key(city, network_type)}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/segments/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        if loader is None:
            raise ImportError("no loader of map extracts was given and the city is not cached")
        try:
            nodes, ways = loader(city, network_type)
        except Exception as e:
            raise ValueError(f"could not load {city}: {e}") from e
        write_graph(graph_from_extract(nodes, ways), path, mode="overwrite")
    return read_graph(spark, path)


def write_geojson(points: DataFrame, path: str, x: str = "x", y: str = "y") -> None:
    """One GeoJSON feature per line, all other columns as properties."""
    rest = [F.col(c) for c in points.columns if c not in (x, y)]
    props = F.struct(*rest) if rest else F.create_map()
    point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties"))).alias("value")).write.text(path)


def uniform_points(spark: SparkSession, n: int, box: tuple[float, float, float, float], seed: int = 0) -> DataFrame:
    """``point_id, x, y`` uniform in a box ``(min_x, max_x, min_y, max_y)``."""
    x0, x1, y0, y1 = box
    return spark.range(n).select(F.col("id").alias("point_id"), (x0 + (x1 - x0) * F.rand(seed)).alias("x"), (y0 + (y1 - y0) * F.rand(seed + 1)).alias("y"))


def hotspot_points(spark: SparkSession, n: int, hotspots: list[tuple[float, float, float]], box: tuple[float, float, float, float], seed: int = 0) -> DataFrame:
    """Points around ``(x, y, spread)`` hotspots, clipped to the box."""
    spots = F.array(*(F.array(*map(F.lit, map(float, h))) for h in hotspots))
    rows = spark.range(n).select(F.col("id").alias("point_id"), F.element_at(spots, (F.floor(F.rand(seed) * len(hotspots)) + 1).cast("int")).alias("h"), F.randn(seed + 1).alias("u"), F.randn(seed + 2).alias("v"))
    clip = lambda c, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))
    return rows.select("point_id", clip(F.col("h")[0] + F.col("u") * F.col("h")[2], box[0], box[1]).alias("x"), clip(F.col("h")[1] + F.col("v") * F.col("h")[2], box[2], box[3]).alias("y"))


def street_points(segments: DataFrame, per_segment: int, noise: float, seed: int = 0) -> DataFrame:
    """``point_id, x, y``: points along each segment with normal noise."""
    t = F.rand(seed)
    rows = segments.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_segment - 1)))).withColumn("t", t)
    x, y = G.along(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("t"))
    return rows.select((F.col("segment_id") * per_segment + F.col("i")).alias("point_id"), (x + noise * F.randn(seed + 1)).alias("x"), (y + noise * F.randn(seed + 2)).alias("y"))
