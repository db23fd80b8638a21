"""The public surface: a graph, an index of it, and what can be drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.graph import POINT_COLUMNS, StreetGraph, require
from waymark.operators import density, spatial
from waymark.operators import simplify as S


class MapIndex:
    """Assignments of points to a graph's nodes and segments, and the data for drawing them."""

    def __init__(self, graph: StreetGraph) -> None:
        self.graph = graph

    def assign_to_endpoints(self, points: DataFrame) -> DataFrame:
        """Points with ``assigned_node_id`` and ``distance``."""
        require(points, POINT_COLUMNS, "Points", POINT_COLUMNS)
        return spatial.nearest_node(points, self.graph.nodes)

    def assign_to_segments(self, points: DataFrame) -> DataFrame:
        """Points with ``assigned_segment_id`` and ``distance``."""
        require(points, POINT_COLUMNS, "Points", POINT_COLUMNS)
        return spatial.nearest_segment(points, self.graph.segments)

    def get_render_data(self, assignments: DataFrame | None = None, neighbor_influence: float = 0.5, outlier_percentile: float = 99.0) -> dict[str, DataFrame]:
        return density.render_data(self.graph, assignments, neighbor_influence, outlier_percentile)

    def __repr__(self) -> str:
        return f"MapIndex({self.graph!r})"


def simplify_graph_topological(graph: StreetGraph, **options: object) -> StreetGraph:
    return S.simplify_topological(graph, **options)


def simplify_graph_geometric(graph: StreetGraph, threshold_meters: float = 10.0, **options: object) -> StreetGraph:
    return S.simplify_geometric(graph, threshold_meters, **options)


def simplify_graph_parallel(graph: StreetGraph, distance_threshold: float = 10.0, angle_threshold_deg: float = 5.0, **options: object) -> StreetGraph:
    return S.simplify_parallel(graph, distance_threshold, angle_threshold_deg, **options)


def simplify_graph(graph: StreetGraph, threshold_meters: float = 10.0) -> StreetGraph:
    """Contract chains; with a positive threshold, also merge near intersections."""
    return simplify_graph_topological(graph) if threshold_meters <= 0 else simplify_graph_geometric(graph, threshold_meters)


def simplify_graph_parallel_cgal(nodes: DataFrame, segments: DataFrame, distance_threshold: float = 10.0, angle_threshold_deg: float = 5.0) -> StreetGraph:
    """:func:`simplify_graph_parallel` under its other name, from two tables."""
    return simplify_graph_parallel(StreetGraph(nodes, segments), distance_threshold, angle_threshold_deg)


def render_realtime(index: MapIndex, assignments: DataFrame | None = None, title: str = "Street Network Visualization") -> dict[str, DataFrame]:
    """Buffers of a view, coloured by density where there are assignments, its box and title.

    Density is capped at the 98th percentile; the view is padded by 5 %.
    """
    buffers = index.get_render_data(assignments, 0.5, 98.0) if assignments is not None else index.get_render_data()
    return buffers | {"view": _view(index, 0.05).withColumn("title", F.lit(title))}


def render_graph(index: MapIndex, title: str = "Street Network Graph") -> dict[str, DataFrame]:
    """Buffers of the bare graph."""
    return render_realtime(index, None, title)


def render_heatmap(index: MapIndex, assignments: DataFrame, title: str = "Crime Density Heatmap") -> dict[str, DataFrame]:
    """Buffers of the graph coloured by density."""
    return render_realtime(index, assignments, title)


def render_comparison(left: MapIndex, right: MapIndex, left_assignments: DataFrame | None = None, right_assignments: DataFrame | None = None, title_left: str = "Original Graph", title_right: str = "Simplified Graph") -> dict[str, dict[str, DataFrame]]:
    """Buffers of two graphs, each with its view (10 % padding) and title."""
    sides = (("left", left, left_assignments, title_left), ("right", right, right_assignments, title_right))
    return {k: i.get_render_data(a, 0.5, 98.0) | {"view": _view(i, 0.1).withColumn("title", F.lit(t))} for k, i, a, t in sides}


def write_buffers(buffers: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Each buffer of a view as a table ``path/name``, in any format Spark writes."""
    for name, rows in buffers.items():
        rows.write.mode(mode).format(fmt).save(f"{path}/{name}")


def _view(index: MapIndex, padding: float) -> DataFrame:
    from waymark.operators.reports import bounding_box

    return bounding_box(index.graph.nodes, padding)
