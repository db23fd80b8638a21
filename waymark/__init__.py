"""Street-network point analytics on Spark DataFrames."""

from waymark.api import (
    MapIndex,
    render_comparison,
    render_graph,
    render_heatmap,
    render_realtime,
    simplify_graph,
    simplify_graph_geometric,
    simplify_graph_parallel,
    simplify_graph_parallel_cgal,
    simplify_graph_topological,
    write_buffers,
)
from waymark.graph import StreetGraph
from waymark.sources.loaders import load_graph, load_map

__all__ = [
    "MapIndex", "StreetGraph", "load_graph", "load_map", "render_comparison", "render_graph", "render_heatmap", "render_realtime",
    "simplify_graph", "simplify_graph_geometric", "simplify_graph_parallel", "simplify_graph_parallel_cgal", "simplify_graph_topological", "write_buffers",
]
