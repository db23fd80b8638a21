"""Street graph: a nodes table and a segments table, checked by name and otherwise lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame

NODE_COLUMNS = ["node_id", "x", "y"]
SEGMENT_COLUMNS = ["segment_id", "node_start", "node_end", "x1", "y1", "x2", "y2"]
POINT_COLUMNS = ["point_id", "x", "y"]


def require(df: DataFrame, columns: list[str], what: str, say: list[str] | None = None) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} DataFrame missing required columns: {say or missing}")


class StreetGraph:
    """``nodes(node_id, x, y, ...)`` and ``segments(segment_id, node_start, node_end, x1, y1, x2, y2, ...)``.

    Ids are longs, coordinates doubles of a projected system. Only the presence of columns is checked;
    nothing is read until a result is asked for.
    """

    def __init__(self, nodes: DataFrame, segments: DataFrame) -> None:
        require(nodes, NODE_COLUMNS, "Nodes")
        require(segments, SEGMENT_COLUMNS, "Segments")
        self.nodes = nodes
        self.segments = segments

    def __repr__(self) -> str:
        return f"StreetGraph(nodes: {', '.join(self.nodes.columns)}; segments: {', '.join(self.segments.columns)})"

    def size(self) -> tuple[int, int]:
        """Numbers of nodes and segments (runs two counts)."""
        return self.nodes.count(), self.segments.count()
