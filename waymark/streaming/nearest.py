"""Nearest-node assignment of a stream of points, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from waymark.graph import POINT_COLUMNS, StreetGraph, require
from waymark.operators.spatial import nearest_node


def assign_stream(points: DataFrame, graph: StreetGraph, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start a query that hands every micro-batch with its assignments to ``sink(batch, id)``.

    The join is stateless; the batch id lets the sink write each batch exactly once.
    """
    require(points, POINT_COLUMNS, "Points", POINT_COLUMNS)
    writer = points.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, k: sink(nearest_node(batch, graph.nodes), k))
    return (writer.trigger(**trigger) if trigger else writer).start()
