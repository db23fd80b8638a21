"""Connected components by contraction: every round each node joins its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.plans.storage import drop, save

#: Edges up to which the planner may broadcast tables of a round. It judges by compressed files, which can be a small
#: part of what the rows take on the driver.
BROADCAST_EDGES = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label each node that occurs in ``edges`` with the smallest node id of its component.

    Returns ``(node, component)``. Nulls and self-loops are ignored; direction and repetition do not
    matter. Each round maps a node to the smallest id among itself and its neighbours (with one
    pointer jump), then rewrites the edges between the images. A node keeps its place only if it is
    a local minimum, so at most half of the connected nodes survive a round: logarithmically many
    rounds, each a few equi-joins, without broadcasts where edges are many. Lineage is cut by tables in the shared folder.
    """
    pair = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    work = save(pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while n := work.count():
        dealt = lambda df: df.hint("merge") if n > BROADCAST_EDGES else df  # noqa: B023, E731
        both = work.union(work.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        step = save(step, "cc-step")
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jump = step.join(dealt(hop), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        if labels is None:
            new = save(jump.select("node", F.col("to").alias("component")), "cc-labels")
        else:
            moved = jump.select(F.col("node").alias("component"), "to")
            new = save(labels.join(dealt(moved), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "cc-labels")
        ja, jb = jump.select(F.col("node").alias("a"), F.col("to").alias("ta")), jump.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        rest = work.join(dealt(ja), "a").join(dealt(jb), "b").where("ta <> tb")
        rest = save(rest.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
        for old in (work, step, labels):
            drop(old)
        work, labels = rest, new
    drop(work)
    if labels is None:
        return pair.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels
