"""Dense ids in a total order without a single-partition window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.storage import save


def dense_ids(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """Append ``name``: ``start, start + 1, ...`` in the given order.

    Rows are range-partitioned and sorted, numbered within their partitions, and shifted by the sizes
    of the partitions before; only these sizes reach the driver.
    """
    rows = df.drop(name) if name in df.columns else df
    place = F.monotonically_increasing_id()
    rows = save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place), "dense")
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(sizes)
    shift = dict(zip(parts, accumulate([start, *(sizes[p] for p in parts[:-1])]), strict=True)) if parts else {0: start}
    offsets = rows.sparkSession.createDataFrame(sorted(shift.items()), "__part bigint, __shift bigint")
    rows = rows.withColumn("__part", part.cast("bigint")).join(F.broadcast(offsets), "__part")  # a row per partition
    return rows.withColumn(name, F.col("__shift") + at).drop("__at", "__part", "__shift")
