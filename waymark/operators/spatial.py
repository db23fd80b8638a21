"""Nearest-neighbour and distance joins on a pyramid of grids.

A grid turns nearness into equality of cells, so every join here is an equi-join. For nearest
neighbours, targets are gathered into one array per cell (with the cells around it), a point reads
the array of its own cell and takes the least ``(distance, id)`` of it: one row per point throughout,
no candidate rows, no aggregation over points. An answer within one cell width is certain, since
all targets that near lie in the block. Only points without a certain answer look one level up, where
cells are four times as wide; those of the last level meet all targets, in blocks. No array is longer
than ``BLOCK_TARGETS``: the finest cells are made for the densest part of the table, and a cell that is
too full for a level is left to the levels below and to the last. Small target tables are broadcast
by the planner on their measured size, and points then are not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.plans.storage import save

#: Mean number of targets of a cell at the finest level, most targets that a point looks at in a level, and levels.
CELL_TARGETS, BLOCK_TARGETS, LEVELS = 2.0, 4_096, 16
#: Most targets that the finest level leaves in a cell where finer cells can part them.
DENSE = 64
BLOCK = 2_048


def cell(v: Column, width: float) -> Column:
    return F.floor(v / F.lit(width)).cast("bigint")


def _around(value: Column) -> Column:
    return F.sequence(value - 1, value + 1)


def _levels(targets: DataFrame, x: Column, y: Column) -> tuple[list[float], int]:
    """Cell widths from fine to coarse, and the number of targets.

    The widths between are fitted to the middle of the table, so that targets far out widen no cell,
    and refined while some cell of distinct places is too full.
    """
    places = targets.select(x.alias("x"), y.alias("y"))
    ends = [F.percentile_approx(c, [0.02, 0.98], 1000).alias(f"q{c}") for c in "xy"]
    box = places.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), *ends).first()
    n = box["n"]
    if not n:
        return [], 0
    extent = max(box["x1"] - box["x0"], box["y1"] - box["y0"], 1e-9)
    wide, high = (max(q[1] - q[0], extent / n) for q in (box["qx"], box["qy"]))
    width = max(sqrt(wide * high / n * CELL_TARGETS), 1e-9 * extent, 1e-9)
    full = places.distinct().groupBy(cell(F.col("x"), width), cell(F.col("y"), width)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    while full > DENSE and width > 1e-9 * extent:  # a guess: places of the fullest cell may be closer still, and then go up
        width, full = width / 4, full / 16
    out = []
    while width < 2 * extent and len(out) < LEVELS:
        out.append(width)
        width *= 4
    return out, n


def _nearest(points: DataFrame, targets: DataFrame, cells: Callable[[DataFrame, float], DataFrame], d2: Callable[[Column], Column], center: tuple[Column, Column], out_id: str) -> DataFrame:
    """Append ``out_id`` and ``distance``. ``targets`` has a struct ``t`` with ``id`` first; ``cells`` deals it out."""
    keep = [c for c in points.columns if c not in (out_id, "distance")]
    rows = points.select(F.struct(*(F.col(c) for c in keep)).alias("p"))
    px, py = F.col("p.x").cast("double"), F.col("p.y").cast("double")
    ok = G.sound(px, py)
    widths, n = _levels(targets, *center)
    best = F.array_min(F.transform("ts", lambda t: F.struct(d2(t).alias("d2"), t["id"].alias("id"))))
    nothing = F.lit(None).cast(f"struct<d2:double,id:{dict(targets.select('t.id').dtypes)['id']}>")
    done = [rows.where(~ok if n else F.lit(True)).select("p", nothing.alias("b"))]
    rows = rows.where(ok if n else F.lit(False)).select("p", px.alias("px"), py.alias("py"))
    for width in widths:
        rows = rows.withColumns({"cx": cell(F.col("px"), width), "cy": cell(F.col("py"), width)})
        table = cells(targets, width)
        if width != widths[0]:  # few points are left: only their cells count, and of these the ones that are not too full
            table = table.join(rows.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
            table = table.join(table.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= BLOCK_TARGETS).select("cx", "cy"), ["cx", "cy"], "left_semi")
        table = table.groupBy("cx", "cy").agg(F.collect_list("t").alias("ts"))
        met = rows.join(table, ["cx", "cy"], "left").select("p", "px", "py", best.alias("b"))
        met = save(met.withColumn("sure", F.coalesce(F.col("b.d2") <= width * width, F.lit(False))), "nearest")
        done.append(met.where("sure").select("p", "b"))
        rows = met.where("not sure").select("p", "px", "py")
        if rows.isEmpty():
            break
    else:
        if n:
            done.append(_in_blocks(rows, targets, n, best))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("p.*", F.col("b.id").alias(out_id), F.sqrt("b.d2").alias("distance"))


def _in_blocks(rows: DataFrame, targets: DataFrame, n: int, best: Column) -> DataFrame:
    """The few points far from everything meet all targets, in blocks of bounded size."""
    blocks = -(-n // BLOCK)
    dealt = targets.groupBy(F.pmod(F.xxhash64("t"), F.lit(blocks)).alias("block")).agg(F.collect_list("t").alias("ts"))
    far = rows.withColumn("row", F.xxhash64("p", F.monotonically_increasing_id()))
    far = far.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).join(dealt, "block")
    return far.select("row", "p", best.alias("b")).groupBy("row").agg(F.first("p").alias("p"), F.min("b").alias("b")).select("p", "b")


def nearest_node(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each point with ``assigned_node_id`` and ``distance`` of its nearest node; ties go to the smaller id.

    Points with null or non-finite coordinates, and all points where there are no nodes, get nulls.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    places = nodes.where(G.sound(x, y)).groupBy(x.alias("x"), y.alias("y")).agg(F.min(F.col("node_id").cast("bigint")).alias("id")).where("id is not null")
    targets = places.select(F.struct("id", "x", "y").alias("t"))

    def cells(t: DataFrame, width: float) -> DataFrame:
        return t.select("t", F.explode(_around(cell(F.col("t.x"), width))).alias("cx")).select("t", "cx", F.explode(_around(cell(F.col("t.y"), width))).alias("cy"))

    return _nearest(points, targets, cells, lambda t: G.squared_distance(F.col("px"), F.col("py"), t["x"], t["y"]), (F.col("t.x"), F.col("t.y")), "assigned_node_id")


def _segment_cells(t: DataFrame, width: float, reach: float) -> DataFrame:
    """Cells within ``reach`` cells of a segment, column by column, so that long segments take few."""
    x1, y1, x2, y2 = (F.col(f"t.{c}") for c in ("x1", "y1", "x2", "y2"))
    k = int(reach)
    cols = t.withColumn("cx", F.explode(F.sequence(cell(F.least(x1, x2), width) - k, cell(F.greatest(x1, x2), width) + k)))
    lo, hi = (F.col("cx") - k).cast("double") * width, (F.col("cx") + k + 1).cast("double") * width
    # the part of the segment over these columns
    step = F.nullif(x2 - x1, F.lit(0.0))
    a, b = (lo - x1) / step, (hi - x1) / step
    t0 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.least(a, b), F.lit(0.0))))
    t1 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.greatest(a, b), F.lit(1.0))))
    ya, yb = y1 + t0 * (y2 - y1), y1 + t1 * (y2 - y1)
    return cols.withColumn("cy", F.explode(F.sequence(cell(F.least(ya, yb), width) - k, cell(F.greatest(ya, yb), width) + k)))


def nearest_segment(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Each point with ``assigned_segment_id`` and ``distance`` of its nearest segment; ties go to the smaller id."""
    xs = [F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]
    named = [c.alias(n) for c, n in zip(xs, ("x1", "y1", "x2", "y2"), strict=True)]
    targets = segments.where(G.sound(*xs)).select(F.struct(F.col("segment_id").cast("bigint").alias("id"), *named).alias("t"))
    center = ((F.col("t.x1") + F.col("t.x2")) / 2, (F.col("t.y1") + F.col("t.y2")) / 2)
    return _nearest(points, targets, lambda t, w: _segment_cells(t, w, 1), lambda t: G.point_segment_squared(F.col("px"), F.col("py"), t["x1"], t["y1"], t["x2"], t["y2"]), center, "assigned_segment_id")


def close_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a < b`` of nodes at most ``threshold`` apart (inclusive), with their squared distance ``d2``."""
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    rows = nodes.where(G.sound(x, y)).select(F.col("node_id").cast("bigint").alias("id"), x.alias("x"), y.alias("y"))
    if threshold == 0:
        a, b = rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b")
        return a.join(b.hint("merge"), ["x", "y"]).where("a < b").select("a", "b", F.lit(0.0).alias("d2"))
    rows = rows.withColumns({"cx": cell(F.col("x"), threshold), "cy": cell(F.col("y"), threshold)})
    # two cells meet once: each looks at itself and at four of the eight around it
    ahead = [F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), F.lit(i == j == 0).alias("own")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]
    near = rows.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.array(*ahead)).alias("c")).select("b", "bx", "by", "c.*")
    d2 = G.squared_distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    # the planner's size of a table knows neither compression nor the copies made here: its broadcast could outgrow the driver
    met = rows.join(near.hint("merge"), ["cx", "cy"]).where("id < b or (id > b and not own)")
    return met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), d2.alias("d2")).where(F.col("d2") <= threshold * threshold)


def parallel_pairs(segments: DataFrame, distance_threshold: float, angle_threshold_deg: float) -> DataFrame:
    """Pairs ``a < b`` of segments within the distance whose directions differ by less than the angle.

    Segments without length are in no pair.
    """
    if distance_threshold < 0:
        raise ValueError("distance_threshold must not be negative")
    names = ("x1", "y1", "x2", "y2")
    xs = [F.col(c).cast("double") for c in names]
    t = segments.where(G.sound(*xs)).select(F.struct(F.col("segment_id").cast("bigint").alias("id"), *(c.alias(n) for c, n in zip(xs, names, strict=True))).alias("t"))
    t = t.where("t.x1 <> t.x2 or t.y1 <> t.y2")
    mean = t.agg(F.avg(F.sqrt(G.squared_distance(F.col("t.x1"), F.col("t.y1"), F.col("t.x2"), F.col("t.y2"))))).first()[0] or 1.0
    width = max(distance_threshold, mean, 1e-9)
    left = _segment_cells(t, width, 0).select("cx", "cy", F.col("t").alias("s"))
    right = _segment_cells(t, width, 1).select("cx", "cy", F.col("t").alias("r"))
    s, r = (tuple(F.col(f"{k}.{n}") for n in names) for k in "sr")
    cos = F.cos(F.radians(F.lit(float(angle_threshold_deg))))
    pairs = left.join(right, ["cx", "cy"]).where("s.id < r.id").where(G.abs_cosine(s, r) > cos)
    pairs = pairs.where(G.segment_segment_squared(s, r) <= distance_threshold * distance_threshold)
    return pairs.select(F.col("s.id").alias("a"), F.col("r.id").alias("b")).distinct()
