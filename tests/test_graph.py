"""Hand-made graphs: the expected results follow the semantics described in the operators' docstrings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import waymark
from waymark.operators import components, reports
from waymark.operators import simplify as S
from waymark.operators import spatial
from waymark.sources import loaders

CHAIN4 = ([(0, 0, 0), (1, 10, 0), (2, 20, 0), (3, 30, 0)], [(0, 1), (1, 2), (2, 3)])
STAR = ([(0, 0, 0), (1, 10, 0), (2, 20, 0), (3, 10, 10), (4, 10, -10)], [(0, 1), (1, 2), (1, 3), (1, 4)])
WYE = ([(0, 0, 0), (1, 5, 0), (2, 2.5, 0), (3, 2.5, 10)], [(0, 2), (1, 2), (2, 3)])
VEE = ([(10, 0, 0), (11, 5, 0), (20, 100, 0)], [(10, 20), (11, 20)])
CHAIN3 = ([(0, 0, 0), (1, 10, 0), (2, 100, 0)], [(0, 1), (1, 2)])
SIMPLE = ([(0, 0, 0), (1, 100, 0), (2, 200, 100), (3, 100, 100)], [(0, 1), (1, 2), (2, 3)])
PARALLEL = ([(0, 0, 0), (1, 0, 5), (2, 100, 0), (3, 100, 5)], [(0, 2), (1, 3)])


def make(spark, spec):
    nodes, links = spec
    at = {n[0]: (float(n[1]), float(n[2])) for n in nodes}
    rows = [(i, a, b, *at.get(a, (0.0, 0.0)), *at.get(b, (0.0, 0.0))) for i, (a, b) in enumerate(links)]
    n = spark.createDataFrame([(k, *xy) for k, xy in at.items()], "node_id bigint, x double, y double")
    s = spark.createDataFrame(rows, "segment_id bigint, node_start bigint, node_end bigint, x1 double, y1 double, x2 double, y2 double")
    return waymark.load_graph(n, s)


def ends(graph):
    return sorted((r.node_start, r.node_end) for r in graph.segments.collect())


def ids(graph):
    return sorted(r.node_id for r in graph.nodes.collect())


def test_missing_columns(spark):
    g = make(spark, CHAIN4)
    for nodes, segments in ((g.nodes.drop("y"), g.segments), (g.nodes, g.segments.drop("x1", "y1", "x2", "y2"))):
        with pytest.raises(ValueError, match="missing required columns"):
            waymark.load_graph(nodes, segments)
    with pytest.raises(ValueError, match="missing required columns"):
        waymark.MapIndex(g).assign_to_endpoints(g.nodes.selectExpr("node_id as point_id", "x"))


def test_assignments(spark):
    index = waymark.MapIndex(make(spark, SIMPLE))
    points = spark.createDataFrame([(0, 5.0, 5.0, "a"), (1, 105.0, 5.0, "b"), (2, 195.0, 95.0, None), (3, None, 1.0, "n"), (4, float("nan"), 1.0, "n"), (5, 50.0, 0.0, "t"), (6, 1e7, -1e7, "far")], "point_id bigint, x double, y double, type string")
    got = {r.point_id: r for r in index.assign_to_endpoints(points).collect()}
    assert [got[i].assigned_node_id for i in range(7)] == [0, 1, 2, None, None, 0, 1] and got[2].type is None
    assert got[0].distance == math.sqrt(50) and got[3].distance is None
    seg = {r.point_id: r for r in index.assign_to_segments(points).collect()}
    assert (seg[5].assigned_segment_id, seg[5].distance) == (0, 0.0) and seg[3].assigned_segment_id is None
    none = waymark.MapIndex(make(spark, ([], [])))
    assert [r.assigned_node_id for r in none.assign_to_endpoints(points).collect()] == [None] * 7
    assert index.assign_to_endpoints(points.limit(0)).columns == ["point_id", "x", "y", "type", "assigned_node_id", "distance"]


@pytest.mark.parametrize("most, levels", [(4096, 16), (4096, 1), (40, 16)])
def test_nearest_against_brute_force(spark, monkeypatch, most, levels):
    monkeypatch.setattr(spatial, "BLOCK_TARGETS", most)
    monkeypatch.setattr(spatial, "LEVELS", levels)
    nodes = spark.range(300).select(F.col("id").alias("node_id"), (F.rand(1) * 100).alias("x"), (F.pow(F.rand(2), 6) * 1000).alias("y"))
    nodes = nodes.union(nodes.selectExpr("node_id + 1000", "x", "y")).union(spark.createDataFrame([(5000, 1e9, -1e9)], "node_id bigint, x double, y double")).cache()
    points = spark.range(300).select(F.col("id").alias("point_id"), (F.rand(3) * 200 - 50).alias("x"), (F.rand(4) * 3000 - 1000).alias("y")).cache()
    at = [(r.node_id, r.x, r.y) for r in nodes.collect()]
    for r in spatial.nearest_node(points, nodes).collect():
        d, n = min(((r.x - x) ** 2 + (r.y - y) ** 2, k) for k, x, y in at)
        assert r.assigned_node_id == n and abs(r.distance - math.sqrt(d)) < 1e-9


@pytest.mark.parametrize("spec, nodes, segments", [(CHAIN4, [0, 3], [(0, 3)]), (STAR, [0, 1, 2, 3, 4], [(0, 1), (1, 2), (1, 3), (1, 4)]), (CHAIN3, [0, 2], [(0, 2)]), (([], []), [], []), (([(0, 0, 0)], []), [0], [])])
def test_topological(spark, spec, nodes, segments):
    g = waymark.simplify_graph(make(spark, spec), 0)
    assert ids(g) == nodes and ends(g) == segments


def test_contraction_corner_cases(spark):
    nodes = [(k, k * 7 % 31, k) for k in range(20)]
    links = [(0, 1), (1, 0), (0, 2), (0, 3), (2, 4), (4, 3), (3, 5), (5, 0), (0, 0), (3, 6), (6, 7), (7, 3), (8, 9), (9, 10), (10, 8), (0, 3), (3, 0)]
    g = waymark.simplify_graph_topological(make(spark, (nodes, links)))
    # stub 0-1, direct 0-3 once, chains 0-2-4-3 and 0-5-3; loop 3-6-7-3, ring 8-9-10 and isolated nodes go
    assert ids(g) == [0, 3] and ends(g) == [(0, 1), (0, 3), (0, 3), (0, 3)]
    assert ends(waymark.simplify_graph_topological(make(spark, (nodes, links)), drop_stubs=True)) == [(0, 3)] * 3
    native = waymark.simplify_graph_topological(make(spark, (nodes, [*links, (0, 99)])), variant="native")
    assert ends(native) == [(0, 3)] and 11 in ids(native) and 1 not in ids(native)


@pytest.mark.parametrize("spec, t, nodes, segments", [(WYE, 10.0, 1, 0), (WYE, 1.0, 4, 3), (VEE, 10.0, 1, 0), (VEE, 0.0, 2, 1), (([], []), 5.0, 0, 0)])
def test_geometric(spark, spec, t, nodes, segments):
    # exactly 10 apart is near enough; node 20 of the V has degree two and is contracted
    assert waymark.simplify_graph_geometric(make(spark, spec), t).size() == (nodes, segments)
    with pytest.raises(ValueError):
        waymark.simplify_graph_geometric(make(spark, spec), -1.0)


def test_parallel(spark):
    g = make(spark, PARALLEL)
    merged = waymark.simplify_graph_parallel(g, 10.0, 5.0)
    assert merged.size() == (1, 0) and ids(merged) == [S.PARALLEL_NODE_IDS]
    assert waymark.simplify_graph_parallel(g, 1.0, 5.0).size() == (4, 2)
    assert waymark.simplify_graph_parallel(g, passthrough=True).size() == (4, 2)
    assert waymark.simplify_graph_parallel(make(spark, ([(0, 0, 0)], []))).size() == (0, 0)
    crossing = make(spark, ([(0, 0, 0), (1, 10, 10), (2, 0, 10), (3, 10, 0), (4, 5, 5)], [(0, 1), (2, 3), (4, 4)]))
    assert spatial.parallel_pairs(crossing.segments, 1.0, 5.0).count() == 0
    assert spatial.parallel_pairs(crossing.segments, 0.0, 90.0).count() == 0  # at right angles: not strictly below
    assert spatial.parallel_pairs(crossing.segments, 0.0, 91.0).count() == 1


def test_coincident_nodes(spark):
    nodes = make(spark, ([(1, 0, 0), (2, 0, 0), (3, 5, 0)], [])).nodes
    label = lambda **o: [r.cluster_id for r in S.clusters(nodes, 5.0, **o).orderBy("node_id").collect()]
    assert label() == [1, 1, 1] and label(merge_coincident=False) == [1, 2, 2]
    assert [r.cluster_id for r in S.clusters(nodes, 0.0).orderBy("node_id").collect()] == [1, 1, 3]


def test_render_data(spark):
    g = make(spark, STAR)
    index = waymark.MapIndex(g)
    plain = waymark.render_graph(index)
    assert {tuple(round(v, 3) for v in r[2:]) for r in plain["node_colors"].collect()} == {(0.4, 0.4, 0.4, 0.8)}
    points = spark.createDataFrame([(i, 9.0, 1.0) for i in range(10)] + [(99, None, None)], "point_id bigint, x double, y double")
    data = waymark.render_heatmap(index, index.assign_to_endpoints(points))
    colors = {r.node_id: r for r in data["node_colors"].collect()}
    assert colors[1].smoothed == 10 and colors[0].smoothed == 5 and colors[1].r == 1.0 and colors[1].a == 1.0
    assert data["segment_vertices"].count() == data["segment_colors"].count() == 8 and data["segment_connectivity"].count() == 4
    assert data["view"].first().min_x == -1.0
    none = index.get_render_data(index.assign_to_endpoints(points.where("x is null")))
    assert {r.smoothed for r in none["node_colors"].collect()} == {0.0}
    dangling = make(spark, (STAR[0], [*STAR[1], (1, 77)]))
    last = [r for r in waymark.render_graph(waymark.MapIndex(dangling))["segment_colors"].collect() if r.segment_id == 4]
    assert [(r.r, r.a) for r in last] == [(0.0, 0.0)] * 2
    both = waymark.render_comparison(index, index)
    assert set(both) == {"left", "right"} and both["left"]["view"].first().max_x == 22.0


def test_reports(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 9.0), (None, None)], "assigned_node_id bigint, distance double")
    assert [tuple(r) for r in reports.top_values(df, 1).collect()] == [(1, 2)]
    assert tuple(reports.distance_stats(df).first()) == (3, 5.0, 4.0, 2.0, 9.0)
    assert tuple(reports.count_stats(df).first()) == (2, 1.5, 2, 1) and reports.active_values(df).first()[0] == 2
    assert {r.assigned_node_id: round(r.pct, 3) for r in reports.points_per(df, "assigned_node_id").collect()} == {1: 66.667, 2: 33.333}
    assert reports.reduction(0, 0) == 0.0 and reports.points_per(df.limit(0), "assigned_node_id").count() == 0


def test_sources(spark, tmp_path):
    nodes = spark.createDataFrame([(70, -74.01, 40.70), (50, -74.00, 40.71), (60, -73.99, 40.70)], "osm_id bigint, lon double, lat double")
    ways = spark.createDataFrame([(50, 60), (60, 50), (70, 50), (70, 1)], "u bigint, v bigint")
    seen = []
    load = lambda: waymark.load_map(spark, "New York, NY", str(tmp_path), loader=lambda c, t: seen.append(c) or (nodes, ways))
    g = load()
    assert load().size() == g.size() == (3, 3) and seen == ["New York, NY"]
    assert (tmp_path / "New_York_NY_drive").is_dir()
    at = {r.node_id: (r.x, r.y) for r in g.nodes.collect()}
    assert abs(at[2][0] - 583640) < 700 and abs(at[2][1] - 4506000) < 1500
    assert ends(g) == [(0, 1), (1, 0), (2, 0)]
    with pytest.raises(ValueError):
        waymark.load_map(spark, "X", str(tmp_path), "fly")
    with pytest.raises(ValueError, match="could not load"):
        waymark.load_map(spark, "X", str(tmp_path), loader=lambda c, t: 1 / 0)
    with pytest.raises(ImportError):
        waymark.load_map(spark, "X", str(tmp_path))
    box = (0.0, 10.0, 0.0, 20.0)
    made = loaders.uniform_points(spark, 500, box).union(loaders.hotspot_points(spark, 500, [(1.0, 1.0, 5.0)], box))
    assert made.where("x < 0 or x > 10 or y < 0 or y > 20").count() == 0
    assert loaders.street_points(g.segments, 5, 1.0).count() == 15
    loaders.write_geojson(made.limit(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_stream(spark, tmp_path):
    from waymark.streaming.nearest import assign_stream

    g = make(spark, SIMPLE)
    spark.createDataFrame([(0, 5.0, 5.0), (1, 195.0, 95.0)], "point_id bigint, x double, y double").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("point_id bigint, x double, y double").parquet(str(tmp_path / "in"))
    assign_stream(stream, g, lambda df, k: got.extend((r.point_id, r.assigned_node_id) for r in df.collect()), str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    assert sorted(got) == [(0, 0), (1, 2)]


def test_titles_and_written_buffers(spark, tmp_path):
    index = waymark.MapIndex(make(spark, SIMPLE))
    view = waymark.render_realtime(index)
    assert view["view"].first().title == "Street Network Visualization"
    waymark.write_buffers(view, str(tmp_path))
    for name, rows in view.items():
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == rows.count()
    g = make(spark, SIMPLE)
    same = waymark.simplify_graph_parallel_cgal(g.nodes, g.segments, 1.0)
    assert same.size() == waymark.simplify_graph_parallel(g, 1.0).size()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _places(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(400), rng.integers(-60, 60, (400, 2)), strict=True)]
    rows += [(1, 500.0, 500.0), (1, 502.0, 500.0), (900, 502.0, 500.0), (901, None, 0.0)]  # an id at two places, a null
    spark.createDataFrame(rows, "node_id bigint, x double, y double").write.parquet(f"{tmp_path}/nodes")
    return rows, spark.read.parquet(f"{tmp_path}/nodes")


def test_close_pairs_are_dealt_by_cell_and_not_broadcast(spark, tmp_path):
    rows, nodes = _places(spark, tmp_path)
    out = spatial.close_pairs(nodes, 7.0)
    assert "Broadcast" not in _plan(out)
    some = [r for r in rows if r[1] is not None]
    want = sorted((p[0], q[0], d) for p in some for q in some if p[0] < q[0] and (d := (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) <= 49)
    assert sorted(tuple(r) for r in out.collect()) == want


def test_rounds_over_many_edges_broadcast_nothing(spark, tmp_path, monkeypatch):
    rows, nodes = _places(spark, tmp_path)
    want = sorted(tuple(r) for r in S.clusters(nodes, 7.0).collect())
    plans = []
    keep = components.save
    monkeypatch.setattr(components, "save", lambda df, label: plans.append(_plan(df)) or keep(df, label))
    monkeypatch.setattr(components, "BROADCAST_EDGES", 10)
    out = S.clusters(nodes, 7.0)
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans[:4]) and "Broadcast" not in _plan(out)
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) == len(rows)


def test_centroids_are_dealt_and_not_broadcast(spark, tmp_path):
    _, nodes = _places(spark, tmp_path)
    nodes = nodes.where("x is not null").dropDuplicates(["node_id"])
    nodes.write.parquet(f"{tmp_path}/once")
    nodes = spark.read.parquet(f"{tmp_path}/once")
    nodes.selectExpr("node_id", "node_id % 7 as cluster_id").write.parquet(f"{tmp_path}/labels")
    out = S.centroids(nodes, spark.read.parquet(f"{tmp_path}/labels"))
    assert "Broadcast" not in _plan(out)
    at = {}
    for k, x, y in nodes.collect():
        at.setdefault(k % 7, []).append((x, y))
    got = {r.cluster_id: (r.n, round(r.x, 9), round(r.y, 9)) for r in out.collect()}
    assert got == {c: (len(v), *(round(sum(z) / len(v), 9) for z in zip(*v, strict=True))) for c, v in at.items()}
