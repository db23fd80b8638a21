"""Registered queries over the street fixtures, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.api import MapIndex, simplify_graph
from waymark.operators import density, reports, spatial
from waymark.operators import simplify as S
from waymark.plans import fixtures as fx

NEAR, FAR, ANGLE = 75.0, 100.0, 10.0
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ---- SQL of shared parts: plain cross products and recursion, no grids and no pointer doubling ------

NEAREST = """
nearest AS MATERIALIZED (SELECT p.point_id, p.crime_type, p.x, p.y, n.node_id AS assigned_node_id, sqrt(b.m.d2) AS distance FROM points p
    JOIN (SELECT p.point_id, min({'d2': (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y), 'id': n.node_id}) AS m FROM points p, nodes n GROUP BY 1) b USING (point_id)
    JOIN nodes n ON n.node_id = b.m.id)"""
ENDS = "ends AS (SELECT node_start AS a, node_end AS b FROM segments UNION ALL SELECT node_end, node_start FROM segments)"
DEGREE = "deg AS (SELECT a AS node_id, count(*) AS degree FROM ends GROUP BY 1)"
COUNTS = "cnts AS (SELECT assigned_node_id AS node_id, count(*) AS cnt FROM nearest GROUP BY 1)"
SMOOTH = """smooth AS (SELECT n.node_id, coalesce(c.cnt, 0)::BIGINT AS cnt, coalesce(c.cnt, 0) + 0.5::DOUBLE * coalesce(m.near, 0) AS smoothed
    FROM nodes n LEFT JOIN cnts c USING (node_id) LEFT JOIN (SELECT a AS node_id, sum(cnt) AS near FROM ends JOIN cnts ON b = cnts.node_id GROUP BY 1) m USING (node_id))"""
CAP = "cap AS (SELECT CASE WHEN quantile_cont(smoothed::DOUBLE, 0.98) = 0 THEN 1 ELSE quantile_cont(smoothed::DOUBLE, 0.98) END AS cap FROM smooth)"
COLORS = """colors AS (SELECT node_id, smoothed, CASE WHEN smoothed > 0 THEN CASE WHEN i < 0.33 THEN 0.4 + 0.6 * (i / 0.33) ELSE 1.0 END ELSE 0.4 END::DOUBLE AS r,
    CASE WHEN smoothed > 0 THEN CASE WHEN i < 0.33 THEN 0.4 + 0.6 * (i / 0.33) WHEN i < 0.66 THEN 1.0 - 0.35 * ((i - 0.33) / 0.33) ELSE 0.65 - 0.65 * ((i - 0.66) / 0.34) END ELSE 0.4 END::DOUBLE AS g,
    CASE WHEN smoothed > 0 THEN CASE WHEN i < 0.33 THEN 0.4 - 0.4 * (i / 0.33) ELSE 0.0 END ELSE 0.4 END::DOUBLE AS b, CASE WHEN smoothed > 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS a
    FROM (SELECT node_id, smoothed, least(smoothed, cap) / cap AS i FROM smooth, cap))"""


def pairs_within(table: str, t: float) -> str:
    return f"near AS (SELECT p.node_id AS a, q.node_id AS b, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2 FROM {table} p, {table} q WHERE p.node_id < q.node_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= {t * t})"


def labels_of(nodes: str, pairs: str) -> str:
    return f"""both_ways AS (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs}),
reach(node_id, other) AS (SELECT node_id, node_id FROM {nodes} UNION SELECT r.node_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
labels AS (SELECT node_id, min(other) AS cluster_id FROM reach GROUP BY 1)"""


def walks(kept: str, stubs: str | None) -> str:
    """Chains by recursion from kept nodes along segments, one segment after the other."""
    end = f"(v IN (SELECT node_id FROM {kept})" + (f" OR v IN (SELECT node_id FROM {stubs}))" if stubs else ")")
    return f"""half AS (SELECT segment_id AS s, node_start AS u, node_end AS v, 0 AS d FROM segments UNION ALL SELECT segment_id, node_end, node_start, 1 FROM segments),
walk(u, f, v, s, d, hops) AS (SELECT u, s, v, s, d, 1 FROM half WHERE u IN (SELECT node_id FROM {kept})
    UNION ALL SELECT w.u, w.f, h.v, h.s, h.d, w.hops + 1 FROM walk w JOIN half h ON h.u = w.v AND NOT (h.s = w.s AND h.d = 1 - w.d) WHERE NOT {end.replace("(v IN", "(w.v IN").replace(" v IN", " w.v IN")}),
chains AS (SELECT u AS node_start, v AS node_end, f AS first_seg, s AS last_seg, hops FROM walk WHERE {end})"""


KEPT = "kept AS (SELECT node_id FROM deg WHERE degree <> 2)"
STUBS = "stubs AS (SELECT node_id FROM deg JOIN (SELECT a AS node_id FROM ends GROUP BY 1 HAVING min(b) = max(b)) USING (node_id) WHERE degree = 2)"
TOPO = f"""{ENDS}, {DEGREE}, {KEPT}, {STUBS}, {walks('kept', 'stubs')},
tp AS (SELECT least(node_start, node_end) AS a, greatest(node_start, node_end) AS b, min(first_seg) AS seg FROM chains WHERE hops = 1 AND node_start <> node_end GROUP BY 1, 2
    UNION ALL SELECT DISTINCT least(node_start, node_end), greatest(node_start, node_end), least(first_seg, last_seg) FROM chains WHERE hops > 1 AND node_start <> node_end),
topo AS (SELECT row_number() OVER (ORDER BY tp.a, tp.b, seg) - 1 AS segment_id, tp.a AS node_start, tp.b AS node_end, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2
    FROM tp JOIN nodes p ON p.node_id = tp.a JOIN nodes q ON q.node_id = tp.b),
tnodes AS (SELECT n.* FROM nodes n JOIN kept USING (node_id))"""
GEO = f"""{TOPO}, {pairs_within('tnodes', FAR)}, {labels_of('tnodes', 'near')},
gnodes AS (SELECT cluster_id AS node_id, avg(x) AS x, avg(y) AS y FROM tnodes JOIN labels USING (node_id) GROUP BY 1),
geo AS (SELECT row_number() OVER (ORDER BY t.segment_id) - 1 AS segment_id, a.cluster_id AS node_start, b.cluster_id AS node_end, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2
    FROM topo t JOIN labels a ON a.node_id = t.node_start JOIN labels b ON b.node_id = t.node_end JOIN gnodes p ON p.node_id = a.cluster_id JOIN gnodes q ON q.node_id = b.cluster_id WHERE a.cluster_id <> b.cluster_id)"""
NATIVE = f"{ENDS}, {DEGREE}, kept AS (SELECT node_id FROM nodes LEFT JOIN deg USING (node_id) WHERE coalesce(degree, 0) <> 2), {walks('kept', None)}"


def named_pairs(names: str, nodes: str) -> str:
    return f"""named AS (SELECT DISTINCT least(a.name, b.name) AS a, greatest(a.name, b.name) AS b FROM chains JOIN {names} a ON a.node_id = node_start JOIN {names} b ON b.node_id = node_end WHERE a.name <> b.name),
final AS (SELECT row_number() OVER (ORDER BY named.a, named.b) - 1 AS segment_id, named.a AS node_start, named.b AS node_end, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2
    FROM named JOIN {nodes} p ON p.node_id = named.a JOIN {nodes} q ON q.node_id = named.b)"""


NATIVE_GEO = f"""{NATIVE}, tnodes AS (SELECT n.* FROM nodes n JOIN kept USING (node_id)), {pairs_within('tnodes', FAR)}, {labels_of('tnodes', 'near')},
cl AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS name, avg(x) AS x, avg(y) AS y FROM tnodes JOIN labels USING (node_id) GROUP BY cluster_id),
names AS (SELECT node_id, name FROM labels JOIN cl USING (cluster_id)), ngnodes AS (SELECT name AS node_id, x, y FROM cl), {named_pairs('names', 'ngnodes')}"""


def _point_segment(px: str, py: str, s: str) -> str:
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    t = f"greatest(0.0, least(1.0, coalesce((({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0)))"
    return f"(({px} - ({s}.x1 + {t} * {dx})) * ({px} - ({s}.x1 + {t} * {dx})) + ({py} - ({s}.y1 + {t} * {dy})) * ({py} - ({s}.y1 + {t} * {dy})))"


def _side(s: str, x: str, y: str) -> str:
    return f"sign(({s}.x2 - {s}.x1) * ({y} - {s}.y1) - ({s}.y2 - {s}.y1) * ({x} - {s}.x1))"


_APART = f"least({_point_segment('p.x1', 'p.y1', 'q')}, {_point_segment('p.x2', 'p.y2', 'q')}, {_point_segment('q.x1', 'q.y1', 'p')}, {_point_segment('q.x2', 'q.y2', 'p')})"
_CROSS = f"({_side('p', 'q.x1', 'q.y1')} * {_side('p', 'q.x2', 'q.y2')} < 0 AND {_side('q', 'p.x1', 'p.y1')} * {_side('q', 'p.x2', 'p.y2')} < 0)"
_COS = "abs((p.x2 - p.x1) * (q.x2 - q.x1) + (p.y2 - p.y1) * (q.y2 - q.y1)) / sqrt(((p.x2 - p.x1) * (p.x2 - p.x1) + (p.y2 - p.y1) * (p.y2 - p.y1)) * ((q.x2 - q.x1) * (q.x2 - q.x1) + (q.y2 - q.y1) * (q.y2 - q.y1)))"


def par(t: float) -> str:
    # boxes further apart than the threshold cannot hold near segments
    boxes = " AND ".join(f"least(p.{c}1, p.{c}2) <= greatest(q.{c}1, q.{c}2) + {t} AND least(q.{c}1, q.{c}2) <= greatest(p.{c}1, p.{c}2) + {t}" for c in "xy")
    return f"par AS (SELECT p.segment_id AS a, q.segment_id AS b FROM segments p JOIN segments q ON p.segment_id < q.segment_id AND {boxes} WHERE {_COS} > cos(radians({ANGLE})) AND (CASE WHEN {_CROSS} THEN 0 ELSE {_APART} END) <= {t * t})"


PARALLEL = f"""{ENDS}, {DEGREE}, {par(20.0)}, segs AS (SELECT DISTINCT unnest([a, b]) AS node_id FROM par), {labels_of('segs', 'par')},
grp AS (SELECT cluster_id AS g, row_number() OVER (ORDER BY cluster_id) - 1 + {S.PARALLEL_NODE_IDS} AS name FROM labels GROUP BY 1),
member AS (SELECT DISTINCT unnest([s.node_start, s.node_end]) AS node_id, name FROM segments s JOIN labels l ON l.node_id = s.segment_id JOIN grp ON grp.g = l.cluster_id),
mapped AS (SELECT node_id, max(name) AS name FROM member GROUP BY 1),
rest AS (SELECT node_id FROM nodes LEFT JOIN deg USING (node_id) WHERE coalesce(degree, 0) <> 2 AND node_id NOT IN (SELECT node_id FROM mapped)),
names AS (SELECT * FROM mapped UNION ALL SELECT node_id, node_id FROM rest),
pnodes AS (SELECT name AS node_id, avg(x) AS x, avg(y) AS y FROM member JOIN nodes USING (node_id) GROUP BY 1 UNION ALL SELECT n.* FROM nodes n JOIN rest USING (node_id)),
{walks('names', None)}, {named_pairs('names', 'pnodes')}"""


def query(sql_parts: str, select: str, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query under its name, with SQL over the fixtures."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{fx.SQL}{', ' + sql_parts if sql_parts else ''}\n{select}"
        return f

    return add


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MapIndex(fx.graph(spark, sf_dir)).assign_to_endpoints(fx.points(spark, sf_dir))


# ---- joins ---------------------------------------------------------------------------------------


@query(NEAREST, "SELECT * FROM nearest")
def nearest_node(spark, sf_dir):
    return assigned(spark, sf_dir)


@query("", f"""SELECT p.point_id, p.crime_type, p.x, p.y, b.m.id AS assigned_segment_id, round(sqrt(b.m.d2), 6) AS distance FROM points p
    JOIN (SELECT p.point_id, min({{'d2': {_point_segment('p.x', 'p.y', 's')}, 'id': s.segment_id}}) AS m FROM points p, segments s GROUP BY 1) b USING (point_id)""")
def nearest_segment(spark, sf_dir):
    out = MapIndex(fx.graph(spark, sf_dir)).assign_to_segments(fx.points(spark, sf_dir))
    return out.withColumn("distance", F.round("distance", 6))


@query(pairs_within("nodes", NEAR), "SELECT a, b, d2 FROM near")
def close_pairs(spark, sf_dir):
    return spatial.close_pairs(fx.nodes(spark, sf_dir), NEAR)


@query(par(20.0), "SELECT a, b FROM par")
def parallel_pairs(spark, sf_dir):
    return spatial.parallel_pairs(fx.segments(spark, sf_dir), 20.0, ANGLE)


# ---- reports -------------------------------------------------------------------------------------


@query(NEAREST, "SELECT assigned_node_id, count(*) AS cnt, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM nearest GROUP BY 1")
def points_per_node(spark, sf_dir):
    return reports.points_per(assigned(spark, sf_dir), "assigned_node_id")


@query("", "SELECT crime_type, count(*) AS cnt, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM points WHERE crime_type IS NOT NULL GROUP BY 1")
def points_per_type(spark, sf_dir):
    return reports.points_per(fx.points(spark, sf_dir), "crime_type")


@query(NEAREST, "SELECT assigned_node_id, count(*) AS cnt FROM nearest GROUP BY 1 ORDER BY cnt DESC, assigned_node_id LIMIT 10")
def top_nodes(spark, sf_dir):
    return reports.top_values(assigned(spark, sf_dir), 10)


@query("", "SELECT * FROM points ORDER BY point_id LIMIT 5")
def first_points(spark, sf_dir):
    return reports.first_rows(fx.points(spark, sf_dir), 5)


@query(NEAREST, "SELECT count(distance) AS n, round(avg(distance), 6) AS mean_distance, round(median(distance), 6) AS median_distance, round(min(distance), 6) AS min_distance, round(max(distance), 6) AS max_distance FROM nearest")
def assignment_stats(spark, sf_dir):
    out = reports.distance_stats(assigned(spark, sf_dir))
    return out.select("n", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(f"{NEAREST}, {COUNTS}", "SELECT count(*) AS n_values, avg(cnt) AS mean_count, max(cnt) AS max_count, min(cnt) AS min_count FROM cnts")
def count_stats(spark, sf_dir):
    return reports.count_stats(assigned(spark, sf_dir))


@query(NEAREST, "SELECT count(DISTINCT assigned_node_id) AS n_active FROM nearest")
def active_nodes(spark, sf_dir):
    return reports.active_values(assigned(spark, sf_dir))


@query("", "SELECT round(min(x) - 0.05::DOUBLE * (max(x) - min(x)), 6) AS min_x, round(max(x) + 0.05::DOUBLE * (max(x) - min(x)), 6) AS max_x, round(min(y) - 0.05::DOUBLE * (max(y) - min(y)), 6) AS min_y, round(max(y) + 0.05::DOUBLE * (max(y) - min(y)), 6) AS max_y FROM nodes")
def bbox(spark, sf_dir):
    out = reports.bounding_box(fx.nodes(spark, sf_dir), 0.05)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"{ENDS}, {DEGREE}", "SELECT degree, count(*) AS nodes FROM deg GROUP BY 1")
def degree_distribution(spark, sf_dir):
    return reports.degree_distribution(fx.segments(spark, sf_dir))


@query(f"{ENDS}, {DEGREE}", "SELECT CASE WHEN k <= 2 THEN degree END AS degree, sum(n)::BIGINT AS nodes FROM (SELECT degree, count(*) AS n, row_number() OVER (ORDER BY degree) AS k FROM deg GROUP BY 1) GROUP BY 1")
def degree_head(spark, sf_dir):
    return reports.degree_distribution(fx.segments(spark, sf_dir), 2)


@query(f"{ENDS}, {DEGREE}", "SELECT avg(degree) AS avg_degree FROM deg")
def avg_degree(spark, sf_dir):
    return reports.average_degree(fx.segments(spark, sf_dir))


# ---- graph ---------------------------------------------------------------------------------------


@query(ENDS, "SELECT a, b FROM ends")
def adjacency(spark, sf_dir):
    return S.adjacency(fx.segments(spark, sf_dir))


@query(f"{ENDS}, {DEGREE}", "SELECT node_id, degree FROM deg")
def degree(spark, sf_dir):
    return S.degrees(fx.segments(spark, sf_dir))


@query("", "SELECT least(node_start, node_end) AS node_a, greatest(node_start, node_end) AS node_b, min(segment_id) AS segment_id FROM segments GROUP BY 1, 2")
def undirected_edges(spark, sf_dir):
    return S.undirected(fx.segments(spark, sf_dir))


@query(f"{pairs_within('nodes', FAR)}, {labels_of('nodes', 'near')}", "SELECT node_id, cluster_id FROM labels", recursive=True)
def clusters(spark, sf_dir):
    return S.clusters(fx.nodes(spark, sf_dir), FAR)


@query(f"{pairs_within('nodes', FAR)}, {labels_of('nodes', 'near')}", "SELECT cluster_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM nodes JOIN labels USING (node_id) GROUP BY 1", recursive=True)
def cluster_centroids(spark, sf_dir):
    nodes = fx.nodes(spark, sf_dir)
    return S.centroids(nodes, S.clusters(nodes, FAR)).select("cluster_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


_SEG = "segment_id, node_start, node_end, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2"
_NODE = "node_id, round(x, 6) AS x, round(y, 6) AS y"


@query(TOPO, f"SELECT {_NODE} FROM tnodes", recursive=True)
def topo_nodes(spark, sf_dir):
    return _rounded(simplify_graph(fx.graph(spark, sf_dir), 0).nodes)


@query(TOPO, f"SELECT {_SEG} FROM topo", recursive=True)
def topo_segments(spark, sf_dir):
    return _rounded(simplify_graph(fx.graph(spark, sf_dir), 0).segments)


@query(NATIVE, f"SELECT {_NODE} FROM nodes JOIN kept USING (node_id)", recursive=True)
def topo_native_nodes(spark, sf_dir):
    return _rounded(S.simplify_topological(fx.graph(spark, sf_dir), "native").nodes)


@query(f"{NATIVE}, own AS (SELECT node_id, node_id AS name FROM kept), {named_pairs('own', 'nodes')}", f"SELECT {_SEG} FROM final", recursive=True)
def topo_native_segments(spark, sf_dir):
    return _rounded(S.simplify_topological(fx.graph(spark, sf_dir), "native").segments)


@query(GEO, f"SELECT {_NODE} FROM gnodes", recursive=True)
def geo_nodes(spark, sf_dir):
    return _rounded(simplify_graph(fx.graph(spark, sf_dir), FAR).nodes)


@query(GEO, f"SELECT {_SEG} FROM geo", recursive=True)
def geo_segments(spark, sf_dir):
    return _rounded(simplify_graph(fx.graph(spark, sf_dir), FAR).segments)


@query(NATIVE_GEO, f"SELECT {_NODE} FROM ngnodes", recursive=True)
def geo_native_nodes(spark, sf_dir):
    return _rounded(S.simplify_geometric(fx.graph(spark, sf_dir), FAR, "native").nodes)


@query(NATIVE_GEO, f"SELECT {_SEG} FROM final", recursive=True)
def geo_native_segments(spark, sf_dir):
    return _rounded(S.simplify_geometric(fx.graph(spark, sf_dir), FAR, "native").segments)


@query(PARALLEL, f"SELECT {_NODE} FROM pnodes", recursive=True)
def parallel_nodes(spark, sf_dir):
    return _rounded(S.simplify_parallel(fx.graph(spark, sf_dir), 20.0, ANGLE).nodes)


@query(PARALLEL, f"SELECT {_SEG} FROM final", recursive=True)
def parallel_segments(spark, sf_dir):
    return _rounded(S.simplify_parallel(fx.graph(spark, sf_dir), 20.0, ANGLE).segments)


@query(GEO, """SELECT 'nodes' AS what, (SELECT count(*) FROM nodes) AS before, (SELECT count(*) FROM gnodes) AS after, round(((SELECT count(*) FROM nodes) - (SELECT count(*) FROM gnodes)) * 100.0::DOUBLE / (SELECT count(*) FROM nodes), 6) AS pct
    UNION ALL SELECT 'segments', (SELECT count(*) FROM segments), (SELECT count(*) FROM geo), round(((SELECT count(*) FROM segments) - (SELECT count(*) FROM geo)) * 100.0::DOUBLE / (SELECT count(*) FROM segments), 6)""", recursive=True)
def reduction_pct(spark, sf_dir):
    graph = fx.graph(spark, sf_dir)
    before, after = graph.size(), simplify_graph(graph, FAR).size()
    rows = [(w, b, a, round(reports.reduction(b, a), 6)) for w, b, a in zip(("nodes", "segments"), before, after, strict=True)]
    return spark.createDataFrame(rows, "what string, before bigint, after bigint, pct double")


# ---- density -------------------------------------------------------------------------------------


@query(f"{NEAREST}, {ENDS}, {COUNTS}, {SMOOTH}", "SELECT node_id, cnt, smoothed FROM smooth")
def smoothed_counts(spark, sf_dir):
    return density.smoothed_counts(fx.graph(spark, sf_dir), assigned(spark, sf_dir))


@query(f"{NEAREST}, {ENDS}, {COUNTS}, {SMOOTH}, {CAP}", "SELECT round(cap, 6) AS cap FROM cap")
def intensity_cap(spark, sf_dir):
    rows = density.smoothed_counts(fx.graph(spark, sf_dir), assigned(spark, sf_dir))
    return density.intensity_cap(rows, 98.0).select(F.round("cap", 6).alias("cap"))


def _color_columns(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(c).cast("double"), 4).alias(c) if c in "rgba" else c for c in df.columns))


@query(f"{NEAREST}, {ENDS}, {COUNTS}, {SMOOTH}, {CAP}, {COLORS}", "SELECT node_id, smoothed, round(r, 4) AS r, round(g, 4) AS g, round(b, 4) AS b, round(a, 4) AS a FROM colors")
def heat_colors(spark, sf_dir):
    return _color_columns(density.node_colors(fx.graph(spark, sf_dir), assigned(spark, sf_dir), 0.5, 98.0))


@query("", "SELECT node_id, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y FROM nodes")
def node_vertices(spark, sf_dir):
    out = density.node_vertices(fx.nodes(spark, sf_dir))
    return out.select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("i AS (SELECT *, row_number() OVER (ORDER BY segment_id) - 1 AS segment_index FROM segments)", """SELECT segment_id, segment_index, segment_index * 2 AS vertex_index, x1 AS x, y1 AS y FROM i
    UNION ALL SELECT segment_id, segment_index, segment_index * 2 + 1, x2, y2 FROM i""")
def segment_vertices(spark, sf_dir):
    out = density.segment_vertices(fx.segments(spark, sf_dir))
    return out.select("segment_id", "segment_index", "vertex_index", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("", "SELECT segment_id, ((row_number() OVER (ORDER BY segment_id) - 1) * 2)::INT AS first, ((row_number() OVER (ORDER BY segment_id) - 1) * 2 + 1)::INT AS second FROM segments")
def segment_connectivity(spark, sf_dir):
    return density.segment_connectivity(fx.segments(spark, sf_dir))


@query(f"{NEAREST}, {ENDS}, {COUNTS}, {SMOOTH}, {CAP}, {COLORS}", "SELECT segment_id, pos::INT AS pos, round(c.r, 4) AS r, round(c.g, 4) AS g, round(c.b, 4) AS b, round(c.a, 4) AS a FROM (SELECT segment_id, node_start AS node_id, 0 AS pos FROM segments UNION ALL SELECT segment_id, node_end, 1 FROM segments) JOIN colors c USING (node_id)")
def segment_colors(spark, sf_dir):
    graph = fx.graph(spark, sf_dir)
    return _color_columns(density.segment_colors(graph.segments, density.node_colors(graph, assigned(spark, sf_dir), 0.5, 98.0)))
