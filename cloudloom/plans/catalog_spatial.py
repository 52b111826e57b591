"""Queries on neighbours, supervoxels and their graphs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import aggregates as A
from cloudloom.operators import relational as R
from cloudloom.operators import spatial as S
from cloudloom.plans.registry import query, rounded
from cloudloom.sources.views import Views, with_views

PAIR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
KNN = f"SELECT *, row_number() OVER (PARTITION BY frame_id, pt_id ORDER BY d2, nb) AS rank FROM (SELECT a.frame_id, a.pt_id, b.pt_id AS nb, {PAIR} AS d2 FROM pts a JOIN pts b ON a.frame_id = b.frame_id)"


@query("knn_join", with_views("pts", f"SELECT frame_id, pt_id, nb, round(d2, 6) + 0e0 AS d2, CAST(rank AS BIGINT) AS rank FROM ({KNN}) WHERE rank <= 5"))
def knn_join(v: Views) -> DataFrame:
    return S.knn_join(v.pts, v.pts, 5, 0.5).select("frame_id", "pt_id", "nb", rounded(F.col("d2"), "d2"), "rank")


def radius_sql(measure: str, limit: str) -> str:
    return with_views("pts", f"SELECT a.frame_id, a.pt_id, b.pt_id AS nb FROM pts a JOIN pts b ON a.frame_id = b.frame_id WHERE {measure} < {limit}")


@query("radius_join_l2", radius_sql(PAIR, "0.3e0 * 0.3e0"))
def radius_join_l2(v: Views) -> DataFrame:
    return S.radius_join(v.pts, v.pts, 0.3).select("frame_id", "pt_id", "nb")


@query("radius_join_l1", radius_sql("abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z)", "0.3e0"))
def radius_join_l1(v: Views) -> DataFrame:
    return S.radius_join(v.pts, v.pts, 0.3, "l1").select("frame_id", "pt_id", "nb")


@query("radius_join_linf", radius_sql("greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z))", "0.3e0"))
def radius_join_linf(v: Views) -> DataFrame:
    return S.radius_join(v.pts, v.pts, 0.3, "linf").select("frame_id", "pt_id", "nb")


@query("nn_label_fill", with_views("pts", f"""+ n AS (SELECT *, row_number() OVER (PARTITION BY frame_id, pt_id ORDER BY d2, nb) AS rank FROM (SELECT a.frame_id, a.pt_id, b.pt_id AS nb, b.label AS fill, {PAIR} AS d2 FROM pts a JOIN pts b ON a.frame_id = b.frame_id WHERE a.label = 0 AND b.label <> 0))
 SELECT p.frame_id, p.pt_id, CAST(coalesce(fill, p.label) AS INT) AS label FROM pts p LEFT JOIN (SELECT * FROM n WHERE rank = 1) USING (frame_id, pt_id)"""))
def nn_label_fill(v: Views) -> DataFrame:
    return S.nearest_label(v.pts, 0.4).select("frame_id", "pt_id", "label")


ERROR = f"SELECT frame_id, pt_id, min(d2) AS d2 FROM (SELECT a.frame_id, a.pt_id, {PAIR} AS d2 FROM pts a JOIN pts b ON a.frame_id = b.frame_id WHERE a.label = 1 AND b.label = 2) GROUP BY frame_id, pt_id"


@query("closest_error", with_views("pts", f"SELECT frame_id, round(avg(sqrt(d2)), 6) + 0e0 AS error FROM ({ERROR}) GROUP BY frame_id"))
def closest_error(v: Views) -> DataFrame:
    return S.closest_error(v.pts.where("label = 1"), v.pts.where("label = 2"), 0.4).select("frame_id", rounded(F.col("error"), "error"))


@query("closest_error_normals", with_views("pts nrm", f"""+ p AS (SELECT pts.*, nx, ny, nz FROM pts JOIN nrm USING (frame_id, pt_id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY frame_id, pt_id ORDER BY d2, nb) AS rank FROM (SELECT a.frame_id, a.pt_id, b.pt_id AS nb, {PAIR} AS d2, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz AS c FROM p a JOIN p b ON a.frame_id = b.frame_id WHERE a.label = 1 AND b.label = 2))
 SELECT frame_id, round(avg(sqrt(d2) * (1 - c)), 6) + 0e0 AS error FROM n WHERE rank = 1 GROUP BY frame_id"""))
def closest_error_normals(v: Views) -> DataFrame:
    p = v.pts.join(v.nrm, ["frame_id", "pt_id"])
    return S.closest_error(p.where("label = 1"), p.where("label = 2"), 0.4, normals=True).select("frame_id", rounded(F.col("error"), "error"))


NEXT = "nx AS (SELECT CAST((frame_id + 7) % 8 AS INT) AS frame_id, pt_id, x, y, z, r, g, b FROM pts)"


def next_frame(points: DataFrame) -> DataFrame:
    """Each frame's points as the target of the frame before (of eight, the last one's is the first)."""
    return points.withColumn("frame_id", F.pmod(F.col("frame_id") + 7, F.lit(8)).cast("int"))


@query("align_around_z", with_views("pts", f"""+ {NEXT}, u AS (SELECT frame_id, pt_id, CAST(k AS INT) AS step, cos(2 * pi() * k / 100) * x - sin(2 * pi() * k / 100) * y AS x, sin(2 * pi() * k / 100) * x + cos(2 * pi() * k / 100) * y AS y, z FROM pts, range(0, 100) t(k)),
 e AS (SELECT frame_id, step, avg(sqrt(d2)) AS error FROM (SELECT a.frame_id, a.step, a.pt_id, min({PAIR}) AS d2 FROM u a JOIN nx b ON b.frame_id = a.frame_id GROUP BY a.frame_id, a.step, a.pt_id) GROUP BY frame_id, step)
 SELECT frame_id, step, round(error, 6) + 0e0 AS error FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY error, step) AS best FROM e) WHERE best = 1"""))
def align_around_z(v: Views) -> DataFrame:
    """The yaw, of a hundred, that lays each frame best on the next one."""
    return S.align_around_z(v.pts, next_frame(v.pts), 0.5).select("frame_id", "step", rounded(F.col("error"), "error"))


@query("voxel_adjacency", with_views("pts sv_edges", "SELECT frame_id, a, b FROM sv_edges"))
def voxel_adjacency(v: Views) -> DataFrame:
    return v.sv_edges


@query("sv2pix", with_views("svpts supervoxels", "SELECT frame_id, pt_id, sv, size FROM svpts JOIN supervoxels USING (frame_id, sv)"))
def sv2pix(v: Views) -> DataFrame:
    return R.to_points(v.svpts, v.supervoxels, "size").select("frame_id", "pt_id", "sv", "size")


@query("get_pix_func", with_views("svpts supervoxels", "SELECT frame_id, pt_id, round(s.cz * 10, 6) + 0e0 AS f FROM svpts p JOIN supervoxels s USING (frame_id, sv)"))
def get_pix_func(v: Views) -> DataFrame:
    values = v.supervoxels.select("frame_id", "sv", rounded(F.col("cz") * 10, "f"))
    return R.to_points(v.svpts, values, "f", none=None).select("frame_id", "pt_id", "f")


@query("get_vox_func", with_views("svpts", "SELECT frame_id, sv, round(avg(x + y) + 1e-9, 6) + 0e0 AS f FROM svpts GROUP BY frame_id, sv"))
def get_vox_func(v: Views) -> DataFrame:
    return R.to_supervoxels(v.svpts.withColumn("f", F.col("x") + F.col("y")), "f").select("frame_id", "sv", rounded(F.col("f") + 1e-9, "f"))


@query("sv_centroid", with_views("supervoxels", "SELECT frame_id, sv, round(cx + 1e-9, 6) + 0e0 AS cx, round(cy + 1e-9, 6) + 0e0 AS cy, round(cz + 1e-9, 6) + 0e0 AS cz, size FROM supervoxels"))
def sv_centroid(v: Views) -> DataFrame:
    return v.supervoxels.select("frame_id", "sv", *[rounded(F.col(c) + 1e-9, c) for c in ("cx", "cy", "cz")], "size")


@query("sv_size", with_views("svpts", "SELECT frame_id, sv, CAST(count(*) AS BIGINT) AS n FROM svpts GROUP BY frame_id, sv"))
def sv_size(v: Views) -> DataFrame:
    return v.svpts.groupBy("frame_id", "sv").agg(F.count(F.lit(1)).alias("n"))


@query("get_sv_index", with_views("svpts", "SELECT frame_id, sv, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY m) - 1 AS BIGINT) AS place FROM (SELECT frame_id, sv, min(pt_id) AS m FROM svpts WHERE label = 1 GROUP BY frame_id, sv)"))
def get_sv_index(v: Views) -> DataFrame:
    return R.supervoxels_of(v.svpts.where("label = 1")).select("frame_id", "sv", "place")


@query("get_sv_index_sorted", with_views("svpts", "SELECT DISTINCT frame_id, sv FROM svpts WHERE label = 1"))
def get_sv_index_sorted(v: Views) -> DataFrame:
    return v.svpts.where("label = 1").select("frame_id", "sv").distinct()


@query("get_pix_index", with_views("svpts", "SELECT frame_id, pt_id FROM svpts WHERE (frame_id, sv) IN (SELECT (frame_id, sv) FROM svpts WHERE pt_id % 80 < 8)"))
def get_pix_index(v: Views) -> DataFrame:
    return R.points_of(v.svpts, v.svpts.where("pt_id % 80 < 8")).select("frame_id", "pt_id")


@query("get_subgraph", with_views("svpts sv_edges", """+ n AS (SELECT frame_id, sv, row_number() OVER (PARTITION BY frame_id ORDER BY m) - 1 AS place FROM (SELECT frame_id, sv, min(pt_id) AS m FROM svpts WHERE label = 1 GROUP BY frame_id, sv))
 SELECT e.frame_id, CAST(least(p.place, q.place) AS BIGINT) AS na, CAST(greatest(p.place, q.place) AS BIGINT) AS nb FROM sv_edges e JOIN n p ON e.frame_id = p.frame_id AND e.a = p.sv JOIN n q ON e.frame_id = q.frame_id AND e.b = q.sv"""))
def get_subgraph(v: Views) -> DataFrame:
    return R.subgraph(v.svpts.where("label = 1"), v.sv_edges)[1].select("frame_id", "na", "nb")


@query("nn_min_dist", with_views("svpts sv_edges", f"SELECT e.frame_id, e.a, e.b, round(min({PAIR.replace('a.', 'p.').replace('b.', 'q.')}), 6) + 0e0 AS d2 FROM sv_edges e JOIN svpts p ON e.frame_id = p.frame_id AND e.a = p.sv JOIN svpts q ON e.frame_id = q.frame_id AND e.b = q.sv GROUP BY e.frame_id, e.a, e.b"))
def nn_min_dist(v: Views) -> DataFrame:
    return min_distance(v.svpts, v.sv_edges).select("frame_id", "a", "b", rounded(F.col("d2"), "d2"))


def min_distance(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Least squared distance between the points of two supervoxels."""
    p = points.select("frame_id", F.col("sv").alias("a"), *[F.col(c).alias("p" + c) for c in "xyz"])
    q = points.select("frame_id", F.col("sv").alias("b"), *[F.col(c).alias("q" + c) for c in "xyz"])
    return edges.join(p, ["frame_id", "a"]).join(q, ["frame_id", "b"]).groupBy("frame_id", "a", "b").agg(F.min(G.sq_dist(G.vec("p"), G.vec("q"))).alias("d2"))


def with_ends(edges: DataFrame, nodes: DataFrame, cols: list[str]) -> DataFrame:
    for side in "ab":
        edges = edges.join(nodes.select("frame_id", F.col("sv").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols]), ["frame_id", side])
    return edges


NODES = "nodes AS (SELECT frame_id, sv, cx, cy, cz, r, g, b, nx / sqrt(nx * nx + ny * ny + nz * nz) AS nx, ny / sqrt(nx * nx + ny * ny + nz * nz) AS ny, nz / sqrt(nx * nx + ny * ny + nz * nz) AS nz FROM supervoxels)"
ENDS = "ends AS (SELECT e.frame_id, e.a, e.b, pow(p.cx - q.cx, 2) + pow(p.cy - q.cy, 2) + pow(p.cz - q.cz, 2) AS d2, p.nx * q.nx + p.ny * q.ny + p.nz * q.nz AS c, pow(p.r - q.r, 2) + pow(p.g - q.g, 2) AS col FROM sv_edges e JOIN nodes p ON e.frame_id = p.frame_id AND e.a = p.sv JOIN nodes q ON e.frame_id = q.frame_id AND e.b = q.sv)"
SIM = f"+ {NODES}, {ENDS}, sim AS (SELECT frame_id, a, b, CASE WHEN d2 > 0.6e0 THEN 0e0 ELSE c / (1 + d2 / 0.6e0) / (1 + sqrt(col) / 100) END AS w FROM ends)"


def unit_nodes(v: Views) -> DataFrame:
    n = G.unit(G.vec("n"))
    return v.supervoxels.select("frame_id", "sv", "cx", "cy", "cz", "r", "g", "b", *[c.alias("n" + a) for c, a in zip(n, "xyz", strict=True)])


def similarity(v: Views) -> DataFrame:
    """(n1 . n2) / (1 + d^2 / th) / (1 + colour difference / scale), 0 beyond the threshold."""
    e = with_ends(v.sv_edges, unit_nodes(v), ["cx", "cy", "cz", "r", "g", "nx", "ny", "nz"])
    side = lambda p, s: tuple(F.col(f"{p}{c}_{s}") for c in "xyz")
    d2 = G.sq_dist(side("c", "a"), side("c", "b"))
    col = F.sqrt(F.pow(F.col("r_a") - F.col("r_b"), 2) + F.pow(F.col("g_a") - F.col("g_b"), 2))
    w = F.when(d2 > 0.6, 0.0).otherwise(G.dot(side("n", "a"), side("n", "b")) / (1 + d2 / 0.6) / (1 + col / 100))
    return e.select("frame_id", "a", "b", w.alias("w"))


@query("voxel_similarity", with_views("supervoxels sv_edges", SIM + " SELECT frame_id, a, b, round(w, 6) + 0e0 AS w FROM sim"))
def voxel_similarity(v: Views) -> DataFrame:
    return similarity(v).select("frame_id", "a", "b", rounded(F.col("w"), "w"))


@query("match", with_views("pts", f"""+ {NEXT},
 n AS (SELECT *, row_number() OVER (PARTITION BY frame_id, pt_id ORDER BY d2, nb) AS rank FROM (SELECT a.frame_id, a.pt_id, b.pt_id AS nb, {PAIR} AS d2, pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2) AS col FROM pts a JOIN nx b ON a.frame_id = b.frame_id)),
 m AS (SELECT *, row_number() OVER (PARTITION BY frame_id, pt_id ORDER BY col, nb) AS best FROM n WHERE rank <= 5)
 SELECT frame_id, pt_id, nb, round(1 / (1 + d2 / 0.1e0), 6) + 0e0 AS geo FROM m WHERE best = 1"""))
def match(v: Views) -> DataFrame:
    """Of the five nearest points of the next frame the one most alike in colour, and its geometric score."""
    s, t = v.pts, next_frame(v.pts)
    near = S.knn_join(s, t, 5, 0.4)
    # Spark sizes points by their packed file; left to that it would broadcast all of them
    both = near.join(s.select("frame_id", "pt_id", "r", "g", "b").hint("merge"), ["frame_id", "pt_id"]).join(t.select("frame_id", F.col("pt_id").alias("nb"), *[F.col(c).alias("n_" + c) for c in "rgb"]).hint("merge"), ["frame_id", "nb"])
    col = sum((F.pow(F.col(c) - F.col("n_" + c), 2) for c in "gb"), F.pow(F.col("r") - F.col("n_r"), 2))
    best = both.groupBy("frame_id", "pt_id").agg(F.min(F.struct(col.alias("col"), "nb", "d2")).alias("m"))
    return best.select("frame_id", "pt_id", "m.nb", rounded(G.radial(F.col("m.d2"), 0.1), "geo"))


@query("match_patch", with_views("pts nrm", f"""+ p AS (SELECT pts.*, nx, ny, nz FROM pts JOIN nrm USING (frame_id, pt_id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY frame_id, pt_id ORDER BY d2, nb) AS rank FROM (SELECT a.frame_id, a.pt_id, b.pt_id AS nb, {PAIR} AS d2, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz AS c FROM p a JOIN p b ON a.frame_id = b.frame_id WHERE a.label = 3 AND b.label = 4))
 SELECT frame_id, round(avg(c / (1 + 10 * sqrt(d2))), 6) + 0e0 AS score FROM n WHERE rank = 1 GROUP BY frame_id"""))
def match_patch(v: Views) -> DataFrame:
    p = v.pts.join(v.nrm, ["frame_id", "pt_id"])
    a, b = p.where("label = 3"), p.where("label = 4")
    near = S.knn_join(a, b, 1, 0.4).join(a.select("frame_id", "pt_id", "nx", "ny", "nz"), ["frame_id", "pt_id"]).join(b.select("frame_id", F.col("pt_id").alias("nb"), *[F.col("n" + c).alias("m" + c) for c in "xyz"]), ["frame_id", "nb"])
    return near.groupBy("frame_id").agg(rounded(F.avg(G.dot(G.vec("n"), G.vec("m")) / (1 + 10 * F.sqrt("d2"))), "score"))


@query("pix_to_object", with_views("pts", f"""+ n AS (SELECT a.frame_id, a.pt_id, b.label AS obj, min({PAIR}) AS d2 FROM pts a JOIN (SELECT * FROM pts WHERE label > 0) b ON a.frame_id = b.frame_id GROUP BY a.frame_id, a.pt_id, b.label)
 SELECT frame_id, pt_id, obj, round(CASE WHEN 1 + sqrt(d2) / 0.5e0 > 1.1e0 * (1 / 0.5e0) THEN 2.2e0 ELSE 1 + sqrt(d2) / 0.5e0 END, 6) + 0e0 AS cost FROM n"""))
def pix_to_object(v: Views) -> DataFrame:
    """Data term of a point for each object: 1 + d / threshold, cut off."""
    known = v.pts.where("label > 0").withColumn("obj", F.col("label"))
    source = v.pts.crossJoin(F.broadcast(v.spark.range(1, 5).select(F.col("id").cast("int").alias("obj"))))
    near = S.knn_join(source, known, 1, 0.5, by=("frame_id", "obj"))
    cost = 1 + F.sqrt("d2") / 0.5
    return near.select("frame_id", "pt_id", "obj", rounded(F.when(cost > 2.2, 2.2).otherwise(cost), "cost"))


@query("extract_patch_expand", with_views("pts", f"SELECT DISTINCT frame_id, label, pt_id FROM (SELECT frame_id, label, pt_id FROM pts WHERE label > 0 UNION ALL SELECT k.frame_id, f.label, k.nb FROM ({KNN}) k JOIN pts f USING (frame_id, pt_id) WHERE rank <= 4 AND f.label > 0)"))
def extract_patch_expand(v: Views) -> DataFrame:
    return R.patch_with_neighbours(v.pts, S.knn_join(v.pts, v.pts, 4, 0.5)).select("frame_id", "label", "pt_id")


@query("extract_patch_radius", with_views("pts", f"SELECT DISTINCT a.frame_id, a.label, b.pt_id FROM pts a JOIN pts b ON a.frame_id = b.frame_id WHERE a.label > 0 AND {PAIR} < 0.25e0 * 0.25e0"))
def extract_patch_radius(v: Views) -> DataFrame:
    return R.patch_with_neighbours(v.pts, S.radius_join(v.pts, v.pts, 0.25)).select("frame_id", "label", "pt_id")


@query("sort_agd", with_views("svpts supervoxels", "SELECT frame_id, pt_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY size DESC, sv, pt_id) AS BIGINT) AS place FROM svpts JOIN supervoxels s USING (frame_id, sv)"))
def sort_agd(v: Views) -> DataFrame:
    return R.sort_by_value(v.svpts, v.supervoxels, "size").select("frame_id", "pt_id", "place")


@query("two_hop_edges", with_views("sv_edges", """+ s AS (SELECT frame_id, a, b FROM sv_edges UNION ALL SELECT frame_id, b, a FROM sv_edges)
 SELECT frame_id, a, b FROM sv_edges UNION SELECT x.frame_id, x.a, y.b FROM s x JOIN s y ON x.frame_id = y.frame_id AND x.b = y.a WHERE x.a < y.b"""))
def two_hop_edges(v: Views) -> DataFrame:
    return R.two_hop(v.sv_edges)


@query("semi_anti", with_views("pts", "SELECT frame_id, CAST(sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS BIGINT) AS known, CAST(sum(CASE WHEN label > 0 THEN 0 ELSE 1 END) AS BIGINT) AS unknown FROM pts GROUP BY frame_id"))
def semi_anti(v: Views) -> DataFrame:
    known = v.pts.where("label > 0").select("frame_id", "pt_id")
    unknown = v.pts.select("frame_id", "pt_id").join(known, ["frame_id", "pt_id"], "left_anti")
    return known.groupBy("frame_id").agg(F.count(F.lit(1)).alias("known")).join(unknown.groupBy("frame_id").agg(F.count(F.lit(1)).alias("unknown")), "frame_id")


@query("intersect", with_views("pts", "SELECT frame_id, pt_id FROM pts WHERE label = 1 INTERSECT SELECT frame_id, pt_id FROM pts WHERE r < 128"))
def intersect(v: Views) -> DataFrame:
    return v.pts.where("label = 1").select("frame_id", "pt_id").intersect(v.pts.where("r < 128").select("frame_id", "pt_id"))


@query("complement", with_views("pts", "SELECT frame_id, pt_id FROM pts EXCEPT SELECT frame_id, pt_id FROM pts WHERE label = 1"))
def complement(v: Views) -> DataFrame:
    return v.pts.select("frame_id", "pt_id").exceptAll(v.pts.where("label = 1").select("frame_id", "pt_id"))


@query("unique", with_views("pts", "SELECT DISTINCT frame_id, label, z FROM pts"))
def unique(v: Views) -> DataFrame:
    return v.pts.select("frame_id", "label", "z").distinct()


@query("atomic_reduce", with_views("ensemble", "+ s AS (SELECT sv, string_agg(CAST(cluster AS VARCHAR), '-' ORDER BY run) AS signature FROM ensemble GROUP BY sv) SELECT sv, signature, CAST(dense_rank() OVER (ORDER BY signature) - 1 AS BIGINT) AS atom FROM s"))
def atomic_reduce(v: Views) -> DataFrame:
    return R.atomic(v.ensemble).select("sv", "signature", "atom")


def ensemble_edges(v: Views) -> DataFrame:
    n = v.table("part").agg(F.max("p_partkey")).first()[0]
    step = F.explode(F.array(F.lit(1), F.lit(2)))
    return v.table("part").select(F.col("p_partkey").alias("a"), step.alias("s")).select("a", (F.col("a") + F.col("s")).alias("b")).where(F.col("b") <= n)


@query("cooccurrence", with_views("ensemble", "SELECT x.sv AS a, y.sv AS b, round(avg(CASE WHEN x.cluster = y.cluster THEN 1e0 ELSE 0e0 END), 6) + 0e0 AS c FROM ensemble x JOIN ensemble y ON x.run = y.run AND y.sv - x.sv IN (1, 2) GROUP BY x.sv, y.sv"))
def cooccurrence(v: Views) -> DataFrame:
    return A.co_association(v.ensemble, ensemble_edges(v)).select("a", "b", rounded(F.col("c"), "c"))


@query("degree", with_views("supervoxels sv_edges", SIM + ", m AS (SELECT frame_id, a, b, w FROM sim UNION ALL SELECT frame_id, b, a, w FROM sim) SELECT frame_id, a AS sv, round(sum(w), 6) + 0e0 AS degree FROM m GROUP BY frame_id, a"))
def degree(v: Views) -> DataFrame:
    return A.degrees(similarity(v)).select("frame_id", "sv", rounded(F.col("degree"), "degree"))


POSITIVE = "pos AS (SELECT frame_id, a, b, w * w + 0.01e0 AS w FROM sim), m AS (SELECT frame_id, a, b, w FROM pos UNION ALL SELECT frame_id, b, a, w FROM pos), d AS (SELECT frame_id, a AS sv, sum(w) AS degree FROM m GROUP BY frame_id, a)"


@query("laplacian", with_views("supervoxels sv_edges", SIM + f", {POSITIVE}, l AS (SELECT frame_id, a, b, -w AS v FROM m UNION ALL SELECT frame_id, sv, sv, degree FROM d) SELECT l.frame_id, l.a, l.b, round(l.v / sqrt(x.degree * y.degree), 6) + 0e0 AS v FROM l JOIN d x ON l.frame_id = x.frame_id AND l.a = x.sv JOIN d y ON l.frame_id = y.frame_id AND l.b = y.sv"))
def laplacian(v: Views) -> DataFrame:
    w = similarity(v).withColumn("w", F.col("w") * F.col("w") + 0.01)
    return A.laplacian(w, kind="normalized").select("frame_id", "a", "b", rounded(F.col("v"), "v"))


@query("cut_assoc", with_views("supervoxels sv_edges", SIM + """, s AS (SELECT frame_id, sv, CASE WHEN cz > 1.5e0 THEN 1 ELSE 0 END AS s FROM supervoxels),
 c AS (SELECT e.frame_id, sum(CASE WHEN p.s <> q.s THEN w ELSE 0 END) AS cut, sum(w * (CASE WHEN p.s = 0 THEN 1 ELSE 0 END + CASE WHEN q.s = 0 THEN 1 ELSE 0 END)) AS assoc0, sum(w * (CASE WHEN p.s = 1 THEN 1 ELSE 0 END + CASE WHEN q.s = 1 THEN 1 ELSE 0 END)) AS assoc1
 FROM sim e JOIN s p ON e.frame_id = p.frame_id AND e.a = p.sv JOIN s q ON e.frame_id = q.frame_id AND e.b = q.sv GROUP BY e.frame_id)
 SELECT frame_id, round(cut, 6) + 0e0 AS cut, round(cut / assoc0 + cut / assoc1, 6) + 0e0 AS ncut FROM c"""))
def cut_assoc(v: Views) -> DataFrame:
    side = v.supervoxels.select("frame_id", "sv", F.when(F.col("cz") > 1.5, 1).otherwise(0).alias("s"))
    return A.cut_assoc(similarity(v), side).select("frame_id", rounded(F.col("cut"), "cut"), rounded(F.col("ncut"), "ncut"))


AFF = f"+ {NODES}, {ENDS.replace('AS col FROM', 'AS col, p.cx - q.cx AS ex, p.cy - q.cy AS ey, p.cz - q.cz AS ez, p.nx AS px, p.ny AS py, p.nz AS pz, q.nx AS qx, q.ny AS qy, q.nz AS qz FROM')}, t AS (SELECT *, acos(greatest(-1, least(1, (px * ex + py * ey + pz * ez) / sqrt(d2)))) - acos(greatest(-1, least(1, (qx * ex + qy * ey + qz * ez) / sqrt(d2)))) AS theta FROM ends), s AS (SELECT frame_id, pow(avg(sqrt(d2)), 2) AS scale FROM ends GROUP BY frame_id)"


@query("affinity", with_views("supervoxels sv_edges", AFF + " SELECT frame_id, a, b, round(0.5e0 * (exp(-d2 / scale) + CASE WHEN theta < -1e-9 THEN 0e0 WHEN theta > 1e-9 THEN 1e0 ELSE 0.5e0 END), 6) + 0e0 AS w FROM t JOIN s USING (frame_id)"))
def affinity(v: Views) -> DataFrame:
    return spectral_affinity(v).select("frame_id", "a", "b", rounded(F.col("w"), "w"))


def spectral_affinity(v: Views) -> DataFrame:
    """Half of exp(-d^2 / scale) and convexity, scale = the squared mean edge length of the frame."""
    e = with_ends(v.sv_edges, unit_nodes(v), ["cx", "cy", "cz", "nx", "ny", "nz"])
    side = lambda p, s: tuple(F.col(f"{p}{c}_{s}") for c in "xyz")
    edge = G.minus(side("c", "a"), side("c", "b"))
    e = e.withColumns({"d2": G.dot(edge, edge), "theta": G.angle(G.dot(side("n", "a"), G.unit(edge))) - G.angle(G.dot(side("n", "b"), G.unit(edge)))})
    scale = e.groupBy("frame_id").agg(F.pow(F.avg(F.sqrt("d2")), 2).alias("scale"))
    convex = F.when(F.col("theta") < -1e-9, 0.0).when(F.col("theta") > 1e-9, 1.0).otherwise(0.5)
    return e.join(F.broadcast(scale), "frame_id").select("frame_id", "a", "b", (0.5 * (G.gaussian(F.col("d2"), F.col("scale")) + convex)).alias("w"))


@query("affinity_debug", with_views("supervoxels sv_edges", SIM + " SELECT frame_id, a, b, round((w - min(w) OVER (PARTITION BY frame_id)) / (max(w) OVER (PARTITION BY frame_id) - min(w) OVER (PARTITION BY frame_id)), 6) + 0e0 AS shade FROM sim"))
def affinity_debug(v: Views) -> DataFrame:
    """Edge weights stretched to 0 to 1 in each frame, for a colour map."""
    w = similarity(v)
    span = w.groupBy("frame_id").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    return w.join(F.broadcast(span), "frame_id").select("frame_id", "a", "b", rounded((F.col("w") - F.col("lo")) / (F.col("hi") - F.col("lo")), "shade"))


@query("bounded_heap_k", with_views("supervoxels", "SELECT frame_id, a, b, CAST(rank AS BIGINT) AS rank FROM (SELECT p.frame_id, p.sv AS a, q.sv AS b, row_number() OVER (PARTITION BY p.frame_id, p.sv ORDER BY pow(p.cx - q.cx, 2) + pow(p.cy - q.cy, 2) + pow(p.cz - q.cz, 2), q.sv) AS rank FROM supervoxels p JOIN supervoxels q ON p.frame_id = q.frame_id AND p.sv <> q.sv) WHERE rank <= 3"))
def bounded_heap_k(v: Views) -> DataFrame:
    """The three nearest segments of each segment."""
    s = v.supervoxels.select("frame_id", F.col("sv").alias("pt_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    near = S.knn_join(s, s, 4, 1.0).where("pt_id <> nb")
    order = Window.partitionBy("frame_id", "pt_id").orderBy("rank")
    return near.select("frame_id", F.col("pt_id").alias("a"), F.col("nb").alias("b"), F.row_number().over(order).cast("long").alias("rank")).where("rank <= 3")


@query("ncut_image_affinity", with_views("pix", """SELECT a.prow AS ra, a.pcol AS ca, b.prow AS rb, b.pcol AS cb, round(exp(-(pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2)) / 5000e0 - (pow(a.prow - b.prow, 2) + pow(a.pcol - b.pcol, 2)) / 9e0), 6) + 0e0 AS w
 FROM pix a JOIN pix b ON b.prow BETWEEN a.prow - 3 AND a.prow + 3 AND b.pcol BETWEEN a.pcol - 3 AND a.pcol + 3 AND (b.prow, b.pcol) > (a.prow, a.pcol)"""))
def ncut_image_affinity(v: Views) -> DataFrame:
    """Affinities of pixels in 7 x 7 windows, each pair once."""
    step = F.explode(F.array(*[F.lit(i) for i in range(-3, 4)]))
    a = v.pix.select(F.col("prow").alias("ra"), F.col("pcol").alias("ca"), *[F.col(c).alias("a" + c) for c in "rgb"]).withColumn("dr", step).withColumn("dc", step)
    a = a.withColumns({"rb": F.col("ra") + F.col("dr"), "cb": F.col("ca") + F.col("dc")}).where("dr > 0 OR dr = 0 AND dc > 0")
    b = v.pix.select(F.col("prow").alias("rb"), F.col("pcol").alias("cb"), *[F.col(c).alias("b" + c) for c in "rgb"])
    col = sum((F.pow(F.col("a" + c) - F.col("b" + c), 2) for c in "gb"), F.pow(F.col("ar") - F.col("br"), 2))
    return a.join(b, ["rb", "cb"]).select("ra", "ca", "rb", "cb", rounded(F.exp(-col / 5000.0 - (F.pow("dr", F.lit(2)) + F.pow("dc", F.lit(2))) / 9.0), "w"))


@query("gaussian_blur", with_views("pix", """SELECT a.prow, a.pcol, round(sum(b.r * exp(-(pow(a.prow - b.prow, 2) + pow(a.pcol - b.pcol, 2)) / 2e0)) / sum(exp(-(pow(a.prow - b.prow, 2) + pow(a.pcol - b.pcol, 2)) / 2e0)), 6) + 0e0 AS r
 FROM pix a JOIN pix b ON b.prow BETWEEN a.prow - 2 AND a.prow + 2 AND b.pcol BETWEEN a.pcol - 2 AND a.pcol + 2 GROUP BY a.prow, a.pcol"""))
def gaussian_blur(v: Views) -> DataFrame:
    """A convolution as a join on shifted pixels and a weighted sum."""
    step = F.explode(F.array(*[F.lit(i) for i in range(-2, 3)]))
    moved = v.pix.select("prow", "pcol", "r").withColumn("dr", step).withColumn("dc", step)
    w = F.exp(-(F.pow("dr", F.lit(2)) + F.pow("dc", F.lit(2))) / 2.0)
    spread = moved.select((F.col("prow") + F.col("dr")).alias("prow"), (F.col("pcol") + F.col("dc")).alias("pcol"), w.alias("w"), (w * F.col("r")).alias("wr")).groupBy("prow", "pcol").agg((F.sum("wr") / F.sum("w")).alias("v"))
    return v.pix.select("prow", "pcol").join(spread, ["prow", "pcol"]).select("prow", "pcol", rounded(F.col("v"), "r"))


@query("voxel_similarity2", with_views("supervoxels sv_edges", AFF + " SELECT frame_id, a, b, round(CASE WHEN theta < -0.35e0 THEN 0e0 WHEN theta > 0.35e0 THEN 2e0 ELSE 1 / (1 + sqrt(col) / 100) END, 6) + 0e0 AS w FROM t"))
def voxel_similarity2(v: Views) -> DataFrame:
    """By the edge's concavity: nothing across a concave edge, the most across a convex one, else by colour."""
    e = with_ends(v.sv_edges, unit_nodes(v), ["cx", "cy", "cz", "r", "g", "nx", "ny", "nz"])
    side = lambda p, s: tuple(F.col(f"{p}{c}_{s}") for c in "xyz")
    edge = G.unit(G.minus(side("c", "a"), side("c", "b")))
    theta = G.angle(G.dot(side("n", "a"), edge)) - G.angle(G.dot(side("n", "b"), edge))
    col = F.sqrt(F.pow(F.col("r_a") - F.col("r_b"), 2) + F.pow(F.col("g_a") - F.col("g_b"), 2))
    w = F.when(theta < -0.35, 0.0).when(theta > 0.35, 2.0).otherwise(1 / (1 + col / 100))
    return e.select("frame_id", "a", "b", rounded(w, "w"))


@query("match_sv", with_views("pts svpts", f"""+ {NEXT},
 n AS (SELECT a.frame_id, a.sv, a.pt_id, min({PAIR}) AS d2 FROM svpts a JOIN nx b ON a.frame_id = b.frame_id GROUP BY a.frame_id, a.sv, a.pt_id)
 SELECT frame_id, sv, round(avg(1 / (1 + d2 / 0.1e0)), 6) + 0e0 AS geo FROM n GROUP BY frame_id, sv"""))
def match_sv(v: Views) -> DataFrame:
    """Geometric score of each supervoxel against the next frame: mean over its points."""
    near = S.knn_join(v.svpts, next_frame(v.pts), 1, 0.4).join(v.svpts.select("frame_id", "pt_id", "sv"), ["frame_id", "pt_id"])
    return near.groupBy("frame_id", "sv").agg(rounded(F.avg(G.radial(F.col("d2"), 0.1)), "geo"))
