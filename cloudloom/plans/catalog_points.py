"""Queries on points, labels, poses, boxes and colours, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import color as C
from cloudloom.functions import geometry as G
from cloudloom.operators import aggregates as A
from cloudloom.operators import relational as R
from cloudloom.operators import spatial as S
from cloudloom.plans.registry import query, rounded
from cloudloom.sources.views import CELL, Views, columns, with_views

FWD = "r00 * x + r01 * y + r02 * z + tx AS x, r10 * x + r11 * y + r12 * z + ty AS y, r20 * x + r21 * y + r22 * z + tz AS z"
INV = "r00 * (x - tx) + r10 * (y - ty) + r20 * (z - tz) AS x, r01 * (x - tx) + r11 * (y - ty) + r21 * (z - tz) AS y, r02 * (x - tx) + r12 * (y - ty) + r22 * (z - tz) AS z"
R6 = "round({0}, 6) + 0e0 AS {0}"
XYZ6 = ", ".join(R6.format(c) for c in "xyz")


def moved(points: DataFrame, vector: tuple) -> DataFrame:
    return points.select("frame_id", "pt_id", "obj_id", *[rounded(c, n) for c, n in zip(vector, "xyz", strict=True)])


@query("rigid_fwd", with_views("pts poses", f"SELECT frame_id, pt_id, obj_id, {XYZ6} FROM (SELECT frame_id, pt_id, obj_id, {FWD} FROM pts JOIN poses USING (frame_id))"))
def rigid_fwd(v: Views) -> DataFrame:
    return moved(v.pts.join(F.broadcast(v.poses), "frame_id"), G.forward(G.vec()))


@query("rigid_inv", with_views("pts poses", f"SELECT frame_id, pt_id, obj_id, {XYZ6} FROM (SELECT frame_id, pt_id, obj_id, {INV} FROM pts JOIN poses USING (frame_id))"))
def rigid_inv(v: Views) -> DataFrame:
    return moved(v.pts.join(F.broadcast(v.poses), "frame_id"), G.inverse(G.vec()))


RPY = """WITH a AS (SELECT r_regionkey AS k, 0.1e0 * r_regionkey AS r, 0.2e0 * r_regionkey AS p, 0.3e0 * r_regionkey AS y FROM region)
SELECT k, round(cos(y) * cos(p), 6) + 0e0 AS m00, round(cos(y) * sin(p) * sin(r) - sin(y) * cos(r), 6) + 0e0 AS m01, round(cos(y) * sin(p) * cos(r) + sin(y) * sin(r), 6) + 0e0 AS m02,
 round(sin(y) * cos(p), 6) + 0e0 AS m10, round(sin(y) * sin(p) * sin(r) + cos(y) * cos(r), 6) + 0e0 AS m11, round(sin(y) * sin(p) * cos(r) - cos(y) * sin(r), 6) + 0e0 AS m12,
 round(-sin(p), 6) + 0e0 AS m20, round(cos(p) * sin(r), 6) + 0e0 AS m21, round(cos(p) * cos(r), 6) + 0e0 AS m22 FROM a"""


@query("rot_rpy", RPY)
def rot_rpy(v: Views) -> DataFrame:
    k = F.col("r_regionkey")
    m = G.roll_pitch_yaw(0.1 * k, 0.2 * k, 0.3 * k)
    return v.table("region").select(k.alias("k"), *[rounded(m[i][j], f"m{i}{j}") for i in range(3) for j in range(3)])


@query("rot_zy", with_views("nrm", """SELECT frame_id, pt_id, round(nx / l, 6) + 0e0 AS zx, round(ny / l, 6) + 0e0 AS zy, round(nz / l, 6) + 0e0 AS zz, round((1 - nx * nx) / q, 6) + 0e0 AS xx, round(-nx * ny / q, 6) + 0e0 AS xy
 FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l, sqrt((1 - nx * nx) * (1 - nx * nx) + nx * ny * nx * ny + nx * nz * nx * nz) AS q FROM nrm)"""))
def rot_zy(v: Views) -> DataFrame:
    m = G.axes_matrix((F.lit(1.0), F.lit(0.0), F.lit(0.0)), G.vec("n"))
    return v.nrm.select("frame_id", "pt_id", *[rounded(m[2][j], f"z{c}") for j, c in enumerate("xyz")], rounded(m[0][0], "xx"), rounded(m[0][1], "xy"))


@query("align_up_z", with_views("pts", """SELECT frame_id, pt_id, round((x - px) * 0.6e0 + (y - py) * 0.8e0, 6) + 0e0 AS x, round((y - py) * 0.6e0 - (x - px) * 0.8e0, 6) + 0e0 AS y, round(z - pz, 6) + 0e0 AS z
 FROM pts JOIN (SELECT frame_id, x AS px, y AS py, z AS pz FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY pt_id) AS n FROM pts) WHERE n = 1) USING (frame_id)"""))
def align_up_z(v: Views) -> DataFrame:
    """Three picks give the axes (here the plane z = 0 with the first axis along (0.6, 0.8, 0)), the first point of a frame the origin."""
    m = G.axes_matrix((F.lit(0.6), F.lit(0.8), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    first = v.pts.groupBy("frame_id").agg(F.min(F.struct("pt_id", "x", "y", "z")).alias("o")).select("frame_id", "o.*").drop("pt_id").toDF("frame_id", "px", "py", "pz")
    p = G.apply(m, G.minus(G.vec(), G.vec("p")))
    return v.pts.join(F.broadcast(first), "frame_id").select("frame_id", "pt_id", *[rounded(c, n) for c, n in zip(p, "xyz", strict=True)])


@query("extract_by_index", with_views("pts", "SELECT frame_id, CAST((pt_id - pt_id % 8) / 8 AS BIGINT) % 100 AS pos, pt_id, x, y, z FROM pts WHERE pt_id % 24 < 8"))
def extract_by_index(v: Views) -> DataFrame:
    picks = v.pts.where("pt_id % 24 < 8").selectExpr("frame_id", "pt_id div 8 % 100 AS pos", "pt_id")
    return R.extract_by_index(v.pts, picks).select("frame_id", "pos", "pt_id", "x", "y", "z")


@query("filter_label", with_views("pts", "SELECT frame_id, label, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) + 0e0 AS mx FROM pts WHERE label > 0 GROUP BY frame_id, label"))
def filter_label(v: Views) -> DataFrame:
    return v.pts.where("label > 0").groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("x"), "mx"))


@query("remove_zero_label", with_views("pts", "SELECT frame_id, pt_id, label, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY pt_id) - 1 AS BIGINT) AS new_id FROM pts WHERE label <> 0"))
def remove_zero_label(v: Views) -> DataFrame:
    return R.remove_zero_label(v.pts).select("frame_id", "pt_id", "label", "new_id")


@query("finite_mask", with_views("pts", "SELECT frame_id, CAST(count(*) AS BIGINT) AS n FROM pts WHERE pt_id % 5 <> 0 AND pt_id % 7 <> 0 GROUP BY frame_id"))
def finite_mask(v: Views) -> DataFrame:
    bad = F.when(F.col("pt_id") % 5 == 0, F.lit(float("nan"))).when(F.col("pt_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("x"))
    return R.finite_mask(v.pts.withColumn("x", bad)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


@query("dist_plane", with_views("pts", "SELECT frame_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN abs(0.6e0 * x + 0.8e0 * z - 1e0) < 0.25e0 THEN 1 ELSE 0 END) AS BIGINT) AS inliers FROM pts GROUP BY frame_id"))
def dist_plane(v: Views) -> DataFrame:
    d = G.plane_distance(G.vec(), (F.lit(0.6), F.lit(0.0), F.lit(0.8)), F.lit(-1.0))
    return v.pts.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum((d < 0.25).cast("long")).alias("inliers"))


@query("select_within", with_views("pts", "SELECT frame_id, pt_id FROM pts WHERE abs(0.6e0 * x + 0.8e0 * z - 1e0) < 0.25e0"))
def select_within(v: Views) -> DataFrame:
    return v.pts.where(G.plane_distance(G.vec(), (F.lit(0.6), F.lit(0.0), F.lit(0.8)), F.lit(-1.0)) < 0.25).select("frame_id", "pt_id")


@query("in2dmbb", with_views("pts", "SELECT frame_id, pt_id FROM pts WHERE abs(x + y - 3.0137e0) <= 1 AND abs(x - y) <= 2.0071e0"))
def in2dmbb(v: Views) -> DataFrame:
    corners = [((s + d) / 2, (s - d) / 2) for s, d in ((2.0137, 2.0071), (4.0137, 2.0071), (4.0137, -2.0071), (2.0137, -2.0071))]
    return v.pts.where(G.in_rectangle((F.col("x"), F.col("y")), [(F.lit(a), F.lit(b)) for a, b in corners])).select("frame_id", "pt_id")


@query("within_box", with_views("pts", "SELECT frame_id, pt_id FROM pts WHERE abs(x + y - 3.0137e0) <= 1 AND abs(x - y) <= 2.0071e0 AND z >= 0.5e0 AND z <= 2e0"))
def within_box(v: Views) -> DataFrame:
    return in2dmbb.plan(v).join(v.pts.where("z >= 0.5 AND z <= 2").select("frame_id", "pt_id"), ["frame_id", "pt_id"])


LOCAL = "cos(yaw) * (x - cx) + sin(yaw) * (y - cy) AS lx, -sin(yaw) * (x - cx) + cos(yaw) * (y - cy) AS ly, z - cz AS lz, hx, hy, hz"
BOXED = f"SELECT frame_id, pt_id, box_id, {LOCAL} FROM pts, boxes"


def boxed(v: Views) -> DataFrame:
    """Points beside each of the few boxes (a fixed table of at most a few hundred rows)."""
    at = v.pts.crossJoin(F.broadcast(v.boxes))
    return at.withColumns({n: c for n, c in zip(("lx", "ly", "lz"), G.in_box_frame(G.vec()), strict=True)})


@query("box_inside", with_views("pts boxes", f"SELECT frame_id, box_id, CAST(sum(CASE WHEN abs(lx) < hx AND abs(ly) < hy AND abs(lz) < hz THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM ({BOXED}) GROUP BY frame_id, box_id"))
def box_inside(v: Views) -> DataFrame:
    return boxed(v).groupBy("frame_id", "box_id").agg(F.sum(G.box_inside(G.vec("l"), G.vec("h")).cast("long")).alias("inside"))


@query("box_outside", with_views("pts boxes", f"SELECT frame_id, box_id, CAST(sum(CASE WHEN abs(lx) > hx OR abs(ly) > hy OR abs(lz) > hz THEN 1 ELSE 0 END) AS BIGINT) AS outside FROM ({BOXED}) GROUP BY frame_id, box_id"))
def box_outside(v: Views) -> DataFrame:
    return boxed(v).groupBy("frame_id", "box_id").agg(F.sum(G.box_outside(G.vec("l"), G.vec("h")).cast("long")).alias("outside"))


GAP = "greatest(0e0, abs({0} - ({1})) - ({2}))"
SQ = "pow({0}, 2) + pow({1}, 2) + pow({2}, 2)"


def plate(ox: str, oy: str, oz: str, hx: str, hy: str, hz: str) -> str:
    return SQ.format(GAP.format("lx", ox, hx), GAP.format("ly", oy, hy), GAP.format("lz", oz, hz))


@query("box_dist2", with_views("pts boxes", f"SELECT frame_id, pt_id, box_id, round({plate('0', '0', '0', 'hx', 'hy', 'hz')}, 6) + 0e0 AS d2 FROM ({BOXED})"))
def box_dist2(v: Views) -> DataFrame:
    return boxed(v).select("frame_id", "pt_id", "box_id", rounded(G.box_sq_dist(G.vec("l"), G.vec("h")), "d2"))


PLATES = ", ".join([plate("hx", "0", "0", "0", "hy", "hz"), plate("-hx", "0", "0", "0", "hy", "hz"), plate("0", "hy", "0", "hx", "0", "hz"), plate("0", "-hy", "0", "hx", "0", "hz"), plate("0", "0", "hz", "hx", "hy", "0")])


@query("plate_dist2", with_views("pts boxes", f"SELECT frame_id, pt_id, box_id, round(least({PLATES}), 6) + 0e0 AS d2 FROM ({BOXED})"))
def plate_dist2(v: Views) -> DataFrame:
    return boxed(v).select("frame_id", "pt_id", "box_id", rounded(G.open_cube_sq_dist(G.vec("l"), G.vec("h")), "d2"))


@query("box_prior", with_views("pts boxes", f"SELECT frame_id, box_id, round(sum(exp(-({plate('0', '0', '0', 'hx', 'hy', 'hz')}))), 6) + 0e0 AS prior FROM ({BOXED}) GROUP BY frame_id, box_id"))
def box_prior(v: Views) -> DataFrame:
    return boxed(v).groupBy("frame_id", "box_id").agg(rounded(F.sum(F.exp(-G.box_sq_dist(G.vec("l"), G.vec("h")))), "prior"))


SCALES = [0.2, 0.6, 1.0, 1.4, 1.8]


@query("cube_scale_grid", with_views("pts boxes", f"""+ s AS (SELECT unnest([0.2e0, 0.6e0, 1e0, 1.4e0, 1.8e0]) AS s), g AS (SELECT a.s AS sx, b.s AS sy, c.s AS sz FROM s a, s b, s c)
 SELECT box_id, sx, sy, sz, round(sum(exp(-least({PLATES.replace('hx', '(hx * sx)').replace('hy', '(hy * sy)').replace('hz', '(hz * sz)')}))), 5) + 0e0 AS score FROM ({BOXED}), g GROUP BY box_id, sx, sy, sz"""))
def cube_scale_grid(v: Views) -> DataFrame:
    """Score of each scale of a cube: the sum of exp(-d^2) to its plates, over a grid of scales."""
    s = F.array(*[F.lit(x) for x in SCALES])
    grid = boxed(v)
    for n in ("sx", "sy", "sz"):
        grid = grid.withColumn(n, F.explode(s))
    half = tuple(F.col(f"h{c}") * F.col(f"s{c}") for c in "xyz")
    return grid.groupBy("box_id", "sx", "sy", "sz").agg(F.round(F.sum(F.exp(-G.open_cube_sq_dist(G.vec("l"), half))), 5).alias("score")).withColumn("score", F.col("score") + 0.0)


@query("make_incomplete", with_views("pts", """+ d AS (SELECT p.frame_id, pt_id, (x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz) AS d2 FROM pts p JOIN (SELECT frame_id, min(pt_id) AS m FROM pts GROUP BY frame_id) USING (frame_id)
 JOIN (SELECT pt_id AS m, x AS sx, y AS sy, z AS sz FROM pts) USING (m)), n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY d2, pt_id) AS place, count(*) OVER (PARTITION BY frame_id) AS n FROM d)
 SELECT frame_id, ratio, pt_id FROM n, (SELECT unnest([0.7e0, 0.9e0]) AS ratio) WHERE place <= round(ratio * n)"""))
def make_incomplete(v: Views) -> DataFrame:
    seeds = v.pts.groupBy("frame_id").agg(F.min(F.struct("pt_id", "x", "y", "z")).alias("o")).select("frame_id", F.col("o.x").alias("sx"), F.col("o.y").alias("sy"), F.col("o.z").alias("sz"))
    return R.incomplete(v.pts, seeds, [0.7, 0.9])


@query("union_scene", with_views("pts poses", f"SELECT frame_id, pt_id, label, {XYZ6} FROM (SELECT frame_id, pt_id, obj_id AS label, {FWD} FROM pts JOIN poses USING (frame_id))"))
def union_scene(v: Views) -> DataFrame:
    return R.merged_scene(v.pts, v.poses).select("frame_id", "pt_id", "label", *[rounded(F.col(c), c) for c in "xyz"])


@query("octree_grid", with_views("pts poses", f"""+ s AS (SELECT frame_id, {FWD}, r, g, b FROM pts JOIN poses USING (frame_id)),
 e AS (SELECT frame_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM s GROUP BY frame_id),
 h AS (SELECT *, greatest((hx - lx) / 2, (hy - ly) / 2, (hz - lz) / 2) AS half FROM e),
 f AS (SELECT *, 2 * half / pow(2e0, greatest(0, floor(log2(half / 0.3e0)) + 1)) AS leaf FROM h),
 k AS (SELECT s.*, CAST(floor((x - ((hx + lx) / 2 - half)) / leaf) AS BIGINT) AS kx, CAST(floor((y - ((hy + ly) / 2 - half)) / leaf) AS BIGINT) AS ky, CAST(floor((z - ((hz + lz) / 2 - half)) / leaf) AS BIGINT) AS kz FROM s JOIN f USING (frame_id))
 SELECT frame_id, kx, ky, kz, round(avg(x) + 1e-9, 6) + 0e0 AS x, round(avg(y) + 1e-9, 6) + 0e0 AS y, round(avg(z) + 1e-9, 6) + 0e0 AS z, CAST(floor(avg(r)) AS INT) AS r, CAST(floor(avg(g)) AS INT) AS g, CAST(floor(avg(b)) AS INT) AS b, CAST(count(*) AS BIGINT) AS n
 FROM k GROUP BY frame_id, kx, ky, kz"""))
def octree_grid(v: Views) -> DataFrame:
    """The flagship: merge posed scenes, then down-sample them."""
    out = S.octree_grid(R.merged_scene(v.pts, v.poses), 0.3)
    # means of few decimals lie on half digits, which engines round apart: a step beside them settles it
    return out.select("frame_id", "kx", "ky", "kz", *[rounded(F.col(c) + 1e-9, c) for c in "xyz"], "r", "g", "b", "n")


@query("voxel_agg", with_views("pts nrm", f"SELECT frame_id, kx, ky, kz, round(avg(x), 6) + 0e0 AS cx, round(avg(y), 6) + 0e0 AS cy, round(avg(z), 6) + 0e0 AS cz, round(avg(r), 6) + 0e0 AS r, round(sum(nx), 6) + 0e0 AS nx, CAST(count(*) AS BIGINT) AS size FROM (SELECT p.*, nx, {CELL} FROM pts p JOIN nrm USING (frame_id, pt_id)) GROUP BY frame_id, kx, ky, kz"))
def voxel_agg(v: Views) -> DataFrame:
    cells = S.with_cells(v.pts.join(v.nrm, ["frame_id", "pt_id"]), 0.5)
    out = S.voxel_mean(cells, ["frame_id", "kx", "ky", "kz"])
    return out.select("frame_id", "kx", "ky", "kz", *[rounded(F.col(c), c) for c in ("cx", "cy", "cz", "r", "nx")], "size")


@query("octree_leaf_bucket", with_views("pts", """+ d AS (SELECT *, CAST(range AS INT) AS depth, CAST(floor(x / (8e0 / (1 << range))) AS BIGINT) AS kx, CAST(floor(y / (8e0 / (1 << range))) AS BIGINT) AS ky, CAST(floor(z / (8e0 / (1 << range))) AS BIGINT) AS kz FROM pts, range(0, 5)),
 c AS (SELECT *, count(*) OVER (PARTITION BY frame_id, depth, kx, ky, kz) AS n FROM d)
 SELECT frame_id, pt_id, CAST(min(CASE WHEN n <= 32 OR depth = 4 THEN depth END) AS INT) AS depth FROM c GROUP BY frame_id, pt_id"""))
def octree_leaf_bucket(v: Views) -> DataFrame:
    return S.bucket_leaves(v.pts, 32, 0.0, 8.0, deepest=4).select("frame_id", "pt_id", "depth")


@query("leaf_cubes", with_views("pts", f"SELECT frame_id, kx, ky, kz, CAST(c AS INT) AS corner, (kx + (c & 1)) * 0.5e0 AS x, (ky + ((c >> 1) & 1)) * 0.5e0 AS y, (kz + ((c >> 2) & 1)) * 0.5e0 AS z FROM (SELECT DISTINCT frame_id, {CELL} FROM pts), range(0, 8) t(c)"))
def leaf_cubes(v: Views) -> DataFrame:
    return S.leaf_corners(v.pts.selectExpr("frame_id", *columns(CELL)).distinct(), 0.5)


@query("rgb2lab", with_views("pts", """+ c AS (SELECT frame_id, pt_id, (0.412453e0 * r + 0.212671e0 * g + 0.019224e0 * b) / 255 / 0.950456e0 AS x, (0.212671e0 * r + 0.715160e0 * g + 0.119193e0 * b) / 255 AS y, (0.019334e0 * r + 0.072169e0 * g + 0.950227e0 * b) / 255 / 1.088754e0 AS z FROM pts),
 f AS (SELECT *, CASE WHEN x > 0.008856e0 THEN pow(x, 1e0 / 3) ELSE 7.787e0 * x + 16e0 / 116 END AS fx, CASE WHEN y > 0.008856e0 THEN pow(y, 1e0 / 3) ELSE 7.787e0 * y + 16e0 / 116 END AS fy, CASE WHEN z > 0.008856e0 THEN pow(z, 1e0 / 3) ELSE 7.787e0 * z + 16e0 / 116 END AS fz FROM c)
 SELECT frame_id, pt_id, round(CASE WHEN y > 0.008856e0 THEN 116 * pow(y, 1e0 / 3) - 16 ELSE 903.3e0 * y END, 6) + 0e0 AS l, round(500 * (fx - fy), 6) + 0e0 AS a, round(200 * (fy - fz), 6) + 0e0 AS bb FROM f"""))
def rgb2lab(v: Views) -> DataFrame:
    lab = C.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return v.pts.select("frame_id", "pt_id", *[rounded(c, n) for c, n in zip(lab, ("l", "a", "bb"), strict=True)])


@query("lab2rgb", with_views("pts", "SELECT frame_id, pt_id, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM pts"))
def lab2rgb(v: Views) -> DataFrame:
    """Round trip: the standard conversion and back gives the colours again."""
    lab = C.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"), matrix="standard")
    back = C.lab_to_rgb(*lab)
    return v.pts.select("frame_id", "pt_id", *[F.round(c).cast("long").alias(n) for c, n in zip(back, "rgb", strict=True)])


@query("hsv2rgb", """WITH c AS (SELECT event_id AS k, CAST(event_id % 360 AS DOUBLE) AS h, CAST(event_id % 11 AS DOUBLE) / 11 AS s, CAST(event_id % 13 AS DOUBLE) / 13 AS v FROM events),
 f AS (SELECT *, CAST(floor(h / 60) AS INT) % 6 AS i, h / 60 - floor(h / 60) AS f FROM c), q AS (SELECT *, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS t FROM f)
 SELECT k, CAST(floor(255e0 * CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END) AS INT) AS r, CAST(floor(255e0 * CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END) AS INT) AS g,
 CAST(floor(255e0 * CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END) AS INT) AS b FROM q""")
def hsv2rgb(v: Views) -> DataFrame:
    k = F.col("event_id")
    rgb = C.hsv_to_rgb((k % 360).cast("double"), (k % 11).cast("double") / 11, (k % 13).cast("double") / 13)
    return v.table("events").select(k.alias("k"), *[c.alias(n) for c, n in zip(rgb, "rgb", strict=True)])


@query("value2hue", with_views("pts", "SELECT frame_id, pt_id, round(240e0 * (1 - (z - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 6) + 0e0 AS hue FROM pts JOIN (SELECT frame_id, min(z) AS lo, max(z) AS hi FROM pts GROUP BY frame_id) USING (frame_id)"))
def value2hue(v: Views) -> DataFrame:
    span = v.pts.groupBy("frame_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return v.pts.join(F.broadcast(span), "frame_id").select("frame_id", "pt_id", rounded(C.value_to_hue(F.col("z"), F.col("lo"), F.col("hi")), "hue"))


@query("label_palette", with_views("pts", "SELECT DISTINCT label FROM pts"))
def label_palette(v: Views) -> DataFrame:
    named = v.pts.select("label").distinct().withColumns(dict(zip(("r", "g", "b"), C.palette(F.col("label")), strict=True)))
    return named.where("r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255").select("label")


@query("label_compact", with_views("pts", "SELECT frame_id, pt_id, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY label) - 1 AS BIGINT) AS compact FROM pts WHERE label <> 2"))
def label_compact(v: Views) -> DataFrame:
    return R.label_compact(v.pts.where("label <> 2")).select("frame_id", "pt_id", "compact")


@query("alter_label", with_views("pts", "SELECT frame_id, pt_id, CAST(CASE label WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 9 ELSE label END AS INT) AS label FROM pts"))
def alter_label(v: Views) -> DataFrame:
    mapping = v.spark.createDataFrame([(1, 2), (2, 1), (3, 9)], "label int, to int")
    return R.alter_label(v.pts, F.broadcast(mapping)).select("frame_id", "pt_id", "label")


@query("label_iou", with_views("pts", "SELECT frame_id, CAST(sum(CASE WHEN pt_id % 3 > 0 OR label = 0 THEN 1 ELSE 0 END) AS DOUBLE) / (2 * count(*) - sum(CASE WHEN pt_id % 3 > 0 OR label = 0 THEN 1 ELSE 0 END)) AS iou FROM pts GROUP BY frame_id"))
def label_iou(v: Views) -> DataFrame:
    other = v.pts.withColumn("label", F.when(F.col("pt_id") % 3 == 0, 0).otherwise(F.col("label")))
    return R.label_iou(v.pts, other)


@query("bbox_aabb", with_views("pts", """SELECT frame_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) / 2, 6) + 0e0 AS radius,
 round(greatest((max(x) - min(x)) * (max(y) - min(y)), (max(x) - min(x)) * (max(z) - min(z)), (max(y) - min(y)) * (max(z) - min(z))), 6) + 0e0 AS face FROM pts GROUP BY frame_id"""))
def bbox_aabb(v: Views) -> DataFrame:
    return A.bounding_box(v.pts).select("frame_id", "x0", "x1", "y0", "y1", "z0", "z1", rounded(F.col("radius"), "radius"), rounded(F.col("face"), "face"))


REDUCE = "round(avg(x), 6) + 0e0 AS mean, min(x) AS lo, max(x) AS hi, round(median(x), 6) + 0e0 AS mid, round(var_samp(x), 6) + 0e0 AS var, round(stddev_samp(x), 6) + 0e0 AS dev, round(sum(x), 4) + 0e0 AS total"


@query("reductions", with_views("pts", f"SELECT frame_id, label, {REDUCE} FROM pts GROUP BY frame_id, label"))
def reductions(v: Views) -> DataFrame:
    return v.pts.groupBy("frame_id", "label").agg(
        rounded(F.avg("x"), "mean"), F.min("x").alias("lo"), F.max("x").alias("hi"), rounded(F.median("x"), "mid"), rounded(F.var_samp("x"), "var"), rounded(F.stddev_samp("x"), "dev"), (F.round(F.sum("x"), 4) + 0.0).alias("total")
    )


@query("argmax_argmin", with_views("pts", "SELECT frame_id, (SELECT q.pt_id FROM pts q WHERE q.frame_id = p.frame_id ORDER BY x DESC, pt_id LIMIT 1) AS top, (SELECT q.pt_id FROM pts q WHERE q.frame_id = p.frame_id ORDER BY x, pt_id LIMIT 1) AS low FROM (SELECT DISTINCT frame_id FROM pts) p"))
def argmax_argmin(v: Views) -> DataFrame:
    top = F.max(F.struct("x", (-F.col("pt_id")).alias("i")))
    return v.pts.groupBy("frame_id").agg((-top["i"]).alias("top"), F.min(F.struct("x", "pt_id"))["pt_id"].alias("low"))


@query("io_pose", with_views("poses", """+ q AS (SELECT a.*, b.r00 AS p00, b.r01 AS p01, b.r10 AS p10, b.r11 AS p11, b.tx AS px, b.ty AS py, b.tz AS pz FROM poses a JOIN poses b ON a.obj_id = b.obj_id AND b.frame_id = (a.frame_id + 7) % 8)
 SELECT frame_id, obj_id, round(r00 * p00 + r01 * p01, 6) + 0e0 AS d00, round(r00 * p10 + r01 * p11, 6) + 0e0 AS d01, round(r10 * p00 + r11 * p01, 6) + 0e0 AS d10,
 round(tx - ((r00 * p00 + r01 * p01) * px + (r00 * p10 + r01 * p11) * py), 6) + 0e0 AS dx, round(ty - ((r10 * p00 + r11 * p01) * px + (r10 * p10 + r11 * p11) * py), 6) + 0e0 AS dy FROM q"""))
def io_pose(v: Views) -> DataFrame:
    return R.relative_pose(v.poses).select("frame_id", "obj_id", *[rounded(F.col(c), c) for c in ("d00", "d01", "d10", "dx", "dy")])


FIT = f"""+ mv AS (SELECT p.frame_id, label, CAST(floor(pt_id / 8) AS BIGINT) AS m, {INV} FROM pts p JOIN poses q ON p.frame_id = q.frame_id AND p.label = q.obj_id WHERE label > 0),
 e AS (SELECT frame_id, (max(x) - min(x) + max(y) - min(y) + max(z) - min(z)) / 3 AS extent FROM pts GROUP BY frame_id)
 SELECT frame_id, round(avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) / any_value(extent), 6) + 0e0 AS fit FROM mv a JOIN (SELECT (frame_id + 1) % 8 AS frame_id, label, m, x, y, z FROM mv) b USING (frame_id, label, m) JOIN e USING (frame_id) GROUP BY frame_id"""


@query("fit_error", with_views("pts poses", FIT))
def fit_error(v: Views) -> DataFrame:
    poses = v.poses.withColumnsRenamed({"frame_id": "q_frame", "obj_id": "q_obj"})
    return R.fit_error(v.pts, poses, F.floor(F.col("pt_id") / 8)).select("frame_id", rounded(F.col("fit"), "fit"))


@query("get_order", with_views("pts", "SELECT frame_id, pt_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY floor(z / 0.25e0), floor(y / 0.25e0), floor(x / 0.25e0), pt_id) AS BIGINT) AS place FROM pts"))
def get_order(v: Views) -> DataFrame:
    return R.binned_order(v.pts, F.lit(0.25)).select("frame_id", "pt_id", "place")


@query("io_picked", with_views("pts", "SELECT p.frame_id, p.pt_id, CAST(coalesce(rank, 1 + n) AS BIGINT) AS rank FROM pts p LEFT JOIN (SELECT frame_id, pt_id, row_number() OVER (PARTITION BY frame_id ORDER BY pt_id) AS rank FROM pts WHERE pt_id % 40 < 8) k USING (frame_id, pt_id) JOIN (SELECT frame_id, count(*) AS n FROM pts WHERE pt_id % 40 < 8 GROUP BY frame_id) USING (frame_id)"))
def io_picked(v: Views) -> DataFrame:
    picks = v.pts.where("pt_id % 40 < 8").select("frame_id", "pt_id", F.row_number().over(Window.partitionBy("frame_id").orderBy("pt_id")).alias("rank"))
    return R.pick_rank(v.pts, picks).select("frame_id", "pt_id", "rank")


@query("annotate_point", with_views("pts", "SELECT frame_id, pt_id, CAST(CASE WHEN pt_id % 40 < 8 THEN 7 ELSE label END AS INT) AS label FROM pts"))
def annotate_point(v: Views) -> DataFrame:
    return R.overwrite_labels(v.pts, v.pts.where("pt_id % 40 < 8"), 7).select("frame_id", "pt_id", "label")


@query("annotate_patch", with_views("pts", "SELECT frame_id, pt_id, CAST(CASE WHEN label IN (SELECT label FROM pts q WHERE q.frame_id = p.frame_id AND q.pt_id < 24) THEN 7 ELSE label END AS INT) AS label FROM pts p"))
def annotate_patch(v: Views) -> DataFrame:
    return R.overwrite_labels(v.pts, v.pts.where("pt_id < 24"), 7, whole_patch=True).select("frame_id", "pt_id", "label")


@query("extract_plane", with_views("pts", "SELECT frame_id, pt_id, CAST(CASE WHEN abs(z - 1e0) < 0.2e0 THEN 0 ELSE label END AS INT) AS label FROM pts"))
def extract_plane(v: Views) -> DataFrame:
    """Plane through the picks (0, 0, 1), (1, 0, 1), (0, 1, 1): its inliers lose their label."""
    n = G.unit(G.cross(tuple(F.lit(x) for x in (1.0, 0.0, 0.0)), tuple(F.lit(x) for x in (0.0, 1.0, 0.0))))
    near = G.plane_distance(G.vec(), n, -G.dot(n, tuple(F.lit(x) for x in (0.0, 0.0, 1.0)))) < 0.2
    return v.pts.select("frame_id", "pt_id", F.when(near, 0).otherwise(F.col("label")).cast("int").alias("label"))


@query("snk_xyzrgbl", with_views("pts", "SELECT frame_id, x, y, z, r, g, b, label FROM pts"))
def snk_xyzrgbl(v: Views) -> DataFrame:
    return v.pts.select("frame_id", "x", "y", "z", "r", "g", "b", "label")


@query("snk_layout", with_views("boxes", "SELECT box_id, CAST(c AS INT) AS corner, concat('v ', CAST(CAST(round(1000 * (cx + (2 * (c & 1) - 1) * hx)) AS BIGINT) AS VARCHAR), ' ', CAST(CAST(round(1000 * (cy + (2 * ((c >> 1) & 1) - 1) * hy)) AS BIGINT) AS VARCHAR), ' ', CAST(CAST(round(1000 * (cz + (2 * ((c >> 2) & 1) - 1) * hz)) AS BIGINT) AS VARCHAR)) AS line FROM boxes, range(0, 8) t(c)"))
def snk_layout(v: Views) -> DataFrame:
    """Vertex lines of boxes in whole millimetres."""
    at = v.boxes.withColumn("corner", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    side = [2 * F.shiftright("corner", b).bitwiseAND(1) - 1 for b in range(3)]
    mm = [F.round(1000 * (F.col(f"c{c}") + s * F.col(f"h{c}"))).cast("long").cast("string") for c, s in zip("xyz", side, strict=True)]
    return at.select("box_id", "corner", F.concat_ws(" ", F.lit("v"), *mm).alias("line"))


@query("circ_shift", with_views("pts", "SELECT frame_id, pt_id, CAST((pt_id + 5) % 16 AS BIGINT) AS k FROM pts"))
def circ_shift(v: Views) -> DataFrame:
    return v.pts.select("frame_id", "pt_id", G.circular_shift(F.col("pt_id"), 5, 16).cast("long").alias("k"))


@query("weights", with_views("pts", """SELECT frame_id, pt_id, round(1 / (1 + x / 0.5e0), 6) + 0e0 AS radial, round(exp(-x * x / 2e0), 6) + 0e0 AS gauss, round(CASE WHEN abs(y - 1) < 0.7e0 THEN 0.5e0 * (1 + cos(pi() * abs(y - 1) / 0.7e0)) ELSE 0 END, 6) + 0e0 AS bump,
 round(ln(greatest(x - 1, 1e-3)), 6) + 0e0 AS low, round(exp(least(x, 1e0)), 6) + 0e0 AS high FROM pts"""))
def weights(v: Views) -> DataFrame:
    """Radial, Gaussian and raised-cosine weights, and cut logarithm and exponential."""
    x, y = F.col("x"), F.col("y")
    return v.pts.select("frame_id", "pt_id", rounded(G.radial(x, 0.5), "radial"), rounded(G.gaussian(x * x, 2.0), "gauss"), rounded(G.bump(y, F.lit(1.0), 0.7), "bump"), rounded(G.trunc_log(x - 1, 1e-3), "low"), rounded(G.trunc_exp(x, 1.0), "high"))


@query("rot2d", with_views("pts", "SELECT frame_id, pt_id, round(cos(0.3e0) * x - sin(0.3e0) * y, 6) + 0e0 AS x, round(sin(0.3e0) * x + cos(0.3e0) * y, 6) + 0e0 AS y FROM pts"))
def rot2d(v: Views) -> DataFrame:
    p = G.apply(G.yaw_matrix(F.lit(0.3)), G.vec())
    return v.pts.select("frame_id", "pt_id", rounded(p[0], "x"), rounded(p[1], "y"))


@query("index_hue", with_views("pts", "SELECT DISTINCT label, round(360e0 * label / 5, 6) + 0e0 AS hue FROM pts"))
def index_hue(v: Views) -> DataFrame:
    return v.pts.select("label").distinct().select("label", rounded(C.index_to_hue(F.col("label"), 5), "hue"))


@query("vertex_normals", """WITH f AS (SELECT box_id, CAST(c AS INT) AS corner, (2 * (c & 1) - 1) AS sx, (2 * ((c >> 1) & 1) - 1) AS sy, (2 * ((c >> 2) & 1) - 1) AS sz FROM (SELECT CAST(r_regionkey + 1 AS INT) AS box_id FROM region), range(0, 8) t(c))
 SELECT box_id, corner, round(sx / sqrt(3e0), 6) + 0e0 AS nx, round(sy / sqrt(3e0), 6) + 0e0 AS ny, round(sz / sqrt(3e0), 6) + 0e0 AS nz FROM f""")
def vertex_normals(v: Views) -> DataFrame:
    """Vertices of boxes take the normalised mean of their faces' normals: faces explode to vertices, then one aggregation."""
    corner = F.explode(F.array(*[F.lit(i) for i in range(8)]))
    faces = []
    for axis in range(3):
        for sign in (-1.0, 1.0):
            n = [F.lit(sign if a == axis else 0.0).alias("n" + "xyz"[a]) for a in range(3)]
            faces.append(F.struct(F.array(*[F.lit(c) for c in range(8) if (2 * (c >> axis & 1) - 1) == sign]).alias("vids"), *n))
    at = v.boxes.select("box_id", F.explode(F.array(*faces)).alias("f")).select("box_id", F.explode("f.vids").alias("corner"), "f.nx", "f.ny", "f.nz")
    s = at.groupBy("box_id", "corner").agg(*[F.sum("n" + c).alias("n" + c) for c in "xyz"])
    return s.select("box_id", "corner", *[rounded(c, "n" + a) for c, a in zip(G.unit(G.vec("n")), "xyz", strict=True)])


@query("shuffle")
def shuffle(v: Views) -> DataFrame:
    """A seeded order of each frame's points by hash: no sort over all rows."""
    w = Window.partitionBy("frame_id").orderBy(F.xxhash64("pt_id", F.lit(11)), "pt_id")
    return v.pts.select("frame_id", "pt_id", F.row_number().over(w).cast("long").alias("place"))


@query("src_mesh", with_views("pts", "SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY pt_id) - 1 AS BIGINT) AS pt_id, x, y, z, r, g, b FROM pts"))
def src_mesh(v: Views) -> DataFrame:
    """Frames written as binary PLY files by the executors, and read again."""
    import uuid

    from cloudloom.sources import meshes
    from cloudloom.sources.shared import shared_folder

    folder = f"{shared_folder(v.spark)}/mesh-{uuid.uuid4().hex}"
    meshes.write_frames(v.pts.select("frame_id", "pt_id", "x", "y", "z", "r", "g", "b"), folder, "ply_binary").count()
    return meshes.read_any_store(v.spark, folder, "*.ply").select("frame_id", "pt_id", "x", "y", "z", "r", "g", "b")


@query("src_ascii", with_views("pts", "SELECT round(sum(x), 3) + 0e0 AS x, round(sum(y), 3) + 0e0 AS y, round(sum(z), 3) + 0e0 AS z, CAST(count(*) AS BIGINT) AS n FROM pts"))
def src_ascii(v: Views) -> DataFrame:
    """Rows of numbers as text, written and read again."""
    import uuid

    from cloudloom.sources import meshes
    from cloudloom.sources.shared import shared_folder

    path = f"{shared_folder(v.spark)}/ascii-{uuid.uuid4().hex}"
    v.pts.select(F.concat_ws(" ", "x", "y", "z").alias("value")).write.text(path)
    return meshes.read_ascii(v.spark, path).agg(*[(F.round(F.sum(c), 3) + 0.0).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))
