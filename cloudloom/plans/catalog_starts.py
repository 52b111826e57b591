"""Queries on starts of the joint registration, boxes fitted in it, discriminant axes and planes from states that merge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import cubes as Q
from cloudloom.operators import discriminant as D
from cloudloom.operators import planes as S
from cloudloom.operators import register as G
from cloudloom.operators import starts as B
from cloudloom.plans.catalog_models import patch_feature
from cloudloom.plans.catalog_spatial import spectral_affinity
from cloudloom.plans.registry import query, rounded
from cloudloom.sources.shared import written
from cloudloom.sources.views import Views, with_views

K, ROUNDS = 60, 2
NEAR = "pow(f1 - g1, 2) + pow(f2 - g2, 2)"
LLOYD = ", ".join(
    f"""n{i} AS (SELECT frame_id, label, f1, f2, arg_min(obj, {NEAR}) AS obj FROM ft, c{i} GROUP BY ALL),
 c{i + 1} AS (SELECT c.obj, coalesce(avg(f1), any_value(g1)) AS g1, coalesce(avg(f2), any_value(g2)) AS g2 FROM c{i} c LEFT JOIN n{i} USING (obj) GROUP BY c.obj)"""
    for i in range(ROUNDS)
)
ALPHA = f"""+ ft AS (SELECT frame_id, label, count(*) AS n, avg(r) / 255 AS f1, avg(g) / 255 AS f2 FROM pts WHERE label > 0 GROUP BY ALL),
 most AS (SELECT frame_id FROM ft GROUP BY frame_id ORDER BY count(*) DESC, frame_id LIMIT 1),
 c0 AS (SELECT row_number() OVER (ORDER BY label) AS obj, f1 AS g1, f2 AS g2 FROM ft JOIN most USING (frame_id)), {LLOYD},
 b AS (SELECT frame_id, label, n, obj, exp(-sqrt({NEAR})) AS b FROM ft, c{ROUNDS}),
 sh AS (SELECT obj, sum(b * n) / (SELECT sum(b * n) FROM b) AS share FROM b GROUP BY obj), s0 AS (SELECT obj, share, greatest(9, floor({K} * share)) AS size FROM sh),
 s AS (SELECT obj, size + CASE WHEN share = (SELECT max(share) FROM sh) THEN {K} - (SELECT sum(size) FROM s0) ELSE 0 END AS size FROM s0),
 h AS (SELECT frame_id, label, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z, var_pop(x) + var_pop(y) + var_pop(z) AS var FROM pts GROUP BY ALL),
 e AS (SELECT h.*, s.obj, size, CASE WHEN h.label > 0 THEN b ELSE 1e0 / {K} END AS a FROM h CROSS JOIN s LEFT JOIN b ON h.frame_id = b.frame_id AND h.label = b.label AND s.obj = b.obj),
 w AS (SELECT * EXCLUDE (a), a / (sum(a * size) OVER (PARTITION BY frame_id, label) + 1e-5) AS a FROM e),
 d AS (SELECT w.frame_id, obj, median(a) AS mid FROM w JOIN pts USING (frame_id, label) GROUP BY ALL),
 t AS (SELECT * EXCLUDE (a), CASE WHEN a < mid THEN 0e0 ELSE a END AS a FROM w JOIN d USING (frame_id, obj)),
 m AS (SELECT frame_id, obj, sum(a * n) AS mass, sum(a * n * x) / sum(a * n) AS mx, sum(a * n * y) / sum(a * n) AS my, sum(a * n * z) / sum(a * n) AS mz FROM t GROUP BY ALL),
 o AS (SELECT frame_id, obj, mass, mx, my, mz, sum(a * n * (var + pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) AS ss FROM t JOIN m USING (frame_id, obj) GROUP BY ALL)
 SELECT frame_id, CAST(obj AS INT) AS obj, round(mass, 6) + 0e0 AS mass, round(mx, 6) + 0e0 AS mx, round(my, 6) + 0e0 AS my, round(mz, 6) + 0e0 AS mz, round(ss, 6) + 0e0 AS ss FROM o"""


@query("jrcs_alpha", with_views("pts", ALPHA))
def jrcs_alpha(v: Views) -> DataFrame:
    """Mass, place and spread of each object in each frame under soft responsibilities from the patches' colours, after two rounds of k-means."""
    colour = lambda p: p.groupBy("frame_id", "label").agg(F.array(F.avg("r") / 255, F.avg("g") / 255).alias("feature"))
    start = B.by_features(colour, 2, ROUNDS)(v.pts)
    got = B.moments(B.blocks(start, B.columns_of(start.shares, K), 1e-5))
    return got.select("frame_id", "obj", *[rounded(F.col(c), c) for c in ("mass", "mx", "my", "mz", "ss")])


@query("jrcs_init")
def jrcs_init(v: Views) -> DataFrame:
    """The object of each point after four rounds of registration that start from soft responsibilities by all patch features."""
    points = written(v.pts.select("frame_id", "pt_id", "x", "y", "z", "r", "g", "b", "label"))
    var = G.VARIANTS["jrcs_base"]
    start = B.by_features(lambda p: patch_feature(v, p))(points)
    model = G.fit(points, B.initial(start, K, var), var, 4)
    return G.labels(points, model, var)


@query("jrcs_init_sihks")
def jrcs_init_sihks(v: Views) -> DataFrame:
    """What each patch is believed to be by the heat kernel words of its supervoxels."""
    nodes = written(v.supervoxels)
    votes = v.svpts.groupBy("frame_id", "sv", "label").agg(F.count(F.lit(1)).alias("n"))
    owners = votes.groupBy("frame_id", "sv").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m")).select("frame_id", "sv", (-F.col("m.l")).alias("label"))
    return B.by_heat(nodes, written(spectral_affinity(v)), owners)(v.pts).beliefs


SHARED = """+ o AS (SELECT box_id AS obj, x, y, z, cos(yaw) * (x - cx) + sin(yaw) * (y - cy) AS u0, cos(yaw) * (y - cy) - sin(yaw) * (x - cx) AS u1, z - cz AS u2, hx AS h0, hy AS h1, hz AS h2, frame_id, pt_id FROM pts, boxes),
 """ + "{}" + """ e AS (SELECT *, exp(-d2) * pow(2e0, 1.5e0) + 2.220446049250313e-16 AS e FROM d), q AS (SELECT *, e / (1.00001e0 * sum(e) OVER (PARTITION BY frame_id, pt_id)) AS a FROM e)"""
FACES = "least(pow(abs(u0) - {0}, 2) + pow(greatest(abs(u1) - {1}, 0), 2) + pow(greatest(u2b - {2}, 0), 2), pow(abs(u1) - {1}, 2) + pow(greatest(abs(u0) - {0}, 0), 2) + pow(greatest(u2b - {2}, 0), 2), pow(u2 - {2}, 2) + pow(greatest(abs(u0) - {0}, 0), 2) + pow(greatest(abs(u1) - {1}, 0), 2))".replace("u2b", "abs(u2)")
SCORES = SHARED.format(f"d AS (SELECT *, {FACES.format('h0', 'h1', 'h2')} AS d2 FROM o),") + f""",
 g AS (SELECT i::INT AS i, j::INT AS j, k::INT AS k, 0.5e0 + i / 10e0 AS si, 0.5e0 + j / 10e0 AS sj, 0.5e0 + k / 10e0 AS sk FROM range(0, 11) a(i), range(0, 11) b(j), range(0, 11) c(k))
 SELECT obj, i, j, k, round(sum(a * exp(-({FACES.format('h0 * si', 'h1 * sj', 'h2 * sk')}))), 5) + 0e0 AS score FROM q, g GROUP BY ALL"""


@query("cube_scale_scores", with_views("pts boxes", SCORES))
def cube_scale_scores(v: Views) -> DataFrame:
    """How well each box fits the points of all frames with its sides scaled by each combination of eleven steps."""
    boxes = v.boxes.orderBy("box_id").collect()  # five
    half = np.array([[r.hx, r.hy, r.hz] for r in boxes])
    frames = [r.frame_id for r in v.pts.select("frame_id").distinct().collect()]
    turn = lambda a: np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    model = Q.Boxes(half, np.full(len(boxes), 2.0), np.full(len(boxes), 1 / len(boxes)), {(f, r.box_id): (turn(r.yaw), np.array([r.cx, r.cy, r.cz])) for f in frames for r in boxes})
    shares = Q.shared_out(v.pts, model, 1e-5).select(F.explode("s").alias("o")).select("o.*")
    return Q.scale_scores(shares, half).select("obj", "i", "j", "k", (F.round("score", 5) + 0.0).alias("score"))


@query("jrcs_cube_fit")
def jrcs_cube_fit(v: Views) -> DataFrame:
    """Poses, half sides and weights of the boxes of four objects after three rounds from a start by the patches' colours."""
    points = written(v.pts.select("frame_id", "pt_id", "x", "y", "z", "r", "g", "b", "label"))
    colour = lambda p: p.groupBy("frame_id", "label").agg(F.array(*[F.avg(c) / 255 for c in "rgb"]).alias("feature"))
    return Q.box_table(v.spark, Q.fit(points, Q.initial(B.by_features(colour, 3)(points)), 3))


# sums have four decimals, roots and their ratios no end: neither lies on a half digit, so engines round them alike
PLANE = "SELECT frame_id, label, CAST(count(*) AS BIGINT) AS n, " + ", ".join([
    *[f"round(sum({c}), 4) + 0e0 AS sum_{c}, round(stddev_pop({c}), 6) + 0e0 AS dev_{c}" for c in "xyz"],
    *[f"round(corr({p[0]}, {p[1]}), 6) + 0e0 AS cor_{p}" for p in ("xy", "xz", "yz")],
]) + " FROM pts GROUP BY frame_id, label"


@query("pca_plane_states", with_views("pts", PLANE))
def pca_plane_states(v: Views) -> DataFrame:
    """Sums, deviations and correlations of each patch, from the merged states of its points by hour."""
    state = S.merged(S.states(v.pts, ["frame_id", "label", "z"]), ["frame_id", "label"])
    out = [c for a in "xyz" for c in ((F.round(F.col(f"m{a}") * F.col("n"), 4) + 0.0).alias(f"sum_{a}"), rounded(F.sqrt(F.col(f"s{a}{a}") / F.col("n")), f"dev_{a}"))]
    out += [rounded(F.col(f"s{p}") / F.sqrt(F.col(f"s{p[0]}{p[0]}") * F.col(f"s{p[1]}{p[1]}")), f"cor_{p}") for p in ("xy", "xz", "yz")]
    return state.select("frame_id", "label", "n", *out)


@query("pca_plane")
def pca_plane(v: Views) -> DataFrame:
    """The plane of each patch and its points' mean squared distance from it."""
    return S.planes(S.merged(S.states(v.pts, ["frame_id", "label", "z"]), ["frame_id", "label"]), ["frame_id", "label"])


@query("lda_gsvd")
def lda_gsvd(v: Views) -> DataFrame:
    """Patch features on the two axes that part the labels best; patches may be fewer than a feature's numbers."""
    rows = written(patch_feature(v))
    first = rows.select(F.size("feature").alias("n")).first()
    axes = D.discriminant_axes(rows, "feature", first.n if first else 0, 2)
    return rows.select("frame_id", "label", *[B.scalar(F.col("feature"), axes[:, k]).alias(f"p{k}") for k in range(axes.shape[1])])
