"""Queries on iterative and dense algorithms: SQL can't express them, tests hold them against invariants and brute force."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import aggregates as A
from cloudloom.operators import drift
from cloudloom.operators import features as E
from cloudloom.operators import linalg as L
from cloudloom.operators import models as M
from cloudloom.operators import register as G
from cloudloom.operators import segment as Z
from cloudloom.operators import spatial as S
from cloudloom.operators import tree
from cloudloom.plans.catalog_models import patch_feature, sv_costs, sv_weights
from cloudloom.plans.catalog_spatial import spectral_affinity, with_ends
from cloudloom.plans.registry import query, rounded
from cloudloom.sources import meshes
from cloudloom.sources.shared import shared_folder, written
from cloudloom.sources.views import Views, with_views


def near(v: Views, k: int = 10) -> DataFrame:
    return S.knn_join(v.pts, v.pts, k, 0.5)


@query("point_normals")
def point_normals(v: Views) -> DataFrame:
    return E.point_normals(v.pts, near(v))


@query("fit_plane")
def fit_plane(v: Views) -> DataFrame:
    """Plane of each patch by its scatter."""
    s = v.pts.where("label > 0").groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias("m" + c) for c in "xyz"], *[(F.covar_pop(a, b) * F.count(F.lit(1))).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])
    e = s.withColumn("e", E.least_axis("xx", "xy", "xz", "yy", "yz", "zz"))
    d = -(F.col("e")[0] * F.col("mx") + F.col("e")[1] * F.col("my") + F.col("e")[2] * F.col("mz"))
    return e.select("frame_id", "label", *[F.col("e")[i].alias(n) for i, n in enumerate(("a", "b", "c"))], d.alias("d"), F.col("e")[3].alias("curvature"))


@query("agd")
def agd(v: Views) -> DataFrame:
    return E.average_geodesic(v.supervoxels, v.sv_edges)


@query("geodesic_relaxed", with_views("supervoxels sv_edges", """+ e AS (SELECT x.frame_id, x.a, x.b, sqrt(pow(p.cx - q.cx, 2) + pow(p.cy - q.cy, 2) + pow(p.cz - q.cz, 2)) AS d FROM sv_edges x JOIN supervoxels p ON x.frame_id = p.frame_id AND x.a = p.sv JOIN supervoxels q ON x.frame_id = q.frame_id AND x.b = q.sv),
 s AS (SELECT frame_id, a, b, d FROM e UNION ALL SELECT frame_id, b, a, d FROM e), z AS (SELECT frame_id, sv, 0e0 AS d FROM supervoxels WHERE sv = 1), o AS (SELECT frame_id, sv, min(d) AS d FROM (SELECT * FROM z UNION ALL SELECT s.frame_id, s.b, z.d + s.d FROM z JOIN s ON z.frame_id = s.frame_id AND z.sv = s.a) GROUP BY ALL), t AS (SELECT frame_id, sv, min(d) AS d FROM (SELECT * FROM o UNION ALL SELECT s.frame_id, s.b, o.d + s.d FROM o JOIN s ON o.frame_id = s.frame_id AND o.sv = s.a) GROUP BY ALL)
 SELECT frame_id, CAST(sv AS BIGINT) AS sv, round(d, 6) + 0e0 AS d FROM t"""))
def geodesic_relaxed(v: Views) -> DataFrame:
    """Two relaxations of path lengths from supervoxel 1 of each frame, as joins."""
    e = with_ends(v.sv_edges, v.supervoxels, ["cx", "cy", "cz"])
    d = F.sqrt(sum((F.pow(F.col(f"c{c}_a") - F.col(f"c{c}_b"), 2) for c in "yz"), F.pow(F.col("cx_a") - F.col("cx_b"), 2)))
    start = v.supervoxels.where("sv = 1").select("frame_id", F.col("sv").alias("src"))
    return E.relaxed_paths(e.select("frame_id", "a", "b", d.alias("d")), start, 2).select("frame_id", "sv", rounded(F.col("d"), "d"))


@query("gdcoord")
def gdcoord(v: Views) -> DataFrame:
    return E.geodesic_coordinates(v.supervoxels, v.sv_edges)


@query("hks")
def hks(v: Views) -> DataFrame:
    return E.heat_kernel(v.supervoxels, spectral_affinity(v))


def embeddings(v: Views) -> DataFrame:
    return v.table("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("f"))


@query("kmeans")
def kmeans(v: Views) -> DataFrame:
    rows = embeddings(v)
    centres = E.code_words(rows, "f", 10)
    return rows.select("vec_id", E.nearest_word(F.col("f"), centres).alias("word"))


@query("bof")
def bof(v: Views) -> DataFrame:
    """Codebook, assignment and tf-idf of each frame's and label's words."""
    from cloudloom.operators.aggregates import tf_idf

    rows = embeddings(v).select(F.expr("CAST(vec_id % 5 AS INT)").alias("frame_id"), "label", "f")
    words = rows.withColumn("word", E.nearest_word(F.col("f"), E.code_words(rows, "f", 12)))
    return tf_idf(words.select("frame_id", "label", "word"))


@query("gmm_diag")
def gmm_diag(v: Views) -> DataFrame:
    """Mixture of two components over each frame's colours."""

    def run(pdf):
        m = L.gmm(pdf[["r", "g", "b"]].to_numpy(float) / 255, 3)
        import pandas as pd

        return pd.DataFrame({"frame_id": pdf.frame_id, "pt_id": pdf.pt_id, "component": m["p"].argmax(1).astype(np.int32)})

    return v.pts.groupBy("frame_id").applyInPandas(run, "frame_id int, pt_id long, component int")


@query("gmm_grow")
def gmm_grow(v: Views) -> DataFrame:
    def run(pdf):
        import pandas as pd

        m = L.grown_gmm(pdf[["x", "y", "z"]].to_numpy(float), 5)
        return pd.DataFrame({"frame_id": pdf.frame_id.iloc[:1], "components": [len(m["weight"])], "avg_log_p": [m["avg_log_p"]]})

    return v.pts.groupBy("frame_id").applyInPandas(run, "frame_id int, components int, avg_log_p double")


def projected(rows: DataFrame, base: np.ndarray, centre: np.ndarray | None = None) -> list:
    """Columns p0, p1, … of the array column f, less ``centre``, on the columns of ``base``."""
    f = F.col("f") if centre is None else F.zip_with("f", F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: a - b)
    dot = lambda w: F.aggregate(F.zip_with(f, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return [dot(base[:, k]).alias(f"p{k}") for k in range(base.shape[1])]


@query("pca")
def pca(v: Views) -> DataFrame:
    """Projection of the embeddings on their first two axes: the scatter in Spark, the base on the driver."""
    rows = embeddings(v).withColumn("one", F.lit(1))
    base = np.linalg.eigh(M.scatter_matrix(A.vector_scatter(rows, "f", 64, "one")[1], 64))[1][:, ::-1][:, :2]
    mean = rows.agg(*[F.avg(F.col("f")[i]) for i in range(64)]).first()
    return rows.select("vec_id", *projected(rows, base, np.array(mean)))


@query("lda")
def lda(v: Views) -> DataFrame:
    rows = embeddings(v)
    between, within = (M.scatter_matrix(df, 64) for df in A.vector_scatter(rows, "f", 64))
    return rows.select("vec_id", *projected(rows, L.lda(between, within, 2)))


def segments(v: Views, method: str, kind: str = "G") -> DataFrame:
    return E.spectral_cut(v.supervoxels, spectral_affinity(v), kind=kind, method=method)


@query("ncut")
def ncut(v: Views) -> DataFrame:
    return segments(v, "bisection", "N")


@query("gps_kmeans")
def gps_kmeans(v: Views) -> DataFrame:
    return segments(v, "kmeans")


@query("mincut_gmm")
def mincut_gmm(v: Views) -> DataFrame:
    return segments(v, "gmm", "M")


@query("spectral_base")
def spectral_base(v: Views) -> DataFrame:
    return E.spectral_base(v.supervoxels, spectral_affinity(v), 8)


@query("peac")
def peac(v: Views) -> DataFrame:
    """Consensus of the three runs over all parts: one sequential descent, so one task holds the (narrow) ensemble."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.pivot(index="sv", columns="run", values="cluster").sort_index()
        x, n = t.to_numpy(), len(t)
        i = np.arange(n - 1)
        edges = np.concatenate([np.stack([i, i + 1], 1), np.stack([i[:-1], i[:-1] + 2], 1)])
        share = (x[edges[:, 0]] == x[edges[:, 1]]).mean(1)
        return pd.DataFrame({"sv": t.index, "label": L.peac(n, edges, share, 6).astype(np.int32)})

    return v.ensemble.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(run, "sv long, label int")


@query("rpeac")
def rpeac(v: Views) -> DataFrame:
    """Consensus on atoms: nodes of one signature are one."""
    import pandas as pd

    from cloudloom.operators.relational import atomic

    atoms = atomic(v.ensemble)
    names = atoms.select("atom", "signature").distinct().orderBy("atom").toPandas()  # signatures: at most the product of the runs' numbers of clusters
    x = np.array([[int(c) for c in s.split("-")] for s in names.signature])
    a, b = np.nonzero(np.triu(np.ones((len(x), len(x)), bool), 1))
    share = (x[a] == x[b]).mean(1)
    keep = share > 0
    label = L.peac(len(x), np.stack([a, b], 1)[keep], share[keep], 6)
    table = v.spark.createDataFrame(pd.DataFrame({"atom": names.atom, "label": label.astype(int)}))
    return atoms.join(F.broadcast(table), "atom").select("sv", "label")


@query("robust_region")
def robust_region(v: Views) -> DataFrame:
    return E.robust_regions(v.supervoxels, spectral_affinity(v))


@query("region_grow")
def region_grow(v: Views) -> DataFrame:
    return Z.region_grow(v.pts.join(v.nrm, ["frame_id", "pt_id"]), near(v, 8), 0.9, 3, 100_000)


@query("region_grow_rgb")
def region_grow_rgb(v: Views) -> DataFrame:
    return Z.region_grow_rgb(v.pts, near(v, 6), 40.0, 25.0, 3)


@query("segment_from_point")
def segment_from_point(v: Views) -> DataFrame:
    grown = region_grow.plan(v)
    return grown.join(grown.where("pt_id < 8 AND label > 0").select("frame_id", "label"), ["frame_id", "label"], "left_semi").select("frame_id", "pt_id")


@query("ransac_plane")
def ransac_plane(v: Views) -> DataFrame:
    return Z.planes(v.pts)


@query("ransac_perpendicular")
def ransac_perpendicular(v: Views) -> DataFrame:
    return Z.planes(v.pts, axis=(0.0, 0.0, 1.0), slack=0.2)


@query("extract_planes")
def extract_planes(v: Views) -> DataFrame:
    return Z.extract_planes(v.pts, 3)


@query("hierarchicalization")
def hierarchicalization(v: Views) -> DataFrame:
    """The deepest node of each point in its frame's tree of planes and objects; heights are spread so that hours are floors."""
    p = written(v.pts.select("frame_id", "pt_id", "x", "y", (F.col("z") * 4).alias("z")))
    near = written(S.knn_join(p, p, 8, 0.5).select("frame_id", "pt_id", "nb"))
    normals = E.point_normals(p, near).select("frame_id", "pt_id", "nx", "ny", "nz")
    labels, nodes = tree.region_tree(p.join(normals, ["frame_id", "pt_id"], "left"), near)
    return labels.join(nodes.select("frame_id", "node", "parent", "is_obj", "depth"), ["frame_id", "node"], "left").select("frame_id", "pt_id", "node", "parent", "is_obj", "depth")


def cut(method: str):
    def plan(v: Views) -> DataFrame:
        return Z.graph_cut(sv_costs(v), sv_weights(v), method)

    return plan


for _name, _method in (("graph_cut_expansion", "expansion"), ("graph_cut_swap", "swap"), ("mrf_maxprod_bp", "max_product"), ("mrf_icm", "icm"), ("mrf_bp_s", "bp_s"), ("mrf_trw_s", "trw_s")):
    query(_name)(cut(_method))


@query("global_graph_cut")
def global_graph_cut(v: Views) -> DataFrame:
    """Supervoxel labels of least energy, written back to the points."""
    return v.svpts.select("frame_id", "pt_id", "sv").join(Z.graph_cut(sv_costs(v), sv_weights(v)), ["frame_id", "sv"]).select("frame_id", "pt_id", "label")


@query("in_patch_graph_cut")
def in_patch_graph_cut(v: Views) -> DataFrame:
    """Binary cuts inside each half of the space: score against its median."""
    score = v.supervoxels.select("frame_id", "sv", F.when(F.col("cx") > 2, 1).otherwise(0).alias("patch"), F.col("cz").alias("s"))
    mid = score.groupBy("frame_id", "patch").agg(F.median("s").alias("m"))
    costs = score.join(mid, ["frame_id", "patch"]).withColumn("label", F.explode(F.array(F.lit(0), F.lit(1)))).select("frame_id", "patch", "sv", "label", F.when(F.col("label") == 1, F.greatest(F.lit(0.0), F.col("m") - F.col("s"))).otherwise(F.greatest(F.lit(0.0), F.col("s") - F.col("m"))).alias("cost"))
    side = score.select("frame_id", "patch", F.col("sv").alias("a"))
    edges = sv_weights(v).join(side, ["frame_id", "a"]).join(side.select("frame_id", "patch", F.col("a").alias("b")), ["frame_id", "patch", "b"])
    return Z.graph_cut(costs, edges, by=("frame_id", "patch"))


@query("dense_crf_3d")
def dense_crf_3d(v: Views) -> DataFrame:
    labels = [f"u{i}" for i in range(5)]
    costs = v.pts.select("frame_id", "pt_id", "x", "y", "z", *[F.when(F.col("label") == i, 0.5).otherwise(1.5 + 0.1 * i).alias(u) for i, u in enumerate(labels)])
    return Z.dense_crf_near(costs, labels, 0.6, 0.04, 2.0, 3)


@query("crf2d")
def crf2d(v: Views) -> DataFrame:
    """Two labels of pixels by brightness, smoothed by nearness and colour."""
    step = F.explode(F.array(*[F.lit(i) for i in range(-3, 4)]))
    pix = v.pix.select(F.lit(0).alias("frame_id"), (F.col("prow") * 50 + F.col("pcol")).cast("long").alias("pt_id"), "prow", "pcol", "r", "g", "b")
    u = pix.withColumn("l", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("u", F.when((F.col("r") > 127) == (F.col("l") == 1), 0.3).otherwise(1.2)).select("frame_id", "pt_id", "l", "u")
    a = pix.withColumn("dr", step).withColumn("dc", step).where("dr <> 0 OR dc <> 0").withColumns({"nr": F.col("prow") + F.col("dr"), "nc": F.col("pcol") + F.col("dc")})
    b = pix.select("frame_id", F.col("pt_id").alias("nb"), F.col("prow").alias("nr"), F.col("pcol").alias("nc"), *[F.col(c).alias("n_" + c) for c in "rgb"])
    col = sum((F.pow(F.col(c) - F.col("n_" + c), 2) for c in "gb"), F.pow(F.col("r") - F.col("n_r"), 2))
    space = F.pow("dr", F.lit(2)) + F.pow("dc", F.lit(2))
    kernel = a.join(b, ["frame_id", "nr", "nc"]).select("frame_id", "pt_id", "nb", (F.exp(-space / 18.0) * 0.1 + F.exp(-space / 12800.0 - col / 338.0) * 0.3).alias("k"))
    return Z.dense_crf(u, kernel, 1.0, 5)


@query("cpd_rigid")
def cpd_rigid(v: Views) -> DataFrame:
    """Registers a turned copy of each frame back: the pose and its error."""
    turned = v.pts.withColumns({"x": 0.95 * F.col("x") - 0.3122498999 * F.col("y") + 0.2, "y": 0.3122498999 * F.col("x") + 0.95 * F.col("y")})
    rows = [(f, float(g["R"][0, 0]), float(g["R"][1, 0]), float(g["t"][0]), g["s"], float(g["sigma2"])) for f, g in drift.cpd_rigid(v.pts, turned).items()]
    return v.spark.createDataFrame(rows, "frame_id int, r00 double, r10 double, tx double, s double, sigma2 double")


def em(name: str, k: int = 12, objects: int = 2, rounds: int = 4):
    def plan(v: Views) -> DataFrame:
        var = G.VARIANTS[name]
        pts = v.pts.join(v.nrm, ["frame_id", "pt_id"]).select("frame_id", "pt_id", "x", "y", "z", "nx", "ny", "nz", *[(F.col(c) / 255).alias(c) for c in "rgb"], "label", *[F.exp(-F.pow(F.col("z") - i, 2)).alias(f"b{i}") for i in range(1, objects + 1)])
        pts = written(pts.repartition(2 * v.spark.sparkContext.defaultParallelism, "pt_id"))  # read in every round, by all cores
        model = G.fit(pts, G.initial(pts, k, objects), var, rounds)
        return G.labels(pts, model, var)

    return plan


for _name in G.VARIANTS:
    query(_name)(em(_name, objects=1 if _name.startswith("jrmpc") else 2))


@query("global_align")
def global_align(v: Views) -> DataFrame:
    return G.global_align(v.pts, 12, 3, 0.8)[0]


@query("jrcs_init_bernoulli")
def jrcs_init_bernoulli(v: Views) -> DataFrame:
    """Segments matched to two objects' shares by size."""
    sizes = v.pts.where("label > 0").groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"))

    def run(pdf):
        import pandas as pd

        return pd.DataFrame({"frame_id": pdf.frame_id, "label": pdf.label, "obj": np.array(M.size_match(pdf.n.tolist(), [0.6, 0.4]), np.int32) + 1})

    return sizes.groupBy("frame_id").applyInPandas(run, "frame_id int, label int, obj int")


@query("unify_label")
def unify_label(v: Views) -> DataFrame:
    return M.unify_labels(patch_feature(v))


@query("looper")
def looper(v: Views) -> DataFrame:
    """Unify and refine patch labels twice, each step a table in the shared folder."""
    pts = v.pts.select("frame_id", "pt_id", "x", "y", "z", "r", "g", "b", "label")
    return M.loop(pts, lambda p: p, lambda p: patch_feature(v, p), lambda p: S.nearest_label(p, 0.4), 2, f"{shared_folder(v.spark)}/loop-{uuid.uuid4().hex}").select("frame_id", "pt_id", "label")


@query("lbfgs")
def lbfgs(v: Views) -> DataFrame:
    """Least squares by L-BFGS, value and gradient summed by Spark: price of a part from its size."""
    rows = v.table("part").select((F.col("p_size") / 50).alias("s"), (F.col("p_retailprice") / 1000).alias("y")).persist()

    def f(w):
        e = F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("s") - F.col("y")
        r = rows.agg(F.avg(e * e), F.avg(2 * e), F.avg(2 * e * F.col("s"))).first()
        return r[0], np.array([r[1], r[2]])

    w, value = L.lbfgs(f, np.zeros(2), 20)
    return v.spark.createDataFrame([(float(w[0]), float(w[1]), float(value))], "intercept double, slope double, loss double")


@query("io_labels", with_views("pts", "SELECT frame_id, pt_id, label FROM pts"))
def io_labels(v: Views) -> DataFrame:
    """Labels saved by frame and loaded again."""
    path = f"{shared_folder(v.spark)}/labels-{uuid.uuid4().hex}"
    meshes.save_labels(v.pts, path)
    return meshes.load_labels(v.pts, path).select("frame_id", "pt_id", "label")


@query("io_supervoxel", with_views("supervoxels", "SELECT frame_id, sv, size FROM supervoxels"))
def io_supervoxel(v: Views) -> DataFrame:
    path = f"{shared_folder(v.spark)}/graph-{uuid.uuid4().hex}"
    meshes.save_graph(v.supervoxels, v.sv_edges, v.svpts.select("frame_id", "pt_id", "sv"), path)
    return meshes.load_graph(v.spark, path)[0].select("frame_id", "sv", "size")


@query("src_image_labels", with_views("pix", "SELECT prow, pcol, CAST(CASE WHEN prow % 3 = 0 THEN -1 ELSE dense_rank() OVER (ORDER BY CASE WHEN prow % 3 = 0 THEN 99 ELSE prow % 3 END) - 1 END AS INT) AS label FROM pix"))
def src_image_labels(v: Views) -> DataFrame:
    coded = v.pix.select("prow", "pcol", (F.col("prow") % 3 * 40).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return meshes.read_annotation(coded)


@query("spectrum")
def spectrum(v: Views) -> DataFrame:
    """A function on the supervoxels (their height), rebuilt from the strongest coefficients of its spectrum, and what is left."""
    f = v.supervoxels.select("frame_id", "sv", F.col("cz").alias("f"))
    base = E.spectral_base(v.supervoxels, spectral_affinity(v), 12, "M").select("frame_id", "sv", F.posexplode("base").alias("i", "e"))
    from cloudloom.operators.aggregates import top_k

    c = base.join(f, ["frame_id", "sv"]).groupBy("frame_id", "i").agg(F.sum(F.col("e") * F.col("f")).alias("c"))
    kept = top_k(c, 5, ["frame_id"], [F.desc(F.abs("c")), "i"]).select("frame_id", "i", "c")
    rebuilt = base.join(F.broadcast(kept), ["frame_id", "i"]).groupBy("frame_id", "sv").agg(F.sum(F.col("c") * F.col("e")).alias("g"))
    return rebuilt.join(f, ["frame_id", "sv"]).select("frame_id", "sv", "f", "g", (F.col("f") - F.col("g")).alias("residual"))


@query("update_object")
def update_object(v: Views) -> DataFrame:
    """Each label's points of all frames registered to one model: label, centroids."""
    out = None
    every = written(v.pts.where("label > 0").select("frame_id", "pt_id", "x", "y", "z", "label"))
    for label in sorted(r["label"] for r in every.select("label").distinct().collect()):  # a row per object
        pts = every.where(F.col("label") == label)
        m = G.fit(pts, G.initial(pts, 8, 1), G.VARIANTS["jrmpc"], 3)
        rows = v.spark.createDataFrame([(label, k, *map(float, x), float(p)) for k, (x, p) in enumerate(zip(m.x, m.p, strict=True))], "label int, k int, x double, y double, z double, p double")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("update_cluster")
def update_cluster(v: Views) -> DataFrame:
    """Patch features in the discriminant base of their labels, and each class's centre."""
    dims = [f"d{i}" for i in range(6)]
    rows = patch_feature(v).select("frame_id", "label", *[F.element_at("feature", 126 + i).alias(d) for i, d in enumerate(dims)])
    base = M.class_base(rows, dims, 2)
    flat = [sum((F.col(d) * float(base[i, k]) for i, d in enumerate(dims) if i), F.col(dims[0]) * float(base[0, k])).alias(f"p{k}") for k in range(base.shape[1])]
    return rows.select("label", *flat).groupBy("label").agg(*[F.avg(f"p{k}").alias(f"p{k}") for k in range(base.shape[1])], F.count(F.lit(1)).alias("n"))


@query("sdp")
def sdp(v: Views) -> DataFrame:
    """A small semidefinite programme: greatest trace product under the trace of the identity."""
    c = np.array([[2.0, 1.0], [1.0, 3.0]])
    x, y, _ = L.solve_sdp(c, [np.eye(2)], np.array([1.0]))
    return v.spark.createDataFrame([(float(np.sum(c * x)), float(y[0]))], "primal double, dual double")
