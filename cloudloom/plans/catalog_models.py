"""Queries on patches, mixtures, fields and energies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import color as C
from cloudloom.functions import geometry as G
from cloudloom.operators import aggregates as A
from cloudloom.operators import spatial as S
from cloudloom.plans.catalog_spatial import SIM, similarity
from cloudloom.plans.registry import query, rounded
from cloudloom.sources.views import Views, with_views

TURN = """t AS (SELECT frame_id, label, CAST(s AS INT) AS step, cos(radians(s)) * x + sin(radians(s)) * y AS u, -sin(radians(s)) * x + cos(radians(s)) * y AS v, z FROM pts, range(0, 360) r(s) WHERE label > 0),
 e AS (SELECT frame_id, label, step, max(u) - min(u) AS length, max(v) - min(v) AS width, max(z) - min(z) AS height FROM t GROUP BY frame_id, label, step),
 m AS (SELECT *, row_number() OVER (PARTITION BY frame_id, label ORDER BY round(length * width, 9), step) AS rank FROM e)"""


@query("mbb2d", with_views("pts", f"+ {TURN} SELECT frame_id, label, step, round(length, 6) + 0e0 AS length, round(width, 6) + 0e0 AS width FROM m WHERE rank = 1"))
def mbb2d(v: Views) -> DataFrame:
    return A.min_box_2d(v.pts.where("label > 0"), ["frame_id", "label"]).select("frame_id", "label", "step", rounded(F.col("length"), "length"), rounded(F.col("width"), "width"))


@query("mbb3d", with_views("pts", f"+ {TURN} SELECT frame_id, label, round(length * width * height, 5) + 0e0 AS volume FROM m WHERE rank = 1"))
def mbb3d(v: Views) -> DataFrame:
    box = A.min_box_3d(v.pts.where("label > 0"), ["frame_id", "label"])
    return box.select("frame_id", "label", (F.round(F.col("length") * F.col("width") * F.col("height"), 5) + 0.0).alias("volume"))


HIST = "+ h AS (SELECT frame_id, label, least(4, floor(r * 5e0 / 256)) * 25 + least(4, floor(g * 5e0 / 256)) * 5 + least(4, floor(b * 5e0 / 256)) AS bin FROM pts WHERE label > 0), c AS (SELECT frame_id, label, bin, count(*) AS n FROM h GROUP BY ALL), s AS (SELECT frame_id, label, count(*) AS size FROM h GROUP BY ALL)"


@query("color_hist_rgb", with_views("pts", HIST + " SELECT frame_id, label, CAST(k AS INT) AS bin, round((coalesce(n, 0) + 1e0) / (size + 125) * size, 6) + 0e0 AS share FROM s CROSS JOIN range(0, 125) t(k) LEFT JOIN c ON s.frame_id = c.frame_id AND s.label = c.label AND c.bin = k".replace("SELECT frame_id, label, CAST", "SELECT s.frame_id, s.label, CAST")))
def color_hist_rgb(v: Views) -> DataFrame:
    return A.color_histogram(v.pts.where("label > 0"), {c: (0.0, 256.0, 5) for c in "rgb"}, ["frame_id", "label"]).select("frame_id", "label", "bin", rounded(F.col("share"), "share"))


@query("color_hist_lab")
def color_hist_lab(v: Views) -> DataFrame:
    """Histogram in Lab space with 1 x 8 x 8 bins."""
    lab = C.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    at = v.pts.where("label > 0").withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), lab, strict=True)))
    return A.color_histogram(at, {"lab_l": (0.0, 100.0, 1), "lab_a": (-128.0, 256.0, 8), "lab_b": (-128.0, 256.0, 8)}, ["frame_id", "label"]).select("frame_id", "label", "bin", rounded(F.col("share"), "share"))


BLOCK = f"""+ {TURN}, o AS (SELECT p.frame_id, p.label, m.length, m.width, m.height, cos(radians(step)) * x + sin(radians(step)) * y AS u, -sin(radians(step)) * x + cos(radians(step)) * y AS v, z
   FROM pts p JOIN m ON p.frame_id = m.frame_id AND p.label = m.label AND m.rank = 1),
 d AS (SELECT *, {", ".join(f"least({c} - min({c}) OVER w, max({c}) OVER w - {c}) AS d{i}" for i, c in enumerate("uvz"))} FROM o WINDOW w AS (PARTITION BY frame_id, label)),
 n AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS side FROM d)
 SELECT frame_id, label, {", ".join(f"round(any_value({c}), 6) + 0e0 AS {c}" for c in ("length", "width", "height"))},
 {", ".join(f"""round(avg(CASE WHEN side = {i} THEN 1e0 ELSE 0 END), 6) + 0e0 AS share{i}, round(coalesce(avg(d{i}) FILTER (side = {i}), 0), 6) + 0e0 AS mean{i},
   round(coalesce(stddev_samp(d{i}) FILTER (side = {i}), 0), 6) + 0e0 AS dev{i}""" for i in range(3))} FROM n GROUP BY frame_id, label"""


@query("block_feature", with_views("pts", BLOCK))
def block_feature(v: Views) -> DataFrame:
    f = A.block_feature(v.pts.where("label > 0"), ["frame_id", "label"])
    return f.select("frame_id", "label", *[rounded(F.col(c), c) for c in f.columns[2:]])


def patch_feature(v: Views, points: DataFrame | None = None) -> DataFrame:
    """Colour histogram and block feature of each patch in one array."""
    points = v.pts.where("label > 0") if points is None else points
    hist = A.color_histogram(points, {c: (0.0, 256.0, 5) for c in "rgb"}, ["frame_id", "label"]).groupBy("frame_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "share"))), lambda x: x["share"]).alias("hist"))
    block = A.block_feature(points, ["frame_id", "label"])
    return hist.join(block, ["frame_id", "label"]).select("frame_id", "label", F.concat("hist", F.array(*[F.col(c) for c in block.columns[2:]])).alias("feature"))


@query("patch_feature")
def patch_features(v: Views) -> DataFrame:
    return patch_feature(v).select("frame_id", "label", F.size("feature").alias("dims"), rounded(F.aggregate("feature", F.lit(0.0), lambda a, x: a + x), "total"))


# products of four decimals lie on half digits: a step beside them settles how both engines round
COV = "CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(covar_pop({p}, {q}) * count(*) + 1e-7, 4) + 0e0 AS s{p}{q}" for p, q in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query("cov_scatter", with_views("pts", f"SELECT frame_id, label, {COV} FROM pts GROUP BY frame_id, label"))
def cov_scatter(v: Views) -> DataFrame:
    s = A.scatter(v.pts, ["frame_id", "label"])
    return s.select("frame_id", "label", "n", *[(F.round(F.col(c) + 1e-7, 4) + 0.0).alias(c) for c in ("sxx", "sxy", "sxz", "syy", "syz", "szz")])


WORDS = "w AS (SELECT frame_id, label, (r * 7 + g) % 48 AS word FROM pts WHERE label > 0), c AS (SELECT frame_id, label, word, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT frame_id, label, sum(n) AS size FROM c GROUP BY ALL)"


@query("bof_tfidf", with_views("pts", f"+ {WORDS}, d AS (SELECT word, count(*) AS df FROM c GROUP BY word) SELECT frame_id, label, word, round(n / (size + 1) * ln(((SELECT count(*) FROM s) + 1e0) / (df + 1)), 6) + 0e0 AS tfidf FROM c JOIN s USING (frame_id, label) JOIN d USING (word)"))
def bof_tfidf(v: Views) -> DataFrame:
    words = v.pts.where("label > 0").selectExpr("frame_id", "label", "(r * 7 + g) % 48 AS word")
    return A.tf_idf(words).select("frame_id", "label", "word", rounded(F.col("tfidf"), "tfidf"))


@query("bof_tfidf_frame", with_views("pts", f"+ {WORDS}, d AS (SELECT frame_id, word, count(*) AS df FROM c GROUP BY ALL), f AS (SELECT frame_id, count(*) AS docs FROM s GROUP BY ALL) SELECT frame_id, label, word, round(n / (size + 1) * ln((docs + 1e0) / (df + 1)), 6) + 0e0 AS tfidf FROM c JOIN s USING (frame_id, label) JOIN d USING (frame_id, word) JOIN f USING (frame_id)"))
def bof_tfidf_frame(v: Views) -> DataFrame:
    words = v.pts.where("label > 0").selectExpr("frame_id", "label", "(r * 7 + g) % 48 AS word")
    return A.tf_idf(words, per_frame=True).select("frame_id", "label", "word", rounded(F.col("tfidf"), "tfidf"))


LIKE = """+ a AS (SELECT q.frame_id, q.pt_id, k, obj_id, p, w, q.x AS vx, q.y AS vy, q.z AS vz, pow(q.x - c.x, 2) + pow(q.y - c.y, 2) + pow(q.z - c.z, 2) AS d2 FROM pts q, centroids c),
 l AS (SELECT *, exp(-0.5e0 * w * d2) * pow(w, 1.5e0) * p AS a FROM a), n AS (SELECT * EXCLUDE (a), a / (sum(a) OVER (PARTITION BY frame_id, pt_id) + 1e-5) AS a FROM l)"""


def likelihood(v: Views) -> DataFrame:
    return A.pair_likelihood(v.pts, v.centroids)


def alpha(v: Views) -> DataFrame:
    return A.row_normalised(likelihood(v), 1e-5)


@query("pairwise_all", with_views("pts centroids", LIKE + " SELECT frame_id, pt_id, k, round(d2, 6) + 0e0 AS d2 FROM a"))
def pairwise_all(v: Views) -> DataFrame:
    return likelihood(v).select("frame_id", "pt_id", "k", rounded(F.col("d2"), "d2"))


@query("row_normalise", with_views("pts centroids", LIKE + " SELECT frame_id, pt_id, k, round(a, 6) + 0e0 AS a FROM n"))
def row_normalise(v: Views) -> DataFrame:
    return alpha(v).select("frame_id", "pt_id", "k", rounded(F.col("a"), "a"))


@query("col_truncate", with_views("pts centroids", LIKE + ", m AS (SELECT frame_id, k, median(a) AS mid FROM n GROUP BY ALL) SELECT frame_id, k, CAST(sum(CASE WHEN n.a >= mid THEN 1 ELSE 0 END) AS BIGINT) AS kept, round(sum(CASE WHEN n.a >= mid THEN n.a ELSE 0 END), 5) + 0e0 AS mass FROM n JOIN m USING (frame_id, k) GROUP BY frame_id, k"))
def col_truncate(v: Views) -> DataFrame:
    t = A.median_truncated(alpha(v))
    return t.groupBy("frame_id", "k").agg(F.sum(F.col("kept").cast("long")).alias("kept"), (F.round(F.sum("a"), 5) + 0.0).alias("mass"))


@query("weighted_mean", with_views("pts centroids", LIKE + " SELECT frame_id, k, round(sum(a * vx) / sum(a), 6) + 0e0 AS x, round(sum(a * vy) / sum(a), 6) + 0e0 AS y, round(sum(a * vz) / sum(a), 6) + 0e0 AS z FROM n GROUP BY frame_id, k"))
def weighted_mean(v: Views) -> DataFrame:
    return A.weighted_means(alpha(v)).select("frame_id", "k", *[rounded(F.col(c), c) for c in "xyz"])


@query("var_prior_update", with_views("pts centroids", LIKE + " SELECT k, round(3 * sum(a) / (sum(a * d2) + 1e-6), 6) + 0e0 AS invvar, round(sum(a) / ((1 + 1e-5) * (SELECT sum(a) FROM n)), 6) + 0e0 AS p FROM n GROUP BY k"))
def var_prior_update(v: Views) -> DataFrame:
    return A.variance_prior(alpha(v)).select("k", rounded(F.col("invvar"), "invvar"), rounded(F.col("p"), "p"))


@query("get_label", with_views("pts centroids", LIKE + ", o AS (SELECT frame_id, pt_id, obj_id, sum(a) AS mass FROM n GROUP BY ALL) SELECT frame_id, pt_id, label FROM (SELECT frame_id, pt_id, obj_id AS label, row_number() OVER (PARTITION BY frame_id, pt_id ORDER BY mass DESC, obj_id) AS r FROM o) WHERE r = 1"))
def get_label(v: Views) -> DataFrame:
    return A.object_label(alpha(v)).select("frame_id", "pt_id", F.col("label").cast("int").alias("label"))


@query("obj_prob", with_views("centroids", "SELECT obj_id, round((sum(p) + 1e-6) / (SELECT sum(s) FROM (SELECT sum(p) + 1e-6 AS s FROM centroids GROUP BY obj_id)), 6) + 0e0 AS prob FROM centroids GROUP BY obj_id"))
def obj_prob(v: Views) -> DataFrame:
    return A.object_prior(v.centroids).select("obj_id", rounded(F.col("prob"), "prob"))


@query("objective", with_views("pts centroids", LIKE + " SELECT frame_id, round(-0.5e0 * sum(a * (w * d2 - 1.5e0 * ln(w) - 2 * ln(p))), 4) + 0e0 AS objective FROM n GROUP BY frame_id"))
def objective(v: Views) -> DataFrame:
    return A.log_objective(alpha(v)).select("frame_id", (F.round("objective", 4) + 0.0).alias("objective"))


@query("aoni_step", with_views("pts centroids", LIKE.replace("n AS (SELECT * EXCLUDE (a), a / (sum(a) OVER (PARTITION BY frame_id, pt_id) + 1e-5) AS a FROM l)", "o AS (SELECT obj_id, (sum(p) + 1e-6) AS s FROM centroids GROUP BY obj_id), b AS (SELECT l.* EXCLUDE (a), a * s / (SELECT sum(s) FROM o) AS a FROM l JOIN o USING (obj_id)), n AS (SELECT * EXCLUDE (a), a / (1.00001e0 * sum(a) OVER (PARTITION BY frame_id, pt_id)) AS a FROM b)") + " SELECT frame_id, pt_id, k, round(a, 6) + 0e0 AS a FROM n"))
def aoni_step(v: Views) -> DataFrame:
    """E-step with the objects' prior."""
    with_prior = likelihood(v).join(F.broadcast(A.object_prior(v.centroids)), "obj_id").withColumn("a", F.col("a") * F.col("prob"))
    return A.row_normalised(with_prior, scale=1.00001).select("frame_id", "pt_id", "k", rounded(F.col("a"), "a"))


@query("running_mean", with_views("pts", "SELECT frame_id, round(avg(m) OVER (ORDER BY frame_id), 6) + 0e0 AS mean FROM (SELECT frame_id, avg(x) AS m FROM pts GROUP BY frame_id)"))
def running_mean(v: Views) -> DataFrame:
    """Mean over the frames so far: a window over one row per frame."""
    m = v.pts.groupBy("frame_id").agg(F.avg("x").alias("m"))
    return m.select("frame_id", (F.round(F.expr("avg(m) OVER (ORDER BY frame_id)"), 6) + 0.0).alias("mean"))


UNARY = "+ u AS (SELECT frame_id, pt_id, CAST(l AS INT) AS l, CASE WHEN l = label THEN 0.5e0 ELSE 1.5e0 + 0.1e0 * l END AS u FROM pts, range(0, 5) t(l)), q AS (SELECT *, exp(-u) / sum(exp(-u)) OVER (PARTITION BY frame_id, pt_id) AS q FROM u)"


def unary(v: Views) -> DataFrame:
    labels = F.explode(F.array(*[F.lit(i) for i in range(5)]))
    u = F.when(F.col("l") == F.col("label"), 0.5).otherwise(1.5 + 0.1 * F.col("l"))
    return v.pts.withColumn("l", labels).select("frame_id", "pt_id", "x", "y", "z", "l", u.alias("u"))


@query("softmax", with_views("pts", UNARY + " SELECT frame_id, pt_id, l, round(q, 6) + 0e0 AS q FROM q"))
def softmax(v: Views) -> DataFrame:
    u = unary(v).withColumn("u", -F.col("u"))
    return A.softmax(u, ["frame_id", "pt_id"]).select("frame_id", "pt_id", "l", rounded(F.col("q"), "q"))


@query("dense_crf_step", with_views("pts", UNARY + """, k AS (SELECT a.frame_id, a.pt_id, b.pt_id AS nb, exp(-0.5e0 * (pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / 0.04e0) AS k FROM pts a JOIN pts b ON a.frame_id = b.frame_id AND a.pt_id <> b.pt_id
 WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) < 0.36e0),
 m AS (SELECT k.frame_id, k.pt_id, l, sum(k * q) AS m FROM k JOIN q ON k.frame_id = q.frame_id AND k.nb = q.pt_id GROUP BY ALL), e AS (SELECT u.frame_id, u.pt_id, u.l, exp(-u + 2 * coalesce(m, 0)) AS e FROM u LEFT JOIN m USING (frame_id, pt_id, l))
 SELECT frame_id, pt_id, l, round(e / sum(e) OVER (PARTITION BY frame_id, pt_id), 6) + 0e0 AS q FROM e"""))
def dense_crf_step(v: Views) -> DataFrame:
    """One mean-field step with a Gaussian kernel of sigma 0.2 cut at 3 sigma, summed by pieces of points, and Potts labels."""
    from cloudloom.operators.segment import mean_field_near

    labels = [f"u{i}" for i in range(5)]
    costs = v.pts.select("frame_id", "pt_id", "x", "y", "z", *[F.when(F.col("label") == i, 0.5).otherwise(1.5 + 0.1 * i).alias(u) for i, u in enumerate(labels)])
    q = mean_field_near(costs, labels, 0.6, 0.04, 2.0, 1)
    return q.select("frame_id", "pt_id", F.posexplode(F.array(*[f"q_{u}" for u in labels])).alias("l", "q")).select("frame_id", "pt_id", "l", rounded(F.col("q"), "q"))


SV_UNARY = ", pos AS (SELECT frame_id, a, b, w * w + 0.01e0 AS w FROM sim), c AS (SELECT frame_id, sv, CAST(l AS INT) AS label, abs(cz - l) AS cost FROM supervoxels, range(0, 4) t(l))"


def sv_costs(v: Views) -> DataFrame:
    return v.supervoxels.withColumn("label", F.explode(F.array(*[F.lit(i) for i in range(4)]))).select("frame_id", "sv", "label", F.abs(F.col("cz") - F.col("label")).alias("cost"))


def sv_weights(v: Views) -> DataFrame:
    return similarity(v).withColumn("w", F.col("w") * F.col("w") + 0.01)


ENERGY = SV_UNARY + ", i AS (SELECT *, row_number() OVER (PARTITION BY frame_id, sv ORDER BY round(cost, 9), label) AS r FROM c), x AS (SELECT frame_id, sv, label, cost FROM i WHERE r = 1)"


def first_labels(v: Views) -> DataFrame:
    best = F.min(F.struct(F.round("cost", 9).alias("c"), "label", "cost")).alias("m")
    return sv_costs(v).groupBy("frame_id", "sv").agg(best).select("frame_id", "sv", "m.label", "m.cost")


@query("mrf_energy", with_views("supervoxels sv_edges", SIM + ENERGY + """, s AS (SELECT e.frame_id, sum(CASE WHEN p.label <> q.label THEN w ELSE 0 END) AS smooth FROM pos e JOIN x p ON e.frame_id = p.frame_id AND e.a = p.sv JOIN x q ON e.frame_id = q.frame_id AND e.b = q.sv GROUP BY e.frame_id),
 d AS (SELECT frame_id, sum(cost) AS data FROM x GROUP BY frame_id) SELECT frame_id, round(data, 6) + 0e0 AS data, round(smooth, 6) + 0e0 AS smooth, round(data + smooth, 6) + 0e0 AS energy FROM d JOIN s USING (frame_id)"""))
def mrf_energy(v: Views) -> DataFrame:
    return A.edge_energy(first_labels(v), sv_weights(v)).select("frame_id", *[rounded(F.col(c), c) for c in ("data", "smooth", "energy")])


@query("mrf_icm_sweep", with_views("supervoxels sv_edges", SIM + ENERGY + """, m AS (SELECT frame_id, a, b, w FROM pos UNION ALL SELECT frame_id, b, a, w FROM pos), t AS (SELECT m.frame_id, m.a AS sv, x.label AS lb, m.w FROM m JOIN x ON m.frame_id = x.frame_id AND m.b = x.sv),
 g AS (SELECT frame_id, sv, sum(w) AS all_w FROM t GROUP BY ALL), y AS (SELECT frame_id, sv, lb AS label, sum(w) AS same FROM t GROUP BY ALL),
 f AS (SELECT c.frame_id, c.sv, c.label, round(cost + coalesce(all_w, 0) - coalesce(same, 0), 9) AS e FROM c LEFT JOIN g USING (frame_id, sv) LEFT JOIN y USING (frame_id, sv, label))
 SELECT frame_id, sv, label FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sv ORDER BY e, label) AS r FROM f) WHERE r = 1"""))
def mrf_icm_sweep(v: Views) -> DataFrame:
    return A.icm_sweep(sv_costs(v), first_labels(v), sv_weights(v)).select("frame_id", "sv", "label")


@query("lda_scatter", """WITH e AS (SELECT vec_id, label, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS c FROM embeddings, range(0, 64) t(i)), m AS (SELECT label, i, count(*) AS n, avg(c) AS m FROM e GROUP BY label, i), g AS (SELECT i, avg(c) AS g FROM e GROUP BY i),
 b AS (SELECT p.i, q.i AS j, sum(p.n * (p.m - gp.g) * (q.m - gq.g)) AS between_v FROM m p JOIN m q USING (label) JOIN g gp ON gp.i = p.i JOIN g gq ON gq.i = q.i GROUP BY p.i, q.i), d AS (SELECT vec_id, e.i, c - m AS d FROM e JOIN m USING (label, i)),
 w AS (SELECT p.i, q.i AS j, sum(p.d * q.d) AS within_v FROM d p JOIN d q USING (vec_id) GROUP BY p.i, q.i)
 SELECT i, j, round(between_v, 4) + 0e0 AS between_v, round(within_v, 4) + 0e0 AS within_v FROM b JOIN w USING (i, j)""")
def lda_scatter(v: Views) -> DataFrame:
    rows = v.table("embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    between, within = A.vector_scatter(rows, "f", 64)
    both = between.withColumnRenamed("v", "between_v").join(within.withColumnRenamed("v", "within_v"), ["i", "j"])
    return both.select("i", "j", *[(F.round(c, 4) + 0.0).alias(c) for c in ("between_v", "within_v")])


@query("top_k_head", """WITH e AS (SELECT vec_id, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS c FROM embeddings, range(0, 64) t(i)) SELECT vec_id, i, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c) DESC, i) AS rank FROM e) WHERE rank <= 5""")
def top_k_head(v: Views) -> DataFrame:
    """The five strongest coefficients of each spectrum."""
    e = v.table("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "c")).withColumn("c", F.col("c").cast("double"))
    return A.top_k(e, 5, ["vec_id"], [F.desc(F.abs("c")), "i"]).select("vec_id", "i", "rank")


@query("diff", """WITH e AS (SELECT vec_id, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS c FROM embeddings, range(0, 64) t(i)) SELECT vec_id, i, round(n - c, 6) + 0e0 AS d FROM (SELECT vec_id, i, c, lead(c) OVER (PARTITION BY vec_id ORDER BY i) AS n FROM e) WHERE n IS NOT NULL""")
def diff(v: Views) -> DataFrame:
    """Differences of neighbouring entries of a row, inside the row's array."""
    c = F.transform("embedding", lambda x: x.cast("double"))
    d = F.zip_with(F.slice(c, 2, 63), F.slice(c, 1, 63), lambda a, b: a - b)
    return v.table("embeddings").select("vec_id", F.posexplode(d).alias("i", "d")).select("vec_id", "i", rounded(F.col("d"), "d"))


@query("object_model", with_views("pts", """+ m AS (SELECT frame_id, pt_id, x, y, z, r, g, b FROM pts WHERE label = 1), t AS (SELECT frame_id, pt_id, x, y, z, r, g, b FROM pts WHERE label = 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY frame_id, pt_id ORDER BY d2, nb) AS rank FROM (SELECT a.frame_id, a.pt_id, b.pt_id AS nb, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, sqrt(pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2)) AS col FROM m a JOIN t b USING (frame_id)))
 SELECT frame_id, pt_id, round(1 / (1 + sqrt(d2) / 0.1e0), 6) + 0e0 AS dist_p, round(1 / (1 + col), 6) + 0e0 AS color_p FROM n WHERE rank = 1"""))
def object_model(v: Views) -> DataFrame:
    """Weights of an object's points by distance and colour of the nearest point of another view."""
    m, t = v.pts.where("label = 1"), v.pts.where("label = 2")
    near = S.knn_join(m, t, 1, 0.4).join(m.select("frame_id", "pt_id", "r", "g", "b"), ["frame_id", "pt_id"]).join(t.select("frame_id", F.col("pt_id").alias("nb"), *[F.col(c).alias("n_" + c) for c in "rgb"]), ["frame_id", "nb"])
    col = F.sqrt(sum((F.pow(F.col(c) - F.col("n_" + c), 2) for c in "gb"), F.pow(F.col("r") - F.col("n_r"), 2)))
    return near.select("frame_id", "pt_id", rounded(G.radial(F.sqrt("d2"), 0.1), "dist_p"), rounded(1 / (1 + col), "color_p"))
