"""Cases of the findings of round 3."""

import math

import numpy as np
from pyspark.sql import functions as F

from cloudloom.operators import aggregates as A
from cloudloom.operators import register as R
from cloudloom.operators import segment as Z
from cloudloom.operators import spatial as S


def test_normalised_rows_far_from_all_centroids(spark):
    df = spark.createDataFrame([(0, 1, 0, 0.0), (0, 1, 1, 0.0), (0, 2, 0, 1.0), (0, 2, 1, 3.0)], "frame_id int, pt_id long, k int, a double")
    got = {(r["pt_id"], r["k"]): r["a"] for r in A.row_normalised(df).collect()}
    assert math.isnan(got[1, 0]) and math.isnan(got[1, 1]) and (got[2, 0], got[2, 1]) == (0.25, 0.75)


def test_truncation_keeps_zeros_at_the_median(spark):
    df = spark.createDataFrame([(0, 0, a) for a in (0.0, 0.0, 0.0, 0.5)] + [(0, 1, a) for a in (0.1, 0.2, 0.3)], "frame_id int, k int, a double")
    got = A.median_truncated(df).groupBy("k").agg(F.sum(F.col("kept").cast("long")).alias("kept"), F.sum("a").alias("mass")).collect()
    assert {r["k"]: (r["kept"], round(r["mass"], 9)) for r in got} == {0: (4, 0.5), 1: (2, 0.5)}


def cloud(spark, x):
    return spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(x)], "frame_id int, pt_id long, x double, y double, z double")


def test_radius_join_does_not_broadcast_its_copies(spark):
    pts = spark.range(1000).selectExpr("0 AS frame_id", "id AS pt_id", "id * 0.1e0 AS x", "0e0 AS y", "0e0 AS z")
    joined = S.radius_join(pts, pts, 0.25)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000 * 5 - 6


def test_knn_sends_few_leaves_of_a_long_frame(spark):
    r = np.random.default_rng(5)
    x = np.c_[r.random(20000), r.random(20000) * 2000, r.random(20000)]
    pts = cloud(spark, x)
    a, b = S.leaves(pts, ["frame_id"], 0.5), S.leaves(pts, ["frame_id"], 0.5, "pt_id", 3)
    sizes = [row["count"] for row in b.groupBy("leaf").count().collect()]
    assert max(sizes) <= S.LEAF and sum(sizes) == 20000
    assert S.knn_pieces(a, b, 3, ["frame_id"]).count() < 3 * len(sizes)
    got = {}
    for row in S.knn_join(pts.where("pt_id % 500 = 0"), pts, 3, 0.5).collect():
        got.setdefault(row["pt_id"], {})[row["rank"]] = row["nb"]
    for i in range(0, 20000, 500):
        e = x - x[i]
        d = e[:, 0] * e[:, 0] + e[:, 1] * e[:, 1] + e[:, 2] * e[:, 2]
        assert [got[i][k] for k in (1, 2, 3)] == np.lexsort((np.arange(20000), d))[:3].tolist()


def test_knn_of_many_points_at_one_place(spark):
    pts = cloud(spark, np.repeat([[0.0, 0.0, 0.0], [5.0, 0.0, 0.0]], [3000, 2], 0))
    got = S.knn_join(pts, pts, 3, 0.5).where("pt_id IN (7, 3001)").orderBy("pt_id", "rank").collect()
    assert [(r["pt_id"], r["nb"], r["d2"]) for r in got] == [(7, 0, 0.0), (7, 1, 0.0), (7, 2, 0.0), (3001, 3000, 0.0), (3001, 3001, 0.0), (3001, 0, 25.0)]


def test_draws_of_planes_sort_no_points(spark):
    r = np.random.default_rng(6)
    x = np.c_[r.random((300, 2)), np.where(np.arange(300) < 200, 1.0, r.random(300) * 9)]
    found = Z.planes(cloud(spark, x), rounds=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" not in plan  # the draws are a small table by now
    row = found.first()
    assert row["inliers"] >= 200 and abs(abs(row["c"]) - 1) < 1e-9


def test_registration_reads_frames_by_batches(spark):
    r = np.random.default_rng(7)
    pts = cloud(spark, r.random((900, 3))).withColumn("label", (F.col("pt_id") % 4).cast("int"))
    var = R.VARIANTS["jrcs_aopt"]
    m = R.initial(pts, 4, 2)
    columns = R.extra_columns(m, var)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        weakest = R.weakest_objects(pts, m, var, columns)
        got = R.medians(pts, m, var, columns, weakest)[0]
        most = R.per_batch(pts, m, var, columns, lambda f, pdf, *_: pdf.assign(n=len(pdf))[["n"]], "n long").agg(F.max("n")).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = pts.toPandas()
    a = R.responsibilities(rows[["x", "y", "z"]].to_numpy(), m, 0, var, {})[0]
    share = np.array([a[:, m.obj == o].sum() for o in (1, 2)]) / a.sum()
    for label in (1, 2, 3):
        own = np.array([a[np.ix_(rows.label == label, m.obj == o)].sum() for o in (1, 2)])
        worst = 1 + int((own / own.sum() / share).argmin())
        assert weakest[0, label] == worst
        a[np.ix_(rows.label == label, m.obj == worst)] = 0
    assert np.array_equal(got, np.median(a, axis=0)) and most <= 100
