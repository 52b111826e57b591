"""The point-set engine: literal fixtures, invariants of iterative algorithms, sources, and every query against its SQL."""

import itertools
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cloudloom.functions import color as C
from cloudloom.functions import geometry as G
from cloudloom.operators import features as E
from cloudloom.operators import linalg as L
from cloudloom.operators import models as M
from cloudloom.operators import register as R
from cloudloom.operators import segment as Z
from cloudloom.operators import spatial as S
from cloudloom.plans import registry
from cloudloom.sources import meshes

DATA = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as from '{DATA}/{f}'")
    return con


def key(row):
    return tuple((x is None, str(type(x)), x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    want = sorted(duck.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall(), key=key)
    assert got == want


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[:4] == ["frame_id", "kx", "ky", "kz"] and out.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_in_rectangle(spark):
    corners = [tuple(map(F.lit, p)) for p in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    df = spark.createDataFrame([(0.5, 0.5), (0.5, 1.5), (-0.5, -0.5), (0.3, 0.4)], "x double, y double")
    assert [r[0] for r in df.select(G.in_rectangle((F.col("x"), F.col("y")), corners)).collect()] == [True, False, False, True]


VERTICES = [(0, 0, 0), (1, 0, 0), (2, 0, 0), (1, 1, 0), (2, 1, 0), (3, 1, 0), (1, 2, 0), (2, 2, 0), (3, 2, 0), (0, 3, 0)]
EDGES = [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 7), (5, 8), (6, 7), (6, 9), (7, 8)]


def graph(spark):
    nodes = spark.createDataFrame([(0, i + 1, *map(float, v)) for i, v in enumerate(VERTICES)], "frame_id int, sv long, cx double, cy double, cz double")
    return nodes, spark.createDataFrame([(0, a + 1, b + 1) for a, b in EDGES], "frame_id int, a long, b long")


def test_average_geodesic(spark):
    n = len(VERTICES)
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b in EDGES:
        d[a, b] = d[b, a] = math.dist(VERTICES[a], VERTICES[b])
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    want = d.sum(1) / (n - 1)
    nodes, edges = graph(spark)
    got = {r["sv"]: r["agd"] for r in E.average_geodesic(nodes, edges).collect()}
    assert all(math.isclose(got[i + 1], want[i]) for i in range(n))
    lengths = edges.withColumn("d", F.when((F.col("a") == 7) & (F.col("b") == 10), math.sqrt(2)).otherwise(1.0))
    relaxed = {(r["src"], r["sv"]): r["d"] for r in E.relaxed_paths(lengths, nodes.select("frame_id", F.col("sv").alias("src")), 8).collect()}
    assert len(relaxed) == n * n and all(math.isclose(relaxed[i + 1, j + 1], d[i, j]) for i in range(n) for j in range(n))


def test_lbfgs_finds_the_minimum():
    def f(x):
        return 100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2, np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)])

    x, value = L.lbfgs(f, np.zeros(2))
    assert np.allclose(x, [1, 1], atol=1e-3) and value < 1e-6


def test_sdp_has_no_gap():
    # fixed values: blocks, constraints and solution of the known example
    c = np.zeros((7, 7))
    c[:2, :2], c[2:5, 2:5] = [[2, 1], [1, 2]], [[3, 0, 1], [0, 2, 0], [1, 0, 3]]
    a1, a2 = np.zeros((7, 7)), np.zeros((7, 7))
    a1[:2, :2], a1[5, 5] = [[3, 1], [1, 3]], 1
    a2[2:5, 2:5], a2[6, 6] = [[3, 0, 1], [0, 4, 0], [1, 0, 5]], 1
    x, y, z = L.solve_sdp(c, [a1, a2], np.array([1.0, 2.0]))
    assert np.allclose(y, [0.75, 1.0], atol=5e-4) and abs(np.sum(c * x) - y @ [1, 2]) < 1e-3
    assert np.linalg.eigvalsh(x)[0] > -1e-8 and np.linalg.eigvalsh(z)[0] > -1e-8
    assert L.sdpa_text([c], [[a1], [a2]], np.array([1.0, 2.0])).splitlines()[:2] == ["2", "1"]


def test_discriminant_base_with_singular_scatter():
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 3)) + np.repeat(np.eye(3) * 4, 20, 0)
    x = np.hstack([x, x[:, :1]])  # a column twice: the scatter within classes is singular
    label = np.repeat([0, 1, 2], 20)
    mean = np.array([x[label == i].mean(0) for i in range(3)])
    within = sum((x[label == i] - mean[i]).T @ (x[label == i] - mean[i]) for i in range(3))
    between = 20 * (mean - x.mean(0)).T @ (mean - x.mean(0))
    flat = x @ L.lda(between, within, 2)
    centre = np.array([flat[label == i].mean(0) for i in range(3)])
    assert (((flat[:, None] - centre) ** 2).sum(2).argmin(1) == label).mean() > 0.9


@pytest.mark.parametrize("seed", range(4))
def test_cuts_are_least(seed):
    r = np.random.default_rng(seed)
    n = 7
    edges = np.array([(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5])
    w, cost = r.random(len(edges)), r.random((n, 2)) * 2
    best = min(Z.energy(cost, edges, w, np.array(y)) for y in itertools.product((0, 1), repeat=n))
    assert math.isclose(Z.energy(cost, edges, w, Z.expansion(cost, edges, w)), best, abs_tol=1e-9)
    assert math.isclose(Z.energy(cost, edges, w, Z.swap(cost, edges, w)), best, abs_tol=1e-9)
    three = r.random((n, 3)) * 2
    best3 = min(Z.energy(three, edges, w, np.array(y)) for y in itertools.product((0, 1, 2), repeat=n))
    for name, solve in Z.SOLVERS.items():
        e = Z.energy(three, edges, w, solve(three, edges, w))
        assert best3 - 1e-9 <= e <= Z.energy(three, edges, w, three.argmin(1)) + 1e-9, name
        if name in ("expansion", "swap"):
            assert e <= 2 * best3 + 1e-9


def test_procrustes_gives_proper_rotations():
    r = np.random.default_rng(2)
    for yaw in (False, True):
        x = r.normal(size=(30, 3))
        a = 0.7
        m = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
        got, t, s = L.procrustes(x, 2.0 * x @ m.T + [1, 2, 3], yaw_only=yaw, scale=True)
        assert np.allclose(got, m) and np.allclose(t, [1, 2, 3]) and math.isclose(s, 2.0)
    flip = L.procrustes(x, x * [1, 1, -1])[0]
    assert math.isclose(np.linalg.det(flip), 1.0) and np.allclose(flip @ flip.T, np.eye(3))


def cloud(spark, frames=3, n=60, seed=1):
    r = np.random.default_rng(seed)
    base = np.concatenate([r.normal([0, 0, 0], 0.15, (n // 2, 3)), r.normal([2, 0.5, 1], 0.15, (n // 2, 3))])
    rows, truth = [], {}
    for f in range(frames):
        a, t = 0.1 * f, np.array([0.1 * f, -0.05 * f, 0])
        m = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
        truth[f] = (m, t)
        rows += [(f, i, *map(float, m @ p + t)) for i, p in enumerate(base)]
    return spark.createDataFrame(rows, "frame_id int, pt_id long, x double, y double, z double"), base, truth


def test_coherent_point_drift_finds_the_motion(spark):
    pts, _, truth = cloud(spark, 2)
    got = R.cpd_rigid(pts.where("frame_id = 0"), pts.where("frame_id = 1"), 60)
    assert np.allclose(got["R"], truth[1][0], atol=0.03) and np.allclose(got["t"], truth[1][1], atol=0.05)


@pytest.mark.parametrize("name", ["jrmpc", "jrcs_base", "jrcs_aoni", "jrcs_bilateral", "jrcs_cube"])
def test_joint_registration(spark, name):
    pts, base, _ = cloud(spark)
    pts = pts.withColumns({"r": F.lit(0.5), "g": F.lit(0.5), "b": F.lit(0.5)})
    objects = 1 if name == "jrmpc" else 2
    m = R.fit(pts, R.initial(pts, 10, objects), R.VARIANTS[name], 6)
    for r, t in m.poses.values():
        assert np.allclose(r @ r.T, np.eye(3), atol=1e-8) and math.isclose(np.linalg.det(r), 1, abs_tol=1e-8) and np.isfinite(t).all()
    assert np.isfinite(m.x).all() and (m.w > 0).all() and m.p.sum() <= 1 + 1e-9
    assert R.labels(pts, m, R.VARIANTS[name]).count() == pts.count()


def test_knn_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.random((60, 3)), r.random((4, 3)) * 40, np.repeat(r.random((1, 3)), 5, 0)])
    pts = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(x)], "frame_id int, pt_id long, x double, y double, z double")
    got = {}
    for row in S.knn_join(pts, pts, 4, 0.2).collect():
        got.setdefault(row["pt_id"], {})[row["rank"]] = row["nb"]
    for i, p in enumerate(x):
        d = ((x - p) ** 2)
        order = sorted(range(len(x)), key=lambda j: (d[j][0] + d[j][1] + d[j][2], j))[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == order


def test_normals_of_a_plane(spark):
    r = np.random.default_rng(4)
    p = np.c_[r.random((50, 2)), np.full(50, 2.0)]
    pts = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(p)], "frame_id int, pt_id long, x double, y double, z double")
    got = E.point_normals(pts, S.knn_join(pts, pts, 8, 0.3)).toPandas()
    assert np.allclose(got.nz, -1) and np.allclose(got[["nx", "ny", "curvature"]], 0, atol=1e-7)


def test_growth_finds_components(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(9)], "frame_id int, pt_id long")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 5, 4), (0, 6, 5), (0, 7, 8)], "frame_id int, a long, b long")
    assert {r["pt_id"]: r["root"] for r in Z.grow(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7}


def test_evidence_accumulation():
    edges = np.array([(i, j) for i in range(8) for j in range(i + 1, 8)])
    share = ((edges[:, 0] < 4) == (edges[:, 1] < 4)).astype(float)
    label = L.peac(8, edges, share, 3)
    assert len(set(label[:4])) == 1 and len(set(label[4:])) == 1 and label[0] != label[4]


def test_eigenvectors_by_lanczos():
    r = np.random.default_rng(5)
    a = r.normal(size=(120, 120))
    a = a @ a.T
    values, vectors = L.smallest_eigen(a, 3, dense_below=10, steps=120)
    assert np.allclose(values, np.linalg.eigvalsh(a)[:3], rtol=1e-4, atol=1e-6) and np.allclose(a @ vectors, vectors * values, atol=1e-3)


def test_greedy_and_size_match():
    assert M.greedy_match(np.array([[0.9, 0.8], [0.95, 0.1]])).tolist() == [1, 0]
    assert M.size_match([1, 10, 4], [0.68, 0.32]) == [1, 0, 1]


def test_colours(spark):
    rows = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (10, 200, 30)], "r int, g int, b int")
    lab = rows.select(*C.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"), "standard")).collect()
    assert abs(lab[0][0] - 100) < 0.01 and abs(lab[1][0]) < 1e-9
    hsv = spark.range(1).select(*C.hsv_to_rgb(F.lit(120.0), F.lit(1.0), F.lit(1.0))).first()
    assert tuple(hsv) == (0, 255, 0)


# fixed values: the unit box of eight corners and six faces
BOX = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]
FACES = [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)]


def test_mesh_formats(spark, tmp_path):
    obj = "".join(f"v {x} {y} {z}\n" for x, y, z in BOX) + "".join("f " + " ".join(str(i + 1) for i in f) + "\n" for f in FACES)
    off = "OFF\n8 6 0\n" + "".join(f"{x} {y} {z}\n" for x, y, z in BOX) + "".join("4 " + " ".join(map(str, f)) + "\n" for f in FACES)
    stl = "solid a\n" + "".join("facet normal 0 0 0\nouter loop\n" + "".join("vertex {} {} {}\n".format(*BOX[i]) for i in f[:3]) + "endloop\nendfacet\n" for f in FACES) + "endsolid\n"
    (tmp_path / "b.obj").write_text(obj)
    (tmp_path / "c.off").write_text(off)
    (tmp_path / "d.stl").write_text(stl)
    table = pd.DataFrame({"x": [0.5, 1.25], "y": [1.0, 2.0], "z": [0.0, -3.0], "r": [1, 2], "g": [3, 4], "b": [255, 0]})
    (tmp_path / "a.ply").write_text(meshes.ply_text(table))
    (tmp_path / "e.ply").write_bytes(meshes.ply_bytes(table))
    meshes.register(spark)
    got = spark.read.format("pointcloud").load(str(tmp_path)).toPandas()
    assert got.groupby("frame_id").size().to_dict() == {0: 2, 1: 8, 2: 8, 3: 8, 4: 2}
    assert got[got.frame_id == 0].drop(columns="frame_id").reset_index(drop=True).equals(got[got.frame_id == 4].drop(columns="frame_id").reset_index(drop=True))
    n = got[got.frame_id == 1][["nx", "ny", "nz"]].to_numpy()
    assert np.allclose(n, np.array(BOX) / math.sqrt(3))
    again = meshes.read_any_store(spark, str(tmp_path), "*.ply").toPandas()
    assert len(again) == 4 and set(again.frame_id) == {0, 1}
    assert spark.read.format("pointcloud").option("suffix", ".off").load(str(tmp_path)).count() == 8


def test_scene_text_and_config(spark, tmp_path):
    text = "#chair\n1 0 0 5\n0 1 0 6\n0 0 1 7\n#desk\n0 -1 0 0\n1 0 0 0\n0 0 1 2\n"
    (tmp_path / "scene.transform").write_text(text)
    rows = {r["name"]: r for r in meshes.read_transform(spark, str(tmp_path / "scene.transform")).collect()}
    assert (rows["chair"]["tx"], rows["chair"]["ty"], rows["chair"]["tz"]) == (5, 6, 7) and rows["desk"]["r01"] == -1
    c = meshes.Config.parse("# head\nA 1 2 3\nB x # tail\nB 2.5\n")
    assert c.numbers("A") == [1, 2, 3] and c.number("B") == 2.5 and c.overlaid({"A": "9"}).whole("A") == 9 and c.number("none", 4) == 4
    assert meshes.over([c, c.overlaid({"B": "1"})], lambda x: x.number("B")) == [2.5, 1.0]
    (tmp_path / "wide.txt").write_text("1 2 3 4\n5 6 7 8\n9 10 11 12\n")
    wide = meshes.read_ascii(spark, str(tmp_path / "wide.txt")).orderBy("pos").collect()
    assert [tuple(r)[1:] for r in wide] == [(1, 5, 9), (2, 6, 10), (3, 7, 11), (4, 8, 12)]


def test_label_files_are_checked(spark, tmp_path):
    pts = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 7)], "frame_id int, pt_id long, label int")
    meshes.save_labels(pts, str(tmp_path / "l"))
    assert meshes.load_labels(pts, str(tmp_path / "l")).count() == 3
    with pytest.raises(ValueError, match="differ"):
        meshes.load_labels(pts.where("pt_id = 1"), str(tmp_path / "l"))


def test_streams(spark, tmp_path):
    from cloudloom.streaming import frames

    pts = spark.createDataFrame([(i % 2, i, float(i), 2.0 * i, 1.0) for i in range(20)], "frame_id int, pt_id long, x double, y double, z double")
    pts.write.parquet(str(tmp_path / "in"))
    stream = frames.frame_stream(spark, str(tmp_path / "in"), pts.schema)
    seen = []
    frames.each_batch(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c1")).awaitTermination(60)
    assert sum(seen) == 20
    q = frames.running_planes(stream).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["frame_id"]: (r["n"], r["sx"]) for r in spark.sql("select * from sums").collect()} == {0: (10, 90.0), 1: (10, 100.0)}
