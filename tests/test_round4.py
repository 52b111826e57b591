import math
import tracemalloc

import numpy as np
import pandas as pd

import __spark_entry__ as cloud
from cloudloom.operators import cubes as Q
from cloudloom.operators import features as E
from cloudloom.operators import linalg as L
from cloudloom.operators import register as R
from cloudloom.operators import segment as Z
from cloudloom.operators import spatial as S
from cloudloom.sources.views import Views

SMALL = "/root/testdata/sf0.001"


def rows(spark, x, frame=None):
    frame = np.zeros(len(x), int) if frame is None else frame
    return spark.createDataFrame([(int(f), i, *map(float, p)) for i, (f, p) in enumerate(zip(frame, x))], "frame_id int, pt_id long, x double, y double, z double")


def closest(a, b):
    return float(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).min(1).mean())


def turned(x, angle):
    c, s = math.cos(angle), math.sin(angle)
    return np.stack([c * x[:, 0] - s * x[:, 1], s * x[:, 0] + c * x[:, 1], x[:, 2]], 1)


def test_yaws_are_tried_without_turned_copies(spark, monkeypatch):
    r = np.random.default_rng(1)
    frame = np.repeat([0, 1], 600)
    x = np.c_[r.random(1200) * 2, r.random(1200) * 40, r.random(1200)]
    y = np.concatenate([turned(x[frame == 0], 2 * math.pi * 37 / 100), r.random((600, 3)) * [3, 3, 1]])
    made, leaves = [], S.leaves

    def counted(points, *args, **more):
        made.append(points.count())
        return leaves(points, *args, **more)

    monkeypatch.setattr(S, "leaves", counted)
    got = {q.frame_id: q for q in S.align_around_z(rows(spark, x, frame), rows(spark, y, frame), 0.5).collect()}
    assert made == [1200, 1200]  # not a hundred times the points
    for f in (0, 1):
        want = min((closest(turned(x[frame == f], 2 * math.pi * k / 100), y[frame == f]), k) for k in range(100))
        assert got[f].step == want[1] and abs(got[f].error - want[0]) < 1e-9
    assert got[0].step == 37


def test_a_frame_is_laid_on_the_next_by_the_best_of_a_hundred_yaws(spark):
    pts = Views(spark, SMALL).pts.toPandas()
    at = {f: g[["x", "y", "z"]].to_numpy() for f, g in pts.groupby("frame_id")}
    got = {q.frame_id: q for q in cloud.queries()["align_around_z"](spark, SMALL).collect()}
    assert len(got) == 8
    for f in range(8):
        want = min((closest(turned(at[f], 2 * math.pi * k / 100), at[(f + 1) % 8]), k) for k in range(100))
        assert got[f].step == want[1] and abs(got[f].error - want[0]) < 1e-6
    assert {q.step % 25 for q in got.values()} != {0}  # some best yaw is none of twelve


def one_by_one(n, edges, share, k, rounds, tolerance=1e-8):
    """Evidence by visits in order, as the method tells it; how many rounds were made before none could gain."""
    y = np.random.default_rng(1).dirichlet(np.ones(k), n)
    near = [[(j, c) for (a, b), c in zip(edges, share) for i, j in ((a, b), (b, a)) if i == p] for p in range(n)]
    near = [(np.array([j for j, _ in e], int), np.array([c for _, c in e])) for e in near]
    for t in range(rounds):
        moved = False
        for i, (at, c) in enumerate(near):
            g = y[at].T @ (y[at] @ y[i] - c)
            a, b = int(g.argmin()), int(np.where(y[i] > 1e-12, g, -np.inf).argmax())
            d = y[at][:, a] - y[at][:, b]
            if g[b] - g[a] > tolerance:
                step = min((g[b] - g[a]) / max(float(d @ d), 1e-12), y[i, b])
                y[i, a] += step
                y[i, b] -= step
                moved = True
        if not moved:
            break
    return y.argmax(1) + 1


def test_evidence_of_a_chain_goes_on_after_62_rounds():
    i = np.arange(59)
    edges = np.concatenate([np.stack([i, i + 1], 1), np.stack([i[:-1], i[:-1] + 2], 1)])
    votes = np.random.default_rng(0).integers(0, 4, (3, 60))
    share = (votes[:, edges[:, 0]] == votes[:, edges[:, 1]]).mean(0)
    label = L.peac(60, edges, share, 6)
    assert (label == one_by_one(60, edges, share, 6, 2000)).all()
    assert (label != one_by_one(60, edges, share, 6, 62)).any()


def test_evidence_of_regions_goes_on_after_62_rounds():
    pairs = np.array([(a * 12 + b, (a + c) * 12 + b + d) for a in range(4) for b in range(12) for c, d in ((0, 1), (1, 0), (1, 1)) if a + c < 4 and b + d < 12])
    edges = E.within_two(48, pairs)
    votes = np.random.default_rng(0).integers(0, 4, (8, 48))
    share = (votes[:, edges[:, 0]] == votes[:, edges[:, 1]]).mean(0)
    label = L.peac(48, edges, share, 6)
    assert (label == one_by_one(48, edges, share, 6, 2000)).all()
    assert (label != one_by_one(48, edges, share, 6, 62)).any()


def test_planes_are_tried_until_sure_and_fitted_to_their_points(spark):
    r = np.random.default_rng(3)
    x = r.random((600, 3)) * 100
    x[:100] = np.c_[x[:100, :2], 40 + r.uniform(-0.01, 0.01, 100)]  # one triple in 216 lies in this plane
    got = Z.planes(rows(spark, x)).first()
    near = x[np.abs(x @ [got.a, got.b, got.c] + got.d) < 0.05]
    assert got.inliers == len(near) >= 100
    n, d, _ = L.plane_of(near)
    n, d = (n, d) if n[2] * got.c > 0 else (-n, -d)
    assert np.allclose([got.a, got.b, got.c, got.d], [*n, d], atol=1e-9)
    assert Z.planes(rows(spark, x[:2])).count() == 0


def test_trials_end_as_the_method_says():
    assert Z.tried([10, 90, 20, 20, 95], 100, 1000, 0.99) == (1, np.log(0.01) / np.log(1 - 0.9**3))  # 3.53 trials: the fifth is not made
    assert Z.tried([10, 9], 100, 1000, 0.99)[1] == 1000


def test_mean_paths_of_parts_need_no_paths(spark):
    """Two chains of 60 and 40 nodes: what is out of reach outweighs all lengths; a chain of its own needs its paths."""
    nodes = [(0, i + 1, float(i), 0.0, 0.0) for i in range(100)] + [(1, i + 1, float(i), 0.0, 0.0) for i in range(5)]
    edges = [(0, i + 1, i + 2) for i in range(99) if i != 59] + [(1, i + 1, i + 2) for i in range(4)]
    n, e = spark.createDataFrame(nodes, "frame_id int, sv long, cx double, cy double, cz double"), spark.createDataFrame(edges, "frame_id int, a long, b long")
    found = E.average_geodesic(n.where("frame_id = 0"), e.where("frame_id = 0"))
    assert "part#" not in found._jdf.queryExecution().executedPlan().toString()
    far = 3.4028234663852886e38
    assert {r.sv: r.agd for r in found.collect()} == {i + 1: far * (40 if i < 60 else 60) / 99 for i in range(100)}
    got = {r.sv: r.agd for r in E.average_geodesic(n, e).where("frame_id = 1").collect()}
    assert got == {1: 2.5, 2: 1.75, 3: 1.5, 4: 1.75, 5: 2.5}


def test_a_mean_field_step_forms_no_pairs(spark, monkeypatch):
    def none(*args, **more):
        raise AssertionError("pairs are formed")

    monkeypatch.setattr(S, "radius_join", none)
    monkeypatch.setattr(Z, "mean_field_step", none)
    pts = Views(spark, SMALL).pts.toPandas()
    got = cloud.queries()["dense_crf_step"](spark, SMALL).toPandas().set_index(["frame_id", "pt_id", "l"]).q
    assert len(got) == 5 * len(pts)
    g = pts[pts.frame_id == 3].sort_values("pt_id")
    x, u = g[["x", "y", "z"]].to_numpy(), np.where(g.label.to_numpy()[:, None] == np.arange(5), 0.5, 1.5 + 0.1 * np.arange(5))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    k = np.where((d < 0.36) & ~np.eye(len(x), dtype=bool), np.exp(-0.5 * d / 0.04), 0.0)
    want = Z.softmaxed(-u + 2 * k @ Z.softmaxed(-u))
    assert np.allclose([[got[3, p, l] for l in range(5)] for p in g.pt_id], want, atol=1e-6)


def test_smoothing_holds_cells_and_no_frame(spark):
    r = np.random.default_rng(8)
    x = r.random((900, 3)) * [2, 12, 2]
    pts, var = rows(spark, x), R.VARIANTS["sjrcs"]
    m = R.initial(pts, 4, 2)
    factors = R.smoothing(pts, m, var, {})
    got = {tuple(q[c] for c in R.CELLS): q.factor for q in factors.collect()}
    cells, at = np.unique(np.floor(x / 0.75).astype(int), axis=0, return_inverse=True)
    at = at.ravel()
    a = R.responsibilities(x, m, 0, var, {})[0]
    near = (np.abs(cells[:, None] - cells[None]).max(2) <= 1).astype(float)
    base = L.smallest_eigen(np.diag(near.sum(1)) - near, 20)[1]
    mean = np.stack([np.bincount(at, a[:, j]) for j in range(8)], 1) / np.bincount(at)[:, None]
    c = base.T @ mean
    new = np.maximum(base @ (c * (np.abs(c) >= np.sort(np.abs(c), axis=0)[-5])), 0)
    want = (new / np.maximum(mean, 1e-300)).clip(0.1, 10)
    assert len(got) == len(cells) and np.allclose([got[tuple(k)] for k in cells.tolist()], want, rtol=1e-6)
    plan = R.labels(pts, m, var)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan  # batches, not whole frames
    middle = R.medians(pts, m, var, {}, {}, factors)[0]
    assert np.allclose(middle, np.median(a * want[at], axis=0), rtol=1e-6)


def test_heat_signatures_hold_no_kernels_of_all_nodes():
    """30,000 nodes in 250 chains: kernels of them all would have 92 MB, 200 vectors of them all 48 MB."""
    i = np.arange(30_000 - 1)
    i = i[i % 120 != 119]
    pairs, w = np.stack([i, i + 1], 1), 0.5 + (i % 7) / 10.0
    tracemalloc.start()
    got = E.heat_signatures(30_000, pairs, w, 200, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6 and got.shape == (30_000, 6)
    few = pairs[:476]  # four chains, which 40 vectors tell apart
    values, vectors, _ = L.graph_eigen(480, few, w[:476], 40)
    heat = vectors**2 @ np.exp(-np.maximum(values, 0)[:, None] * 2.0 ** np.arange(1, 25 + 1 / 32, 1 / 16))
    want = np.abs(np.fft.fft(np.diff(np.log(np.maximum(heat, 1e-300)), axis=1), axis=1))[:, :6]
    assert np.allclose(E.heat_signatures(480, few, w[:476], 40, 6), want, atol=1e-9)


def test_regions_by_colour_search_neighbours_once(spark):
    n = 300  # a chain of three colours, and a point of its own colour
    colour = [0.0 if i < 100 else 20.0 if i < 200 else 200.0 for i in range(n)] + [90.0]
    pts = spark.createDataFrame([(0, i, c, 0.0, 0.0) for i, c in enumerate(colour)], "frame_id int, pt_id long, r double, g double, b double")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    near = spark.createDataFrame([(0, i, i + d) for i in range(n + 1) for d in (-1, 0, 1) if 0 <= i + d <= n], "frame_id int, pt_id long, nb long")
    rows_ = near.count()
    got = {q.pt_id: q.label for q in Z.region_grow_rgb(pts, near.mapInPandas(counted, near.schema), 10.0, 25.0, 3).collect()}
    assert read.value == rows_
    assert got == {i: 1 if i < 200 else 2 for i in range(n + 1)}


def test_scores_of_sides_take_few_exponentials(spark, monkeypatch):
    """A row has 1331 cells; exponentials are taken for its 66 distances from faces."""
    r = np.random.default_rng(9)
    u, a, half = np.r_[r.normal(size=(300, 3)) * 2, [[900.0, 0, 0], [0, 0, -40.0]]], r.random(302), np.array([[1.0, 0.7, 1.3]])
    taken = []

    class Rows:  # stands for a table: the batches are read here
        sparkSession = spark

        def select(self, *names):
            return self

        def repartition(self, n):
            return self

        def mapInPandas(self, run, schema):
            exp = np.exp
            monkeypatch.setattr(np, "exp", lambda x, *args, **more: (taken.append(np.size(x)), exp(x, *args, **more))[1])
            out = pd.concat(run([pd.DataFrame({"obj": 1, **{f"u{i}": u[:, i] for i in range(3)}, "a": a})]))
            monkeypatch.undo()
            return spark.createDataFrame(out, schema)

    got = {(q.i, q.j, q.k): q.score for q in Q.scale_scores(Rows(), half).collect()}
    assert len(got) == 1331 and sum(taken) <= 302 * 66
    for (i, j, k), score in list(got.items())[::97]:
        h = half[0] * [Q.STEPS[i], Q.STEPS[j], Q.STEPS[k]]
        out, face = np.maximum(np.abs(u) - h, 0) ** 2, (np.abs(u) - h) ** 2
        face[:, 2] = (u[:, 2] - h[2]) ** 2
        d = np.min([face[:, c] + out[:, (c + 1) % 3] + out[:, (c + 2) % 3] for c in range(3)], axis=0)
        assert abs(score - a @ np.exp(-d)) < 1e-9
