"""Boxes against plain rules, and planted turned boxes found again."""

import numpy as np
from pyspark.sql import functions as F

from cloudloom.operators import cubes as Q

ROW = "obj int, u0 double, u1 double, u2 double, h0 double, h1 double, h2 double, a double"


def plain_distance2(u, h, open_below):
    """Least squared distance from the faces, each a rectangle."""
    best = np.inf
    for axis in range(3):
        for sign in (-1, 1):
            if open_below and axis == 2 and sign == -1:
                continue
            low, high = -np.array(h), np.array(h)
            low[axis] = high[axis] = sign * h[axis]
            best = min(best, float(((u - np.clip(u, low, high)) ** 2).sum()))
    return best


def rows_of(seed, n):
    r = np.random.default_rng(seed)
    return [(int(r.integers(1, 3)), *map(float, r.normal(0, 1.2, 3)), 0.5, 1.0, 0.8, float(r.uniform(0, 1))) for _ in range(n)]


def test_distance_and_scores(spark):
    rows = rows_of(1, 60)
    table = spark.createDataFrame(rows, ROW).repartition(3)
    half = np.array([[0.5, 1.0, 0.8], [1.2, 0.3, 0.6]])
    steps = (0.5, 1.0, 1.4)
    for open_below in (True, False):
        d2 = Q.surface_distance2([F.col(f"u{i}") for i in range(3)], [F.col(f"h{i}") for i in range(3)], open_below)
        for r in table.withColumn("d2", d2).collect():
            assert abs(r.d2 - plain_distance2(np.array([r.u0, r.u1, r.u2]), [0.5, 1.0, 0.8], open_below)) < 1e-12
        got = {(r.obj, r.i, r.j, r.k): r.score for r in Q.scale_scores(table, half, 0.7, open_below, steps, block=7).collect()}
        assert len(got) == 2 * 27
        for (o, i, j, k), score in got.items():
            h = half[o - 1] * [steps[i], steps[j], steps[k]]
            want = sum(r[7] * np.exp(-plain_distance2(np.array(r[1:4]), h, open_below) / 0.49) for r in rows if r[0] == o)
            assert abs(score - want) < 1e-9


def test_rescaled_ties_and_least(spark):
    scores = spark.createDataFrame([(1, 2, 1, 0, 5.0), (1, 1, 2, 0, 5.0), (1, 0, 0, 0, 4.0), (2, 0, 0, 0, 0.0)], "obj int, i int, j int, k int, score double")
    out = Q.rescaled(np.array([[1.0, 1.0, 0.015], [2.0, 2.0, 2.0]]), scores, (0.5, 1.0, 1.5))
    assert np.allclose(out, [[1.0, 1.5, 0.015], [2.0, 2.0, 2.0]])


def test_truncation_against_plain_rule(spark):
    r = np.random.default_rng(5)
    points = spark.createDataFrame([(f, *map(float, r.normal(0, 1, 3))) for f in (0, 1) for _ in range(21)], "frame_id int, x double, y double, z double")
    m = Q.Boxes(np.array([[0.5, 0.6, 0.7], [1.0, 0.4, 0.9]]), np.array([1.5, 0.8]), np.full(2, 0.5), {(f, o): (np.eye(3), np.full(3, 0.3 * o)) for f in (0, 1) for o in (1, 2)})
    got = sorted((x.frame_id, x.obj, round(x.a, 9)) for x in Q.truncated(Q.shared_out(points, m, 0.1), 0.1).collect())
    want = []
    for f in (0, 1):
        v = np.array([[p.x, p.y, p.z] for p in points.where(F.col("frame_id") == f).collect()])
        a = np.array([[np.exp(-0.5 * m.w[o] * plain_distance2(p - 0.3 * (o + 1), m.half[o], True)) * m.w[o] ** 1.5 + Q.EPS for o in (0, 1)] for p in v])
        a /= 1.1 * a.sum(1, keepdims=True)
        a = np.where(a < np.median(a, axis=0), 0, a) + Q.EPS
        a /= 1.1 * a.sum(1, keepdims=True)
        want += [(f, o + 1, round(float(x), 9)) for o in (0, 1) for x in a[:, o]]
    assert got == sorted(want)


def surface(half, n, seed):
    """Points on the sides and the top."""
    r = np.random.default_rng(seed)
    out = []
    for axis, sign in ((0, -1), (0, 1), (1, -1), (1, 1), (2, 1)):
        p = r.uniform(-1, 1, (n, 3)) * half
        p[:, axis] = sign * half[axis]
        out.append(p)
    return np.concatenate(out)


def test_planted_boxes_are_found(spark):
    true = np.array([[1.0, 0.5, 0.6], [0.4, 0.8, 1.1]])
    rows, poses, start = [], {}, {}
    turn = lambda t: np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
    for f in range(3):
        for o, at in ((1, [0.0, 0.5 * f, 0.6]), (2, [4.0 + f, 1.0, 1.1])):
            poses[f, o] = (turn(0.4 * f + o), np.array(at))
            start[f, o] = (turn(0.4 * f + o + 0.12), np.array(at) + [0.1, -0.08, 0.05])
            rows += [(f, *map(float, v)) for v in surface(true[o - 1], 60, 10 * f + o) @ poses[f, o][0].T + at]
    points = spark.createDataFrame(rows, "frame_id int, x double, y double, z double")
    m = Q.fit(points, Q.Boxes(true * [[1.3, 0.8, 1.2], [0.8, 1.25, 0.8]], np.full(2, 4.0), np.full(2, 0.5), start), 6, reach=0.4)
    assert np.abs(m.half / true - 1).max() < 0.12
    for key, (r, t) in poses.items():
        got, at = m.poses[key]
        assert np.arccos(min(1.0, float((got[:2, :2] * r[:2, :2]).sum() / 2))) < 0.12
        assert np.abs(at - t).max() < 0.15
    assert m.trace[-1] > m.trace[0]


def test_no_points(spark):
    m = Q.fit(spark.createDataFrame([], "frame_id int, x double, y double, z double"), Q.Boxes(np.ones((1, 3)), np.ones(1), np.ones(1), {(0, 1): (np.eye(3), np.zeros(3))}), 2)
    assert np.allclose(m.half, 1) and m.trace == []
