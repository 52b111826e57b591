"""Generalised singular values: the identities, singular and full scatter, and factors over many partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import discriminant as D


@pytest.mark.parametrize("a,b", [
    ([[1, 2, 3], [3, 2, 1], [4, 5, 6], [7, 8, 8]], [[-2, -3, 3], [4, 6, 5]]),
    ([[1, 2, 3]], [[0, 1, 1], [2, 1, 0], [1, 1, 1], [0, 0, 3]]),
    ([[1, 0, 0, 0], [2, 0, 0, 0]], [[0, 1, 0, 0], [0, 2, 0, 0]]),
    ([[0, 0], [0, 0]], [[1, 2], [2, 4]]),
])
def test_identities(a, b):
    a, b = np.array(a, float), np.array(b, float)
    u, v, c, s, x = D.gsvd(a, b)
    inverse = np.linalg.inv(x)
    assert np.allclose(u @ c @ inverse, a) and np.allclose(v @ s @ inverse, b)
    assert np.allclose(u @ u.T, np.eye(len(a))) and np.allclose(v @ v.T, np.eye(len(b)))
    t = np.linalg.matrix_rank(np.vstack([a, b]))
    assert np.allclose(c.T @ c + s.T @ s, np.diag([1.0] * t + [0.0] * (a.shape[1] - t)))


def table(spark, x, labels):
    return spark.createDataFrame([(int(la), list(map(float, v))) for la, v in zip(labels, x, strict=True)], "label int, f array<double>").repartition(11)


def test_triangle(spark):
    x = np.random.default_rng(1).normal(size=(40, 5)) @ np.diag([1e5, 1, 1e-4, 2, 3])
    r = D.triangle(table(spark, x, [0] * 40), "f", 5)
    assert np.allclose(r.T @ r, x.T @ x, rtol=1e-10) and r.shape == (5, 5)
    few = D.triangle(table(spark, x[:2], [0, 0]), "f", 5)
    assert np.allclose(few.T @ few, x[:2].T @ x[:2])
    assert np.allclose(D.triangle(table(spark, x, [0] * 40).where("label = 9"), "f", 5), 0)


def test_full_rank_equals_eigenproblem(spark):
    r = np.random.default_rng(2)
    labels = r.integers(0, 3, 90)
    x = r.normal(size=(90, 4)) + 3 * r.normal(size=(3, 4))[labels]
    axes = D.discriminant_axes(table(spark, x, labels), "f", 4, 2)
    m = np.array([x[labels == k].mean(0) for k in range(3)])
    sw = sum((x[labels == k] - m[k]).T @ (x[labels == k] - m[k]) for k in range(3))
    sb = sum((labels == k).sum() * np.outer(m[k] - x.mean(0), m[k] - x.mean(0)) for k in range(3))
    values, vectors = np.linalg.eig(np.linalg.solve(sw, sb))
    want = np.real(vectors[:, np.argsort(-np.real(values))[:2]])
    assert np.allclose(np.abs((axes * want / np.linalg.norm(want, axis=0)).sum(0)), 1, atol=1e-8)


def test_singular_scatter_separates(spark):
    """Fewer rows than dimensions: classes fall on single points of the axes."""
    r = np.random.default_rng(3)
    labels = np.repeat([0, 1, 2], 4)
    x = r.normal(size=(12, 30))
    axes = D.discriminant_axes(table(spark, x, labels), "f", 30, 5)
    assert axes.shape == (30, 2)
    p = x @ axes
    inner = max(np.ptp(p[labels == k], axis=0).max() for k in range(3))
    outer = min(np.abs(p[labels == i].mean(0) - p[labels == j].mean(0)).max() for i, j in ((0, 1), (0, 2), (1, 2)))
    assert inner < 1e-8 < outer
    assert D.discriminant_axes(table(spark, x, labels).where(F.col("label") > 5), "f", 30, 2).shape == (30, 0)
