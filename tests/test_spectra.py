"""Lanczos steps over edges against dense eigenproblems: both scalings, parts without links, tiny graphs, several at once."""

import numpy as np
import pytest

from cloudloom.operators import spectra as P


def dense(n, edges, kind):
    w = np.eye(n)
    for a, b, x in edges:
        w[a, b] += x
        w[b, a] += x
    d = w.sum(1)
    m = np.diag(d) - w
    return m / np.sqrt(np.outer(d, d)) if kind == "N" else m


@pytest.mark.parametrize("kind", ["N", "M"])
def test_smallest(spark, kind):
    r = np.random.default_rng(6)
    graphs = {0: (22, {(k, k + 1) for k in range(21)} | {tuple(sorted(map(int, r.choice(22, 2, replace=False)))) for _ in range(20)}), 1: (12, {(k, k + 1) for k in range(11) if k != 4}), 2: (2, {(0, 1)})}
    graphs = {g: (n, [(a, b, float(r.uniform(0.2, 1))) for a, b in sorted(e)]) for g, (n, e) in graphs.items()}
    nodes = spark.createDataFrame([(g, 5 * k) for g, (n, _) in graphs.items() for k in range(n)], "frame_id int, sv long")
    edges = spark.createDataFrame([(g, 5 * a, 5 * b, x) for g, (_, e) in graphs.items() for a, b, x in e], "frame_id int, a long, b long, w double")
    values, vectors = P.smallest(nodes, edges, 3, kind, tolerance=1e-7)
    got, base = {}, {}
    for x in values.collect():
        got.setdefault(x.frame_id, {})[x.i] = (x.value, x.error)
    for x in vectors.collect():
        base.setdefault(x.frame_id, {})[x.sv // 5] = x.base
    for g, (n, e) in graphs.items():
        m = dense(n, e, kind)
        want = np.linalg.eigvalsh(m)[:3]
        assert np.allclose([got[g][i][0] for i in sorted(got[g])], want, atol=1e-6)
        q = np.array([base[g][k] for k in range(n)])
        assert np.allclose(m @ q, q * want, atol=1e-5) and np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-6)


def test_no_graphs(spark):
    nodes = spark.createDataFrame([], "frame_id int, sv long")
    values, vectors = P.smallest(nodes, spark.createDataFrame([], "frame_id int, a long, b long, w double"), 3)
    assert values.count() == 0 and vectors.count() == 0
