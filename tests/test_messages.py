"""Sequential messages against all labellings of small graphs: bounds, energies, trees, cost kinds, and many graphs at once."""

import itertools

import numpy as np
import pytest

from cloudloom.operators import messages as M


def optimum(cost, edges, w, v):
    return min(M.total_cost(cost, edges, w, v, np.array(x)) for x in itertools.product(range(cost.shape[1]), repeat=len(cost)))


def graph(r, n, m, share=0.5):
    edges = np.array([(b, a) if r.random() < 0.3 else (a, b) for a in range(n) for b in range(a + 1, n) if r.random() < share], np.int64).reshape(-1, 2)
    return r.uniform(0, 2, (n, m)), edges, r.uniform(0.1, 1.5, len(edges))


@pytest.mark.parametrize("kind", ["potts", "l1", "l2", "matrix"])
def test_bound_and_energy_enclose_the_optimum(kind):
    r = np.random.default_rng(3)
    for _ in range(25):
        m = int(r.integers(2, 4))
        cost, edges, w = graph(r, int(r.integers(2, 7)), m)
        v = M.smoothness(m, kind, 1.5, r.uniform(0, 1, (m, m)))
        label, energy, bounds = M.passes(cost, edges, w, v)
        best = optimum(cost, edges, w, v)
        assert np.isclose(energy, M.total_cost(cost, edges, w, v, label)) and energy >= best - 1e-9
        assert bounds[-1] <= best + 1e-9
        assert all(b >= a - 1e-9 for a, b in zip(bounds, bounds[1:]))
        assert M.passes(cost, edges, w, v, reweighted=False)[1] >= best - 1e-9


def test_trees_are_solved():
    r = np.random.default_rng(5)
    for _ in range(20):
        n, m = 7, 3
        edges = np.array([(k, int(r.integers(k))) for k in range(1, n)], np.int64)
        cost, w, v = r.uniform(0, 2, (n, m)), r.uniform(0.1, 2, n - 1), M.smoothness(m, "l1", 1.5)
        best = optimum(cost, edges, w, v)
        _, energy, bounds = M.passes(cost, edges, w, v, rounds=200)
        assert np.isclose(energy, best) and np.isclose(bounds[-1], best, atol=1e-6)
        assert np.isclose(M.passes(cost, edges, w, v, reweighted=False)[1], best)


def test_graphs(spark):
    r = np.random.default_rng(8)
    costs, edges, want = [], [], {}
    for g in range(4):
        c, e, w = graph(r, 5, 3, 0.6 if g else 0.0)
        costs += [(g, 10 * k + 1, j, float(c[k, j])) for k in range(5) for j in range(3)]
        edges += [(g, int(a) * 10 + 1, int(b) * 10 + 1, float(x)) for (a, b), x in zip(e, w)] + [(g, 1, 999, 5.0), (g, 1, 1, 3.0)]
        want[g] = M.passes(c, e, w, M.smoothness(3))
    left, right = spark.createDataFrame(costs, "frame_id int, sv long, label int, cost double"), spark.createDataFrame(edges, "frame_id int, a long, b long, w double")
    labels, graphs = M.solve(left, right)
    for row in graphs.collect():
        label, energy, bounds = want[row.frame_id]
        assert np.isclose(row.energy, energy) and np.isclose(row.bound, bounds[-1]) and row.nodes == 5
        assert [x.label for x in labels.where(f"frame_id = {row.frame_id}").orderBy("sv").collect()] == label.tolist()
    assert M.solve(left, right, reweighted=False)[1].where("bound IS NOT NULL").count() == 0
    assert M.solve(left.where("false"), right)[0].count() == 0
