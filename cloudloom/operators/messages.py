"""Sequential message passing on graphs with pairwise costs: tree-reweighted (TRW-S, with a lower bound) and belief propagation (BP-S).

Nodes are visited in order, forwards then backwards; a visit passes messages to the neighbours ahead. The order makes a graph's
passes one sequence, so a graph (a frame, or a patch of one) is one task's work; graphs are dealt over the cluster. Nodes that don't
wait for one another are a wave and visited at once, which gives what visits one by one would; a graph is held as flat arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.sources.shared import written


def smoothness(labels: int, kind: str = "potts", most: float = 1.0, matrix: Sequence[Sequence[float]] | None = None) -> np.ndarray:
    """Costs of label pairs: ``potts``, ``l1`` or ``l2`` cut off at ``most``, or a given ``matrix``; an edge's weight scales them."""
    if kind == "matrix":
        return np.array(matrix, float)
    away = np.abs(np.subtract.outer(np.arange(labels), np.arange(labels))).astype(float)
    costs = {"potts": (away > 0) * 1.0, "l1": np.minimum(away, most), "l2": np.minimum(away**2, most)}
    return costs[kind]


def total_cost(cost: np.ndarray, edges: np.ndarray, w: np.ndarray, v: np.ndarray, label: np.ndarray) -> float:
    return float(cost[np.arange(len(label)), label].sum() + (w * v[label[edges[:, 0]], label[edges[:, 1]]]).sum())


def passes(cost: np.ndarray, edges: np.ndarray, w: np.ndarray, v: np.ndarray, rounds: int = 50, reweighted: bool = True, tolerance: float = 1e-9) -> tuple[np.ndarray, float, list[float]]:
    """Labels of the least energy met, that energy, and the lower bound after each round (empty without ``reweighted``).

    ``v[a, b]`` times an edge's weight is the cost of label a at its first and b at its second end. Ends of an edge are places in
    ``cost``; rounds end when neither bound nor energy moves. Each message is kept with its least entry zero; what is
    taken off in a backward pass adds up to the bound.
    """
    n, m = cost.shape
    if not n:
        return np.zeros(0, int), 0.0, []
    v = np.asarray(v, float)
    ends, weight = edges, w
    sound = edges[:, 0] != edges[:, 1]
    edges, w = edges[sound], np.asarray(w, float)[sound]
    flip = edges[:, 0] > edges[:, 1]
    low, high = edges.min(1, initial=n).astype(np.int32), edges.max(1, initial=-1).astype(np.int32)
    rank, bounds_of = waves(n, low, high)
    # edges lie by the wave and number of their earlier end; ``back`` has them by their later end
    order = np.lexsort((low, rank[low]))
    low, high, w, flip = low[order], high[order], w[order], flip[order].astype(np.int8)
    behind = np.lexsort((order, high, rank[high])).astype(np.int32)
    gamma = 1 / np.maximum(1, np.maximum(np.bincount(low, minlength=n), np.bincount(high, minlength=n))) if reweighted else np.ones(n)
    nodes = np.argsort(rank, kind="stable").astype(np.int32)
    at = np.searchsorted(rank[nodes], np.arange(bounds_of + 1))
    out_at, in_at = np.searchsorted(rank[low], np.arange(bounds_of + 1)), np.searchsorted(rank[high[behind]], np.arange(bounds_of + 1))
    place = np.empty(n, np.int32)
    place[nodes] = np.arange(n) - at[rank[nodes]]
    pair, column = np.stack([v, v.T]), np.arange(m)
    up, down = np.zeros((len(low), m)), np.zeros((len(low), m))  # to the later end, to the earlier one
    best, least, bounds = cost.argmin(1), total_cost(cost, ends, weight, v, cost.argmin(1)), []

    def added(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
        return np.bincount((rows[:, None] * m + column).ravel(), values.ravel(), count * m).reshape(count, m)

    def wave(k: int) -> tuple:
        own, out, into = nodes[at[k] : at[k + 1]], slice(out_at[k], out_at[k + 1]), behind[in_at[k] : in_at[k + 1]]
        return own, out, into, place[low[out]], place[high[into]]

    def sums(own, out, into, low_at, high_at) -> np.ndarray:
        h = cost[own]
        if len(into):
            h = h + added(high_at, up[into], len(own))
        return h + added(low_at, down[out], len(own)) if out.stop > out.start else h

    for _ in range(rounds):
        before = (least, bounds[-1] if bounds else None)
        label = np.zeros(n, int)
        for k in range(bounds_of):
            own, out, into, low_at, high_at = wave(k)
            ahead = out.stop > out.start
            if ahead:
                h = sums(own, out, into, low_at, high_at)
                h = (h - h.min(1, keepdims=True)) * gamma[own][:, None]
                new = ((h[low_at] - down[out])[:, :, None] + w[out, None, None] * pair[flip[out]]).min(1)
                up[out] = new - new.min(1, keepdims=True)
            h = cost[own]
            if ahead:
                h = h + added(low_at, down[out], len(own))
            if len(into):
                h = h + added(high_at, w[into, None] * pair[flip[into], label[low[into]]], len(own))
            label[own] = h.argmin(1)
        taken = np.zeros(n)
        for k in reversed(range(bounds_of)):
            own, out, into, low_at, high_at = wave(k)
            h = sums(own, out, into, low_at, high_at)
            off = h.min(1)
            if len(into):
                h = (h - off[:, None]) * gamma[own][:, None]
                new = ((h[high_at] - up[into])[:, :, None] + w[into, None, None] * pair[1 - flip[into]]).min(1)
                less = new.min(1)
                down[into] = new - less[:, None]
                off = np.bincount(np.concatenate([np.arange(len(own)), high_at]), np.concatenate([off, less]), len(own))
            taken[own] = off
        energy = total_cost(cost, ends, weight, v, label)
        if energy < least:
            best, least = label, energy
        if reweighted:
            bounds.append(float(sum(taken[::-1].tolist())))
        if before[0] - least <= tolerance and (not reweighted or before[1] is not None and bounds[-1] - before[1] <= tolerance):
            break
    return best, least, bounds


def waves(n: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, int]:
    """Each node's wave, and how many there are: a node is in a later wave than all its neighbours of lesser number."""
    order = np.argsort(low, kind="stable")
    first, to = np.searchsorted(low[order], np.arange(n + 1)), high[order]
    waits, rank = np.bincount(high, minlength=n), np.zeros(n, np.int32)
    now, k = np.flatnonzero(waits == 0), 0
    while len(now):
        rank[now] = k
        met = to[spans(first[now], first[now + 1])]
        now, times = np.unique(met, return_counts=True)
        waits[now] -= times
        now, k = now[waits[now] == 0], k + 1
    return rank, k


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0] .. stop[0] - 1, start[1] .. and so on, in one array."""
    count = stop - start
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def as_arrays(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, labels, costs of each node and label, edges as places of nodes, weights); edges with an end without costs are left out."""
    sv, label = np.unique(left.sv.to_numpy()), np.unique(left.label.to_numpy())
    cost = np.full((len(sv), len(label)), np.nan)
    cost[np.searchsorted(sv, left.sv.to_numpy()), np.searchsorted(label, left.label.to_numpy())] = left.cost.to_numpy(float)
    if not len(sv) or not len(right):
        return sv, label, cost, np.zeros((0, 2), np.int32), np.zeros(0)
    pairs = np.empty((len(right), 2), np.int32)
    known = np.ones(len(right), bool)
    for i, c in enumerate("ab"):
        end = right[c].to_numpy()
        pairs[:, i] = np.minimum(np.searchsorted(sv, end), len(sv) - 1)
        known &= sv[pairs[:, i]] == end
    return sv, label, cost, pairs[known], right.w.to_numpy(float)[known]


def solve(costs: DataFrame, edges: DataFrame, reweighted: bool = True, kind: str = "potts", most: float = 1.0, matrix: Sequence[Sequence[float]] | None = None,
          rounds: int = 50, by: Sequence[str] = ("frame_id",)) -> tuple[DataFrame, DataFrame]:
    """(labels(by, sv, label), graphs(by, nodes, rounds, energy, bound)). ``costs(by, sv, label, cost)``, ``edges(by, a, b, w)``.

    The bound is null without ``reweighted``. Edges with an end that has no costs are left out; a graph without edges is solved by its costs.
    """
    by = list(by)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[*by, "sv", "label", "rounds", "energy", "bound"])
        sv, names, cost, pairs, w = as_arrays(left, right[right.a != right.b])
        label, energy, bounds = passes(cost, pairs, w, smoothness(len(names), kind, most, matrix), rounds, reweighted)
        out = pd.DataFrame({"sv": sv, "label": names[label], "rounds": len(bounds), "energy": energy, "bound": bounds[-1] if bounds else None})
        for b in reversed(by):
            out.insert(0, b, left[b].iloc[0])
        return out

    kinds = {f.name: f.dataType.simpleString() for f in costs.schema}
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", sv long, label int, rounds int, energy double, bound double"
    found = written(costs.groupBy(*by).cogroup(edges.toDF(*edges.columns).groupBy(*by)).applyInPandas(run, schema))
    graphs = found.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"), F.max("rounds").alias("rounds"), F.max("energy").alias("energy"), F.max("bound").alias("bound"))
    return found.select(*by, "sv", "label"), graphs
