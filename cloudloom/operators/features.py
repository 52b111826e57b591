"""Features of points, graphs and patches: sums in Spark, eigenproblems and paths per frame in NumPy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cloudloom.operators import linalg as L
from cloudloom.sources.shared import written

FRAME = ("frame_id",)


@F.pandas_udf(ArrayType(DoubleType()))
def least_axis(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
    """The eigenvector of the least eigenvalue of each 3 x 3 scatter, and the root of that value: all rows at once."""
    m = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1).astype(float)
    values, vectors = np.linalg.eigh(m)
    out = np.concatenate([vectors[:, :, 0], np.sqrt(np.maximum(values[:, :1], 0))], axis=1)
    return pd.Series(list(out))


def neighbour_scatter(points: DataFrame, neighbours: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """The scatter of each point's neighbours about the point itself."""
    p = points.select(*by, "pt_id", "x", "y", "z")
    q = points.select(*by, F.col("pt_id").alias("nb"), *[F.col(c).alias("q" + c) for c in "xyz"])
    d = {c: F.col("q" + c) - F.col(c) for c in "xyz"}
    sums = [F.sum(d[a] * d[b]).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return neighbours.join(p, [*by, "pt_id"]).join(q, [*by, "nb"]).groupBy(*by, "pt_id", "x", "y", "z").agg(F.count(F.lit(1)).alias("n"), *sums)


def point_normals(points: DataFrame, neighbours: DataFrame, by: Sequence[str] = FRAME, least: int = 4) -> DataFrame:
    """Normals turned to the origin, and curvature; null for fewer than ``least`` neighbours."""
    s = neighbour_scatter(points, neighbours, by).withColumn("e", least_axis("xx", "xy", "xz", "yy", "yz", "zz"))
    ok = F.col("n") >= least
    n = [F.col("e")[i] for i in range(3)]
    away = n[0] * F.col("x") + n[1] * F.col("y") + n[2] * F.col("z") > 0
    turn = lambda c: F.when(ok, F.when(away, -c).otherwise(c))
    return s.select(*by, "pt_id", *[turn(c).alias("n" + a) for c, a in zip(n, "xyz", strict=True)], F.when(ok, F.col("e")[3]).alias("curvature"))


def by_graph(nodes: DataFrame, edges: DataFrame, run, schema: str, by: Sequence[str] = FRAME) -> DataFrame:
    """``run(sv numbers, node table, edge index pairs, edge table) -> table`` for each frame's graph."""

    def call(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("sv").reset_index(drop=True)
        sv = left.sv.to_numpy()
        right = right[right.a.isin(sv) & right.b.isin(sv)]
        pairs = np.stack([np.searchsorted(sv, right[c].to_numpy()) for c in "ab"], 1).astype(np.int64)
        out = run(left, pairs, right)
        for b in reversed(by):
            out.insert(0, b, left[b].iloc[0] if len(left) else None)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    return nodes.groupBy(*by).cogroup(edges.toDF(*edges.columns).groupBy(*by)).applyInPandas(call, ", ".join(f"{b} {kinds[b]}" for b in by) + ", " + schema)


def lengths(nodes: pd.DataFrame, pairs: np.ndarray) -> np.ndarray:
    xyz = nodes[["cx", "cy", "cz"]].to_numpy(float)
    return np.linalg.norm(xyz[pairs[:, 0]] - xyz[pairs[:, 1]], axis=1)


def part_sizes(n: int, pairs: np.ndarray) -> np.ndarray:
    """How many nodes the part of each node of a graph has."""
    first, to, _ = L.neighbours(n, pairs)
    out = np.zeros(n, np.int64)
    for layers in L.parted(n, first, to):
        rows = np.concatenate(layers)
        out[rows] = len(rows)
    return out


def average_geodesic(nodes: DataFrame, edges: DataFrame, far: float = 3.4028234663852886e38, parts: int = 8) -> DataFrame:
    """Mean of the positive path lengths of each supervoxel; ``far`` stands for unreachable ones.

    Where a graph has several parts and ``far`` is so great that all real lengths together are lost in rounding beside it, a mean is known
    from the sizes of parts. For other graphs all paths are needed, a graph's nodes squared: such a graph goes to ``parts`` tasks, each
    with its share of the sources, some at a time, so memory grows with the nodes.
    """
    share = F.explode(F.array(*[F.lit(i) for i in range(parts)]))

    def known(n: pd.DataFrame, pairs: np.ndarray, _: pd.DataFrame) -> pd.DataFrame:
        d, found = lengths(n, pairs), np.full(len(n), np.nan)
        lost = len(n) - part_sizes(len(n), pairs)
        if (lost > 0).all() and far > 2.0**56 * len(n) * d.sum():
            found = far * lost / (len(n) - part_sizes(len(n), pairs[d == 0]))
        return pd.DataFrame({"sv": n.sv, "agd": found})

    def run(n: pd.DataFrame, pairs: np.ndarray, _: pd.DataFrame) -> pd.DataFrame:
        own = np.arange(int(n.part.iloc[0]) if len(n) else 0, len(n), parts)
        paths, out = L.path_sweeps(len(n), pairs, lengths(n, pairs)), np.zeros(len(own))
        step = int(np.clip(4_000_000 // max(1, len(n)), 8, 256))
        for i in range(0, len(own), step):
            d = paths(own[i : i + step])
            d[np.isinf(d)] = far
            positive = d > 0
            out[i : i + step] = np.where(positive.any(1), (d * positive).sum(1) / np.maximum(positive.sum(1), 1), 0.0)
        return pd.DataFrame({"sv": n.sv.to_numpy()[own], "agd": out})

    nodes, edges = nodes.select(*FRAME, "sv", "cx", "cy", "cz"), edges.select(*FRAME, "a", "b")
    nodes = written(nodes)
    done = written(by_graph(nodes, edges, known, "sv long, agd double"))
    left = written(done.where("agd IS NULL OR isnan(agd)").select(*FRAME).distinct())  # at most a row per frame
    done = done.where("agd IS NOT NULL AND NOT isnan(agd)")
    if left.isEmpty():
        return done
    # little is read for much work: without a given number, the parts of a graph would be put into one task again
    tasks = 4 * nodes.sparkSession.sparkContext.defaultParallelism
    dealt = [df.join(F.broadcast(left), list(FRAME), "left_semi").withColumn("part", share).repartition(tasks, *FRAME, "part") for df in (nodes, edges)]
    return done.unionByName(by_graph(*dealt, run, "sv long, agd double", (*FRAME, "part")).drop("part"))


def relaxed_paths(edges: DataFrame, sources: DataFrame, rounds: int, by: Sequence[str] = FRAME) -> DataFrame:
    """Path lengths by joins: (by, src, sv, d) after ``rounds`` relaxations; ``edges(by, a, b, d)``, ``sources(by, src)``."""
    both = edges.select(*by, "a", "b", "d").union(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    at = sources.select(*by, "src", F.col("src").alias("sv"), F.lit(0.0).alias("d"))
    for _ in range(rounds):
        step = at.withColumnRenamed("d", "so_far").join(both.withColumnRenamed("a", "sv"), [*by, "sv"]).select(*by, "src", F.col("b").alias("sv"), (F.col("so_far") + F.col("d")).alias("d"))
        at = at.union(step).groupBy(*by, "src", "sv").agg(F.min("d").alias("d"))
    return at


def geodesic_coordinates(nodes: DataFrame, edges: DataFrame, picks: int = 3) -> DataFrame:
    """1 / (1 + d) to each of the first ``picks`` supervoxels."""

    def run(n: pd.DataFrame, pairs: np.ndarray, _: pd.DataFrame) -> pd.DataFrame:
        chosen = list(range(min(picks, len(n))))
        d = L.shortest_paths(len(n), pairs, lengths(n, pairs), chosen)
        return pd.DataFrame({"sv": n.sv, "coordinate": list((1 / (1 + d)).T)})

    return by_graph(nodes, edges, run, "sv long, coordinate array<double>")


def heat_kernel(nodes: DataFrame, edges: DataFrame, k: int = 200, kept: int = 6) -> DataFrame:
    """Scale-invariant heat kernel signature: log of the kernel over logarithmic times, differences, first Fourier magnitudes."""

    def run(n: pd.DataFrame, pairs: np.ndarray, e: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sv": n.sv, "hks": list(heat_signatures(len(n), pairs, e.w.to_numpy(float), k, kept))})

    return by_graph(nodes, edges, run, "sv long, hks array<double>")


def heat_signatures(n: int, pairs: np.ndarray, w: np.ndarray, k: int, kept: int) -> np.ndarray:
    """A row of ``kept`` numbers for each node. Vectors stay with their part, and kernels (385 times a node) are made for 4096 nodes at once."""
    values, vectors, _ = L.part_vectors(n, pairs, w, k)
    times = 2.0 ** np.arange(1, 25 + 1 / 32, 1 / 16)
    fall, out = np.exp(-np.maximum(values, 0)[:, None] * times[None]), np.zeros((n, kept))
    parts: dict[int, list[int]] = {}
    for j, (rows, _) in enumerate(vectors):
        parts.setdefault(id(rows), []).append(j)
    for own in parts.values():
        rows = vectors[own[0]][0]
        for i in range(0, len(rows), 4096):
            heat = np.stack([vectors[j][1][i : i + 4096] for j in own], 1) ** 2 @ fall[own]
            steps = np.diff(np.log(np.maximum(heat, 1e-300)), axis=1)
            out[rows[i : i + 4096]] = np.abs(np.fft.fft(steps, axis=1)[:, :kept])
    return out


def code_words(features: DataFrame, value: str, k: int, rounds: int = 10, seed: int = 1, sample: int = 5000) -> np.ndarray:
    """A codebook by k-means: starts from a bounded sample, then Lloyd steps as Spark aggregations over all rows."""
    rows = features.select(value).orderBy(F.xxhash64(F.col(value), F.lit(seed))).limit(sample).collect()
    x = np.array([r[0] for r in rows], float)
    centres = L.kmeans(x, k, 5, seed)[1]
    dims = centres.shape[1]
    for _ in range(rounds):
        assigned = features.withColumn("word", nearest_word(F.col(value), centres))
        mean = assigned.groupBy("word").agg(*[F.avg(F.col(value)[i]).alias(f"m{i}") for i in range(dims)]).collect()  # k rows
        new = centres.copy()
        for r in mean:
            new[r["word"]] = [r[f"m{i}"] for i in range(dims)]
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres


def nearest_word(value: Column, centres: np.ndarray) -> Column:
    """The nearest centre's number, as an expression in the JVM."""
    d = []
    for i, c in enumerate(centres):
        e = F.aggregate(F.zip_with(value, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        d.append(F.struct(e.alias("d"), F.lit(i).alias("i")))
    return F.array_min(F.array(*d))["i"]


def spectral_base(nodes: DataFrame, edges: DataFrame, k: int, kind: str = "N") -> DataFrame:
    """The first eigenvectors of each frame's graph: ``N`` normalised, ``M`` plain, ``G`` scaled by 1 / sqrt(value)."""

    def run(n: pd.DataFrame, pairs: np.ndarray, e: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sv": n.sv, "base": list(decomposed(len(n), pairs, e.w.to_numpy(float), k, kind)[0])})

    return by_graph(nodes, edges, run, "sv long, base array<double>")


def decomposed(n: int, pairs: np.ndarray, w: np.ndarray, k: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, degrees) of a graph of ``n`` nodes with weights ``w`` of ``pairs``, and 1 of each node with itself."""
    values, vectors, d = L.graph_eigen(n, pairs, w, k + 1, scaled=kind == "N")
    if kind == "N":
        vectors = vectors / np.sqrt(np.maximum(d, 1e-300))[:, None]
    keep = values > 1e-9
    vectors = vectors[:, keep][:, :k]
    return vectors / np.sqrt(values[keep][:k]) if kind == "G" else vectors, d


def spectral_cut(nodes: DataFrame, edges: DataFrame, k: int = 8, clusters: int = 6, kind: str = "G", method: str = "kmeans", seed: int = 1) -> DataFrame:
    """Clusters in the spectral base: k-means, a grown mixture, or repeated bisection by the least normalised cut."""

    def run(n: pd.DataFrame, pairs: np.ndarray, e: pd.DataFrame) -> pd.DataFrame:
        w = e.w.to_numpy(float)
        if method == "bisection":
            label = bisected(len(n), pairs, w, clusters)
        else:
            base = decomposed(len(n), pairs, w, min(k, len(n) - 1), kind)[0] if len(n) > 1 else np.zeros((len(n), 1))
            base = base if base.shape[1] else np.zeros((len(n), 1))
            label = L.kmeans(base, clusters, 50, seed)[0] if method == "kmeans" else L.grown_gmm(base, clusters, seed=seed)["p"].argmax(1)
        return pd.DataFrame({"sv": n.sv, "label": (label + 1).astype(np.int32)})

    return by_graph(nodes, edges, run, "sv long, label int")


def bisected(n: int, pairs: np.ndarray, w: np.ndarray, clusters: int) -> np.ndarray:
    label = np.zeros(n, int)
    for new in range(1, clusters):
        part = np.bincount(label).argmax()
        at = np.flatnonzero(label == part)
        if len(at) < 4:
            break
        place = np.full(n, -1)
        place[at] = np.arange(len(at))
        own = (place[pairs] >= 0).all(1)
        inner, weight = place[pairs[own]], w[own]
        v, d = decomposed(len(at), inner, weight, 1, "N")
        if not v.shape[1]:
            break
        best, cut = None, np.inf
        for th in np.quantile(v[:, 0], np.linspace(0.1, 0.9, 17)):
            s = v[:, 0] > th
            if s.any() and not s.all():
                across = weight[s[inner[:, 0]] != s[inner[:, 1]]].sum()
                c = across / d[s].sum() + across / d[~s].sum()
                if c < cut:
                    best, cut = s, c
        if best is None:
            break
        label[at[best]] = new
    return label


def within_two(n: int, pairs: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Pairs a < b of nodes that are linked or have a neighbour in common, in order; some rows of the graph at a time."""
    loops = np.arange(n)
    first, to, _ = L.neighbours(n, np.concatenate([pairs, np.stack([loops, loops], 1)]))
    found = []
    for i in range(0, n, rows):
        own = loops[i : i + rows]
        one = np.repeat(own, np.diff(first)[own])
        mid = to[L.spread(first, own)]
        one, end = np.repeat(one, np.diff(first)[mid]), to[L.spread(first, mid)]
        found.append(np.unique((one * n + end)[end > one]))
    every = np.concatenate(found) if found else np.zeros(0, np.int64)
    return np.stack([every // n, every % n], 1)


def robust_regions(nodes: DataFrame, edges: DataFrame, runs: int = 8, k: int = 6, seed: int = 1) -> DataFrame:
    """Consensus of spectral cuts with different seeds: co-association on edges and two-hop edges, then evidence accumulation."""

    def run(n: pd.DataFrame, pairs: np.ndarray, e: pd.DataFrame) -> pd.DataFrame:
        w = e.w.to_numpy(float)
        base = decomposed(len(n), pairs, w, min(8, max(1, len(n) - 1)), "G")[0]
        base = base if base.shape[1] else np.zeros((len(n), 1))
        votes = np.stack([L.kmeans(base, int(np.random.default_rng(seed + i).integers(max(2, k - 2), k + 3)), 30, seed + i)[0] for i in range(runs)])
        linked = within_two(len(n), pairs[w > 0])
        share = (votes[:, linked[:, 0]] == votes[:, linked[:, 1]]).mean(0)
        label = L.peac(len(n), linked, share, k, seed=seed)
        return pd.DataFrame({"sv": n.sv, "label": label.astype(np.int32)})

    return by_graph(nodes, edges, run, "sv long, label int")
