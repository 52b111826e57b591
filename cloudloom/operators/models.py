"""Object models and the iterative pipeline: patches are unified across frames, objects are built, labels are cut anew."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import aggregates as A
from cloudloom.operators import linalg as L
from cloudloom.operators import relational as R


def greedy_match(score: np.ndarray) -> np.ndarray:
    """Repeatedly takes the greatest score and drops its row and column: the column of each row, or -1."""
    score, out = score.astype(float).copy(), np.full(len(score), -1)
    for _ in range(min(score.shape)):
        i, j = np.unravel_index(score.argmax(), score.shape)
        if score[i, j] == -np.inf:
            break
        out[i] = j
        score[i], score[:, j] = -np.inf, -np.inf
    return out


def size_match(sizes: Sequence[float], prior: Sequence[float]) -> list[int]:
    """Each segment's object: segments, largest first, fill the objects with the largest shares left."""
    left = np.array(prior, float) / sum(prior)
    share = np.array(sizes, float) / sum(sizes)
    out = [0] * len(sizes)
    for i in np.argsort(-share, kind="stable"):
        j = int(left.argmax())
        out[i], left[j] = j, left[j] - share[i]
    return out


def unify_labels(features: DataFrame, dims: int = 2, rounds: int = 20) -> DataFrame:
    """Patch features (frame_id, label, feature) → mapping (frame_id, label, to): the patches of all frames are matched to shared clusters.

    There is a row per patch, not per point: features come to the driver.
    """
    rows = features.orderBy("frame_id", "label").collect()
    if not rows:
        return features.sparkSession.createDataFrame([], "frame_id int, label int, to int")
    x = np.array([r["feature"] for r in rows], float)
    flat = L.pca(x, min(dims, x.shape[1]))[2]
    frames = np.array([r["frame_id"] for r in rows])
    most = np.bincount(np.unique(frames, return_inverse=True)[1]).argmax()
    start = flat[frames == np.unique(frames)[most]]
    centres = L.kmeans(flat, len(start), rounds, start=start)[1]
    out = []
    for f in np.unique(frames):
        at = np.flatnonzero(frames == f)
        match = greedy_match(np.exp(-np.linalg.norm(flat[at][:, None] - centres[None], axis=2)))
        out += [(int(f), int(rows[i]["label"]), int(j) + 1) for i, j in zip(at, match, strict=True) if j >= 0]
    return features.sparkSession.createDataFrame(out, "frame_id int, label int, to int")


def class_base(rows: DataFrame, dims: Sequence[str], d: int, label: str = "label") -> np.ndarray:
    """Discriminant base of labelled rows: scatters in Spark, a small eigenproblem here."""
    between, within = A.class_scatter(rows, dims, label)
    n = len(dims)
    m = [np.zeros((n, n)), np.zeros((n, n))]
    for k, df in enumerate((between, within)):
        for r in df.collect():  # n x n entries
            m[k][r["i"], r["j"]] = r["v"]
    return L.lda(m[0], m[1], d)


def scatter_matrix(entries: DataFrame, n: int) -> np.ndarray:
    """Entries (i, j, v) as a matrix, on the driver: n x n numbers."""
    m = np.zeros((n, n))
    for r in entries.collect():
        m[r["i"], r["j"]] = r["v"]
    return m


def hierarchy(points: DataFrame, angle: float = 0.95, near: float = 0.5, least: int = 20) -> DataFrame:
    """Planes and the objects on them, frame by frame: (frame_id, pt_id, node, parent, is_obj).

    Points of like normals are split into connected parts; a part is a plane if it is flat, and of the rest each connected part
    is an object of the largest plane below it.
    """

    def parts(xyz: np.ndarray) -> np.ndarray:
        cells, at = np.unique(np.floor(xyz / near).astype(int), axis=0, return_inverse=True)
        at = at.ravel()
        index = {tuple(c): i for i, c in enumerate(cells)}
        root = np.arange(len(cells))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
        for i, c in enumerate(cells):
            for s in steps:
                j = index.get((c[0] + s[0], c[1] + s[1], c[2] + s[2]))
                if j is not None:
                    root[find(i)] = find(j)
        return np.array([find(i) for i in range(len(cells))])[at]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz, n = pdf[["x", "y", "z"]].to_numpy(float), pdf[["nx", "ny", "nz"]].to_numpy(float)
        node, parent, is_obj = np.zeros(len(pdf), int), np.zeros(len(pdf), int), np.zeros(len(pdf), bool)
        up = np.abs(n[:, 2]) >= angle
        count, planes = 0, []
        flat = np.flatnonzero(up)
        if len(flat):
            which = parts(xyz[flat] * [1, 1, 4])
            for p in np.unique(which):
                at = flat[which == p]
                if len(at) >= least:
                    count += 1
                    node[at] = count
                    planes.append((count, len(at), xyz[at, 2].mean()))
        rest = np.flatnonzero(node == 0)
        if len(rest):
            which = parts(xyz[rest])
            for p in np.unique(which):
                at = rest[which == p]
                if len(at) >= least:
                    count += 1
                    node[at], is_obj[at] = count, True
                    below = [q for q in planes if q[2] <= xyz[at, 2].mean()] or planes
                    parent[at] = max(below, key=lambda q: q[1])[0] if below else 0
        return pd.DataFrame({"frame_id": pdf.frame_id, "pt_id": pdf.pt_id, "node": node.astype(np.int32), "parent": parent.astype(np.int32), "is_obj": is_obj})

    return points.groupBy("frame_id").applyInPandas(run, "frame_id int, pt_id long, node int, parent int, is_obj boolean")


def full_model(points: DataFrame, neighbours: DataFrame, spacing: DataFrame) -> DataFrame:
    """Points of another view join a model if their nearest model point is at least the point's own spacing away."""
    return points.join(neighbours.select("frame_id", "pt_id", "d2"), ["frame_id", "pt_id"], "left").join(spacing.select("frame_id", "pt_id", F.col("d2").alias("own")), ["frame_id", "pt_id"], "left").where("d2 IS NULL OR own IS NULL OR d2 >= own")


def loop(points: DataFrame, segment: Callable[[DataFrame], DataFrame], feature: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame], rounds: int, folder: str) -> DataFrame:
    """Segment once, then unify and refine labels again and again; each step is a table in ``folder`` (the shared one)."""
    spark = points.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    state = kept(segment(points), "segments")
    for i in range(rounds):
        mapping = unify_labels(feature(state.where("label > 0")))
        state = kept(R.alter_label(state, F.broadcast(mapping), by=("frame_id",)), f"unified{i}")
        state = kept(refine(state), f"refined{i}")
    return state
