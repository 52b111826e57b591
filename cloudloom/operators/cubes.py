"""Boxes of any orientation fitted to scenes by expectation-maximisation: a box for each object, a pose for each frame and object.

A round: points share themselves among the boxes by their distance from the surfaces; each frame's poses follow from the points
near the boxes' corners; then every box tries all combinations of ``STEPS`` of its three sides, scored by sums over the points
of all frames, and takes the best. Points are dealt as they lie: no frame is in one task. Boxes may be open below, as things that
stand on a floor are seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import linalg as L
from cloudloom.operators.starts import Start, blocks, columns_of, moments
from cloudloom.sources.shared import written

STEPS = tuple(round(0.5 + 0.1 * i, 1) for i in range(11))
CORNERS = [(i, j, k) for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)]
EPS = float(np.finfo(float).eps)
NAMES = [f"{c}{i}" for c in "uh" for i in range(3)]


@dataclass
class Boxes:
    """Half sides, inverse variances and weights of objects 1.., poses of (frame, object); local points x are at R x + t."""

    half: np.ndarray
    w: np.ndarray
    p: np.ndarray
    poses: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    trace: list[float] = field(default_factory=list)


def surface_distance2(u: Sequence[Column], h: Sequence[Column], open_below: bool = True) -> Column:
    """Squared distance of a local point from the nearest face of the box with half sides ``h``."""
    out = [F.greatest(F.abs(a) - b, F.lit(0.0)) ** 2 for a, b in zip(u, h, strict=True)]
    face = [(F.abs(a) - b) ** 2 for a, b in zip(u, h, strict=True)]
    if open_below:
        face[2] = (u[2] - h[2]) ** 2
    return F.least(*[face[i] + out[(i + 1) % 3] + out[(i + 2) % 3] for i in range(3)])


def initial(start: Start, k: int = 60) -> Boxes:
    """Boxes at the start's means, with sides by its spread; upright, as scanned rooms are."""
    sizes = columns_of(start.shares, k)
    alpha = written(blocks(start, sizes, 1e-5))
    n = len(sizes)
    mass, ss, poses = np.zeros(n), np.zeros(n), {}
    middle = {r.frame_id: np.array([r.x, r.y, r.z]) for r in alpha.where("obj = 1").groupBy("frame_id").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "xyz"]).collect()}
    for r in moments(alpha).collect():  # a row for each frame and object
        mass[r.obj - 1] += r.mass
        ss[r.obj - 1] += r.ss
        poses[r.frame_id, r.obj] = (np.eye(3), np.array([r.mx, r.my, r.mz]) if r.mass > 0 else middle[r.frame_id])
    spread = np.maximum(ss / np.maximum(mass, 1e-300), 1e-4)
    return Boxes(np.repeat(np.sqrt(spread)[:, None], 3, 1), 1 / spread, mass / max(mass.sum(), 1e-300), poses)


def frame_rows(points: DataFrame, values: dict[int, list], kind: str) -> DataFrame:
    """``points`` with its frame's array ``m``; one row a frame, broadcast while they are few."""
    table = points.sparkSession.createDataFrame(sorted(values.items()), f"frame_id int, m array<{kind}>")
    return points.join(F.broadcast(table) if len(values) <= 10_000 else table, "frame_id")


def shared_out(points: DataFrame, m: Boxes, beta: float, open_below: bool = True) -> DataFrame:
    """(frame_id, s): for each point the array over objects of (obj, u0.., h0.., d2, a), ``a`` divided by (1 + beta) times its sum."""
    fields = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]
    frames: dict[int, list] = {}
    for (f, o), (r, t) in sorted(m.poses.items()):
        frames.setdefault(f, []).append((o, *map(float, r.ravel()), *map(float, t), *map(float, m.half[o - 1]), float(m.w[o - 1])))
    kind = "struct<obj:int, " + ", ".join(f"{c}:double" for c in [*fields, "h0", "h1", "h2", "w"]) + ">"
    at = frame_rows(points.select("frame_id", "x", "y", "z"), frames, kind)

    def local(o: Column) -> Column:
        u = G.inverse(G.vec(), [[o[f"r{i}{j}"] for j in range(3)] for i in range(3)], tuple(o[f"t{c}"] for c in "xyz"))
        return F.struct(o["obj"].alias("obj"), *[c.alias(f"u{i}") for i, c in enumerate(u)], *[o[f"h{i}"].alias(f"h{i}") for i in range(3)], o["w"].alias("w"))

    def likely(o: Column) -> Column:
        d2 = surface_distance2([o[f"u{i}"] for i in range(3)], [o[f"h{i}"] for i in range(3)], open_below)
        return F.struct(o["obj"].alias("obj"), *[o[c].alias(c) for c in NAMES], d2.alias("d2"), (F.exp(-0.5 * o["w"] * d2) * F.pow(o["w"], F.lit(1.5)) + EPS).alias("a"))

    at = at.withColumn("s", F.transform("m", local)).withColumn("s", F.transform("s", likely)).select("frame_id", "s")
    return at.withColumn("s", normalised(lambda o: o["a"], beta))


def normalised(a, beta: float) -> Column:
    total = (1 + beta) * F.aggregate("s", F.lit(0.0), lambda x, o: x + a(o))
    return F.transform("s", lambda o: o.withField("a", a(o) / total))


def truncated(shares: DataFrame, beta: float) -> DataFrame:
    """Shares below the median of their frame and object become (almost) 0, and rows are divided again.

    The median is the lower one, exact up to 10,000 points and beyond that within a 10,000th of the ranks.
    """
    each = shares.select("frame_id", F.explode("s").alias("o")).groupBy("frame_id", "o.obj").agg(F.percentile_approx("o.a", 0.5, 10_000).alias("mid"))
    frames: dict[int, list] = {}
    for r in each.orderBy("frame_id", "obj").collect():  # a row for each frame and object
        frames.setdefault(r.frame_id, []).append(r.mid)
    at = frame_rows(shares, frames, "double")
    cut = F.zip_with("s", "m", lambda o, mid: o.withField("a", F.when(o["a"] < mid, 0.0).otherwise(o["a"]) + EPS))
    return at.withColumn("s", cut).withColumn("s", normalised(lambda o: o["a"], beta)).select("frame_id", F.explode("s").alias("o")).select("frame_id", "o.*")


def corner_sums(rows: DataFrame, reach: float) -> DataFrame:
    """Of each frame and object the mean of the points near each corner, weighted by exp(-distance² / reach²) and their shares."""
    u, h = [F.col(f"u{i}") for i in range(3)], [F.col(f"h{i}") for i in range(3)]
    out = []
    for k, sign in enumerate(CORNERS):
        d2 = sum(((u[i] - sign[i] * h[i]) ** 2 for i in (1, 2)), (u[0] - sign[0] * h[0]) ** 2)
        weight = F.exp(-d2 / reach**2) * F.col("a") + EPS
        out += [(F.sum(weight * u[i]) / F.sum(weight)).alias(f"c{k}{i}") for i in range(3)]
    return rows.groupBy("frame_id", "obj").agg(*out)


def scale_scores(rows: DataFrame, half: np.ndarray, reach: float = 1.0, open_below: bool = True, steps: Sequence[float] = STEPS, block: int = 64) -> DataFrame:
    """``rows(obj, u0, u1, u2, a)`` → (obj, i, j, k, score): the sum of a exp(-d² / reach²) if the sides are scaled by those steps.

    A task sends the cells of the objects that it met, however many points it has. Rows are narrow and each costs all cells, so they
    are dealt evenly to the cores first.
    """
    spark = rows.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n, s = len(steps), np.array(steps, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for o, g in pdf.groupby("obj"):
                u, a = g[["u0", "u1", "u2"]].to_numpy(float), g["a"].to_numpy(float)
                acc = total.setdefault(int(o), np.zeros((n, n, n)))
                for at in range(0, len(u), block):
                    b = u[at : at + block, :, None]
                    away = np.abs(b) - half[int(o) - 1][None, :, None] * s
                    out, face = np.maximum(away, 0) ** 2, away**2
                    if open_below:
                        face[:, 2] = (b[:, 2] - half[int(o) - 1][2] * s) ** 2
                    out, face = np.exp(-out / reach**2), np.exp(-face / reach**2)
                    # the nearest face has the greatest of three products; where they underflow for the best sides, all cells are 0
                    (ox, oy, oz), (fx, fy, fz) = (q.max(2).T for q in (out, face))
                    some = (fx * (oy * oz) > 0) | (ox * np.maximum(fy * oz, oy * fz) > 0)
                    (ox, oy, oz), (fx, fy, fz) = (q[some].transpose(1, 0, 2) for q in (out, face))
                    oy, oz, fy, fz = oy[:, :, None], oz[:, None], fy[:, :, None], fz[:, None]
                    cells = ox[:, :, None, None] * np.maximum(fy * oz, oy * fz)[:, None]
                    np.maximum(cells, fx[:, :, None, None] * (oy * oz)[:, None], out=cells)
                    acc += np.tensordot(a[at : at + block][some], cells, 1)
        i, j, k = (m.ravel() for m in np.indices((n, n, n)))
        for o, acc in total.items():
            yield pd.DataFrame({"obj": np.full(n**3, o, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "k": k.astype(np.int32), "score": acc.ravel()})

    parts = rows.select("obj", "u0", "u1", "u2", "a").repartition(tasks).mapInPandas(run, "obj int, i int, j int, k int, score double")
    return parts.groupBy("obj", "i", "j", "k").agg(F.sum("score").alias("score"))


def rescaled(half: np.ndarray, scores: DataFrame, steps: Sequence[float] = STEPS, least: float = 0.01) -> np.ndarray:
    """Each box with its best steps (the smallest of equals); a side that would fall to ``least`` keeps its length."""
    best = F.max(F.struct(F.round("score", 9).alias("score"), *[(-F.col(c)).alias(c) for c in "ijk"])).alias("b")
    out = half.copy()
    for r in scores.groupBy("obj").agg(best).select("obj", "b.*").collect():  # a row an object
        if r.score > 0:
            new = half[r.obj - 1] * [steps[-r[c]] for c in "ijk"]
            out[r.obj - 1] = np.where(new > least, new, half[r.obj - 1])
    return out


def fit(points: DataFrame, m: Boxes, rounds: int = 10, beta: float = 1e-5, reach: float = 1.0, open_below: bool = True, yaw_only: bool = True) -> Boxes:
    """``points(frame_id, x, y, z)``: poses, sides and variances by turns; ends early when nothing moves. Without points the boxes stay."""
    spark = points.sparkSession
    corners = np.array(CORNERS, float)
    for _ in range(rounds):
        rows = written(truncated(written(shared_out(points, m, beta, open_below)), beta))
        moves, shift = [], 0.0
        for r in corner_sums(rows, reach).collect():  # a row for each frame and object, as poses are
            target = np.array([[r[f"c{k}{i}"] for i in range(3)] for k in range(8)])
            turn, t, _ = L.procrustes(corners * m.half[r.obj - 1], target, yaw_only=yaw_only)
            old, at = m.poses[r.frame_id, r.obj]
            m.poses[r.frame_id, r.obj] = (old @ turn, old @ t + at)
            shift = max(shift, float(np.abs(t).max()), float(np.abs(turn - np.eye(3)).max()))
            moves.append((r.frame_id, r.obj, *map(float, turn.ravel()), *map(float, t)))
        if not moves:
            break
        names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]
        table = spark.createDataFrame(moves, "frame_id int, obj int, " + ", ".join(f"{c} double" for c in names))
        at = rows.join(F.broadcast(table) if len(moves) <= 100_000 else table, ["frame_id", "obj"])
        u = G.inverse((F.col("u0"), F.col("u1"), F.col("u2")))
        at = at.select("obj", "a", *[c.alias(f"u{i}") for i, c in enumerate(u)], "h0", "h1", "h2")
        d2 = surface_distance2([F.col(f"u{i}") for i in range(3)], [F.col(f"h{i}") for i in range(3)], open_below)
        sums = at.groupBy("obj").agg(F.sum("a").alias("mass"), F.sum(F.col("a") * d2).alias("s")).collect()  # a row an object
        half = rescaled(m.half, scale_scores(at, m.half, reach, open_below))
        shift = max(shift, float(np.abs(half - m.half).max()))
        m.half = half
        mass, s = np.zeros(len(half)), np.zeros(len(half))
        for r in sums:
            mass[r.obj - 1], s[r.obj - 1] = r.mass, r.s
        m.w = np.clip(3 * mass / (s + beta), 1e-9, 1e6)
        m.p = mass / ((1 + beta) * max(mass.sum(), 1e-300))
        m.trace.append(float((-0.5 * m.w * s + mass * (1.5 * np.log(m.w) + np.log(np.maximum(m.p, 1e-300)))).sum()))
        if shift < 1e-6:
            break
    return m


def box_table(spark, m: Boxes) -> DataFrame:
    rows = [(f, o, *map(float, r.ravel()), *map(float, t), *map(float, m.half[o - 1]), float(m.w[o - 1]), float(m.p[o - 1])) for (f, o), (r, t) in sorted(m.poses.items())]
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz", "h0", "h1", "h2", "w", "p"]
    return spark.createDataFrame(rows, "frame_id int, obj int, " + ", ".join(f"{c} double" for c in names))
