"""Registration by expectation-maximisation: frames in parallel, the model (K centroids, poses) on the driver.

Each round turns batches of points into K weighted sums a frame (responsibilities below a frame's median, and a patch's weakest
object, are found by rounds of sums before); the driver finds the poses from K rows per frame and
sends the new model with the next round's plan. No point leaves the executors, and lineage doesn't grow.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import aggregates as A
from cloudloom.operators import linalg as L
from cloudloom.sources.shared import written

POSE = [*[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"]


def cpd_rigid(source: DataFrame, target: DataFrame, rounds: int = 30, omega: float = 0.1, scaled: bool = False, block: int = 2048) -> dict[str, np.ndarray | float]:
    """Moves ``source`` onto ``target`` (x, y, z): R, t, s, sigma2. The source is the model and is held by each task; targets stream in blocks."""
    y = np.array(source.select("x", "y", "z").collect(), float)  # the model: bounded by what one node holds, as in the method itself
    n = target.count()
    s1 = target.agg(*[F.sum(c) for c in "xyz"], F.sum(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).first()
    mean_sq = s1[3] / n + (y**2).sum() / len(y) - 2 * (np.array(s1[:3]) / n) @ y.mean(0)
    r, t, s, sigma2 = np.eye(3), np.zeros(3), 1.0, max(mean_sq / 3, 1e-9)
    m = len(y)
    for _ in range(rounds):
        moved = s * y @ r.T + t
        c = A.cpd_constant(sigma2, omega, m, n)

        def sums(batches, moved=moved, sigma2=sigma2, c=c):
            p1, px, xx, px_y, pt = np.zeros(m), np.zeros((m, 3)), 0.0, np.zeros(3), 0.0
            for pdf in batches:
                x = pdf[["x", "y", "z"]].to_numpy(float)
                for i in range(0, len(x), block):
                    b = x[i : i + block]
                    d = ((b[:, None] - moved[None]) ** 2).sum(2)
                    p = np.exp(-d / (2 * sigma2))
                    p /= p.sum(1, keepdims=True) + c
                    p1 += p.sum(0)
                    px += p.T @ b
                    w = p.sum(1)
                    xx += float((w * (b**2).sum(1)).sum())
                    px_y += w @ b
                    pt += w.sum()
            yield pd.DataFrame({"k": np.arange(m), "p": p1, "x": px[:, 0], "y": px[:, 1], "z": px[:, 2], "xx": np.r_[xx, np.zeros(m - 1)]})

        got = target.select("x", "y", "z").mapInPandas(sums, "k int, p double, x double, y double, z double, xx double").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("p", "x", "y", "z", "xx")]).toPandas().sort_values("k")
        p1, px = got.p.to_numpy(), got[["x", "y", "z"]].to_numpy()
        total = p1.sum()
        mx, my = px.sum(0) / total, p1 @ y / total
        a = (px - p1[:, None] * mx).T @ (y - my)
        u, _, v = np.linalg.svd(a)
        r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v)) or 1]) @ v
        spread = float((p1 * ((y - my) ** 2).sum(1)).sum())
        s = float(np.trace(r.T @ a) / spread) if scaled and spread > 0 else 1.0
        t = mx - s * r @ my
        var_x = float(got.xx.sum() - total * mx @ mx)
        new = max((var_x + s * s * spread - 2 * s * float(np.trace(r.T @ a))) / (3 * total), 1e-12)
        done = abs(new - sigma2) < 1e-10 * max(sigma2, 1e-30)
        sigma2 = new
        if done:
            break
    return {"R": r, "t": t, "s": s, "sigma2": sigma2}


def cpd_rigid_dense(y: np.ndarray, x: np.ndarray, rounds: int = 30, omega: float = 0.1, block: int = 512) -> tuple[np.ndarray, np.ndarray, float, float]:
    """As ``cpd_rigid`` without a scale, for two sets that one task holds: ``y`` moved onto ``x``, targets block by block."""
    m, n = len(y), len(x)
    r, t = np.eye(3), np.zeros(3)
    sigma2 = max(((x**2).sum() / n + (y**2).sum() / m - 2 * x.mean(0) @ y.mean(0)) / 3, 1e-9)
    for _ in range(rounds):
        moved = y @ r.T + t
        c = A.cpd_constant(sigma2, omega, m, n)
        p1, px, xx = np.zeros(m), np.zeros((m, 3)), 0.0
        for i in range(0, n, block):
            b = x[i : i + block]
            p = np.exp(-np.maximum((b**2).sum(1)[:, None] + (moved**2).sum(1)[None] - 2 * b @ moved.T, 0) / (2 * sigma2))
            p /= p.sum(1, keepdims=True) + c
            p1 += p.sum(0)
            px += p.T @ b
            xx += float(p.sum(1) @ (b**2).sum(1))
        total = p1.sum()
        mx, my = px.sum(0) / total, p1 @ y / total
        a = (px - p1[:, None] * mx).T @ (y - my)
        u, _, v = np.linalg.svd(a)
        r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v)) or 1]) @ v
        t = mx - r @ my
        spread = float(p1 @ ((y - my) ** 2).sum(1))
        new = max((xx - total * mx @ mx + spread - 2 * float(np.trace(r.T @ a))) / (3 * total), 1e-12)
        done = abs(new - sigma2) < 1e-10 * max(sigma2, 1e-30)
        sigma2 = new
        if done:
            break
    return r, t, 1.0, sigma2


@dataclass
class Model:
    """Centroids of all objects with weights and inverse variances, and a pose of each frame and object."""

    x: np.ndarray
    obj: np.ndarray
    p: np.ndarray
    w: np.ndarray
    poses: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    normals: np.ndarray | None = None
    colour: np.ndarray | None = None
    trace: list[float] = field(default_factory=list)
    base: DataFrame | None = None  # of the frames' cells, for smoothing

    def __getstate__(self) -> dict:
        return self.__dict__ | {"base": None}  # tasks get its rows, not the table

    def moved(self, frame: int) -> np.ndarray:
        out = np.empty_like(self.x)
        for o in np.unique(self.obj):
            r, t = self.poses[frame, int(o)]
            out[self.obj == o] = self.x[self.obj == o] @ r.T + t
        return out


@dataclass(frozen=True)
class Variant:
    """What tells the members of the family apart.

    ``prior``: weights in the E-step. ``object_prior``: the objects' shares in the E-step. ``scale``: rows are divided by
    (1 + beta) times their sum, else by the sum + beta. ``truncate``: responsibilities below the column's median are dropped.
    ``yaw_only``: poses turn about z. ``normals``, ``colour``: extra likelihood terms. ``boxes``: probability of boxes per object.
    ``primitive``: objects are plates or cubes (distance to a fitted box). ``recentre``: objects go to fixed places along z.
    ``patches``: after each E-step the weakest object of each input patch is dropped. ``spectral``: responsibilities are smoothed
    by a graph's low frequencies.
    """

    prior: bool = True
    object_prior: bool = False
    scale: bool = False
    truncate: bool = True
    yaw_only: bool = False
    normals: bool = False
    colour: bool = False
    boxes: bool = False
    primitive: str = ""
    recentre: bool = False
    patches: bool = False
    spectral: int = 0
    beta: float | None = 1e-5
    gamma: float = 0.1
    eps: float = 1e-6


VARIANTS = {
    "jrmpc": Variant(truncate=False, beta=None),
    "jrmpc_step": Variant(truncate=True, beta=None),
    "jrmpc_v2": Variant(truncate=False, beta=None, normals=True),
    "jrcs_base": Variant(beta=None, recentre=True),
    "jrcs_aoni": Variant(object_prior=True, scale=True, recentre=True),
    "jrcs_aopt": Variant(object_prior=True, scale=True, recentre=True, patches=True),
    "sjrcs": Variant(scale=True, recentre=True, spectral=5),
    "jrcs_bilateral": Variant(prior=False, scale=True, recentre=True, colour=True),
    "jrcs_box": Variant(prior=False, recentre=True, boxes=True, colour=True),
    "jrcs_primitive": Variant(prior=False, primitive="plate"),
    "jrcs_cube": Variant(prior=False, primitive="cube"),
}


def sphere(k: int, seed: int) -> np.ndarray:
    v = np.random.default_rng(seed).normal(size=(k, 3))
    return 0.4 * v / np.linalg.norm(v, axis=1, keepdims=True)


def initial(points: DataFrame, k: int, objects: int, seed: int = 1, start: np.ndarray | None = None) -> Model:
    """Centroids on spheres scaled by half the frames' largest diagonal; poses at the frames' means."""
    stats = points.groupBy("frame_id").agg(*[F.min(c).alias("l" + c) for c in "xyz"], *[F.max(c).alias("h" + c) for c in "xyz"], *[F.avg(c).alias("m" + c) for c in "xyz"]).collect()  # a row per frame
    diag = max(float(np.linalg.norm([r["h" + c] - r["l" + c] for c in "xyz"])) for r in stats)
    x = np.concatenate([sphere(k, seed + o) for o in range(objects)]) * 0.5 * diag if start is None else start
    obj = np.repeat(np.arange(1, objects + 1), k)[: len(x)] if start is None else np.ones(len(x), int)
    where = {r["frame_id"]: np.array([r["m" + c] for c in "xyz"]) for r in stats}
    poses = {(f, o): (np.eye(3), m if start is None else np.zeros(3)) for f, m in where.items() for o in range(1, objects + 1)}
    return Model(x, obj, np.full(len(x), 1 / len(x)), np.full(len(x), 1 / max(diag * diag / 16, 1e-9)), poses)


def responsibilities(v: np.ndarray, m: Model, frame: int, var: Variant, extra: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of points, columns of centroids; and squared distances."""
    at = m.moved(frame)
    d2 = ((v[:, None] - at[None]) ** 2).sum(2)
    if var.primitive:
        d2 = primitive_distance(v, at, m.obj, var.primitive)
    a = np.exp(-0.5 * m.w * d2) * m.w**1.5 + (0 if var.prior else np.finfo(float).eps)
    if var.prior:
        a = a * m.p
    if var.normals and m.normals is not None and "n" in extra:
        a = a * np.maximum(extra["n"] @ m.normals.T, 0.01)
    if var.colour and m.colour is not None and "c" in extra:
        a = a * np.exp(-0.5 * ((extra["c"][:, None] - m.colour[None]) ** 2).sum(2) / 0.05)
    if var.boxes and "b" in extra:
        a = a * np.maximum(extra["b"][:, m.obj - 1], 1e-6)
    if var.object_prior:
        share = np.array([m.p[m.obj == o].sum() for o in range(1, m.obj.max() + 1)]) + 1e-6
        a = a * (share / share.sum())[m.obj - 1]
    beta = var.beta
    if beta is None:
        h = 2 / m.w.mean()
        beta = var.gamma / (h * (var.gamma + 1))
    total = a.sum(1, keepdims=True)
    a = a / ((1 + beta) * total + 1e-300) if var.scale else a / (total + beta + 1e-300)
    return a, d2


CELLS = ("kx", "ky", "kz")


def in_cells(points: DataFrame) -> DataFrame:
    return points.withColumns({k: F.floor(F.col(c) / F.lit(0.75)).cast("long") for k, c in zip(CELLS, "xyz")})


def touching(cells: np.ndarray) -> np.ndarray:
    """Pairs of rows of ``cells`` (sorted, all different) that differ by at most 1 in each place."""
    low = cells.min(0) - 1
    span = cells.max(0) + 2 - low
    name = lambda c: ((c[:, 0] - low[0]) * span[1] + c[:, 1] - low[1]) * span[2] + c[:, 2] - low[2]
    own, found = name(cells), []
    for d in np.ndindex(3, 3, 3):
        if d > (1, 1, 1):
            at = name(cells + np.array(d) - 1)
            j = np.minimum(np.searchsorted(own, at), len(own) - 1)
            i = np.flatnonzero(own[j] == at)
            found.append(np.stack([i, j[i]], 1))
    return np.concatenate(found)


def cell_base(points: DataFrame, k: int) -> DataFrame:
    """(frame_id, kx, ky, kz, base): the 4 ``k`` lowest frequencies of the graph of each frame's cells, a row for each cell; empty for fewer than four cells."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["kx", "ky", "kz"]).reset_index(drop=True)
        base = np.zeros((len(g), 0))
        if len(g) >= 4:
            pairs = touching(g[["kx", "ky", "kz"]].to_numpy())
            base = L.graph_eigen(len(g), pairs, np.ones(len(pairs)), min(4 * k, len(g)))[1]
        return g.assign(base=list(base))

    cells = in_cells(points).select("frame_id", *CELLS).distinct()
    return written(cells.groupBy("frame_id").applyInPandas(run, "frame_id int, kx long, ky long, kz long, base array<double>"))


def smoothing(points: DataFrame, m: Model, var: Variant, columns: dict[str, list[str]]) -> DataFrame | None:
    """(frame_id, kx, ky, kz, factor): by what each column of a cell's responsibilities is multiplied, so that the ``spectral`` strongest coefficients of its means are kept.

    Points are read by batches; a frame's cells are held at once.
    """
    if not var.spectral:
        return None
    if m.base is None:
        m.base = cell_base(points, var.spectral)

    def add(frame, pdf, v, a, d2, extra):
        cells, at = np.unique(np.floor(v / 0.75).astype(np.int64), axis=0, return_inverse=True)
        both = np.c_[a, np.ones(len(a))]
        sums = np.stack([np.bincount(at.ravel(), both[:, j], len(cells)) for j in range(both.shape[1])], 1)
        return pd.DataFrame({"frame_id": frame, **dict(zip(CELLS, cells.T)), **{f"s{j}": sums[:, j] for j in range(both.shape[1])}})

    names = [f"s{j}" for j in range(len(m.x) + 1)]
    key = ["frame_id", *CELLS]
    sums = per_batch(points, m, var, columns, add, "frame_id int, kx long, ky long, kz long, " + ", ".join(f"{n} double" for n in names)).groupBy(*key).agg(*[F.sum(n).alias(n) for n in names])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        base, total = np.stack(g.base.to_numpy()), g[names].to_numpy()
        factor = np.ones((len(g), len(m.x)))
        if base.shape[1]:
            mean = total[:, :-1] / total[:, -1:]
            c = base.T @ mean
            keep = np.abs(c) >= np.sort(np.abs(c), axis=0)[-min(var.spectral, len(c))]
            factor = (np.maximum(base @ (c * keep), 0) / np.maximum(mean, 1e-300)).clip(0.1, 10)
        return g[key].assign(factor=list(factor))

    return written(sums.join(m.base.hint("merge"), key).groupBy("frame_id").applyInPandas(run, "frame_id int, kx long, ky long, kz long, factor array<double>"))


def per_batch(points: DataFrame, m: Model, var: Variant, columns: dict[str, list[str]], run, schema: str, keep: list[str] | None = None, weakest: dict | None = None, factors: DataFrame | None = None) -> DataFrame:
    """``run(frame, rows, points, responsibilities, squared distances, extra values)`` on each batch of a frame's points, so a task's memory doesn't grow with the frame.

    ``weakest``: the object to drop for each frame and patch. ``factors``: what responsibilities in each cell are multiplied by (``smoothing``).
    """

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        frame, v = int(pdf.frame_id.iloc[0]), pdf[["x", "y", "z"]].to_numpy(float)
        extra = extra_values(pdf, columns)
        a, d2 = responsibilities(v, m, frame, var, extra)
        if "factor" in pdf:
            a = a * np.stack(pdf.factor.to_numpy())
        if weakest:
            worst = np.array([weakest.get((frame, int(p)), 0) for p in extra["l"]])
            a = np.where(worst[:, None] == m.obj[None], 0, a)
        return run(frame, pdf, v, a, d2, extra)

    points = points.select("frame_id", *(keep or []), "x", "y", "z", *[c for names in columns.values() for c in names])
    if factors is not None:
        points = in_cells(points).join(factors.hint("merge"), ["frame_id", *CELLS]).drop(*CELLS)

    def batches(every):
        for pdf in every:
            for _, g in pdf.groupby("frame_id", sort=False):
                yield part(g)

    return points.mapInPandas(batches, schema)


def weakest_objects(points: DataFrame, m: Model, var: Variant, columns: dict[str, list[str]]) -> dict[tuple[int, int], int]:
    """The object with the least share of each frame's patch, against its share of the frame. A row for each patch and object on the driver."""
    objects = np.unique(m.obj)
    if not var.patches or "l" not in columns or len(objects) < 2:
        return {}

    def run(frame, pdf, v, a, d2, extra):
        sums = pd.DataFrame({int(o): a[:, m.obj == o].sum(1) for o in objects}).groupby(extra["l"]).sum()
        return sums.stack().rename_axis(["label", "obj"]).reset_index(name="mass").assign(frame_id=frame)[["frame_id", "label", "obj", "mass"]]

    got = per_batch(points, m, var, columns, run, "frame_id int, label int, obj int, mass double").groupBy("frame_id", "label", "obj").agg(F.sum("mass").alias("mass")).toPandas()
    out = {}
    for f, rows in got.groupby("frame_id"):
        table = rows.pivot(index="label", columns="obj", values="mass")[objects]
        share = table.to_numpy().sum(0) / max(table.to_numpy().sum(), 1e-300)
        for label, own in table.iterrows():
            if label > 0:
                ratio = own.to_numpy() / max(own.sum(), 1e-300) / np.maximum(share, 1e-12)
                out[int(f), int(label)] = int(objects[ratio.argmin()])
    return out


def medians(points: DataFrame, m: Model, var: Variant, columns: dict[str, list[str]], weakest: dict, factors: DataFrame | None = None) -> dict[int, np.ndarray]:
    """The exact median of each frame's responsibilities for each centroid.

    Bits of numbers from 0 on are in the numbers' order: counts by the leading 16 bits tell where the middle ones lie, and only values there
    (with their counts) are gathered.
    """

    def bits(a: np.ndarray) -> np.ndarray:
        return np.abs(np.ascontiguousarray(a)).view(np.int64) >> 48

    def count(frame, pdf, v, a, d2, extra):
        both, n = np.unique((np.arange(a.shape[1]) << 16) + bits(a), return_counts=True)
        return pd.DataFrame({"frame_id": frame, "k": both >> 16, "bin": both & 0xFFFF, "n": n})

    def middle_bins(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bin")
        upto, total = g.n.cumsum().to_numpy(), int(g.n.sum())
        ranks = np.array([(total - 1) // 2, total // 2])
        at = np.searchsorted(upto, ranks, side="right")
        return pd.DataFrame({"frame_id": g.frame_id.iloc[0], "k": g.k.iloc[0], "bin": g.bin.to_numpy()[at], "rank": ranks - np.r_[0, upto][at]})

    counts = per_batch(points, m, var, columns, count, "frame_id int, k int, bin long, n long", weakest=weakest, factors=factors).groupBy("frame_id", "k", "bin").agg(F.sum("n").alias("n"))
    middle, before = {}, {}
    for r in counts.groupBy("frame_id", "k").applyInPandas(middle_bins, "frame_id int, k int, bin long, rank long").collect():  # two rows for each frame and centroid
        middle.setdefault((r["frame_id"], r["k"]), []).append(r["bin"])
        before.setdefault((r["frame_id"], r["k"]), []).append(r["rank"])

    def gather(frame, pdf, v, a, d2, extra):
        own, rows = bits(a), []
        for k in range(a.shape[1]):
            values, n = np.unique(a[np.isin(own[:, k], middle[frame, k]), k], return_counts=True)
            rows.append(pd.DataFrame({"frame_id": frame, "k": k, "value": values, "n": n}))
        return pd.concat(rows)

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        key = int(g.frame_id.iloc[0]), int(g.k.iloc[0])
        g = g.sort_values("value")
        found, value = [], g.value.to_numpy()
        own = bits(value)
        for b, r in zip(middle[key], before[key], strict=True):
            at = own == b
            found.append(value[at][np.searchsorted(g.n.to_numpy()[at].cumsum(), r, side="right")])
        return pd.DataFrame({"frame_id": [key[0]], "k": [key[1]], "median": [np.mean(found)]})

    values = per_batch(points, m, var, columns, gather, "frame_id int, k int, value double, n long", weakest=weakest, factors=factors).groupBy("frame_id", "k", "value").agg(F.sum("n").alias("n"))
    got = values.groupBy("frame_id", "k").applyInPandas(pick, "frame_id int, k int, median double").toPandas().sort_values("k")
    return {int(f): g["median"].to_numpy() for f, g in got.groupby("frame_id")}


def primitive_distance(v: np.ndarray, at: np.ndarray, obj: np.ndarray, kind: str) -> np.ndarray:
    """Squared distance to the box of each object's centroids (its surface for plates), the same for all of the object's columns."""
    out = np.empty((len(v), len(at)))
    for o in np.unique(obj):
        lo, hi = at[obj == o].min(0), at[obj == o].max(0)
        beyond = np.maximum(np.maximum(lo - v, v - hi), 0)
        d = (beyond**2).sum(1)
        if kind == "plate":
            inside = np.minimum(v - lo, hi - v).min(1)
            d = np.where(inside > 0, inside**2, d)
        out[:, obj == o] = d[:, None]
    return out


def step(points: DataFrame, m: Model, var: Variant, extra_cols: dict[str, list[str]]) -> pd.DataFrame:
    """One round over all frames: K sums per frame and the poses found there. Points are read by batches; sums and poses are a frame's."""
    weakest = weakest_objects(points, m, var, extra_cols)
    factors = smoothing(points, m, var, extra_cols)
    middle = medians(points, m, var, extra_cols, weakest, factors) if var.truncate else {}
    more = ("nx", "ny", "nz", "r", "g", "b")

    def sums(frame, pdf, v, a, d2, extra):
        if var.truncate:
            a = np.where(a < middle[frame], 0, a)
        at = a.T @ v
        out = {"frame_id": frame, "k": np.arange(a.shape[1]), "mass": a.sum(0), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "s": (a * d2).sum(0)}
        for key, names in (("n", more[:3]), ("c", more[3:])):
            e = a.T @ extra[key] if key in extra else np.zeros((a.shape[1], 3))
            out |= {f"e_{n}": e[:, i] for i, n in enumerate(names)}
        return pd.DataFrame(out)

    names = ["mass", "x", "y", "z", "s", *[f"e_{n}" for n in more]]
    schema = "frame_id int, k int, " + ", ".join(f"{n} double" for n in names)
    got = per_batch(points, m, var, extra_cols, sums, schema, weakest=weakest, factors=factors).groupBy("frame_id", "k").agg(*[F.sum(n).alias(n) for n in names]).toPandas().sort_values(["frame_id", "k"])  # frames x K rows of sums
    rows = []
    for frame, g in got.groupby("frame_id"):
        mass, moved = g.mass.to_numpy(), m.moved(int(frame))
        mean = g[["x", "y", "z"]].to_numpy() / np.maximum(mass, 1e-12)[:, None]
        mean[mass <= 1e-12] = moved[mass <= 1e-12]
        back, pose = np.empty_like(mean), np.empty((len(mean), len(POSE)))
        for o in np.unique(m.obj):
            own = m.obj == o
            r, t, _ = L.procrustes(m.x[own], mean[own], mass[own] * m.w[own], yaw_only=var.yaw_only)
            back[own] = (mean[own] - t) @ r
            pose[own] = np.r_[r.ravel(), t]
        rows.append(g.assign(**{c: back[:, i] * mass for i, c in enumerate("xyz")}, **{c: pose[:, i] for i, c in enumerate(POSE)}))
    return pd.concat(rows)


def extra_columns(m: Model, var: Variant) -> dict[str, list[str]]:
    """The columns that a variant's likelihood reads besides positions."""
    extra: dict[str, list[str]] = {}
    if var.normals:
        extra["n"] = ["nx", "ny", "nz"]
    if var.colour:
        extra["c"] = ["r", "g", "b"]
    if var.boxes:
        extra["b"] = [f"b{i}" for i in range(1, int(m.obj.max()) + 1)]
    if var.patches:
        extra["l"] = ["label"]
    return extra


def extra_values(pdf: pd.DataFrame, columns: dict[str, list[str]]) -> dict[str, np.ndarray]:
    return {k: pdf[c].to_numpy(float) if k != "l" else pdf[c[0]].to_numpy() for k, c in columns.items()}


def fit(points: DataFrame, m: Model, var: Variant, rounds: int = 10) -> Model:
    """Alternates E and M steps; stops when the model stands still. ``points(frame_id, pt_id, x, y, z[, nx, ny, nz, r, g, b, label, b1..])``."""
    extra = extra_columns(m, var)
    for _ in range(rounds):
        got = step(points, m, var, extra)
        for (f, k), row in got.set_index(["frame_id", "k"])[POSE].iterrows():
            r = row.to_numpy(float)
            m.poses[int(f), int(m.obj[int(k)])] = (r[:9].reshape(3, 3), r[9:])
        total = got.groupby("k")[["mass", "x", "y", "z", "s", *[f"e_{n}" for n in ("nx", "ny", "nz", "r", "g", "b")]]].sum().sort_index()
        mass = np.maximum(total["mass"].to_numpy(), 1e-12)
        x = total[["x", "y", "z"]].to_numpy() / mass[:, None]
        x[total["mass"] <= 1e-9] = m.x[total["mass"] <= 1e-9]
        if var.recentre:
            objects = np.unique(m.obj)
            for o, z in zip(objects, np.linspace(-len(objects) / 2, len(objects) / 2, len(objects)), strict=True):
                shift = np.array([0, 0, z]) - x[m.obj == o].mean(0)
                x[m.obj == o] += shift
                for (f, oo), (r, t) in list(m.poses.items()):
                    if oo == o:
                        m.poses[f, oo] = (r, t - r @ shift)
        moved = float(np.abs(x - m.x).max())
        m.x = x
        m.w = np.minimum(3 * mass / (total["s"].to_numpy() + var.eps), 1e6)
        m.p = mass / ((1 + (var.beta or var.gamma)) * mass.sum())
        if var.normals:
            n = total[["e_nx", "e_ny", "e_nz"]].to_numpy()
            m.normals = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12)
        if var.colour:
            m.colour = total[["e_r", "e_g", "e_b"]].to_numpy() / mass[:, None]
        m.trace.append(-0.5 * float((m.w * total["s"].to_numpy() - mass * (1.5 * np.log(m.w) + 2 * np.log(np.maximum(m.p, 1e-300)))).sum()))
        if moved < 1e-7:
            break
    return m


def labels(points: DataFrame, m: Model, var: Variant) -> DataFrame:
    """The object with most responsibility of each point, under the model that was fitted."""
    columns = extra_columns(m, var)

    def run(frame, pdf, v, a, d2, extra):
        objects = np.unique(m.obj)
        mass = np.stack([a[:, m.obj == o].sum(1) for o in objects], 1)
        return pd.DataFrame({"frame_id": pdf.frame_id, "pt_id": pdf.pt_id, "label": objects[mass.argmax(1)].astype(np.int32)})

    return per_batch(points, m, var, columns, run, "frame_id int, pt_id long, label int", ["pt_id"], weakest_objects(points, m, var, columns), smoothing(points, m, var, columns))


def pose_table(spark, m: Model) -> DataFrame:
    rows = [(f, o, *map(float, r.ravel()), *map(float, t)) for (f, o), (r, t) in sorted(m.poses.items())]
    return spark.createDataFrame(rows, "frame_id int, obj_id int, " + ", ".join(f"{p} double" for p in POSE))


def global_align(points: DataFrame, k: int, rounds: int = 10, resolution: float = 0.5, seed: int = 1) -> tuple[DataFrame, Model]:
    """Down-samples, registers the samples jointly, and moves the full frames into the common space."""
    from cloudloom.functions import geometry as G
    from cloudloom.operators.spatial import octree_grid

    sample = octree_grid(points, resolution).withColumn("pt_id", F.xxhash64("kx", "ky", "kz"))
    m = fit(sample, initial(sample, k, 1, seed), VARIANTS["jrmpc"], rounds)
    at = points.join(F.broadcast(pose_table(points.sparkSession, m)), "frame_id")
    return at.select("frame_id", "pt_id", *[c.alias(n) for c, n in zip(G.inverse(G.vec()), "xyz", strict=True)]), m
