"""Grouped statistics: boxes, histograms, scatters, affinities and expectation-maximisation steps as Spark aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators.linalg import hull

FRAME = ("frame_id",)
XYZ = ("x", "y", "z")


def bounding_box(points: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Extents, half diagonal and largest face of each group."""
    box = points.groupBy(*by).agg(*[F.min(c).alias(f"{c}0") for c in XYZ], *[F.max(c).alias(f"{c}1") for c in XYZ])
    e = [F.col(f"{c}1") - F.col(f"{c}0") for c in XYZ]
    return box.withColumns({"radius": F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2]) / 2, "face": F.greatest(e[0] * e[1], e[0] * e[2], e[1] * e[2])})


def hull_corners(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """What a group's box with a vertical axis depends on: (by, x, y, low, high), the corners of the hulls of each batch of points.

    A group of any size is a few rows for each batch.
    """
    by = list(by)

    def corners(batches):
        for pdf in batches:
            rows = []
            for _, g in pdf.groupby(by, sort=False, dropna=False):
                h = hull(g[["x", "y"]].to_numpy(float))
                rows.append(pd.DataFrame({**{b: [g[b].iloc[0]] * len(h) for b in by}, "x": h[:, 0], "y": h[:, 1], "low": g.z.min(), "high": g.z.max()}))
            if rows:
                yield pd.concat(rows)

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.select(*by, "x", "y", "z").mapInPandas(corners, ", ".join(f"{b} {kinds[b]}" for b in by) + ", x double, y double, low double, high double")


def min_box_2d(points: DataFrame, by: Sequence[str] = FRAME, steps: int = 360) -> DataFrame:
    """The rectangle of least area over whole degrees: (by, step, area, length, width). Only corners of hulls are turned."""
    turned = hull_corners(points, by).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    a = F.radians(F.col("step").cast("double"))
    u, v = F.cos(a) * F.col("x") + F.sin(a) * F.col("y"), -F.sin(a) * F.col("x") + F.cos(a) * F.col("y")
    size = turned.select(*by, "step", u.alias("u"), v.alias("v")).groupBy(*by, "step").agg((F.max("u") - F.min("u")).alias("length"), (F.max("v") - F.min("v")).alias("width"))
    best = F.min(F.struct(F.round(F.col("length") * F.col("width"), 9).alias("area"), "step", "length", "width")).alias("m")
    return size.groupBy(*by).agg(best).select(*by, "m.step", "m.area", "m.length", "m.width")


def min_box_3d(points: DataFrame, by: Sequence[str] = FRAME, steps: int = 360) -> DataFrame:
    high = points.groupBy(*by).agg((F.max("z") - F.min("z")).alias("height"))
    return min_box_2d(points, by, steps).join(high, list(by))


def color_histogram(points: DataFrame, channels: dict[str, tuple[float, float, int]], by: Sequence[str]) -> DataFrame:
    """Counts in a grid of bins with a prior of 1 each, as shares times the number of bins: (by, bin, share).

    ``channels``: for each column its least value, its span and its number of bins.
    """
    key, total = F.lit(0), 1
    for name, (low, span, n) in channels.items():
        k = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(name) - F.lit(low)) * F.lit(n) / F.lit(span)))).cast("int")
        key, total = key * n + k, total * n
    counts = points.withColumn("bin", key).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = points.groupBy(*by).agg(F.count(F.lit(1)).alias("size")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    share = (F.coalesce("n", F.lit(0)) + 1) / (F.col("size") + total) * F.col("size")
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", share.alias("share"))


def block_feature(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Twelve numbers of a patch: its box's sides, and for each pair of sides the share of points nearest to it and the mean and deviation of their distances."""
    box = min_box_3d(points, by).select(*by, "step", "length", "width", "height")
    a = F.radians(F.col("step").cast("double"))
    at = points.join(F.broadcast(box), list(by)).withColumns({"u": F.cos(a) * F.col("x") + F.sin(a) * F.col("y"), "v": -F.sin(a) * F.col("x") + F.cos(a) * F.col("y")})
    low = at.groupBy(*by).agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    at = at.join(F.broadcast(low), list(by))
    d = [F.least(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(c)) for c in ("u", "v", "z")]
    at = at.withColumns({f"d{i}": e for i, e in enumerate(d)})
    nearest = F.when((F.col("d0") <= F.col("d1")) & (F.col("d0") <= F.col("d2")), 0).when(F.col("d1") <= F.col("d2"), 1).otherwise(2)
    at = at.withColumn("side", nearest)
    out = [F.first("length").alias("length"), F.first("width").alias("width"), F.first("height").alias("height")]
    for i in range(3):
        own = F.when(F.col("side") == i, F.col(f"d{i}"))
        out += [F.avg((F.col("side") == i).cast("double")).alias(f"share{i}"), F.coalesce(F.avg(own), F.lit(0.0)).alias(f"mean{i}"), F.coalesce(F.stddev_samp(own), F.lit(0.0)).alias(f"dev{i}")]
    return at.groupBy(*by).agg(*out)


def scatter(points: DataFrame, by: Sequence[str], axes: Sequence[str] = XYZ) -> DataFrame:
    """Count, means and the six sums of the scatter matrix about the mean."""
    n = F.count(F.lit(1))
    sums = [n.alias("n"), *[F.avg(c).alias(f"m{c}") for c in axes]]
    for i, p in enumerate(axes):
        for q in axes[i:]:
            sums.append((F.covar_pop(p, q) * n).alias(f"s{p}{q}"))
    return points.groupBy(*by).agg(*sums)


def tf_idf(words: DataFrame, by: Sequence[str] = ("frame_id", "label"), per_frame: bool = False) -> DataFrame:
    """``words(by, word)``: tf = n / (size + 1), idf = ln((D + 1) / (df + 1)) over all documents, or over a frame's."""
    counts = words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    size = counts.groupBy(*by).agg(F.sum("n").alias("size"))
    scope = [by[0]] if per_frame else []
    df = counts.groupBy(*scope, "word").agg(F.count(F.lit(1)).alias("df"))
    if scope:
        docs = size.groupBy(*scope).agg(F.count(F.lit(1)).alias("docs"))
        joined = counts.join(size, list(by)).join(df, [*scope, "word"]).join(docs, scope)
    else:
        joined = counts.join(size, list(by)).join(df, "word").crossJoin(F.broadcast(size.agg(F.count(F.lit(1)).alias("docs"))))
    return joined.select(*by, "word", (F.col("n") / (F.col("size") + 1) * F.log((F.col("docs") + 1) / (F.col("df") + 1))).alias("tfidf"))


def co_association(ensemble: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of base clusterings in which an edge's ends agree: (a, b, c)."""
    ends = edges.join(ensemble.select(F.col("sv").alias("a"), "run", F.col("cluster").alias("ca")), "a").join(ensemble.select(F.col("sv").alias("b"), "run", F.col("cluster").alias("cb")), ["b", "run"])
    return ends.groupBy("a", "b").agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("c"))


def mirrored(edges: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    return edges.select(*by, "a", "b", "w").union(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def degrees(edges: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Sum of the weights at each node."""
    return mirrored(edges, by).groupBy(*by, F.col("a").alias("sv")).agg(F.sum("w").alias("degree"))


def laplacian(edges: DataFrame, by: Sequence[str] = FRAME, kind: str = "plain") -> DataFrame:
    """L = D - W, or D^-1/2 L D^-1/2 for ``kind`` = normalized: entries (by, a, b, v)."""
    d = degrees(edges, by)
    off = mirrored(edges, by).select(*by, "a", "b", (-F.col("w")).alias("v"))
    diagonal = d.select(*by, F.col("sv").alias("a"), F.col("sv").alias("b"), F.col("degree").alias("v"))
    full = off.union(diagonal)
    if kind == "plain":
        return full
    da, db = d.select(*by, F.col("sv").alias("a"), F.col("degree").alias("da")), d.select(*by, F.col("sv").alias("b"), F.col("degree").alias("db"))
    return full.join(da, [*by, "a"]).join(db, [*by, "b"]).select(*by, "a", "b", (F.col("v") / F.sqrt(F.col("da") * F.col("db"))).alias("v"))


def cut_assoc(edges: DataFrame, side: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """``side(by, sv, s)`` of 0 or 1: weight across, weight at either side, and the normalised cut."""
    ends = edges.join(side.select(*by, F.col("sv").alias("a"), F.col("s").alias("sa")), [*by, "a"]).join(side.select(*by, F.col("sv").alias("b"), F.col("s").alias("sb")), [*by, "b"])
    w = F.col("w")
    sums = ends.groupBy(*by).agg(
        F.sum(F.when(F.col("sa") != F.col("sb"), w).otherwise(0.0)).alias("cut"),
        F.sum(w * (F.when(F.col("sa") == 0, 1).otherwise(0) + F.when(F.col("sb") == 0, 1).otherwise(0))).alias("assoc0"),
        F.sum(w * (F.when(F.col("sa") == 1, 1).otherwise(0) + F.when(F.col("sb") == 1, 1).otherwise(0))).alias("assoc1"),
    )
    part = lambda c: F.when(F.col(c) > 0, F.col("cut") / F.when(F.col(c) > 0, F.col(c))).otherwise(0.0)
    return sums.withColumn("ncut", part("assoc0") + part("assoc1"))


def row_normalised(alpha: DataFrame, beta: float = 0.0, scale: float = 1.0, by: Sequence[str] = ("frame_id", "pt_id")) -> DataFrame:
    """a / (scale * (sum over k) + beta); NaN, as 0 / 0 is, where a point is so far from all centroids that its sum is 0."""
    rows = alpha.withColumn("_total", scale * F.sum("a").over(Window.partitionBy(*by)) + beta)
    return rows.withColumn("a", F.when(F.col("_total") == 0, float("nan")).otherwise(F.col("a") / F.col("_total"))).drop("_total")


def softmax(scores: DataFrame, by: Sequence[str], value: str = "u") -> DataFrame:
    w = Window.partitionBy(*by)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return scores.withColumn("_e", e).withColumn("q", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def median_truncated(alpha: DataFrame, by: Sequence[str] = ("frame_id", "k")) -> DataFrame:
    """Responsibilities below their column's median become 0; ``kept`` tells the others, which may be 0 as well."""
    mid = alpha.groupBy(*by).agg(F.median("a").alias("mid"))
    return alpha.join(mid, list(by)).withColumn("kept", F.col("a") >= F.col("mid")).withColumn("a", F.when(F.col("kept"), F.col("a")).otherwise(0.0)).drop("mid")


def top_k(rows: DataFrame, k: int, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def pair_likelihood(points: DataFrame, centroids: DataFrame, prior: bool = True) -> DataFrame:
    """E-step: exp(-w d^2 / 2) w^1.5 p for each point and centroid. Centroids are the model: few, whatever the cloud's size."""
    near = points.crossJoin(F.broadcast(centroids.select("k", "obj_id", *[F.col(c).alias("c" + c) for c in XYZ], "p", "w")))
    d2 = G.sq_dist(G.vec(), G.vec("c"))
    a = F.exp(-0.5 * F.col("w") * d2) * F.pow("w", F.lit(1.5))
    return near.withColumn("d2", d2).withColumn("a", a * F.col("p") if prior else a)


def weighted_means(alpha: DataFrame, values: Sequence[str] = XYZ, by: Sequence[str] = ("frame_id", "k")) -> DataFrame:
    return alpha.groupBy(*by).agg(F.sum("a").alias("mass"), *[(F.sum(F.col("a") * F.col(c)) / F.sum("a")).alias(c) for c in values])


def variance_prior(alpha: DataFrame, eps: float = 1e-6, beta: float = 1e-5) -> DataFrame:
    """Inverse variance 3 A / (sum a d^2 + eps) and weight A / ((1 + beta) sum A) of each centroid."""
    sums = alpha.groupBy("k").agg(F.sum("a").alias("mass"), F.sum(F.col("a") * F.col("d2")).alias("s"))
    total = sums.agg(F.sum("mass").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("k", (3 * F.col("mass") / (F.col("s") + eps)).alias("invvar"), (F.col("mass") / ((1 + beta) * F.col("total"))).alias("p"))


def object_label(alpha: DataFrame, by: Sequence[str] = ("frame_id", "pt_id")) -> DataFrame:
    """The object with most responsibility of a point; the first one of equals."""
    sums = alpha.groupBy(*by, "obj_id").agg(F.sum("a").alias("mass"))
    best = F.max(F.struct("mass", (-F.col("obj_id")).alias("o"))).alias("m")
    return sums.groupBy(*by).agg(best).select(*by, (-F.col("m.o")).alias("label"))


def object_prior(centroids: DataFrame, smooth: float = 1e-6) -> DataFrame:
    sums = centroids.groupBy("obj_id").agg((F.sum("p") + smooth).alias("s"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("s").alias("t")))).select("obj_id", (F.col("s") / F.col("t")).alias("prob"))


def log_objective(alpha: DataFrame) -> DataFrame:
    """-1/2 sum a (w d^2 - 1.5 ln w - 2 ln p) of each frame."""
    term = F.col("a") * (F.col("w") * F.col("d2") - 1.5 * F.log("w") - 2 * F.log("p"))
    return alpha.groupBy("frame_id").agg((-0.5 * F.sum(term)).alias("objective"))


def cpd_constant(sigma2: float, omega: float, m: int, n: int) -> float:
    return (2 * math.pi * sigma2) ** 1.5 * omega / (1 - omega) * m / n


def class_scatter(rows: DataFrame, dims: Sequence[str], by: str = "label") -> tuple[DataFrame, DataFrame]:
    """Between- and within-class scatter as entries (i, j, v)."""
    mean = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in dims])
    all_of = rows.agg(*[F.avg(c).alias(f"g_{c}") for c in dims])
    both = mean.crossJoin(F.broadcast(all_of))
    between = [F.sum(F.col("n") * (F.col(f"m_{p}") - F.col(f"g_{p}")) * (F.col(f"m_{q}") - F.col(f"g_{q}"))).alias(f"{i}_{j}") for i, p in enumerate(dims) for j, q in enumerate(dims)]
    inner = rows.groupBy(by).agg(*[(F.covar_pop(p, q) * F.count(F.lit(1))).alias(f"{i}_{j}") for i, p in enumerate(dims) for j, q in enumerate(dims)])
    within = [F.sum(f"{i}_{j}").alias(f"{i}_{j}") for i in range(len(dims)) for j in range(len(dims))]
    return entries(both.agg(*between), len(dims)), entries(inner.agg(*within), len(dims))


def vector_scatter(rows: DataFrame, value: str, dims: int, by: str = "label") -> tuple[DataFrame, DataFrame]:
    """Between- and within-class scatter of array rows as entries (i, j, v): products are summed per batch, then per entry."""
    mean = F.array(*[F.avg(F.col(value)[i]) for i in range(dims)])
    classes = rows.groupBy(by).agg(mean.alias("m"), F.count(F.lit(1)).cast("double").alias("n"))
    centre = rows.agg(mean.alias("g"))
    away = lambda x, y: F.zip_with(x, y, lambda a, b: a - b)
    spread = classes.crossJoin(F.broadcast(centre)).select(away("m", "g").alias("d"), "n")  # a row per class
    inner = rows.join(F.broadcast(classes) if classes.count() <= 100_000 else classes, by).select(away(value, "m").alias("d"), F.lit(1.0).alias("n"))

    def products(batches):
        for pdf in batches:
            if len(pdf):
                d = np.stack(pdf["d"].to_numpy())
                s = (d * pdf["n"].to_numpy()[:, None]).T @ d
                i, j = np.indices(s.shape)
                yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": s.ravel()})

    return tuple(df.mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")) for df in (spread, inner))


def entries(one: DataFrame, n: int) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{i}_{j}").alias("v")) for i in range(n) for j in range(n)])
    return one.select(F.explode(cells).alias("e")).select("e.i", "e.j", "e.v")


def edge_energy(unary: DataFrame, edges: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Energies of a labelling ``unary(by, sv, label, cost)``: data, Potts smoothness over ``edges(by, a, b, w)``, total."""
    data = unary.groupBy(*by).agg(F.sum("cost").alias("data"))
    ends = edges.join(unary.select(*by, F.col("sv").alias("a"), F.col("label").alias("la")), [*by, "a"]).join(unary.select(*by, F.col("sv").alias("b"), F.col("label").alias("lb")), [*by, "b"])
    smooth = ends.groupBy(*by).agg(F.sum(F.when(F.col("la") != F.col("lb"), F.col("w")).otherwise(0.0)).alias("smooth"))
    return data.join(smooth, list(by), "left").withColumn("smooth", F.coalesce("smooth", F.lit(0.0))).withColumn("energy", F.col("data") + F.col("smooth"))


def icm_sweep(costs: DataFrame, labels: DataFrame, edges: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """One synchronous sweep: each node takes the label of least cost given its neighbours' labels. ``costs(by, sv, label, cost)``."""
    both = mirrored(edges, by)
    seen = both.join(labels.select(*by, F.col("sv").alias("b"), F.col("label").alias("lb")), [*by, "b"]).groupBy(*by, F.col("a").alias("sv"), F.col("lb").alias("label")).agg(F.sum("w").alias("same"))
    total = both.groupBy(*by, F.col("a").alias("sv")).agg(F.sum("w").alias("all_w"))
    full = costs.join(seen, [*by, "sv", "label"], "left").join(total, [*by, "sv"], "left")
    e = F.col("cost") + F.coalesce("all_w", F.lit(0.0)) - F.coalesce("same", F.lit(0.0))
    return full.withColumn("e", F.round(e, 9)).groupBy(*by, "sv").agg(F.min(F.struct("e", "label")).alias("m")).select(*by, "sv", "m.label", "m.e")
