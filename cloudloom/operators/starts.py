"""Starts of the joint registration: what is believed of each patch before the first round, and the model that follows from it.

A strategy is a function from points to a ``Start``; ``initial`` turns any start into the model that ``register.fit`` goes on
with. Beliefs are rows of patches and objects, so points are read once (for their patches' sums) and never paired with objects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators import aggregates as A
from cloudloom.operators import features as E
from cloudloom.operators import models as M
from cloudloom.operators.register import Model, Variant, sphere
from cloudloom.operators.tree import box_labels
from cloudloom.sources.shared import written

PATCH = ["frame_id", "label"]


@dataclass(frozen=True)
class Start:
    """``points`` with the labels of their patches, ``beliefs(frame_id, label, obj, a)`` (a pair left out is 0), each object's share."""

    points: DataFrame
    beliefs: DataFrame
    shares: np.ndarray


Strategy = Callable[[DataFrame], Start]


def scalar(a: Column, b: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(a, F.array(*[F.lit(float(x)) for x in b]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance2(value: Column, centre: Column) -> Column:
    return F.aggregate(F.zip_with(value, centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def listed(centres: np.ndarray) -> Column:
    """The centres as one array of (obj, c), objects from 1. There is one for each object, however many patches there are."""
    return F.array(*[F.struct(F.lit(i + 1).alias("obj"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for i, c in enumerate(centres)])


def reduced(features: DataFrame, dims: int) -> DataFrame:
    """``features(.., feature)`` on the ``dims`` strongest axes of their scatter; left alone where they have no more than that."""
    first = features.select(F.size("feature").alias("n")).first()
    if first is None or first.n <= dims:
        return features
    n = first.n
    mean = np.array(features.agg(F.array(*[F.avg(F.col("feature")[i]) for i in range(n)])).first()[0])
    entries = A.vector_scatter(features.select("feature", F.lit(0).alias("label")), "feature", n)[1]
    axes = np.linalg.eigh(M.scatter_matrix(entries, n))[1][:, ::-1][:, :dims]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(dims)] < 0, -1, 1)
    return features.withColumn("feature", F.array(*[scalar(F.col("feature"), a) - float(mean @ a) for a in axes.T]))


def clustered(features: DataFrame, rounds: int) -> np.ndarray:
    """Centres of the patches' features: those of the frame with most patches (the first of equals), moved by Lloyd rounds over all."""
    most = features.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "frame_id").first()
    if most is None:
        raise ValueError("there are no patches to start from")
    centres = np.array([r.feature for r in features.where(F.col("frame_id") == most.frame_id).orderBy("label").select("feature").collect()], float)  # one frame's patches: the objects
    dims = centres.shape[1]
    for _ in range(rounds):
        near = F.array_min(F.transform(listed(centres), lambda c: F.struct(distance2(F.col("feature"), c["c"]).alias("d"), c["obj"].alias("obj"))))["obj"]
        means = features.groupBy(near.alias("obj")).agg(F.array(*[F.avg(F.col("feature")[i]) for i in range(dims)]).alias("m")).collect()  # a row an object
        new = centres.copy()
        for r in means:
            new[r.obj - 1] = r.m
        if np.abs(new - centres).max() < 1e-10:
            break
        centres = new
    return centres


def by_features(feature: Callable[[DataFrame], DataFrame], dims: int = 2, rounds: int = 20) -> Strategy:
    """Patches believed to be an object by exp(-distance) of their features from its centre.

    ``feature``: labelled points → (frame_id, label, feature). Objects are the clusters of all frames' patches.
    """

    def start(points: DataFrame) -> Start:
        found = written(reduced(written(feature(points.where("label > 0"))), dims))
        centres = clustered(found, rounds)
        each = found.withColumn("o", F.explode(listed(centres)))
        beliefs = written(each.select(*PATCH, "o.obj", F.exp(-F.sqrt(distance2(F.col("feature"), F.col("o.c")))).alias("a")))
        return Start(points, beliefs, shares_of(points, beliefs, len(centres)))

    return start


def shares_of(points: DataFrame, beliefs: DataFrame, objects: int) -> np.ndarray:
    sizes = points.where("label > 0").groupBy(*PATCH).agg(F.count(F.lit(1)).alias("n"))
    got = beliefs.join(sizes, PATCH).groupBy("obj").agg(F.sum(F.col("a") * F.col("n")).alias("m")).collect()  # a row an object
    out = np.zeros(objects)
    for r in got:
        out[r.obj - 1] = r.m
    return out / max(out.sum(), 1e-300)


def by_sizes(shares: list[float]) -> Strategy:
    """Patches given to objects for certain: the largest patches of a frame fill the objects with the largest shares left."""

    def start(points: DataFrame) -> Start:
        import pandas as pd

        sizes = points.where("label > 0").groupBy(*PATCH).agg(F.count(F.lit(1)).alias("n"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["n", "label"], ascending=[False, True])
            return pd.DataFrame({"frame_id": pdf.frame_id, "label": pdf.label, "obj": np.array(M.size_match(pdf.n.tolist(), shares), np.int32) + 1, "a": 1.0})

        kinds = {f.name: f.dataType.simpleString() for f in points.schema}
        beliefs = written(sizes.groupBy("frame_id").applyInPandas(run, f"frame_id {kinds['frame_id']}, label {kinds['label']}, obj int, a double"))  # a row a patch
        return Start(points, beliefs, np.array(shares, float) / sum(shares))

    return start


def by_heat(nodes: DataFrame, edges: DataFrame, owners: DataFrame, words: int = 12, dims: int = 2, rounds: int = 20) -> Strategy:
    """As ``by_features``, of the words of heat kernel signatures in each patch; ``owners(frame_id, sv, label)`` says whose a node is."""

    def feature(points: DataFrame) -> DataFrame:
        heat = written(E.heat_kernel(nodes, edges).join(owners.where("label > 0"), ["frame_id", "sv"]).select(*PATCH, "hks"))
        book = E.code_words(heat, "hks", words)
        counted = A.tf_idf(heat.select(*PATCH, E.nearest_word(F.col("hks"), book).alias("word")))
        held = counted.groupBy(*PATCH).agg(F.map_from_entries(F.collect_list(F.struct("word", "tfidf"))).alias("m"))
        return held.select(*PATCH, F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0.0)) for i in range(words)]).alias("feature"))

    return by_features(feature, dims, rounds)


def by_boxes(nodes: DataFrame, cell: float, then: Strategy) -> Strategy:
    """Patches are the points in the boxes of a tree's objects (``tree.region_tree``); ``then`` says what they are believed to be."""
    return lambda points: then(points.drop("label").join(box_labels(points, nodes, cell), ["frame_id", "pt_id"]))


def columns_of(shares: np.ndarray, k: int, least: int = 9) -> np.ndarray:
    """How many of ``k`` centroids each object has: its share, at least ``least`` as long as they last; what is left goes to the largest."""
    least, left, out = min(least, k // len(shares)), k, np.zeros(len(shares), int)
    for o, share in enumerate(shares):
        out[o] = min(max(least, int(k * share)), left - least * (len(shares) - o - 1))
        left -= out[o]
    out[int(np.argmax(shares))] += left
    return out


def blocks(start: Start, sizes: np.ndarray, beta: float) -> DataFrame:
    """Responsibilities of one centroid of each object for each patch's points: (frame_id, label, obj, n, x, y, z, var, a).

    A patch without beliefs (label 0) is every centroid's alike. Rows are divided by their sum over all centroids and ``beta``;
    what is below the median of its frame and object, over points, becomes 0.
    """
    axes = "xyz"
    spread = sum((F.var_pop(c) for c in "yz"), F.var_pop("x"))
    held = start.points.groupBy(*PATCH).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in axes], spread.alias("var"))
    each = held.withColumn("obj", F.explode(F.sequence(F.lit(1), F.lit(len(sizes))))).join(start.beliefs.withColumnRenamed("a", "b"), [*PATCH, "obj"], "left")
    row = Window.partitionBy(*PATCH)  # a row an object
    a = F.coalesce("b", F.when(F.count("b").over(row) > 0, 0.0).otherwise(1.0 / int(sizes.sum())))
    size = F.element_at(F.array(*[F.lit(int(s)) for s in sizes]), F.col("obj"))
    each = each.withColumn("a", a).withColumn("a", F.col("a") / (F.sum(F.col("a") * size).over(row) + beta)).drop("b")
    middle = each.groupBy("frame_id", "obj").agg(F.expr("percentile(a, 0.5, n)").alias("mid"))
    return each.join(middle, ["frame_id", "obj"]).withColumn("a", F.when(F.col("a") < F.col("mid"), 0.0).otherwise(F.col("a"))).drop("mid")


def moments(alpha: DataFrame) -> DataFrame:
    """Of each frame and object: the mass of one centroid, its mean and the sum of squares about it."""
    an = F.col("a") * F.col("n")
    mean = alpha.groupBy("frame_id", "obj").agg(F.sum(an).alias("mass"), *[F.try_divide(F.sum(an * F.col(c)), F.sum(an)).alias("m" + c) for c in "xyz"])
    off = sum(((F.col(c) - F.col("m" + c)) ** 2 for c in "yz"), (F.col("x") - F.col("mx")) ** 2)
    about = alpha.join(mean, ["frame_id", "obj"]).groupBy("frame_id", "obj", "mass", "mx", "my", "mz").agg(F.sum(an * (F.col("var") + off)).alias("ss"))
    return about.withColumn("ss", F.coalesce("ss", F.lit(0.0)))


def initial(start: Start, k: int, var: Variant, seed: int = 1) -> Model:
    """The model after a round whose responsibilities are the start's.

    All centroids of an object have the same responsibilities then, so that round settles what they share: where the object is
    in each frame, its extent, its weight. Its centroids start on a sphere of that extent, as equal means would never part.
    An object without mass in a frame is put at the frame's mean.
    """
    sizes = columns_of(start.shares, k)
    beta = var.beta if var.beta is not None else 1e-5
    alpha = written(blocks(start, sizes, beta))
    got = moments(alpha).collect()  # a row for each frame and object, as poses are
    n = F.sum("n")
    middle = {r.frame_id: np.array([r.x, r.y, r.z]) for r in alpha.where("obj = 1").groupBy("frame_id").agg(*[(F.sum(F.col(c) * F.col("n")) / n).alias(c) for c in "xyz"]).collect()}
    objects = len(sizes)
    mass, ss, poses = np.zeros(objects), np.zeros(objects), {}
    for r in got:
        mass[r.obj - 1] += r.mass
        ss[r.obj - 1] += r.ss
        poses[r.frame_id, r.obj] = (np.eye(3), np.array([r.mx, r.my, r.mz]) if r.mass > 0 else middle[r.frame_id])
    extent = np.sqrt(np.maximum(ss / np.maximum(mass, 1e-300), 1e-12))
    x = np.concatenate([sphere(int(s), seed + o) / 0.4 * extent[o] for o, s in enumerate(sizes)])
    obj = np.repeat(np.arange(1, objects + 1), sizes)
    p = mass[obj - 1] / ((1 + beta) * max(float((mass * sizes).sum()), 1e-300))
    return Model(x, obj, p, np.minimum(3 / (2 * extent**2), 1e6)[obj - 1], poses)
