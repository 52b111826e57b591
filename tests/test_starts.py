"""Each start of the registration finds two planted objects again, whatever their patches are called in a frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import register as G
from cloudloom.operators import starts as B

SCHEMA = "frame_id int, pt_id long, x double, y double, z double, r int, g int, b int, label int, planted int"


def room(frames=3, flip=True):
    """A flat red plate of 160 points and a high blue pole of 80, moved and turned in each frame; labels change places in odd frames."""
    rows = []
    shapes = {1: np.random.default_rng(1).uniform(-1, 1, (160, 3)) * [1.0, 0.7, 0.1], 2: np.random.default_rng(2).uniform(-1, 1, (80, 3)) * [0.1, 0.1, 1.2]}
    colours = {1: (220, 30, 40), 2: (20, 60, 210)}
    for f in range(frames):
        t = 0.3 * f
        turn = np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
        for o, shape in shapes.items():
            at = shape @ turn.T + ([0.5 * f, 0, 0] if o == 1 else [4 - f, 3 + f, 1])
            label = 3 - o if flip and f % 2 else o
            rows += [(f, len(rows) + i, *map(float, v), *colours[o], label, o) for i, v in enumerate(at)]
    return rows


def purity(labels, points):
    """Share of points whose object is the one that most points of their planted object got over all frames; 0 if both got the same."""
    counts = labels.join(points.select("frame_id", "pt_id", "planted"), ["frame_id", "pt_id"]).groupBy("planted", labels["label"].alias("got")).count().collect()
    best = {o: max((r for r in counts if r.planted == o), key=lambda r: r["count"]) for o in (1, 2)}
    return 0.0 if best[1].got == best[2].got else sum(r["count"] for r in best.values()) / sum(r["count"] for r in counts)


def colours(p):
    return p.groupBy("frame_id", "label").agg(F.array(F.avg("r") / 255, F.avg("g") / 255, F.avg("b") / 255).alias("feature"))


def heat(points):
    """Ten nodes a patch: a ring in plates, a star in poles, so that only the graph tells them apart."""
    patches = points.select("frame_id", "label", "planted").distinct()
    nodes = patches.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("sv", (F.col("label") * 100 + F.col("i")).cast("long"))
    other = F.when(F.col("planted") == 1, (F.col("i") + 1) % 10).otherwise(0)
    edges = nodes.where("planted = 1 OR i > 0").select("frame_id", "sv", (F.col("label") * 100 + other).cast("long").alias("o"))
    edges = edges.select("frame_id", F.least("sv", "o").alias("a"), F.greatest("sv", "o").alias("b"), F.lit(1.0).alias("w"))
    return B.by_heat(nodes.select("frame_id", "sv"), edges, nodes.select("frame_id", "sv", "label"), words=3)


def boxes(points):
    """Patches come from boxes of a tree; the given labels are of no use."""
    grown = points.groupBy("frame_id", "planted").agg(*[((F.min(c) + F.max(c)) / 2).alias(f"c{c}") for c in "xyz"], *[(F.max(c) - F.min(c) + 0.01).alias(n) for c, n in zip("xyz", ("length", "width", "height"), strict=True)])
    nodes = grown.select("frame_id", F.col("planted").cast("long").alias("node"), F.lit(True).alias("is_obj"), "cx", "cy", "cz", "length", "width", "height", F.lit(0.0).alias("yaw"))
    return B.by_boxes(nodes, 1.0, B.by_features(colours))


@pytest.mark.parametrize("kind", ["features", "sizes", "heat", "boxes"])
def test_starts_find_planted_objects(spark, kind):
    points = spark.createDataFrame(room(), SCHEMA)
    if kind == "boxes":
        points = points.withColumn("label", F.lit(1))
    strategy = {"features": lambda: B.by_features(colours), "sizes": lambda: B.by_sizes([2, 1]), "heat": lambda: heat(points), "boxes": lambda: boxes(points)}[kind]()
    var = G.VARIANTS["jrcs_base"]
    start = strategy(points)
    assert abs(start.shares.sum() - 1) < 1e-9 and len(start.shares) == 2
    model = B.initial(start, 40, var)
    assert purity(G.labels(points, model, var), points) > 0.9
    model = G.fit(start.points, model, var, 3)
    assert purity(G.labels(points, model, var), points) > 0.9


def test_blocks_against_plain_rule(spark):
    """Responsibilities and moments, held against matrices of points and centroids; with points of no patch and an empty frame of one object."""
    rows = [*room(2), *[(0, 9000 + i, 0.1 * i, 1.0, 2.0, 0, 0, 0, 0, 1) for i in range(30)], *[(7, 9100 + i, 1.0, 0.1 * i, 0.0, 220, 30, 40, 5, 1) for i in range(20)]]
    points = spark.createDataFrame(rows, SCHEMA)
    beliefs = {(0, 1): [0.9, 0.2], (0, 2): [0.1, 0.7], (1, 1): [0.3, 0.4], (1, 2): [0.5, 0.1], (7, 5): [1.0, None]}
    table = spark.createDataFrame([(f, la, o + 1, a) for (f, la), v in beliefs.items() for o, a in enumerate(v) if a is not None], "frame_id int, label int, obj int, a double")
    sizes = B.columns_of(np.array([0.6, 0.4]), 25)
    assert list(sizes) == [15, 10]
    got = {(r.frame_id, r.obj): r for r in B.moments(B.blocks(B.Start(points, table, np.array([0.6, 0.4])), sizes, 0.01)).collect()}
    for f in (0, 1, 7):
        own = [r for r in rows if r[0] == f]
        v = np.array([r[2:5] for r in own])
        a = np.array([[x or 0.0 for x in beliefs[f, r[8]]] if r[8] else [1 / 25] * 2 for r in own])
        a = np.repeat(a, sizes, axis=1)
        a = a / (a.sum(1, keepdims=True) + 0.01)
        a[a < np.median(a, axis=0)] = 0
        for o, c in ((1, 0), (2, 20)):
            w, r = a[:, c], got[f, o]
            assert abs(w.sum() - r.mass) < 1e-9
            if w.sum() == 0:
                assert r.mx is None and r.ss == 0
                continue
            mean = w @ v / w.sum()
            assert np.allclose([r.mx, r.my, r.mz], mean) and abs(r.ss - w @ ((v - mean) ** 2).sum(1)) < 1e-8


def test_reduced_features_keep_distances(spark):
    x = np.random.default_rng(3).normal(size=(30, 2)) @ np.random.default_rng(4).normal(size=(2, 6)) + 5
    rows = spark.createDataFrame([(i, 1, list(map(float, v))) for i, v in enumerate(x)], "frame_id int, label int, feature array<double>")
    got = np.array([r.feature for r in B.reduced(rows, 2).orderBy("frame_id").collect()])
    assert got.shape == (30, 2)
    assert np.allclose(np.linalg.norm(got[:, None] - got[None], axis=2), np.linalg.norm(x[:, None] - x[None], axis=2))


def test_columns_and_no_patches(spark):
    assert list(B.columns_of(np.array([0.05, 0.9, 0.05]), 40)) == [9, 22, 9]
    assert list(B.columns_of(np.array([0.5, 0.5]), 4)) == [2, 2]
    points = spark.createDataFrame([r for r in room(1)], SCHEMA).withColumn("label", F.lit(0))
    with pytest.raises(ValueError):
        B.by_features(colours)(points)
