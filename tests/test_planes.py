"""Plane states: any parts in any order give the batch plane; a stream ends at the same states."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import planes as P

SCHEMA = "frame_id int, part int, x double, y double, z double"


def points(seed=1):
    """Two tilted planes far from the origin, a pair of points and a frame with a bad point."""
    r = np.random.default_rng(seed)
    rows = []
    for f, (normal, at) in enumerate((([0.2, -0.1, 1.0], [1e5, 2e5, 30.0]), ([-1.0, 0.3, 0.1], [0.0, 5.0, -2.0]))):
        n = np.array(normal) / np.linalg.norm(normal)
        u = np.cross(n, [0, 1, 0.5])
        base = np.stack([u / np.linalg.norm(u), np.cross(n, u / np.linalg.norm(u))])
        for i, (p, e) in enumerate(zip(r.uniform(-2, 2, (60, 2)), r.normal(0, 0.01, 60), strict=True)):
            rows.append((f, int(r.integers(0, 7)), *map(float, p @ base + n * e + at)))
    return [*rows, (2, 0, 0.0, 0.0, 0.0), (2, 1, 1.0, 1.0, 0.0), (3, 0, 1.0, 2.0, 3.0), (3, 1, float("nan"), 0.0, 0.0)]


def plain(rows, frame):
    x = np.array([r[2:] for r in rows if r[0] == frame])
    x = x[np.isfinite(x).all(1)]
    return x, x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0))


def test_merged_parts_equal_the_whole(spark):
    rows = points()
    table = spark.createDataFrame(rows, SCHEMA)
    whole = {r.frame_id: r for r in P.states(table, ["frame_id"]).collect()}
    two = P.merged(P.merged(P.states(table, ["frame_id", "part"]).withColumn("half", F.col("part") % 2), ["frame_id", "half"]), ["frame_id"])
    for got in (whole, {r.frame_id: r for r in two.collect()}):
        assert set(got) == {0, 1, 2, 3}
        for f, r in got.items():
            x, mean, s = plain(rows, f)
            assert r.n == len(x) and np.allclose([r.mx, r.my, r.mz], mean, rtol=1e-12)
            assert np.allclose([r[f"s{p}"] for p in P.PAIRS], [s[i, j] for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))], atol=1e-6)
    for r in P.planes(two, ["frame_id"]).collect():
        x, mean, s = plain(rows, r.frame_id)
        if r.n < 3:
            assert r.a is None and r.d is None and r.spread is None
            continue
        values, vectors = np.linalg.eigh(s)
        assert abs(abs(np.dot([r.a, r.b, r.c], vectors[:, 0])) - 1) < 1e-8 and abs(r.spread - values[0] / r.n) < 1e-8
        assert max((r.a, r.b, r.c), key=abs) > 0 and abs(np.dot([r.a, r.b, r.c], mean) + r.d) < 1e-6


def test_stream_ends_at_the_batch_states(spark, tmp_path):
    rows = points(2)
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = P.running_states(stream).writeStream.format("memory").queryName("plane_states").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    last = {}
    for r in spark.table("plane_states").collect():
        if r.frame_id not in last or r.n > last[r.frame_id].n:
            last[r.frame_id] = r
    for f in range(4):
        x, mean, s = plain(rows, f)
        assert last[f].n == len(x) and np.allclose([last[f].mx, last[f].my, last[f].mz], mean, rtol=1e-12) and last[f].sxy == pytest.approx(s[0, 1], abs=1e-6)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.planes(P.merged(P.states(empty, ["frame_id", "part"]), ["frame_id"]), ["frame_id"]).count() == 0
