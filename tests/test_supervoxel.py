"""Supervoxels against a plain version on random frames, and on cases that are odd."""

import collections
import math
import random

import pytest

from cloudloom.operators import supervoxel as X
from cloudloom.operators.ranks import places

SCHEMA = "frame_id int, pt_id long, x double, y double, z double, nx double, ny double, nz double, r int, g int, b int"
SIZE, SPACING = 0.25, 1.0


def scene(seed, n, frame):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.uniform(0, 4), rng.uniform(0, 3)
        tilt = rng.uniform(-0.2, 0.2)
        rows.append((frame, i, x, y, 0.2 * math.sin(x), tilt, 0.0, math.sqrt(1 - tilt * tilt), 200 if x > 2 else 30, rng.randrange(256), 90))
    return rows


def plain(rows, weights=(0.2, 0.8, 0.4), rounds=1 + int(1.8 * SPACING / SIZE)):
    """One frame at a time, with dictionaries: {pt_id: seed voxel or None}, and seeds."""

    def cells(pts, size):
        lo, hi = ([f(p[c] for p in pts) for c in range(3)] for f in (min, max))
        half = max((h - l) / 2 for l, h in zip(lo, hi))
        leaf = 2 * half / 2 ** max(0, math.floor(math.log2(half / size)) + 1)
        origin = [(h + l) / 2 - half for l, h in zip(lo, hi)]
        return [tuple(max(0, math.floor((p[c] - origin[c]) / leaf)) for c in range(3)) for p in pts], origin, leaf

    def unit(v):
        n = math.sqrt(sum(a * a for a in v))
        return [a / n for a in v] if n > 1e-12 else [0.0] * 3

    at, origin, leaf = cells([r[2:5] for r in rows], SIZE)
    members = collections.defaultdict(list)
    for k, r in zip(at, rows):
        members[k].append(r)
    feature = {}
    for k, m in members.items():
        mean = [sum(r[c] for r in m) / len(m) for c in range(2, 11)]
        feature[k] = (mean[:3], unit([sum(r[c] for r in m) for c in (5, 6, 7)]), mean[6:])
    middle = {k: [origin[c] + (k[c] + 0.5) * leaf for c in range(3)] for k in members}
    beside = {k: [o for o in members if o != k and max(abs(a - b) for a, b in zip(k, o)) <= 1] for k in members}
    keys = sorted(members)
    coarse, low, big = cells([middle[k] for k in keys], SPACING)
    starts = set()
    for c in set(coarse):
        m = [low[i] + (c[i] + 0.5) * big for i in range(3)]
        starts.add(min(keys, key=lambda k: (round(math.dist(middle[k], m) ** 2, 9), k)))
    radius = SPACING / 2
    full = {k for k in starts if sum(math.dist(middle[k], middle[o]) ** 2 < radius**2 for o in keys) > 0.05 * math.pi * radius**2 / SIZE**2}
    seeds = {k for k in full if len(beside[k]) >= 6}

    def far(k, s):
        (p, n, c), (q, m, d) = feature[k], feature[s]
        return round(weights[0] * (1 - abs(sum(a * b for a, b in zip(n, m)))) + weights[1] * math.dist(c, d) / 255 + weights[2] * math.dist(p, q) / SPACING, 9)

    owner = {k: (0.0, k) for k in seeds}
    for _ in range(rounds):
        offers = collections.defaultdict(set)
        for k, (_, s) in owner.items():
            for o in beside[k]:
                offers[o].add((far(o, s), s))
        won = {o: min(c) for o, c in offers.items() if o not in owner or min(c)[0] < owner[o][0]}
        owner.update(won)
    return {r[1]: owner[k][1] if k in owner else None for k, r in zip(at, rows)}, {k: s for k, (_, s) in owner.items()}


def number(k):
    return k[0] * (1 << 42) + k[1] * (1 << 21) + k[2]


@pytest.mark.parametrize("weights", [(0.2, 0.8, 0.4), (0.0, 0.0, 1.0)])
def test_equals_the_plain_version(spark, weights):
    frames = {0: scene(1, 700, 0), 1: scene(2, 150, 1)}
    run = X.supervoxels(spark.createDataFrame([r for rows in frames.values() for r in rows], SCHEMA), SIZE, SPACING, X.weighted(SPACING, *weights))
    labels = {(r.frame_id, r.pt_id): r.label for r in run.labels().collect()}
    total = {(r.frame_id, r.label): r for r in run.summary().collect()}
    links = {(r.frame_id, r.a, r.b) for r in run.edges().collect()}
    for f, rows in frames.items():
        want, held = plain(rows, weights)
        sizes = collections.Counter(held.values())
        name = {s: i + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (-sizes[s], number(s))))}
        assert len(name) > 3
        assert {p: name.get(s, 0) for p, s in want.items()} == {p: v for (g, p), v in labels.items() if g == f}
        points = collections.Counter(want.values())
        assert {(total[f, i].voxels, total[f, i].size) for i in name.values()} == {(sizes[s], points[s]) for s in name}
        met = {tuple(sorted((name[held[a]], name[held[b]]))) for a in held for b in held if held[a] != held[b] and max(abs(p - q) for p, q in zip(a, b)) <= 1}
        assert met == {(a, b) for g, a, b in links if g == f}


def test_a_distance_of_ones_own(spark):
    """A distance that forbids another colour keeps the halves of a sheet apart."""
    rows = [(0, i * 40 + j, i * 0.1, j * 0.1, 0.0, 0.0, 0.0, 1.0, 250 if i >= 20 else 10, 0, 0) for i in range(40) for j in range(40)]

    def same(a, b):
        from pyspark.sql import functions as F

        apart = F.sqrt((a("x") - b("x")) * (a("x") - b("x")) + (a("y") - b("y")) * (a("y") - b("y")))
        return apart + F.when(F.abs(a("r") - b("r")) > 100, 1000.0).otherwise(0.0)

    run = X.supervoxels(spark.createDataFrame(rows, SCHEMA), 0.12, 0.5, same)
    half = collections.defaultdict(set)
    for r in run.labels().collect():
        half[r.label].add(r.pt_id // 40 >= 20)
    assert 0 not in half and len(half) > 6 and all(len(s) == 1 for s in half.values())


def test_odd_rows(spark):
    rows = scene(3, 400, 0)
    clean = {r.pt_id: r.label for r in X.supervoxels(spark.createDataFrame(rows, SCHEMA), SIZE, SPACING).labels().collect()}
    nan, none = float("nan"), None
    odd = [(0, 900, none, 1.0, 0.0, 0.0, 0.0, 1.0, 1, 1, 1), (0, 901, nan, 1.0, 0.0, 0.0, 0.0, 1.0, 1, 1, 1), (0, 902, float("inf"), 1.0, 0.0, 0.0, 0.0, 1.0, 1, 1, 1), (7, 0, 1.0, 1.0, 1.0, none, none, none, none, none, none)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS voxel", "'x' AS leaf", "2 AS label", "3 AS kx", "4 AS seed")
    run = X.supervoxels(df.repartition(7), SIZE, SPACING)
    got = {(r.frame_id, r.pt_id): r.label for r in run.labels().collect()}
    assert {p: v for (f, p), v in got.items() if f == 0 and p < 900} == clean
    assert [got[k] for k in ((0, 900), (0, 901), (0, 902), (7, 0))] == [0, 0, 0, 0]
    empty = X.supervoxels(spark.createDataFrame([], SCHEMA), SIZE, SPACING)
    assert empty.labels().count() == empty.summary().count() == empty.edges().count() == 0


def test_places(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else f"g{i % 9}", rng.randrange(50), i) for i in range(3000)]
    got = places(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], ["v", "i"], "place").collect()
    groups = collections.defaultdict(list)
    for k, v, i in sorted(rows):
        groups[k].append(i)
    assert {(r.k, r.i): r.place for r in got} == {(k, i): n + 1 for k, m in groups.items() for n, i in enumerate(m)}


def test_touching_voxels_are_bits_across_blocks(spark):
    r = random.Random(9)
    keys = [(0, k) for k in {tuple(r.randrange(29, 36) for _ in range(3)) for _ in range(90)}] + [(1, k) for k in [(0, 0, 0), (0, 1, 0), (63, 64, 31), (64, 63, 32), (64, 65, 31)]]
    packed = lambda k: k[0] * (1 << 42) + k[1] * (1 << 21) + k[2]
    voxels = spark.createDataFrame([(f, packed(k), *k) for f, k in keys], "frame_id int, voxel long, kx long, ky long, kz long")
    near = X.touching(voxels)
    assert near.count() == len(keys)
    got = {tuple(row) for row in near.select("frame_id", "voxel", X.touched().alias("nb")).collect()}
    assert got == {(f, packed(a), packed(b)) for f, a in keys for g, b in keys if f == g and a != b and max(abs(i - j) for i, j in zip(a, b, strict=True)) == 1}
