"""Supervoxels: voxels of an octree's leaf size, taken by seeds in competing wavefronts over touching voxels.

Seeds are the voxels nearest to the middles of a coarser octree's leaves; one that has few voxels around it, or fewer than six that
touch it, is no seed. In a round each voxel that has just changed hands is offered, through its touching voxels, on behalf of its seed;
a voxel goes to the best offer if that is nearer than what holds it now. All offers of a round are judged together, so the result
depends on no order of visits; equal offers go to the seed with the lesser key.

Voxels and their owners are tables. Which of the 26 around it a voxel touches are bits of one number, found by blocks of the grid
with a margin of one voxel. In a round only what moved is spread to what it touches, and joined with the voxels, which stay dealt as
they are, and the seeds; what a seed can reach is bounded by the rounds. No frame and no supervoxel is held by one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import spatial as S
from cloudloom.operators.ranks import places
from cloudloom.sources.shared import written

FRAME = ("frame_id",)
BLOCK = 32  # voxels along a block's side
STEPS = [i * (1 << 42) + j * (1 << 21) + h for i in (-1, 0, 1) for j in (-1, 0, 1) for h in (-1, 0, 1) if (i, j, h) != (0, 0, 0)]  # in packed keys, rising
FEATURES = ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b")
Distance = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def weighted(seed_size: float, normal: float = 0.2, colour: float = 0.8, space: float = 0.4) -> Distance:
    """The usual distance of a voxel from a seed: turn of the normals, colours over 255, place over the seeds' spacing."""

    def distance(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        turn = F.abs(a("nx") * b("nx") + a("ny") * b("ny") + a("nz") * b("nz"))
        rgb, xyz = (F.sqrt(sum(((a(c) - b(c)) * (a(c) - b(c)) for c in names[1:]), (a(names[0]) - b(names[0])) * (a(names[0]) - b(names[0])))) for names in ("rgb", "xyz"))
        return normal * (1 - turn) + colour * (rgb / 255.0) + space * (xyz / float(seed_size))

    return distance


def leaves(points: DataFrame, size: float, by: Sequence[str]) -> DataFrame:
    """``S.octree_cells``; a frame's least point, which rounding may put just outside its corner, is in the first leaf."""
    return S.octree_cells(points, size, by).withColumns({f"k{c}": F.greatest(F.lit(0).cast("long"), F.col(f"k{c}")) for c in "xyz"})


def packed() -> Column:
    """One number for a leaf's place: 21 bits an axis."""
    big = F.greatest("kx", "ky", "kz") >= 1 << 21
    key = F.col("kx") * (1 << 42) + F.col("ky") * (1 << 21) + F.col("kz")
    return F.when(big, F.raise_error(F.lit("a frame's extent is over 2^20 voxels")).cast("long")).otherwise(key)


def middles(cells: DataFrame) -> dict[str, Column]:
    return {c: F.col(f"o{c}") + (F.col(f"k{c}") + 0.5) * F.col("leaf") for c in "xyz"}


def voxelised(points: DataFrame, size: float, by: Sequence[str] = FRAME) -> tuple[DataFrame, DataFrame]:
    """(points(by, pt_id, voxel), voxels(by, voxel, kx.., mx.. the leaf's middle, size, means of places and colours, unit normal)).

    Points without a finite place are in no voxel. Missing colours and normals don't count in a voxel's means; a voxel without any has zeros.
    """
    by = list(by)
    sound = points.where("abs(x) + abs(y) + abs(z) < double('infinity')")  # false for infinite and NaN, which Spark orders last
    at = written(leaves(sound.select(*by, "pt_id", *FEATURES), size, by).withColumn("voxel", packed()))
    means = [F.avg(c).alias(c) for c in "xyz"] + [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in "rgb"]
    normals = [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s{c}") for c in ("nx", "ny", "nz")]
    places = [F.first(c).alias(c) for c in ("ox", "oy", "oz", "leaf")]  # the same in all of a frame
    v = at.groupBy(*by, "voxel", "kx", "ky", "kz").agg(F.count(F.lit(1)).alias("size"), *means, *normals, *places)
    length = F.sqrt(F.col("snx") * F.col("snx") + F.col("sny") * F.col("sny") + F.col("snz") * F.col("snz"))
    unit = [F.when(length > 1e-12, F.col(f"sn{c}") / length).otherwise(0.0).alias(f"n{c}") for c in "xyz"]
    v = v.select(*by, "voxel", "kx", "ky", "kz", *[m.alias(f"m{c}") for c, m in middles(v).items()], "size", "x", "y", "z", *unit, "r", "g", "b")
    return at.select(*by, "pt_id", "voxel"), written(v)


def touching(voxels: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """(by, voxel, near): a bit for each of ``STEPS`` that leads to a voxel. A block of the grid has at most 34^3 rows."""
    by = list(by)
    rows = voxels.select(*by, "voxel", "kx", "ky", "kz")
    for c in "xyz":
        rows = rows.withColumn(f"b{c}", F.explode(F.array_distinct(F.array(*[F.floor((F.col(f"k{c}") + i) / BLOCK).cast("long") for i in (-1, 0, 1)]))))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        own = p[(p.kx // BLOCK == p.bx) & (p.ky // BLOCK == p.by) & (p.kz // BLOCK == p.bz)]
        keys, at = np.sort(p.voxel.to_numpy()), own.voxel.to_numpy()
        near = np.zeros(len(at), np.int64)
        for bit, step in enumerate(STEPS):
            i = np.minimum(np.searchsorted(keys, at + step), len(keys) - 1)
            near |= (keys[i] == at + step).astype(np.int64) << bit
        return own[[*by, "voxel"]].assign(near=near)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in voxels.select(*by).schema)
    return written(rows.groupBy(*by, "bx", "by", "bz").applyInPandas(run, f"{kinds}, voxel long, near long"))


def touched(steps: Sequence[int] = range(len(STEPS))) -> Column:
    """The voxels that a row's ``voxel`` touches by its bits, one a row."""
    return F.explode(F.array_compact(F.array(*[F.when(F.col("near").bitwiseAND(F.lit(1 << i)) != 0, F.col("voxel") + F.lit(STEPS[i])) for i in steps])))


def seeds(voxels: DataFrame, near: DataFrame, size: float, seed_size: float, least_links: int = 6, share: float = 0.05, by: Sequence[str] = FRAME) -> DataFrame:
    """Voxels that may start a supervoxel: (by, voxel).

    Around a seed, within half the seeds' spacing, lie more than ``share`` of the voxels of a full disc. The voxel nearest to a
    leaf's middle is in the leaf or touches it: a middle is at most 0.87 leaf sizes from what is in the leaf, and 1.5 from what is farther off.
    """
    by = list(by)
    spots = voxels.select(*by, "voxel", *[F.col(f"m{c}").alias(c) for c in "xyz"])
    cells = written(leaves(spots, seed_size, by))
    middle = cells.select(*by, "kx", "ky", "kz", "ox", "oy", "oz", "leaf").distinct()
    middle = middle.select(*by, "kx", "ky", "kz", *[m.alias(f"m{c}") for c, m in middles(middle).items()])
    d = sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "yz"), (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")))
    # leaves, which are few, are spread and not voxels
    spread = S.around(middle.withColumns({f"a{c}": F.col(f"k{c}") for c in "xyz"}))
    asked = cells.select(*by, "voxel", "x", "y", "z", "kx", "ky", "kz").join(spread, [*by, "kx", "ky", "kz"])
    nearest = asked.groupBy(*by, "ax", "ay", "az").agg(F.min(F.struct(F.round(d, 9).alias("d"), "voxel")).alias("m")).select(*by, "m.voxel").distinct()
    nearest = written(nearest)
    radius = 0.5 * seed_size
    some = spots.join(nearest, [*by, "voxel"], "left_semi")
    full = S.radius_join(spots, some, radius, by=by, key="voxel").groupBy(*by, F.col("nb").alias("voxel")).agg(F.count(F.lit(1)).alias("n"))
    full = full.where(F.col("n") > share * math.pi * radius * radius / (size * size)).select(*by, "voxel")
    met = near.where(F.bit_count("near") >= least_links).select(*by, "voxel")
    return full.join(met, [*by, "voxel"])


def grown(voxels: DataFrame, near: DataFrame, starts: DataFrame, rounds: int, distance: Distance, by: Sequence[str] = FRAME) -> DataFrame:
    """(by, voxel, near, seed, d): who holds each voxel after the rounds, null where no wavefront came. Ends early if nothing moves."""
    by = list(by)
    parts = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    feature = voxels.select(*by, "voxel", *FEATURES).repartition(parts, *by, "voxel").persist(StorageLevel.DISK_ONLY)  # dealt once for all rounds
    centre = written(feature.join(starts, [*by, "voxel"], "left_semi").select(*by, F.col("voxel").alias("seed"), *[F.col(c).alias(f"seed_{c}") for c in FEATURES]))
    few = centre.count() <= 300_000  # counted rows of ten numbers
    first = near.join(centre.select(*by, F.col("seed").alias("voxel"), F.col("seed")), [*by, "voxel"], "left")
    owner = written(first.select(*by, "voxel", "near", "seed", F.when(F.col("seed").isNotNull(), 0.0).alias("d"), F.col("seed").isNotNull().alias("moved")))
    d = F.round(distance(F.col, lambda c: F.col(f"seed_{c}")), 9)
    for _ in range(rounds):
        moved = owner.where("moved")
        if moved.isEmpty():
            break
        offers = moved.select(*by, touched().alias("voxel"), "seed").repartition(parts, *by, "voxel").distinct()
        judged = offers.join(F.broadcast(centre) if few else centre, [*by, "seed"]).join(feature, [*by, "voxel"])
        best = judged.groupBy(*by, "voxel").agg(F.min(F.struct(d.alias("d"), "seed")).alias("m"))
        new = owner.join(best, [*by, "voxel"], "left")
        takes = F.coalesce((F.col("m.d") < F.col("d")) | (F.col("seed").isNull() & F.col("m").isNotNull()), F.lit(False))
        owner = written(new.select(*by, "voxel", "near", F.when(takes, F.col("m.seed")).otherwise(F.col("seed")).alias("seed"), F.when(takes, F.col("m.d")).otherwise(F.col("d")).alias("d"), takes.alias("moved")))
    feature.unpersist()
    return owner.select(*by, "voxel", "near", "seed", "d")


@dataclass
class Supervoxels:
    """Tables of one run; labels count from 1 in each frame, the supervoxel of most voxels first, 0 is none."""

    points: DataFrame
    voxels: DataFrame
    owner: DataFrame
    by: list[str]

    def labels(self) -> DataFrame:
        """(by, pt_id, label) of all points."""
        at = self.points.join(self.owner.select(*self.by, "voxel", "label"), [*self.by, "voxel"], "left")
        return at.select(*self.by, "pt_id", F.coalesce("label", F.lit(0)).cast("long").alias("label"))

    def summary(self) -> DataFrame:
        """(by, label, voxels, size in points, centre, colour, unit normal): means over a supervoxel's voxels."""
        held = self.voxels.join(self.owner.where("label > 0").select(*self.by, "voxel", "label"), [*self.by, "voxel"])
        s = held.groupBy(*self.by, "label").agg(F.count(F.lit(1)).alias("voxels"), F.sum("size").alias("size"), *[F.avg(c).alias(c) for c in FEATURES])
        length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
        unit = [F.when(length > 1e-12, F.col(f"n{c}") / length).otherwise(0.0).alias(f"n{c}") for c in "xyz"]
        return s.select(*self.by, "label", "voxels", "size", *[F.col(c).alias(f"c{c}") for c in "xyz"], *unit, "r", "g", "b")

    def edges(self) -> DataFrame:
        """Supervoxels that touch: (by, a, b, links) with a < b and the number of touching pairs of voxels."""
        side = self.owner.where("label > 0")
        ends = side.select(*self.by, touched(range(len(STEPS) // 2, len(STEPS))).alias("voxel"), F.col("label").alias("p"))  # to greater keys
        ends = ends.join(side.select(*self.by, "voxel", F.col("label").alias("q")), [*self.by, "voxel"]).where("p <> q")
        return ends.groupBy(*self.by, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.count(F.lit(1)).alias("links"))


def supervoxels(points: DataFrame, size: float, seed_size: float, distance: Distance | None = None, rounds: int | None = None, by: Sequence[str] = FRAME) -> Supervoxels:
    """Supervoxels of ``points(by, pt_id, x.., nx.., r, g, b)``; ``distance`` gives a Column from accessors of a voxel's and a seed's features.

    A frame without a voxel that may be a seed has no supervoxel: all its points get 0, as do points without a finite place. Repeated points weigh more in means.
    """
    by = list(by)
    at, voxels = voxelised(points, size, by)
    near = touching(voxels, by)
    rounds = 1 + int(1.8 * seed_size / size) if rounds is None else rounds
    owner = grown(voxels, near, seeds(voxels, near, size, seed_size, by=by), rounds, distance or weighted(seed_size), by)
    sizes = owner.where("seed IS NOT NULL").groupBy(*by, "seed").agg((-F.count(F.lit(1))).alias("less"))
    names = places(sizes, by, ["less", "seed"], "label")
    owner = written(owner.join(names.select(*by, "seed", "label"), [*by, "seed"], "left").select(*by, "voxel", "near", "seed", F.coalesce("label", F.lit(0)).alias("label")))
    everyone = at.unionByName(points.where("x IS NULL OR y IS NULL OR z IS NULL OR NOT (abs(x) + abs(y) + abs(z) < double('infinity'))").select(*by, "pt_id", F.lit(None).cast("long").alias("voxel")))
    return Supervoxels(everyone, voxels, owner, by)
