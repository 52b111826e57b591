"""Queries on supervoxels grown by wavefronts, each with its SQL: the rounds are common table expressions, one after another."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import supervoxel as X
from cloudloom.plans.registry import query, rounded
from cloudloom.sources.views import Views, with_views

SIZE, SPACING = 0.2, 0.8
ROUNDS = 1 + int(1.8 * SPACING / SIZE)
LEAST = 0.05 * math.pi * (0.5 * SPACING) ** 2 / SIZE**2


def octree(name: str, table: str, size: float, carried: str) -> str:
    """CTE ``name``: rows of ``table`` with their leaf's place in the frame's octree."""
    return f"""{name}_h AS (SELECT frame_id, greatest((max(x) - min(x)) / 2, (max(y) - min(y)) / 2, (max(z) - min(z)) / 2) AS half,
   (max(x) + min(x)) / 2 AS ax, (max(y) + min(y)) / 2 AS ay, (max(z) + min(z)) / 2 AS az FROM {table} GROUP BY frame_id),
 {name}_f AS (SELECT frame_id, ax - half AS ox, ay - half AS oy, az - half AS oz, CASE WHEN half > 0 THEN 2 * half / pow(2e0, greatest(0, floor(log2(half / {size!r}e0)) + 1)) ELSE 0e0 END AS leaf FROM {name}_h),
 {name}_g AS (SELECT t.*, ox, oy, oz, leaf, CASE WHEN leaf > 0 THEN leaf ELSE 1e0 END AS by_leaf FROM {table} t JOIN {name}_f USING (frame_id)),
 {name} AS MATERIALIZED (SELECT {carried}, frame_id, x, y, z, greatest(0, CAST(floor((x - ox) / by_leaf) AS BIGINT)) AS kx, greatest(0, CAST(floor((y - oy) / by_leaf) AS BIGINT)) AS ky, greatest(0, CAST(floor((z - oz) / by_leaf) AS BIGINT)) AS kz,
   ox, oy, oz, leaf FROM {name}_g)"""


def unit(name: str) -> str:
    """CASE: the part of a summed normal along one axis, at unit length."""
    return f"CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-12 THEN {name} / sqrt(nx * nx + ny * ny + nz * nz) ELSE 0e0 END AS {name}"


FEATURES = ", ".join(X.FEATURES)
MIDDLE = ", ".join(f"o{c} + (k{c} + 0.5e0) * leaf AS m{c}" for c in "xyz")
DISTANCE = """round(0.2e0 * (1 - abs(v.nx * c.nx + v.ny * c.ny + v.nz * c.nz)) + 0.8e0 * (sqrt((v.r - c.r) * (v.r - c.r) + (v.g - c.g) * (v.g - c.g) + (v.b - c.b) * (v.b - c.b)) / 255e0)
   + 0.4e0 * (sqrt((v.x - c.x) * (v.x - c.x) + (v.y - c.y) * (v.y - c.y) + (v.z - c.z) * (v.z - c.z)) / """ + f"{SPACING!r}e0), 9)"


def turn(i: int) -> str:
    """CTE ``o{i}``: who holds each voxel after round i."""
    return f"""q{i} AS (SELECT DISTINCT o.frame_id, l.b AS voxel, o.seed FROM o{i - 1} o JOIN l ON l.frame_id = o.frame_id AND l.a = o.voxel WHERE o.moved),
 w{i} AS (SELECT q.frame_id, q.voxel, q.seed, {DISTANCE} AS d FROM q{i} q JOIN v ON v.frame_id = q.frame_id AND v.voxel = q.voxel JOIN v c ON c.frame_id = q.frame_id AND c.voxel = q.seed),
 m{i} AS (SELECT * FROM w{i} QUALIFY row_number() OVER (PARTITION BY frame_id, voxel ORDER BY d, seed) = 1),
 o{i} AS MATERIALIZED (SELECT o.frame_id, o.voxel, CASE WHEN m.d < coalesce(o.d, 1e300) THEN m.seed ELSE o.seed END AS seed, CASE WHEN m.d < coalesce(o.d, 1e300) THEN m.d ELSE o.d END AS d,
   coalesce(m.d < coalesce(o.d, 1e300), false) AS moved FROM o{i - 1} o LEFT JOIN m{i} m ON m.frame_id = o.frame_id AND m.voxel = o.voxel)"""


GROWN = f"""+ pn AS (SELECT p.frame_id, p.pt_id, x, y, z, nx, ny, nz, r, g, b FROM pts p JOIN nrm USING (frame_id, pt_id)),
 {octree("k", "pn", SIZE, "pt_id, nx, ny, nz, r, g, b")},
 vox AS (SELECT frame_id, pt_id, kx * 4398046511104 + ky * 2097152 + kz AS voxel FROM k),
 vs AS (SELECT frame_id, kx * 4398046511104 + ky * 2097152 + kz AS voxel, kx, ky, kz, {MIDDLE}, count(*) AS size, avg(x) AS x, avg(y) AS y, avg(z) AS z, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz,
   avg(r) AS r, avg(g) AS g, avg(b) AS b FROM k GROUP BY frame_id, kx, ky, kz, ox, oy, oz, leaf),
 v AS MATERIALIZED (SELECT frame_id, voxel, kx, ky, kz, mx, my, mz, size, x, y, z, {unit("nx")}, {unit("ny")}, {unit("nz")}, r, g, b FROM vs),
 near AS (SELECT frame_id, voxel, kx + i AS kx, ky + j AS ky, kz + h AS kz FROM v, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS h)),
 l AS MATERIALIZED (SELECT n.frame_id, n.voxel AS a, v.voxel AS b FROM near n JOIN v USING (frame_id, kx, ky, kz) WHERE n.voxel <> v.voxel),
 spot AS (SELECT frame_id, voxel, mx AS x, my AS y, mz AS z FROM v),
 {octree("sc", "spot", SPACING, "voxel")},
 mid AS (SELECT DISTINCT frame_id, kx, ky, kz, {MIDDLE} FROM sc),
 near_mid AS (SELECT m.frame_id, m.kx, m.ky, m.kz, s.voxel, round((s.x - mx) * (s.x - mx) + (s.y - my) * (s.y - my) + (s.z - mz) * (s.z - mz), 9) AS d
   FROM mid m JOIN sc s ON s.frame_id = m.frame_id AND abs(s.kx - m.kx) <= 1 AND abs(s.ky - m.ky) <= 1 AND abs(s.kz - m.kz) <= 1),
 nearest AS (SELECT DISTINCT frame_id, voxel FROM (SELECT * FROM near_mid QUALIFY row_number() OVER (PARTITION BY frame_id, kx, ky, kz ORDER BY d, voxel) = 1)),
 crowd AS (SELECT n.frame_id, n.voxel FROM nearest n JOIN spot p USING (frame_id, voxel) JOIN spot t ON t.frame_id = p.frame_id
   AND (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z) < {(0.5 * SPACING) ** 2!r}e0 GROUP BY n.frame_id, n.voxel HAVING count(*) > {LEAST!r}e0),
 seeds AS (SELECT frame_id, voxel FROM crowd JOIN (SELECT frame_id, a AS voxel FROM l GROUP BY frame_id, a HAVING count(*) >= 6) USING (frame_id, voxel)),
 o0 AS MATERIALIZED (SELECT v.frame_id, v.voxel, s.voxel AS seed, CASE WHEN s.voxel IS NOT NULL THEN 0e0 END AS d, s.voxel IS NOT NULL AS moved FROM v LEFT JOIN seeds s ON s.frame_id = v.frame_id AND s.voxel = v.voxel),
 {", ".join(turn(i) for i in range(1, ROUNDS + 1))},
 names AS (SELECT frame_id, seed, row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, seed) AS label FROM o{ROUNDS} WHERE seed IS NOT NULL GROUP BY frame_id, seed),
 held AS MATERIALIZED (SELECT o.frame_id, o.voxel, CAST(coalesce(label, 0) AS BIGINT) AS label FROM o{ROUNDS} o LEFT JOIN names n ON n.frame_id = o.frame_id AND n.seed = o.seed)"""  # fmt: skip


def grown(v: Views) -> X.Supervoxels:
    return X.supervoxels(v.pts.join(v.nrm, ["frame_id", "pt_id"]), SIZE, SPACING)


@query("supervoxel", with_views("pts nrm", GROWN + " SELECT frame_id, pt_id, label FROM vox JOIN held USING (frame_id, voxel)"))
def supervoxel(v: Views) -> DataFrame:
    """Each point's supervoxel, from 1 by falling number of voxels; 0 where no wavefront came."""
    return grown(v).labels()


@query("supervoxel_summary", with_views("pts nrm", GROWN + f""", u AS (SELECT frame_id, label, count(*) AS voxels, CAST(sum(size) AS BIGINT) AS size, {", ".join(f"avg({c}) AS {c}" for c in X.FEATURES)}
   FROM v JOIN held USING (frame_id, voxel) WHERE label > 0 GROUP BY frame_id, label),
 t AS (SELECT frame_id, label, voxels, size, x AS cx, y AS cy, z AS cz, {unit("nx")}, {unit("ny")}, {unit("nz")}, r, g, b FROM u)
 SELECT frame_id, label, voxels, size, {", ".join(f"round({c} + 1e-9, 6) + 0e0 AS {c}" for c in ("cx", "cy", "cz", "nx", "ny", "nz", "r", "g", "b"))} FROM t"""))  # fmt: skip
def supervoxel_summary(v: Views) -> DataFrame:
    """Voxels, points and means of each supervoxel. A step beside half digits keeps engines from rounding them apart."""
    s = grown(v).summary()
    return s.select("frame_id", "label", "voxels", "size", *[rounded(F.col(c) + 1e-9, c) for c in ("cx", "cy", "cz", "nx", "ny", "nz", "r", "g", "b")])


@query("supervoxel_links", with_views("pts nrm", GROWN + """ SELECT p.frame_id, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, count(*) AS links
 FROM l JOIN held p ON p.frame_id = l.frame_id AND p.voxel = l.a JOIN held q ON q.frame_id = l.frame_id AND q.voxel = l.b WHERE l.a < l.b AND p.label > 0 AND q.label > 0 AND p.label <> q.label GROUP BY ALL"""))  # fmt: skip
def supervoxel_links(v: Views) -> DataFrame:
    """Which supervoxels touch, and at how many pairs of voxels."""
    return grown(v).edges()
