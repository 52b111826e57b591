"""Queries on fields over points and graphs: lattice filters, dense random fields, sequential messages, spectra by Lanczos steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import lattice as T
from cloudloom.operators import messages as M
from cloudloom.operators import spectra as P
from cloudloom.plans.catalog_models import sv_costs, sv_weights
from cloudloom.plans.catalog_spatial import spectral_affinity
from cloudloom.plans.registry import query, rounded
from cloudloom.sources.shared import written
from cloudloom.sources.views import Views, with_views

LABELS = [f"q{i}" for i in range(5)]
SIGMA = 0.4
SX, SY, SZ = T.scales(3)


def placed(v: Views) -> DataFrame:
    """Points with features in units of a kernel's width: place, and place and colour."""
    return v.pts.select("frame_id", "pt_id", "label", *[(F.col(c) / SIGMA).alias(f"f{c}") for c in "xyz"], *[(F.col(c) / 60.0).alias(f"f{c}") for c in "rgb"])


LATTICE = f"""+ f AS (SELECT frame_id, pt_id, x / {SIGMA!r}e0 * {SX!r}e0 AS c0, y / {SIGMA!r}e0 * {SY!r}e0 AS c1, z / {SIGMA!r}e0 * {SZ!r}e0 AS c2, CASE WHEN label = 1 THEN 1e0 ELSE 0e0 END AS v FROM pts),
 e AS (SELECT frame_id, pt_id, v, unnest([c0 + c1 + c2, c1 + c2 - 1 * c0, c2 - 2 * c1, -3 * c2]) AS e, unnest([0, 1, 2, 3]) AS i FROM f),
 z AS (SELECT *, floor(e / 4 + 0.5e0)::integer AS z FROM e), o AS (SELECT *, e / 4 - z AS o FROM z),
 r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, pt_id ORDER BY o DESC, i) - 1 + sum(z) OVER (PARTITION BY frame_id, pt_id) AS r FROM o),
 t AS (SELECT frame_id, pt_id, v, i, CASE WHEN r < 0 THEN z + 1 WHEN r > 3 THEN z - 1 ELSE z END AS z, CASE WHEN r < 0 THEN r + 4 WHEN r > 3 THEN r - 4 ELSE r END AS r,
   CASE WHEN r < 0 THEN o - 1 WHEN r > 3 THEN o + 1 ELSE o END AS o FROM r),
 p AS (SELECT frame_id, pt_id, any_value(v) AS v, list(z ORDER BY i) AS z, list(r ORDER BY i) AS r, list(o ORDER BY o DESC) AS o FROM t GROUP BY ALL),
 s AS (SELECT frame_id, pt_id, v, k, (z[1] * 4 + k - CASE WHEN r[1] > 3 - k THEN 4 ELSE 0 END)::integer AS a, (z[2] * 4 + k - CASE WHEN r[2] > 3 - k THEN 4 ELSE 0 END)::integer AS b,
   (z[3] * 4 + k - CASE WHEN r[3] > 3 - k THEN 4 ELSE 0 END)::integer AS c, CASE WHEN k = 0 THEN 1 + o[4] - o[1] ELSE o[4 - k] - o[5 - k] END AS w FROM (SELECT *, unnest([0, 1, 2, 3]) AS k FROM p)),
 b0 AS (SELECT frame_id, a, b, c, sum(w * v) AS v, sum(w) AS n FROM s GROUP BY ALL),
 {", ".join(f'''b{i + 1} AS (SELECT frame_id, a + h * {3 if i == 0 else -1} AS a, b + h * {3 if i == 1 else -1} AS b, c + h * {3 if i == 2 else -1} AS c,
   sum(v * CASE WHEN h = 0 THEN 1 ELSE 0.5e0 END) AS v, sum(n * CASE WHEN h = 0 THEN 1 ELSE 0.5e0 END) AS n FROM (SELECT *, unnest([-1, 0, 1]) AS h FROM b{i}) GROUP BY ALL)''' for i in range(4))},
 g AS (SELECT frame_id, pt_id, sum(s.w * b4.v) AS v, sum(s.w * b4.n) AS n FROM s JOIN b4 USING (frame_id, a, b, c) GROUP BY ALL)
 SELECT frame_id, pt_id, round(v / (n + 1e-20), 6) + 0e0 AS share FROM g"""


@query("lattice_filter", with_views("pts", LATTICE))
def lattice_filter(v: Views) -> DataFrame:
    """The share of label 1 around each point, by a Gaussian of width 0.4 in space: filtered, then divided by the filter of ones."""
    values = placed(v).withColumns({"v": (F.col("label") == 1).cast("double"), "n": F.lit(1.0)})
    values = written(values.select("frame_id", "pt_id", "fx", "fy", "fz", "v", "n"))
    got = T.Lattice(values, ["fx", "fy", "fz"]).filter(values, ["v", "n"])
    return got.select("frame_id", "pt_id", rounded(F.col("v") / (F.col("n") + T.TINY), "share"))


def field(v: Views) -> T.Field:
    """Five labels with costs by the given label; kernels of place, and of place and colour, as for scanned rooms."""
    p = written(placed(v))
    unary = p.select("frame_id", "pt_id", *[F.when(F.col("label") == i, 0.5).otherwise(1.5 + 0.1 * i).alias(q) for i, q in enumerate(LABELS)])
    place = T.Kernel(T.Lattice(p, ["fx", "fy", "fz"], grow=False), 1.0)
    colour = T.Kernel(T.Lattice(p, ["fx", "fy", "fz", "fr", "fg", "fb"], grow=False), [-2.0, -1.5, -1.5, -1.5, -1.0])
    return T.Field(unary, [place, colour], LABELS)


@query("dense_crf_lattice")
def dense_crf_lattice(v: Views) -> DataFrame:
    """Labels of all points after three mean-field updates with symmetric normalisation."""
    f = field(v)
    return f.labelled(f.infer(3))


@query("dense_crf_kl")
def dense_crf_kl(v: Views) -> DataFrame:
    """How far the marginals are from the field before and after each of two updates, for each frame."""
    f = field(v)
    q, out = f.start(), None
    for t in range(3):
        part = f.divergence(q).select("frame_id", F.lit(t).alias("round"), *[rounded(F.col(c), c) for c in ("entropy", "unary", "pairwise", "kl")])
        out = part if out is None else out.unionByName(part)
        q = f.step(q) if t < 2 else q
    return out


@query("mrf_trw_s_bound")
def mrf_trw_s_bound(v: Views) -> DataFrame:
    """Energy of each frame's supervoxel labels and the lower bound that tree-reweighted messages prove, with costs cut off at two."""
    graphs = M.solve(sv_costs(v), sv_weights(v), kind="l1", most=2.0)[1]
    return graphs.select("frame_id", "nodes", "rounds", rounded(F.col("energy"), "energy"), rounded(F.col("bound"), "bound"))


@query("eigs_edges")
def eigs_edges(v: Views) -> DataFrame:
    """The four smallest values of each frame's scaled graph Laplacian after at most 24 steps over edges, with their residual bounds."""
    return P.smallest(v.supervoxels, written(spectral_affinity(v)), 4, steps=24, tolerance=1e-4, every=8)[0]
