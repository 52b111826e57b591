"""Labels, supervoxels, orders and poses as joins, windows and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G

FRAME = ("frame_id",)


def extract_by_index(points: DataFrame, picks: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Points in the order of ``picks(by, pos, pt_id)``."""
    return picks.join(points, [*by, "pt_id"])


def remove_zero_label(points: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Labelled points with new numbers from 0 in each frame."""
    return points.where("label <> 0").withColumn("new_id", F.row_number().over(Window.partitionBy(*by).orderBy("pt_id")).cast("long") - 1)


def finite_mask(points: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    ok = F.lit(True)
    for c in axes:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return points.where(ok)


def label_compact(points: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Labels of each frame as 0, 1, 2, ... in their order. The window runs over distinct labels only."""
    names = points.select(*by, "label").distinct().withColumn("compact", F.row_number().over(Window.partitionBy(*by).orderBy("label")).cast("long") - 1)
    return points.join(names, [*by, "label"])


def alter_label(points: DataFrame, mapping: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All labels mapped at once by ``mapping(by, label, to)``; labels without an entry stay."""
    return points.join(mapping, [*by, "label"], "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def label_iou(a: DataFrame, b: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """m / (2N - m) for m points of N labelled alike."""
    both = a.select(*by, "pt_id", F.col("label").alias("la")).join(b.select(*by, "pt_id", F.col("label").alias("lb")), [*by, "pt_id"])
    m, n = F.sum((F.col("la") == F.col("lb")).cast("long")), F.count(F.lit(1))
    return both.groupBy(*by).agg((m / (2 * n - m)).alias("iou"))


def previous(poses: DataFrame, by: Sequence[str] = ("obj_id",), order: str = "frame_id") -> DataFrame:
    """Each pose with that of the frame before (the last one, for the first frame), as ``p_…`` columns."""
    w = Window.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = [c for c in poses.columns if c not in (*by, order)]
    return poses.select("*", *[F.coalesce(F.lag(c).over(w), F.last(c).over(whole)).alias(f"p_{c}") for c in [order, *cols]])


def relative_pose(poses: DataFrame) -> DataFrame:
    """R_i R_{i-1}' and t_i - R t_{i-1} of each object, the first frame against the last."""
    both = previous(poses)
    now, was = G.matrix(), G.transposed(G.matrix("p_"))
    r = [[sum((now[i][k] * was[k][j] for k in range(1, 3)), now[i][0] * was[0][j]) for j in range(3)] for i in range(3)]
    t = G.minus(G.vec("t"), G.apply(r, G.vec("p_t")))
    return both.select("frame_id", "obj_id", *[r[i][j].alias(f"d{i}{j}") for i in range(3) for j in range(3)], *[c.alias(n) for c, n in zip(t, ("dx", "dy", "dz"), strict=True)])


def fit_error(points: DataFrame, poses: DataFrame, index: Column) -> DataFrame:
    """Mean distance between matched points of neighbouring frames, moved by their label's poses, over the mean extent of the frame."""
    at = points.where("label > 0").withColumn("m", index).join(F.broadcast(poses), (F.col("frame_id") == F.col("q_frame")) & (F.col("label") == F.col("q_obj")))
    v = G.inverse(G.vec())
    moved = at.select("frame_id", "label", "m", *[c.alias(n) for c, n in zip(v, ("u", "v", "w"), strict=True)])
    frames = points.agg(F.max("frame_id")).first()[0]
    before = moved.select(F.when(F.col("frame_id") == frames, 0).otherwise(F.col("frame_id") + 1).cast("int").alias("frame_id"), "label", "m", *[F.col(c).alias("p" + c) for c in "uvw"])
    d = G.norm(G.minus(G.vec("", "uvw"), G.vec("p", "uvw")))
    error = moved.join(before, ["frame_id", "label", "m"]).groupBy("frame_id").agg(F.avg(d).alias("mean"))
    extent = points.groupBy("frame_id").agg(((F.max("x") - F.min("x") + F.max("y") - F.min("y") + F.max("z") - F.min("z")) / 3).alias("extent"))
    return error.join(extent, "frame_id").select("frame_id", (F.col("mean") / F.col("extent")).alias("fit"))


def to_points(points: DataFrame, values: DataFrame, value: str, by: Sequence[str] = FRAME, none: int | None = 0) -> DataFrame:
    """A supervoxel's value for each of its points; points of no supervoxel get ``none``."""
    out = points.join(values.select(*by, "sv", value), [*by, "sv"], "left")
    return out if none is None else out.withColumn(value, F.coalesce(value, F.lit(none)))


def to_supervoxels(points: DataFrame, value: str, by: Sequence[str] = FRAME) -> DataFrame:
    """The mean of a point value over each supervoxel."""
    return points.where("sv > 0").groupBy(*by, "sv").agg(F.avg(value).alias(value))


def supervoxels_of(points: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Supervoxels of picked points: (by, sv, first position, place by first appearance from 0)."""
    first = points.where("sv > 0").groupBy(*by, "sv").agg(F.min("pt_id").alias("first_pt"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("first_pt")).cast("long") - 1)


def points_of(points: DataFrame, picked: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    return points.join(picked.select(*by, "sv").distinct(), [*by, "sv"], "left_semi")


def subgraph(points: DataFrame, edges: DataFrame, by: Sequence[str] = FRAME) -> tuple[DataFrame, DataFrame]:
    """Nodes (numbered by first appearance, counted anew) and edges that lie in the points given."""
    nodes = supervoxels_of(points, by).join(points.groupBy(*by, "sv").agg(F.count(F.lit(1)).alias("size")), [*by, "sv"])
    a, b = nodes.select(*by, F.col("sv").alias("a"), F.col("place").alias("na")), nodes.select(*by, F.col("sv").alias("b"), F.col("place").alias("nb"))
    return nodes, edges.join(a, [*by, "a"]).join(b, [*by, "b"]).select(*by, "a", "b", F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb"))


def two_hop(edges: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Edges and neighbours of neighbours, a < b, each once."""
    both = edges.select(*by, "a", "b").union(edges.select(*by, "b", "a"))
    far = both.select(*by, F.col("b").alias("m"), "a").join(both.select(*by, F.col("a").alias("m"), "b"), [*by, "m"]).where("a < b").select(*by, "a", "b")
    return edges.select(*by, "a", "b").union(far).distinct()


def atomic(ensemble: DataFrame, node: str = "sv") -> DataFrame:
    """Nodes with the same clusters in all runs share an atom, numbered by signature from 0."""
    rows = ensemble.groupBy(node).agg(F.array_sort(F.collect_list(F.struct("run", "cluster"))).alias("s")).withColumn("signature", F.concat_ws("-", F.transform("s", lambda x: x["cluster"].cast("string"))))
    names = rows.select("signature").distinct().withColumn("atom", F.row_number().over(Window.orderBy("signature")).cast("long") - 1)
    return rows.select(node, "signature").join(names, "signature")


def sort_by_value(points: DataFrame, values: DataFrame, value: str, by: Sequence[str] = FRAME) -> DataFrame:
    """Points of no supervoxel first, then by their supervoxel's value, greatest first."""
    at = points.join(values.select(*by, "sv", value), [*by, "sv"], "left")
    order = Window.partitionBy(*by).orderBy(F.when(F.col("sv") == 0, 0).otherwise(1), F.desc(value), "sv", "pt_id")
    return at.withColumn("place", F.row_number().over(order).cast("long"))


def binned_order(points: DataFrame, step: Column, by: Sequence[str] = FRAME) -> DataFrame:
    """Order by z, y, x in bins of ``step``, then by number."""
    bins = [F.floor(F.col(c) / step).cast("long") for c in ("z", "y", "x")]
    return points.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*bins, "pt_id")).cast("long"))


def pick_rank(points: DataFrame, picks: DataFrame, by: Sequence[str] = FRAME, voxels: bool = False) -> DataFrame:
    """Rank of a pick; the others get the number of picks + 1 (points) or 0 (voxels)."""
    n = picks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    out = points.join(picks, [*by, "pt_id"], "left").join(n, list(by), "left")
    rest = F.lit(0) if voxels else F.coalesce("n", F.lit(0)) + 1
    return out.withColumn("rank", F.coalesce("rank", rest).cast("long")).drop("n")


def incomplete(points: DataFrame, seeds: DataFrame, ratios: Sequence[float], by: Sequence[str] = FRAME) -> DataFrame:
    """For each ratio the share of a frame's points nearest to its seed point (by, sx, sy, sz)."""
    d2 = G.sq_dist(G.vec(), G.vec("s"))
    at = points.join(F.broadcast(seeds), list(by)).withColumn("d2", d2)
    w = Window.partitionBy(*by)
    at = at.withColumn("place", F.row_number().over(w.orderBy("d2", "pt_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    ratio = F.explode(F.array(*[F.lit(float(r)) for r in ratios]))
    return at.withColumn("ratio", ratio).where(F.col("place") <= F.round(F.col("ratio") * F.col("n"))).select(*by, "ratio", "pt_id")


def merged_scene(points: DataFrame, poses: DataFrame) -> DataFrame:
    """All objects' points moved by their poses, one union with the object's number as label."""
    at = points.join(F.broadcast(poses), "frame_id")
    return at.select("frame_id", "pt_id", *[c.alias(n) for c, n in zip(G.forward(G.vec()), ("x", "y", "z"), strict=True)], "r", "g", "b", F.col("obj_id").alias("label"))


def patch_with_neighbours(points: DataFrame, neighbours: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """A patch and all neighbours of its points, each point once for each label."""
    own = points.where("label > 0").select(*by, "label", "pt_id")
    more = own.join(neighbours.select(*by, "pt_id", "nb"), [*by, "pt_id"]).select(*by, "label", F.col("nb").alias("pt_id"))
    return own.union(more).distinct()


def overwrite_labels(points: DataFrame, picks: DataFrame, label: int, whole_patch: bool = False, by: Sequence[str] = FRAME) -> DataFrame:
    """Picked points, or each patch that a pick touches, get ``label``. An undo is the frame before."""
    keys = [*by, "pt_id"]
    chosen = picks.select(*keys).distinct()
    if whole_patch:
        chosen, keys = points.join(chosen, keys, "left_semi").select(*by, "label").distinct(), [*by, "label"]
    return points.join(chosen.withColumn("_hit", F.lit(True)), keys, "left").withColumn("label", F.when(F.col("_hit"), F.lit(label)).otherwise(F.col("label"))).drop("_hit")
