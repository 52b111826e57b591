"""Point sets derived from the tables of a folder: frames of points, normals, poses, supervoxels, boxes, features.

Each view has one definition in SQL that Spark and DuckDB both read; ``Views`` gives it as a DataFrame, ``with_views`` as
common table expressions in front of a query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES, OBJECTS = 8, 4

PTS = """CAST(event_id % 8 AS INT) AS frame_id, event_id AS pt_id, value / 100 AS x, CAST(user_id AS DOUBLE) / 50 AS y,
    CAST(hour(ts) AS DOUBLE) / 8 AS z, CAST((event_id * 37) % 256 AS INT) AS r, CAST((user_id * 53) % 256 AS INT) AS g,
    CAST((event_id * 11 + user_id * 17) % 256 AS INT) AS b,
    CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS INT) AS label"""
NRM = """CAST(event_id % 8 AS INT) AS frame_id, event_id AS pt_id,
    CAST((event_id * 7) % 11 - 5 AS DOUBLE) AS a, CAST((event_id * 13) % 7 - 3 AS DOUBLE) AS b, CAST((user_id % 5) + 1 AS DOUBLE) AS c"""
UNIT = "frame_id, pt_id, a / sqrt(a * a + b * b + c * c) AS nx, b / sqrt(a * a + b * b + c * c) AS ny, c / sqrt(a * a + b * b + c * c) AS nz"
BOXES = "CAST(r_regionkey + 1 AS INT) AS box_id, 1 + 0.5e0 * r_regionkey AS cx, 1.5e0 AS cy, 1.5e0 AS cz, 0.5e0 AS hx, 1e0 AS hy, 1e0 AS hz, 0.1e0 * r_regionkey AS yaw"
PIX = """CAST((p_partkey - 1 - (p_partkey - 1) % 50) / 50 AS INT) AS prow, CAST((p_partkey - 1) % 50 AS INT) AS pcol,
    CAST((p_size * 5) % 256 AS INT) AS r, CAST(CAST(floor(p_retailprice) AS BIGINT) % 256 AS INT) AS g, CAST((p_partkey * 7) % 256 AS INT) AS b"""
CELL = "CAST(floor(x / 0.5e0) AS BIGINT) AS kx, CAST(floor(y / 0.5e0) AS BIGINT) AS ky, CAST(floor(z / 0.5e0) AS BIGINT) AS kz"

SQL = {
    "pts": f"SELECT {PTS} FROM events",
    "nrm": f"SELECT {UNIT} FROM (SELECT {NRM} FROM events)",
    "poses": """SELECT frame_id, obj_id, cos(yaw) AS r00, -sin(yaw) AS r01, 0e0 AS r02, sin(yaw) AS r10, cos(yaw) AS r11, 0e0 AS r12, 0e0 AS r20, 0e0 AS r21, 1e0 AS r22,
        0.1e0 * frame_id AS tx, 0.2e0 * obj_id AS ty, 0e0 AS tz
        FROM (SELECT CAST(f.range AS INT) AS frame_id, CAST(o.range AS INT) AS obj_id, 2 * pi() * f.range * o.range / 32 AS yaw FROM range(8) f, range(1, 5) o)""",
    "boxes": f"SELECT {BOXES} FROM region",
    "pix": f"SELECT {PIX} FROM part",
    "cells": f"SELECT DISTINCT frame_id, {CELL} FROM pts",
    "svids": "SELECT frame_id, kx, ky, kz, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY kx, ky, kz) AS BIGINT) AS sv FROM cells",
    "svpts": f"SELECT p.*, s.sv FROM (SELECT *, {CELL} FROM pts) p JOIN svids s USING (frame_id, kx, ky, kz)",
    "supervoxels": """SELECT p.frame_id, p.sv, avg(p.x) AS cx, avg(p.y) AS cy, avg(p.z) AS cz, avg(p.r) AS r, avg(p.g) AS g, avg(p.b) AS b, CAST(count(*) AS BIGINT) AS size,
        sum(n.nx) AS nx, sum(n.ny) AS ny, sum(n.nz) AS nz FROM svpts p JOIN nrm n USING (frame_id, pt_id) GROUP BY p.frame_id, p.sv""",
    "sv_edges": """SELECT s.frame_id, s.sv AS a, t.sv AS b FROM svids s JOIN svids t ON s.frame_id = t.frame_id AND s.sv < t.sv
        AND abs(s.kx - t.kx) <= 1 AND abs(s.ky - t.ky) <= 1 AND abs(s.kz - t.kz) <= 1""",
    "centroids": """SELECT CAST(vec_id AS INT) AS k, CAST(vec_id % 4 + 1 AS INT) AS obj_id, CAST(vec_id % 7 AS DOUBLE) * 0.7e0 AS x, CAST(vec_id % 5 AS DOUBLE) * 0.6e0 AS y, CAST(vec_id % 3 AS DOUBLE) AS z,
        (1 + CAST(vec_id % 3 AS DOUBLE)) / 40 AS p, 2 + CAST(vec_id % 4 AS DOUBLE) AS w FROM embeddings WHERE vec_id < 20""",
    "ensemble": """SELECT p_partkey AS sv, 0 AS run, CAST(p_size % 7 AS BIGINT) AS cluster FROM part UNION ALL SELECT p_partkey, 1, CAST(length(p_type) % 5 AS BIGINT) FROM part
        UNION ALL SELECT p_partkey, 2, CAST(length(p_name) % 4 AS BIGINT) FROM part""",
}
NEEDS = {"cells": ["pts"], "svids": ["cells"], "svpts": ["pts", "svids"], "supervoxels": ["svpts", "nrm"], "sv_edges": ["svids"]}


def needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*needed(tuple(NEEDS.get(n, []))), n]:
            if m not in out:
                out.append(m)
    return out


def with_views(names: str, body: str) -> str:
    """DuckDB SQL: the named views (apart by spaces), then ``body`` (which may go on with more of them)."""
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in needed(tuple(names.split())))
    return f"WITH {parts}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"


class Views:
    """The views of a folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def pts(self) -> DataFrame:
        return self.table("events").selectExpr(*columns(PTS))

    @cached_property
    def nrm(self) -> DataFrame:
        return self.table("events").selectExpr(*columns(NRM)).selectExpr(*columns(UNIT))

    @cached_property
    def poses(self) -> DataFrame:
        grid = self.spark.range(FRAMES * OBJECTS).selectExpr(f"CAST(id % {FRAMES} AS INT) AS frame_id", f"CAST(id div {FRAMES} + 1 AS INT) AS obj_id")
        yaw = grid.withColumn("yaw", F.lit(2) * F.expr("pi()") * F.col("frame_id") * F.col("obj_id") / 32)
        turn = {"r00": F.cos("yaw"), "r01": -F.sin("yaw"), "r02": F.lit(0.0), "r10": F.sin("yaw"), "r11": F.cos("yaw"), "r12": F.lit(0.0), "r20": F.lit(0.0), "r21": F.lit(0.0), "r22": F.lit(1.0)}
        return yaw.select("frame_id", "obj_id", *[c.alias(n) for n, c in turn.items()], (F.lit(0.1) * F.col("frame_id")).alias("tx"), (F.lit(0.2) * F.col("obj_id")).alias("ty"), F.lit(0.0).alias("tz"))

    @cached_property
    def boxes(self) -> DataFrame:
        return self.table("region").selectExpr(*columns(BOXES))

    @cached_property
    def pix(self) -> DataFrame:
        return self.table("part").selectExpr(*columns(PIX))

    @cached_property
    def svids(self) -> DataFrame:
        from cloudloom.operators.spatial import number_cells

        return number_cells(self.pts.selectExpr("frame_id", *columns(CELL)).distinct())

    @cached_property
    def svpts(self) -> DataFrame:
        return self.pts.selectExpr("*", *columns(CELL)).join(self.svids, ["frame_id", "kx", "ky", "kz"])

    @cached_property
    def supervoxels(self) -> DataFrame:
        from cloudloom.operators.spatial import voxel_mean

        return voxel_mean(self.svpts.join(self.nrm, ["frame_id", "pt_id"]), ["frame_id", "sv"])

    @cached_property
    def sv_edges(self) -> DataFrame:
        from cloudloom.operators.spatial import voxel_adjacency

        return voxel_adjacency(self.svids).select("frame_id", "a", "b")

    @cached_property
    def centroids(self) -> DataFrame:
        return self.table("embeddings").where("vec_id < 20").selectExpr(
            "CAST(vec_id AS INT) AS k", "CAST(vec_id % 4 + 1 AS INT) AS obj_id", "CAST(vec_id % 7 AS DOUBLE) * 0.7e0 AS x", "CAST(vec_id % 5 AS DOUBLE) * 0.6e0 AS y", "CAST(vec_id % 3 AS DOUBLE) AS z",
            "(1 + CAST(vec_id % 3 AS DOUBLE)) / 40 AS p", "2 + CAST(vec_id % 4 AS DOUBLE) AS w",
        )

    @cached_property
    def ensemble(self) -> DataFrame:
        runs = "stack(3, 0, CAST(p_size % 7 AS BIGINT), 1, CAST(length(p_type) % 5 AS BIGINT), 2, CAST(length(p_name) % 4 AS BIGINT)) AS (run, cluster)"
        return self.table("part").selectExpr("p_partkey AS sv", runs)


def columns(text: str) -> list[str]:
    """A select list, cut at its outer commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]]]
