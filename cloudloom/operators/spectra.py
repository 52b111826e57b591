"""The smallest eigenpairs of many graphs' Laplacians at once, by Lanczos steps over written edges.

A step multiplies by the Laplacian (a join of edges and nodes, and a sum), then takes from the new vector its parts along all
earlier ones, twice, and gives it unit length. Vectors stay with the nodes, as one array a node; the driver sees, for each graph and
step, the products of the new vector with the earlier ones, and solves each graph's small tridiagonal problem. No matrix and
no graph is held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cloudloom.sources.shared import written

TINY = 1e-10


def laplacian(nodes: DataFrame, edges: DataFrame, kind: str = "N", diagonal: float = 1.0, by: Sequence[str] = ("frame_id",)) -> tuple[DataFrame, DataFrame]:
    """(entries(by, a, b, w) off the diagonal, nodes(by, sv, diag)): ``M`` D - W, ``N`` scaled to a unit diagonal of D. Weights of repeated edges add up."""
    by = list(by)
    both = edges.where("a <> b").select(*by, "a", "b", "w").union(edges.where("a <> b").select(*by, "b", "a", "w")).groupBy(*by, "a", "b").agg(F.sum("w").alias("w"))
    degree = nodes.select(*by, "sv").join(both.groupBy(*by, F.col("a").alias("sv")).agg(F.sum("w").alias("d")), [*by, "sv"], "left")
    degree = written(degree.select(*by, "sv", (F.coalesce("d", F.lit(0.0)) + diagonal).alias("d")))
    root = F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0) if kind == "N" else F.lit(1.0)
    one, two = (degree.select(*by, F.col("sv").alias(e), root.alias(f"s{e}")) for e in "ab")
    entries = written(both.join(one, [*by, "a"]).join(two, [*by, "b"]).select(*by, "a", "b", (-F.col("w") * F.col("sa") * F.col("sb")).alias("w")))
    return entries, degree.select(*by, "sv", ((F.col("d") - diagonal) * root * root).alias("diag"))


def smallest(nodes: DataFrame, edges: DataFrame, k: int, kind: str = "N", diagonal: float = 1.0, steps: int = 200, tolerance: float = 1e-8, every: int = 5,
             by: Sequence[str] = ("frame_id",), seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(values(by, i, value, error), vectors(by, sv, base)): the ``k`` smallest pairs of each graph.

    Steps go on until the residuals of all pairs are at most ``tolerance``, or ``steps`` are done; ``error`` is each pair's residual bound, so a
    looser result is seen as such. A graph of fewer than k nodes has as many pairs as nodes. Where the vectors run out (parts without
    a link), a new one is drawn, so each part has its pairs.
    """
    by, spark = list(by), nodes.sparkSession
    entries, at = laplacian(nodes, edges, kind, diagonal, by)
    kinds = ", ".join(f"{b} {nodes.schema[b].dataType.simpleString()}" for b in by)

    def drawn(j: int):
        return F.xxhash64("sv", F.lit(seed), F.lit(j)) / float(2**63)

    def small(rows: dict, name: str, kind: str) -> DataFrame:
        """A row for each graph, as a local table: Spark knows its size, and broadcasts it only if that is small."""
        schema = StructType.fromDDL(f"{kinds}, {name} {kind}")
        columns = {b: [g[i] for g in rows] for i, b in enumerate(by)} | {name: list(rows.values())}
        return spark.createDataFrame(pa.Table.from_pydict(columns, schema=to_arrow_schema(schema)), schema)

    def sums(table: DataFrame) -> dict:
        """By graph: products of r with the vectors so far and its square, and the nodes. The plan is one for any number of vectors, so it's compiled once."""
        terms = F.transform(F.concat("q", F.array("r")), lambda x: x * F.col("r"))
        found = table.select(*by, F.posexplode(terms).alias("i", "p")).groupBy(*by, "i").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
        out: dict = {}
        for row in sorted(found.collect(), key=lambda row: row["i"]):  # a row for each graph and vector
            out.setdefault(tuple(row[: len(by)]), ([], row["n"]))[0].append(row["p"])
        return {g: (np.array(p, float), n) for g, (p, n) in out.items()}

    def without(table: DataFrame, parts: dict) -> DataFrame:
        c = small({g: [float(x) for x in p[:-1]] for g, (p, _) in parts.items()}, "c", "array<double>")
        along = F.aggregate(F.zip_with("q", "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return table.join(c, by).withColumn("r", F.col("r") - along).drop("c")

    state = at.select(*by, "sv", "diag", F.expr("cast(array() as array<double>)").alias("q"), drawn(0).alias("r"))
    first = sums(state)
    if not first:
        return spark.createDataFrame([], f"{kinds}, i int, value double, error double"), at.select(*by, "sv", F.expr("cast(array() as array<double>)").alias("base"))
    length = {g: float(np.sqrt(p[-1])) for g, (p, _) in first.items()}
    size = {g: n for g, (_, n) in first.items()}
    alpha, beta, solved, j = {g: [] for g in size}, {g: [] for g in size}, {}, 0

    def ritz(g) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = np.array(alpha[g]), np.array(beta[g])
        values, s = np.linalg.eigh(np.diag(a) + np.diag(b[:-1], 1) + np.diag(b[:-1], -1))
        m = min(k, len(a))
        return values[:m], s[:, :m], np.abs(b[-1] * s[-1, :m]) if len(a) < size[g] else np.zeros(m)

    while True:
        # graphs whose space is full get zeros from here on
        scale = small({g: 1 / length[g] if len(alpha[g]) < size[g] else 0.0 for g in size}, "scale", "double")
        state = written(state.join(scale, by).select(*by, "sv", "diag", F.concat("q", F.array(F.col("r") * F.col("scale"))).alias("q")))
        last = state.select(*by, F.col("sv").alias("b"), F.element_at("q", -1).alias("x"))
        times = entries.join(last, [*by, "b"]).groupBy(*by, F.col("a").alias("sv")).agg(F.sum(F.col("w") * F.col("x")).alias("wx"))
        j += 1
        table = written(state.join(times, [*by, "sv"], "left").withColumn("r", F.col("diag") * F.element_at("q", -1) + F.coalesce("wx", F.lit(0.0))).drop("wx"))
        one = sums(table)
        table = without(table, one)
        two = sums(table)
        table = without(table, two)
        for g in size:
            if len(alpha[g]) < size[g]:
                alpha[g].append(float(one[g][0][j - 1] + two[g][0][j - 1]))
                left = two[g][0][-1] - (two[g][0][:-1] ** 2).sum()
                length[g] = float(np.sqrt(max(left, 0.0)))
                beta[g].append(length[g])
        ended = {g: True for g in size if length[g] < TINY and len(alpha[g]) < size[g]}
        if ended:  # what a vector can reach is used up: a new one, across all earlier ones
            table = written(table.join(small(ended, "_new", "boolean"), by, "left").withColumn("r", F.when(F.col("_new"), drawn(j)).otherwise(F.col("r"))).drop("_new"))
            for _ in range(2):
                parts = sums(table)
                table = without(table, {g: (p if g in ended else np.zeros_like(p), n) for g, (p, n) in parts.items()})
            fresh = sums(table.withColumn("q", F.expr("cast(array() as array<double>)")))
            for g in ended:
                beta[g][-1], length[g] = 0.0, float(np.sqrt(fresh[g][0][-1]))
        full = all(len(alpha[g]) >= size[g] for g in size)
        if full or j >= steps or (j >= k and j % every == 0):
            solved = {g: ritz(g) for g in size}
            # a graph that drew a new vector just now has more to come
            if full or j >= steps or all(len(v) >= min(k, size[g]) and e.max() <= tolerance and beta[g][-1] > 0 for g, (v, _, e) in solved.items() if len(alpha[g]) < size[g]):
                break
        state = table
    rows = [(*g, i, float(v[i]), float(e[i])) for g, (v, _, e) in solved.items() for i in range(len(v))]
    values = spark.createDataFrame(rows, f"{kinds}, i int, value double, error double")
    turn = small({g: [[float(x) for x in s[:, i]] for i in range(s.shape[1])] for g, (_, s, _) in solved.items()}, "s", "array<array<double>>")
    base = F.transform("s", lambda row: F.aggregate(F.zip_with(F.slice("q", 1, F.size(row)), row, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x))
    return values, written(state.join(turn, by).select(*by, "sv", base.alias("base")))
