"""Discriminant axes of labelled vectors whose scatter within the classes may be singular, by generalised singular values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.sources.shared import written


def gsvd(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """U, V, C, S, X with a = U C X⁻¹ and b = V S X⁻¹: U, V orthogonal, C'C + S'S = 1 on the rank of both together.

    Columns of X stand by falling ratio of C to S; those beyond the common rank, where a and b are zero, are last.
    """
    m, n = a.shape
    p = len(b)
    left, size, right = np.linalg.svd(np.vstack([a, b]))
    t = int((size > tolerance * max(m + p, n) * max(size.max(initial=0.0), 1e-300)).sum())
    u, c, turn = np.linalg.svd(left[:m, :t])
    full_c, full_s = np.zeros((m, n)), np.zeros((p, n))
    full_c[range(len(c)), range(len(c))] = c
    rest = left[m:, :t] @ turn.T  # its columns are orthogonal; their lengths are S
    s = np.linalg.norm(rest, axis=0)
    held = np.flatnonzero(s > 1e-10)
    full_s[range(len(held)), held] = s[held]
    own = rest[:, held] / s[held]
    whole = np.linalg.qr(np.hstack([own, np.eye(p)]))[0][:, :p]
    v = whole * np.where(np.r_[(whole[:, : len(held)] * own).sum(0), np.ones(p - len(held))] < 0, -1, 1)
    inner = right.T.copy()
    inner[:, :t] = right[:t].T / size[:t] @ turn.T
    return u, v, full_c, full_s, inner


def triangle(rows: DataFrame, value: str, dims: int, arity: int = 8) -> np.ndarray:
    """R of the rows' QR factors (R'R is their sum of products), without squaring them: each task keeps ``dims`` rows, ``arity`` tasks' are joined at a time."""

    def factor(x: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(x, mode="r")
        return np.vstack([r, np.zeros((dims - len(r), dims))]) if len(r) < dims else r

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((dims, dims))
        for pdf in batches:
            if len(pdf):
                r = factor(np.vstack([r, np.stack(pdf[value].to_numpy())]))
        yield pd.DataFrame({value: list(r)})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": pdf.g.iloc[0], value: list(factor(np.stack(pdf[value].to_numpy())))})

    held = written(rows.select(value).mapInPandas(own, f"{value} array<double>").withColumn("g", F.spark_partition_id()))
    n = held.agg(F.coalesce(F.max("g"), F.lit(0))).first()[0] + 1
    while n > 1:
        n = -(-n // arity)
        held = held.withColumn("g", F.floor(F.col("g") / arity).cast("int")).groupBy("g").applyInPandas(joined, f"g int, {value} array<double>")
    got = held.select(value).collect()  # dims rows
    return np.array([r[0] for r in got], float) if got else np.zeros((dims, dims))


def discriminant_axes(rows: DataFrame, value: str, dims: int, d: int, label: str = "label") -> np.ndarray:
    """(dims, up to d) axes by falling ratio of scatter between to within the classes; ratios may be infinite. No classes: none.

    There is a row a class on the driver, and the triangle of what is left of the rows less their classes' means.
    """
    mean = F.array(*[F.avg(F.col(value)[i]) for i in range(dims)])
    classes = rows.groupBy(F.col(label).alias("_k")).agg(mean.alias("_m"), F.count(F.lit(1)).alias("_n"))
    held = classes.collect()
    if not held:
        return np.zeros((dims, 0))
    m, n = np.array([r["_m"] for r in held], float), np.array([r["_n"] for r in held], float)
    between = np.sqrt(n)[:, None] * (m - n @ m / n.sum())
    away = rows.join(F.broadcast(classes) if len(held) <= 10_000 else classes, F.col(label).eqNullSafe(F.col("_k")))
    within = triangle(away.select(F.zip_with(value, "_m", lambda x, y: x - y).alias(value)), value, dims)
    _, _, c, s, x = gsvd(between, within)
    keep = int((np.linalg.norm(c, axis=0) > 1e-9).sum())
    axes = x[:, : min(d, keep)]
    axes = axes / np.maximum(np.linalg.norm(axes, axis=0), 1e-300)
    return axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)
