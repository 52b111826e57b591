"""Planes from states that merge: count, means and scatter of points, in batch and over streams.

A state is a row (by, n, mx, my, mz, sxx, sxy, sxz, syy, syz, szz), the scatter about the mean. States of parts add up to the state
of the whole in any order and grouping, so a plane can follow its points as they come and be read off at any time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.aggregates import scatter
from cloudloom.operators.features import least_axis

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
STATE = ["n", *[f"m{c}" for c in "xyz"], *[f"s{p}" for p in PAIRS]]
TYPES = "n long, " + ", ".join(f"{c} double" for c in STATE[1:])


def states(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """The state of each group of finite points; points with a null or NaN coordinate count for nothing."""
    good = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    return scatter(good, list(by)).select(*by, F.col("n").cast("long").alias("n"), *STATE[1:])


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of parts → states by ``by``: scatters add up with the scatter of the parts' means, taken about the new mean."""
    by = list(by)
    means = parts.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.sum("n").alias("_n"), *[(F.sum(F.col("n") * F.col(f"m{c}")) / F.sum("n")).alias(f"_m{c}") for c in "xyz"])
    at = parts.join(means, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    off = {c: F.col(f"m{c}") - F.col(f"_m{c}") for c in "xyz"}
    sums = [F.sum(F.col(f"s{p}") + F.col("n") * off[p[0]] * off[p[1]]).alias(f"s{p}") for p in PAIRS]
    return at.groupBy(*by, "_n", "_mx", "_my", "_mz").agg(*sums).select(*by, F.col("_n").alias("n"), *[F.col(f"_m{c}").alias(f"m{c}") for c in "xyz"], *STATE[4:])


def planes(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, a, b, c, d, spread): a x + b y + c z + d = 0 with the largest of a, b, c positive; ``spread`` is the mean squared
    distance from it. Null for fewer than three points, which settle no plane."""
    e = state.withColumn("_e", least_axis(*[f"s{p}" for p in PAIRS]))
    axis = [F.col("_e")[i] for i in range(3)]
    top = F.greatest(*[F.abs(c) for c in axis])
    sign = F.when(F.when(F.abs(axis[0]) == top, axis[0]).when(F.abs(axis[1]) == top, axis[1]).otherwise(axis[2]) < 0, -1.0).otherwise(1.0)
    ok = F.col("n") >= 3
    abc = [F.when(ok, sign * c) for c in axis]
    d = -(abc[0] * F.col("mx") + abc[1] * F.col("my") + abc[2] * F.col("mz"))
    return e.select(*by, "n", *[c.alias(k) for c, k in zip(abc, "abc", strict=True)], d.alias("d"), F.when(ok, F.col("_e")[3] ** 2 / F.col("n")).alias("spread"))


def joined(one: Sequence[float] | None, x: np.ndarray) -> list[float]:
    """A state and more points → the state of both."""
    n, m = len(x), x.mean(0)
    s = (x - m).T @ (x - m)
    if one is not None:
        n0, m0 = one[0], np.array(one[1:4])
        away = m - m0
        s = s + np.outer(away, away) * n0 * n / (n0 + n)
        for k, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
            s[i, j] += one[4 + k]
        m, n = m0 + away * n / (n0 + n), n0 + n
    return [int(n), *map(float, m), *(float(s[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))]


def running_states(stream: DataFrame, key: str = "frame_id", kind: str = "int") -> DataFrame:
    """Of a stream of points the states of all that came so far, sent anew (mode update) for the keys of each micro-batch.

    A key holds ten numbers, and its points of a micro-batch are read in slices.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(at: tuple, slices: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        for pdf in slices:
            x = pdf[["x", "y", "z"]].to_numpy(float)
            x = x[np.isfinite(x).all(1)]
            if len(x):
                held = joined(held, x)
        if held is not None:
            state.update(tuple(held))
            yield pd.DataFrame([(at[0], *held)], columns=[key, *STATE])

    return stream.select(key, "x", "y", "z").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {TYPES}", TYPES, "update", GroupStateTimeout.NoTimeout)
