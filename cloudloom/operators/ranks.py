"""Places of rows in their groups without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.sources.shared import written


def places(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place in its group, from 1 and gapless, by ascending ``order`` (which must tell rows apart).

    Rows are dealt by range of (group, order) and numbered inside their partition; the counts of the partitions before
    are added. What is summed up over partitions is a row for each group and partition.
    """
    group, cols = list(group), [*group, *order]
    row, part, start = f"_{name}_row", f"_{name}_part", f"_{name}_start"
    dealt = written(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn(row, F.monotonically_increasing_id()))
    dealt = dealt.withColumn(part, F.shiftright(row, 33))
    counts = dealt.groupBy(*group, part).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"))
    before = F.expr(f"sum(_n) OVER (PARTITION BY {', '.join(group)} ORDER BY {part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    starts = counts.select(*group, part, (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias(start))
    return dealt.join(starts, [*group, part]).select(*df.columns, (F.col(row) + F.col(start)).alias(name))
