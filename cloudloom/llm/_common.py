"""What the operators of this subpackage share: the workspace on the cluster's shared folder, row ids and distributed ranks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SCANS = frozenset(("LogicalRelation", "Project", "Filter", "SubqueryAlias"))
ROW_BITS = 36  # of a row's place in its file


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cloudloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Written tables that cut lineage. They lie in the shared folder, so that any executor can read them again."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
        self.serial = 0
        spark.conf.set(ARROW_ROWS, str(min(1000, int(spark.conf.get(ARROW_ROWS, "1000")))))  # long texts come in batches too

    def table(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        """``df``, written and read again; the shuffles that made it are deleted."""
        self.serial += 1
        path = f"{self.path}/{self.serial}"
        with self.tidy():
            df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_to = path
        return out

    def is_empty(self, df: DataFrame) -> bool:
        with self.tidy():
            return df.isEmpty()

    @contextmanager
    def tidy(self) -> Iterator[None]:
        """Shuffle files of the actions inside are deleted when these end, not when the driver collects its garbage."""
        before = self.spark.conf.get(CLEAN_SHUFFLES, "false")
        self.spark.conf.set(CLEAN_SHUFFLES, "true")
        try:
            yield
        finally:
            self.spark.conf.set(CLEAN_SHUFFLES, before)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads; what wasn't written here is left alone."""
        for df in tables:
            if path := getattr(df, "_written_to", None):
                self.delete(path)

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables but these."""
        kept = {getattr(df, "_written_to", None) for df in tables} | {getattr(df, "_reads", None) for df in tables}
        for k in range(1, self.serial + 1):
            if f"{self.path}/{k}" not in kept:
                self.delete(f"{self.path}/{k}")

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def row_id() -> Column:
    """A row's number in this scan. Another scan may cut the files otherwise and number other rows so: write it with what is read again."""
    return F.monotonically_increasing_id()


def is_scan(rows: DataFrame) -> bool:
    """Whether ``rows`` are rows of Parquet files, chosen and projected by deterministic expressions: each has a place in a file."""
    if "_metadata" in map(str.lower, rows.columns):
        return False
    left = [rows._jdf.queryExecution().analyzed()]
    while left:
        node = left.pop()
        if node.nodeName() not in SCANS or not node.deterministic():
            return False
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    try:
        rows.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def numbered(ws: Workspace, rows: DataFrame, *columns: str) -> DataFrame:
    """(rid, columns): a number for each row that stays with it in all later scans, however these cut the files.

    Rows of Parquet files are numbered by their file's number and their place in it. Others are written once with their numbers.
    """
    if not is_scan(rows):
        return ws.table(rows.select(row_id().alias("rid"), *columns), compression="zstd")
    place = rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), *columns)
    # a row for each file: few enough to be numbered in one task
    files = ws.table(place.select("_file").distinct().withColumn("_k", F.expr("row_number() over (order by _file)").cast("long")))
    out = place.join(maybe_broadcast(files), "_file").select((F.shiftleft("_k", ROW_BITS) + F.col("_row")).alias("rid"), *columns)
    out._reads = files._written_to
    return out


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether a table of narrow rows has at most so many: the check before each broadcast."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, marked for a broadcast if its counted rows are few; else a shuffled join follows."""
    return F.broadcast(df) if is_small(df, rows) else df


def ranked(ws: Workspace, df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place in its group, from 0 and gapless, whatever the size of a group.

    Rows are dealt by range of (group, order), numbered inside their partition, and moved on by the counts of
    the partitions before. No task holds a whole group.
    """
    spark = ws.spark
    cols = [*group, *order]
    dealt = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_row", F.monotonically_increasing_id())
    dealt = ws.table(dealt)
    part = F.shiftright("_row", 33)
    counts = dealt.groupBy(*group, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    keys = ", ".join(f"`{g}`" for g in group)
    over = f"partition by {keys} order by _part rows between unbounded preceding and 1 preceding" if group else "order by _part rows between unbounded preceding and 1 preceding"
    starts = ws.table(counts.select(*group, "_part", "_first", F.expr(f"coalesce(sum(_n) over ({over}), 0L)").alias("_before")))
    joined = dealt.withColumn("_part", part).alias("d").join(
        maybe_broadcast(starts).alias("s"),
        [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*group, "_part"]],
    )
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("d._row") - F.col("s._first") + F.col("s._before")).alias(name))


def running(ws: Workspace, df: DataFrame, group: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` of the rows before in the row's group, without a task that holds a whole group."""
    cols = [*group, *order]
    dealt = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _part int, _sum long"

    def add(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = total + np.cumsum(batch.column(weight).to_numpy())
            own = pa.array(np.concatenate([[total], ends[:-1]]).astype(np.int64)[: batch.num_rows])
            total = int(ends[-1]) if batch.num_rows else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), own], [*batch.schema.names, "_part", "_sum"])

    summed = ws.table(dealt.mapInArrow(add, schema))
    over = f"partition by {', '.join(f'`{g}`' for g in group)} order by _part rows between unbounded preceding and 1 preceding"
    parts = summed.groupBy(*group, "_part").agg(F.sum(weight).alias("_n"), F.min("_sum").alias("_first"))  # a row for each group and partition
    starts = ws.table(parts.select(*group, "_part", "_first", F.expr(f"coalesce(sum(_n) over ({over}), 0L)").alias("_before")))
    return summed.join(maybe_broadcast(starts), [*group, "_part"]).select(*df.columns, (F.col("_sum") - F.col("_first") + F.col("_before")).alias(name))
