"""Tables kept in the session's shared folder: rounds of iterative operators, running sums and numbers of rows."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What has been written to the shared folder and not deleted: by this process, or by the run of `run_tables` that is going on.
_WRITTEN: ContextVar[list[str]] = ContextVar("written", default=[])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests in local mode), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.get().append(path)
    return path


@contextmanager
def run_tables() -> Iterator[None]:
    """Within it, `written` and `discard` know of this run's tables only, so runs side by side in threads don't delete each other's."""
    before = _WRITTEN.set([])
    try:
        yield
    finally:
        left = _WRITTEN.get()
        _WRITTEN.reset(before)
        _WRITTEN.get().extend(left)


def written() -> int:
    """How many tables have been written so far: a mark for `discard`."""
    return len(_WRITTEN.get())


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what was written since a mark, but for the last `keep`. Only when no DataFrame that reads them is still needed."""
    tables = _WRITTEN.get()
    for path in tables[since : len(tables) - keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        tables.remove(path)


def publish(df: DataFrame, name: str = "round", parts: int | None = None) -> DataFrame:
    """Write df to the shared folder, in at most so many parts, and read it back.

    That cuts the lineage (a lost executor costs no recomputation of what came before) and gives the
    optimizer the true size, so that it broadcasts the table only below spark.sql.autoBroadcastJoinThreshold.
    """
    path = new_path(df.sparkSession, name)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[Column | str], name: str, weight: Column | None = None) -> DataFrame:
    """df with the sum of weight (1 each) over all rows before, in an order that should be total.

    Rows are sorted and summed within ranges, kept, and the ranges' sums (a row each) are added: no task sees all rows.
    """
    ranged = df.withColumn("weight_", F.lit(1).cast("bigint") if weight is None else weight).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = publish(ranged.withColumn("part_", F.spark_partition_id()))
    sums = ranged.groupBy("part_").agg(F.sum("weight_").alias("sum_"))
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sums.select("part_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("before_"))
    within = F.coalesce(F.sum("weight_").over(Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("within_", within).join(offsets, "part_").withColumn(name, F.col("before_") + F.col("within_")).drop("part_", "within_", "before_", "weight_")


def _combined(how: str, a: Column, b: Column) -> Column:
    """What two parts have together; a part without a value is null."""
    return F.coalesce(a + b, a, b) if how == "sum" else F.least(a, b) if how == "min" else F.greatest(a, b)


def before(df: DataFrame, by: list[str], order: list[str], sums: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with what all rows before have in their value of `by`, in an order that should be total: sums name columns (how, of what), how is sum, min or max.

    As in `running`, rows are sorted and summed within ranges, and the ranges' sums are added: a row per range and value of `by`, so no task sees all rows of one.
    """
    ranged = df.withColumns({f"{c}_of_": value for c, (_, value) in sums.items()}).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranged = publish(ranged.withColumn("part_", F.spark_partition_id()))
    fold = lambda c: getattr(F, sums[c][0])
    parts = ranged.groupBy(*by, "part_").agg(*(fold(c)(f"{c}_of_").alias(f"{c}_all_") for c in sums))
    ahead = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    earlier = ahead(Window.partitionBy(*by).orderBy("part_"))
    inside = ahead(Window.partitionBy("part_", *by).orderBy(*order))
    parts = parts.select(*(F.col(c).alias(f"{c}_by_") for c in by), F.col("part_").alias("part_by_"), *(fold(c)(f"{c}_all_").over(earlier).alias(f"{c}_before_") for c in sums))
    same = F.col("part_") == F.col("part_by_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_by_"))
    rows = ranged.withColumns({f"{c}_within_": fold(c)(f"{c}_of_").over(inside) for c in sums}).join(parts, same)
    return rows.select(*df.columns, *(_combined(sums[c][0], F.col(f"{c}_before_"), F.col(f"{c}_within_")).alias(c) for c in sums))


def numbered(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """df with numbers from 1 within each value of `by`, however many rows it has."""
    rows = running(df, [*by, *order], name)
    firsts = rows.groupBy(*(F.col(c).alias(f"{c}_first_") for c in by)).agg(F.min(name).alias("least_"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_first_"))
    return rows.join(firsts, same).withColumn(name, F.col(name) - F.col("least_") + 1).drop("least_", *(f"{c}_first_" for c in by))
