"""NDJSON logs and stores of JSON records."""

from __future__ import annotations

import datetime
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.activity import LOG_SCHEMA


def read_log(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """Log rows; lines that are no JSON are skipped. Days are partitions, so a filter on log_date prunes files."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_log(log: DataFrame, path: str, at: str = "occurred_at") -> None:
    """Appends to a folder per day."""
    log.withColumn("log_date", F.to_date(at)).write.mode("append").partitionBy("log_date").json(path)


def pending_count(spark: SparkSession, path: str) -> int:
    """Lines of a queue file that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_newest(spark: SparkSession, path: str, days: int = 5, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """The log of the newest days there are: their names come from the folders, and only these folders are read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    newest = sorted(n for n in names if n.startswith("log_date="))[-days:]  # a name a day
    return read_log(spark, path, schema).where(F.col("log_date").isin([n.removeprefix("log_date=") for n in newest]))


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, a function from a place to its Path)."""
    at = lambda place: spark._jvm.org.apache.hadoop.fs.Path(place)
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of records, or a record per line; its backup (path.bak) where the store is damaged, or gone because a writer died between its two renames."""

    def rows(place: str, mode: str) -> DataFrame:
        return spark.read.schema(schema).option("mode", mode).option("multiLine", True).json(place)

    def damaged(place: str) -> bool:
        try:
            rows(place, "FAILFAST").write.format("noop").mode("overwrite").save()
        except (PySparkException, Py4JJavaError):
            return True
        return False

    fs, at = _files(spark, path)
    store, backup = fs.exists(at(path)), fs.exists(at(path + ".bak"))
    if not store and not backup:
        return spark.createDataFrame([], schema)
    return rows(path + ".bak" if not store or backup and damaged(path) else path, "DROPMALFORMED")


def write_store(records: DataFrame, path: str) -> None:
    """Written beside the store first; then the store becomes the backup and the new one takes its place. A reader sees the old store (by itself or as the backup) or the new one."""
    fs, at = _files(records.sparkSession, path)
    new = f"{path}.new-{uuid.uuid4().hex}"
    records.write.json(new)
    if fs.exists(at(path)):
        fs.delete(at(path + ".bak"), True)
        fs.rename(at(path), at(path + ".bak"))
    fs.rename(at(new), at(path))


#: Columns whose values a scan looks up one by one, and the columns that a day's rows are ordered by.
LOOKED_UP = ("id", "session_id")
CLUSTERED_BY = ("tool_id", "session_id", "occurred_at")


def write_clustered(log: DataFrame, path: str, at: str = "occurred_at", by: tuple[str, ...] = CLUSTERED_BY, looked_up: tuple[str, ...] = LOOKED_UP, block_bytes: int | None = None) -> None:
    """Appends Parquet to a folder per day, rows of a day in ranges of tool and session, so that a scan for one of them skips most row groups.

    Within a file rows are sorted, so row groups have narrow bounds of tool, and of session within a tool; ids and sessions, which lie in many
    places, have Bloom filters besides. The ranges span days (a day is cut where it is large), so a hot tool or day is many files.
    """
    columns = [c for c in by if c in log.columns]
    days = log.withColumn("log_date", F.to_date(at))
    writer = days.repartitionByRange("log_date", *columns).sortWithinPartitions("log_date", *columns).write.mode("append").partitionBy("log_date")
    for c in looked_up:
        if c in log.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    (writer if block_bytes is None else writer.option("parquet.block.size", block_bytes)).parquet(path)


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def drop_expired(spark: SparkSession, path: str, today: datetime.date, days: int = 90) -> list[str]:
    """Delete the day folders of a log that are older than some days; their names tell, no file is opened. The names of those that went."""
    fs, at = _files(spark, path)
    oldest = (today - datetime.timedelta(days=days)).isoformat()
    expired = [f.getPath() for f in fs.listStatus(at(path)) if re.fullmatch(r"log_date=\d{4}-\d\d-\d\d", f.getPath().getName()) and f.getPath().getName() < f"log_date={oldest}"]
    for folder in expired:
        fs.delete(folder, True)
    return sorted(folder.getName() for folder in expired)
