"""A table with a key: rows of an id that is stored already are left out, however long ago it came.

Rows lie in buckets by a hash of their id. Every batch writes a folder of its own; a manifest, a small JSON file per
version, lists the folders that count and the last batch of each writer. So a batch that was cut off leaves a folder that nobody
reads, and one that runs again after its commit does nothing. To tell what is new, a batch reads the ids of the buckets
that its own ids fall into, and of these, if it is small, only the row groups whose Bloom filters know one of its ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.manifest import Manifest

BUCKETS = 64
#: A batch of so many ids or fewer names them to the scan.
FEW_IDS = 200
_BUCKET = "bucket_"


class KeyedTable:
    """One writer at a time; readers see the version that was the last when they began. Rows without an id are not stored: the commit counts them."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", order: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.versions = Manifest(spark, f"{self.path}/manifest")

    def manifest(self) -> dict:
        """The newest version: version, schema, buckets, commits (name, buckets, rows, without_id), batches (the last number of each writer)."""
        return self.versions.read() or {"version": 0, "schema": None, "buckets": self.buckets, "commits": [], "batches": {}}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.manifest()["buckets"])).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets: only these buckets' folders are listed and opened."""
        manifest = self.manifest()
        if not manifest["schema"]:
            raise FileNotFoundError(f"{self.path} has no rows yet, so no schema")
        schema = T.StructType.fromJson(manifest["schema"])
        wanted = lambda c: c["buckets"] if buckets is None else sorted(set(c["buckets"]) & set(buckets))
        paths = [f"{self.path}/data/{c['name']}/{_BUCKET}={b}" for c in manifest["commits"] for b in wanted(c)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def known(self, rows: DataFrame, buckets: list[int]) -> DataFrame | None:
        """Ids of rows (with bucket_) that may be stored already; None for a table without any."""
        if not self.manifest()["commits"]:
            return None
        stored = self.read(buckets).select(self.key)
        few = [r[0] for r in rows.select(self.key).limit(FEW_IDS + 1).collect()]
        return stored.where(F.col(self.key).isin(few)) if len(few) <= FEW_IDS else stored

    def append(self, batch: DataFrame, writer: str = "batch", number: int | None = None) -> int:
        """Store the rows of new ids, of several with one id the first by `order`; how many those are. A batch number that `writer` has committed already: none."""
        manifest = self.manifest()
        if number is not None and manifest["batches"].get(writer, -1) >= number:
            return 0
        columns = batch.columns
        first = F.min_by(F.struct(*columns), F.col(self.order) if self.order else F.xxhash64(*columns)).alias("row_")
        rows = batch.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("key_")).agg(first).select("row_.*").withColumn(_BUCKET, self._bucket()).persist()
        try:
            touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())  # a row per bucket
            known = self._with_bloom_pushdown(lambda: self.known(rows, touched))
            fresh = rows if known is None else rows.join(known, self.key, "left_anti")
            name = f"{writer}-{'x' if number is None else number}-{uuid.uuid4().hex}"
            self._with_bloom_pushdown(lambda: self._write(fresh, name))
        finally:
            rows.unpersist()
        return self._commit(manifest, batch, name, writer, number)

    def _with_bloom_pushdown(self, run):
        """Parquet asks its Bloom filters about ids that are named one by one, so longer lists of ids have to be handed down to it."""
        conf, name = self.spark.conf, "spark.sql.parquet.pushdown.inFilterThreshold"
        before = conf.get(name)
        conf.set(name, str(FEW_IDS))
        try:
            return run()
        finally:
            conf.set(name, before)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows = rows.repartition(_BUCKET).sortWithinPartitions(_BUCKET, self.key)
        bloom = rows.write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        bloom.partitionBy(_BUCKET).parquet(f"{self.path}/data/{name}")

    def _commit(self, manifest: dict, batch: DataFrame, name: str, writer: str, number: int | None) -> int:
        folder = f"{self.path}/data/{name}"
        buckets = sorted(int(n.partition("=")[2]) for n in self.versions.names(folder) if n.startswith(f"{_BUCKET}="))
        written = self.spark.read.parquet(folder).count() if buckets else 0
        if written:
            commit = {"name": name, "buckets": buckets, "rows": written, "without_id": batch.where(F.col(self.key).isNull()).count()}
            manifest["commits"].append(commit)
        manifest["schema"] = manifest["schema"] or batch.schema.jsonValue()
        if number is not None:
            manifest["batches"][writer] = number
        manifest["version"] += 1
        self.versions.publish(manifest)
        return written

    def compact(self) -> None:
        """All commits as one, so that a bucket has a file; what they were stays until `vacuum`."""
        manifest = self.manifest()
        if len(manifest["commits"]) < 2:
            return
        name = f"compact-{uuid.uuid4().hex}"
        self._write(self.read().withColumn(_BUCKET, self._bucket()), name)
        total = {k: sum(c[k] for c in manifest["commits"]) for k in ("rows", "without_id")}
        manifest["commits"] = [{"name": name, "buckets": sorted({b for c in manifest["commits"] for b in c["buckets"]}), **total}]
        manifest["version"] += 1
        self.versions.publish(manifest)

    def vacuum(self) -> list[str]:
        """Delete folders that the newest version doesn't name; their names. Not while a batch or an older reader is at work."""
        named = {c["name"] for c in self.manifest()["commits"]}
        gone = sorted(n for n in self.versions.names(f"{self.path}/data") if n not in named)
        self.versions.delete([f"{self.path}/data/{n}" for n in gone])
        return gone
