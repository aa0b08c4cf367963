"""Exact de-duplication by Grace hashing.

Texts are equal when they are identical after each run of ASCII white space has become one space. Of equal
texts the row with the smallest doc_id stays.

How it runs: every input partition first finds its own groups of equal texts (the pre-aggregation: a group
of copies, however large, leaves at most one row per partition), then the representatives are shuffled by
their hash and grouped again. Both passes are the same Grace hash pass: an open-addressing table compares
complete contents; a partition that doesn't fit its memory budget is split by further hash bits into spill
files of the task in Spark's local folder, recursively, until each bucket fits.

Defined results: null text equals the empty text; a null doc_id is larger than any other; rows that repeat
both doc_id and text are counted in group_size and share one verdict; an empty table gives an empty result;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import SPACES, publish, text_of

#: Bytes of text that a task holds in its table before it splits its input into spill files.
MEMORY_BUDGET = 256 << 20
#: Spill files per split.
FAN_OUT = 16
_HEAD = struct.Struct("<iqq?32s")
_GROUPS = "content binary, digest binary, keep_id bigint, group_size bigint"

Record = tuple[bytes, bytes, int | None, int]


class ContentTable:
    """Open addressing with linear probing; a slot matches when the complete contents are equal."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.groups: list[list] = []
        self.n_bytes = 0

    def add(self, record: Record) -> None:
        content, digest, doc_id, count = record
        h = xxhash.xxh3_64_intdigest(content)
        at = self._slot(h, content)
        if self.slots[at] >= 0:
            group = self.groups[self.slots[at]]
            group[3] += count
            if doc_id is not None and (group[2] is None or doc_id < group[2]):
                group[2] = doc_id
            return
        self.slots[at] = len(self.groups)
        self.groups.append([content, digest, doc_id, count])
        self.hashes.append(h)
        self.n_bytes += len(content) + 120
        if 2 * len(self.groups) > len(self.slots):
            self._grow()

    def _slot(self, h: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0 and not (self.hashes[k] == h and self.groups[k][0] == content):
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def grace_groups(records: Iterable[Record], budget: int = MEMORY_BUDGET, level: int = 0) -> Iterator[Record]:
    """One record per distinct content: the smallest doc_id, the sum of the counts."""
    table, records = ContentTable(), iter(records)
    for record in records:
        table.add(record)
        if table.n_bytes > budget and len(table.groups) > 1:
            break
    else:
        yield from map(tuple, table.groups)
        return
    with tempfile.TemporaryDirectory(prefix="grace-", dir=_local_dir()) as folder:
        files = [open(os.path.join(folder, str(k)), "wb") for k in range(FAN_OUT)]
        try:
            for source in (map(tuple, table.groups), records):
                for content, digest, doc_id, count in source:
                    f = files[xxhash.xxh64_intdigest(content, seed=level + 1) % FAN_OUT]
                    f.write(_HEAD.pack(len(content), doc_id or 0, count, doc_id is None, digest))
                    f.write(content)
            del table
        finally:
            for f in files:
                f.close()
        for f in files:
            yield from grace_groups(_spilled(f.name), budget, level + 1)
            os.remove(f.name)


def _local_dir() -> str | None:
    """The folder where Spark itself spills on this machine, if it tells; a task's files there are read by the same task only."""
    folders = (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or "").split(",")
    return folders[0] if folders[0] and os.path.isdir(folders[0]) else None


def _spilled(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            size, doc_id, count, no_id, digest = _HEAD.unpack(head)
            yield f.read(size), digest, None if no_id else doc_id, count


def _grace_pass(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        out: list[Record] = []
        n_bytes = 0
        for group in grace_groups(records, budget):
            out.append(group)
            n_bytes += len(group[0])
            if n_bytes > 8 << 20 or len(out) >= 10_000:
                yield _batch(out)
                out, n_bytes = [], 0
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[Record]) -> pa.RecordBatch:
    kinds = (("content", pa.binary()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def exact_groups(docs: DataFrame, budget: int = MEMORY_BUDGET) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    content = F.regexp_replace(text_of(), SPACES, " ")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), content.alias("content"))
    digest = F.unhex(F.sha2("content", 256))
    rows = keyed.select(F.col("content").cast("binary").alias("content"), digest.alias("digest"), "doc_id", F.lit(1).cast("bigint").alias("n"))
    local = rows.mapInArrow(_grace_pass(budget), _GROUPS)
    groups = local.repartition("digest").mapInArrow(_grace_pass(budget), _GROUPS).select("digest", "keep_id", "group_size")
    groups = publish(groups, "exact-groups")
    members = keyed.select("doc_id", digest.alias("digest"))
    return members.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, budget: int = MEMORY_BUDGET) -> DataFrame:
    """The documents that stay, all columns; of rows that repeat doc_id and text, one."""
    verdict = exact_groups(docs, budget).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    sha = F.sha2(F.regexp_replace(text_of(), SPACES, " "), 256)
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("bigint").alias("id"), sha.alias("sha"))  # so that no column of docs clashes
    kept = keyed.join(verdict, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return kept.dropDuplicates(["id", "sha"]).select("doc.*")
