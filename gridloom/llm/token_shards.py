"""Token ids in sorted-string-table shards.

A shard holds documents in key order: blocks of prefix-compressed entries, a sparse index (last key, place,
length and checksum of each block), a Bloom filter over the document ids and a footer. A lookup asks the
filter, finds its block by binary search in the index and its entry by a scan of that one block.

    shard  := block* index bloom footer
    block  := (shared varint, unshared varint, value length varint, key suffix, value)*
    value  := token ids, little-endian, 2 or 4 bytes each (the footer tells)
    key    := 0, or 1 and the doc_id big-endian with its sign bit flipped; then a 4-byte number among equal ids

The documents are range-partitioned and sorted by doc_id; a task writes one shard into the shared folder, under a name of
its own attempt. The manifest, which only committed attempts write, names the files that count, with their first and
last doc_id; what a lost or a second attempt wrote is in no manifest (`remove_strays` deletes it). Files are written by
pyarrow.fs, which knows file:, hdfs:, s3: and gs:.

Defined results: a null text is the end id alone; a null doc_id sorts first; rows that repeat a doc_id are all
kept, ordered by a hash of their texts; an empty table has no shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import fast_tokens
from gridloom.llm.shared import new_path, publish, text_of

BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 0
_MAGIC = b"GLSSTv01"
_FOOTER = struct.Struct("<QQQQQQQB7x8s")  # index place, length; bloom place, length, bits; documents, tokens; bytes an id
_INDEX = struct.Struct("<HQII")  # key length, place, length, crc32


def key_of(doc_id: int | None, number: int = 0) -> bytes:
    head = b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))
    return head + struct.pack(">I", number)


def doc_id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _bloom_places(doc_id: int | None, n_bits: int) -> list[int]:
    head = key_of(doc_id)[:-4]
    a, b = xxhash.xxh64_intdigest(head, 1), xxhash.xxh64_intdigest(head, 2) | 1
    return [(a + k * b) % n_bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Takes documents in ascending key order."""

    def __init__(self, out: BinaryIO, id_bytes: int):
        self.out, self.id_bytes = out, id_bytes
        self.place = self.n_tokens = 0
        self.block, self.last_key = bytearray(), b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.number = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.number = self.number + 1 if self.doc_ids and self.doc_ids[-1] == doc_id else 0
        key, value = key_of(doc_id, self.number), ids.astype(f"<u{self.id_bytes}").tobytes()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last_key)) and key[shared] == self.last_key[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last_key = key
        self.doc_ids.append(doc_id)
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        self.out.write(bytes(self.block))
        self.index.append((self.last_key, self.place, len(self.block), zlib.crc32(self.block)))
        self.place += len(self.block)
        self.block = bytearray()

    def close(self) -> None:
        if self.block:
            self._end_block()
        index = b"".join(_INDEX.pack(len(k), place, size, crc) + k for k, place, size, crc in self.index)
        n_bits = max(64, BLOOM_BITS * len(self.doc_ids))
        bits = np.zeros(n_bits, np.uint8)
        for doc_id in self.doc_ids:
            bits[_bloom_places(doc_id, n_bits)] = 1
        bloom = np.packbits(bits, bitorder="little").tobytes()
        footer = _FOOTER.pack(self.place, len(index), self.place + len(index), len(bloom), n_bits, len(self.doc_ids), self.n_tokens, self.id_bytes, _MAGIC)
        self.out.write(index + bloom + footer)


class ShardReader:
    def __init__(self, path: str):
        fs, place = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(place)
        foot = self._at(self.file.size() - _FOOTER.size, _FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.n_bits, self.n_docs, self.n_tokens, self.id_bytes, magic = _FOOTER.unpack(foot)
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.bloom = self._at(bloom_at, bloom_size)
        data, at, self.keys, self.blocks = self._at(index_at, index_size), 0, [], []
        while at < len(data):
            size, *block = _INDEX.unpack_from(data, at)
            at += _INDEX.size
            self.keys.append(data[at : at + size])
            self.blocks.append(block)
            at += size

    def _at(self, place: int, size: int) -> bytes:
        return self.file.read_at(size, place)

    def _entries(self, number: int) -> Iterator[tuple[bytes, np.ndarray]]:
        place, size, crc = self.blocks[number]
        data, at, key = self._at(place, size), 0, b""
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {number} is damaged")
        while at < size:
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(data, f"<u{self.id_bytes}", length // self.id_bytes, at)
            at += length

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for number in range(len(self.blocks)):
            for key, ids in self._entries(number):
                yield doc_id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of this doc_id."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(doc_id, self.n_bits)):
            return []
        found, number = [], bisect_left(self.keys, key_of(doc_id))
        while number < len(self.keys):
            for key, ids in self._entries(number):
                if doc_id_of(key) == doc_id:
                    found.append(ids)
                elif key > key_of(doc_id):
                    return found
            number += 1
        return found


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder's URI with its file system, as Spark resolves it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the shards into folder (a URI that all executors share). The manifest: shard, path, n_docs, n_tokens, first_id, last_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = fast_tokens.load("byte", tokenizer)
        id_bytes = 2 if encoder.library.get_vocab_size() <= 65536 else 4
        shard = TaskContext.get().partitionId()
        fs, place = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(place, recursive=True)
        name = f"shard-{shard:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.sst"
        writer = None
        with fs.open_output_stream(f"{place}/{name}") as out:
            for batch in batches:
                writer = writer or ShardWriter(out, id_bytes)
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
            if writer:
                writer.close()
        if not writer:
            fs.delete_file(f"{place}/{name}")
            return
        row = {"shard": shard, "path": f"{folder}/{name}", "n_docs": len(writer.doc_ids), "n_tokens": writer.n_tokens, "first_id": writer.doc_ids[0], "last_id": writer.doc_ids[-1]}
        yield pa.RecordBatch.from_pylist([row], _MANIFEST)

    folder = _qualified(docs.sparkSession, folder)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return publish(ranged.mapInArrow(run, "shard bigint, path string, n_docs bigint, n_tokens bigint, first_id bigint, last_id bigint"), "shards")


def remove_strays(manifest: DataFrame, folder: str) -> None:
    """Delete the shards in folder that the manifest doesn't name; only when no task writes there any more."""
    fs, place = pyarrow.fs.FileSystem.from_uri(_qualified(manifest.sparkSession, folder))
    named = {r["path"].rsplit("/", 1)[1] for r in manifest.select("path").toLocalIterator()}  # a row per shard
    for info in fs.get_file_info(pyarrow.fs.FileSelector(place)):
        if info.base_name.endswith(".sst") and info.base_name not in named:
            fs.delete_file(info.path)


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, ids (4 bytes each) of each document whose doc_id is among those wanted. Only shards whose range holds one are opened.

    The shards' ranges (a row per shard) go to every task; wanted ids then meet at their shard.
    """
    order = lambda k: (k is not None, k or 0)
    ranges = sorted((order(r["last_id"]), order(r["first_id"]), r["path"]) for r in manifest.select("path", "first_id", "last_id").collect())  # a row per shard
    shared = manifest.sparkSession.sparkContext.broadcast(ranges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for doc_id in batch.column(0).to_pylist():
                key, k = order(doc_id), bisect_left(shared.value, (order(doc_id),))
                while k < len(shared.value) and shared.value[k][1] <= key:  # equal ids may reach over several shards
                    out[0].append(shared.value[k][2])
                    out[1].append(doc_id)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64())], names=["path", "doc_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for at, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path, reader = (path, reader) if at == path else (at, ShardReader(at))
                for ids in reader.get(doc_id):
                    found[0].append(doc_id)
                    found[1].append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.binary())], names=["doc_id", "ids"])

    placed = wanted.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().mapInArrow(place, "path string, doc_id bigint")
    return placed.repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(read, "doc_id bigint, ids binary")


def read_shards(manifest: DataFrame) -> DataFrame:
    """A row per document: shard, doc_id, start (ids of the documents before it in its shard), ids (4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, n_bytes, start = [], 0, 0
                for doc_id, ids in ShardReader(path):
                    rows.append({"shard": shard, "doc_id": doc_id, "start": start, "ids": ids.astype("<u4").tobytes()})
                    start += len(ids)
                    n_bytes += 4 * len(ids)
                    if n_bytes > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                        rows, n_bytes = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    n = max(1, manifest.count())
    return manifest.select("shard", "path").repartitionByRange(n, "shard").mapInArrow(run, "shard bigint, doc_id bigint, start bigint, ids binary")


_MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_tokens", "first_id", "last_id"))])
_READ = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def token_report(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write shards, read them back: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_shards(docs, tokenizer, new_path(spark, "token-shards"))
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per shard
    bases = manifest.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    rows = read_shards(manifest).join(publish(bases, "bases"), "shard")
    return rows.select("doc_id", (F.col("base") + F.col("start")).alias("start"), F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
