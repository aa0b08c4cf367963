"""Packing documents into training sequences: best-fit decreasing over a segment tree of remaining capacities.

A document is its token ids and an end id. Documents longer than a sequence are first cut into full windows;
what remains of each document is placed, longest first, into the open window with the least room that still
holds it, found by a segment tree indexed by remaining capacity. Gaps of MIN_GAP tokens or more that are left
then are filled by cutting pieces of the emptiest windows, and the one window that stays partly filled is cut
into sequences whose lengths are powers of two, which need no padding.

Each input partition packs its own documents, GROUP_TOKENS at a time: no shuffle, and a task's memory has a
bound that doesn't depend on the input. Sequence ids hold the partition's number in the upper bits, so they
are unique, and a lost task that runs again gives the same pieces.

Defined results: a null or empty text is the end id alone; doc_id is only carried along, so nulls and ties
don't matter; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import fast_tokens
from gridloom.llm.shared import text_of

LENGTH = 2048
END_ID = 1
MIN_GAP = 16
GROUP_TOKENS = 1 << 23
_SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class CapacityTree:
    """Counts of open windows by remaining capacity, in a binary segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = self.leaves + capacity
        while at:
            self.counts[at] += n
            at //= 2

    def tightest(self, size: int) -> int:
        """The smallest capacity of at least size that an open window has, or -1."""
        at = self.leaves + size
        if not self.counts[at]:
            while at > 1 and (at % 2 or not self.counts[at + 1]):
                at //= 2
            if at == 1:
                return -1
            at += 1
            while at < self.leaves:
                at = 2 * at if self.counts[2 * at] else 2 * at + 1
        return at - self.leaves


@dataclass
class Window:
    room: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)  # document's number, start, length


def best_fit_decreasing(pieces: list[tuple[int, int, int]], length: int) -> list[Window]:
    tree, by_room, windows = CapacityTree(length), [[] for _ in range(length + 1)], []
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0])):
        room = tree.tightest(piece[2])
        if room < 0:
            window, room = Window(length), length
            windows.append(window)
        else:
            window = by_room[room].pop()
            tree.add(room, -1)
        window.pieces.append(piece)
        window.room = room - piece[2]
        if window.room:
            by_room[window.room].append(window)
            tree.add(window.room, 1)
    return windows


def fill_gaps(windows: list[Window], min_gap: int) -> list[Window]:
    """Cut pieces of the emptiest windows to fill the gaps of the others."""
    order = sorted(windows, key=lambda w: w.room)
    giver = len(order) - 1
    for k, taker in enumerate(order):
        while taker.room >= min_gap and k < giver:
            doc, start, size = order[giver].pieces.pop()
            moved = min(size, taker.room)
            taker.pieces.append((doc, start + size - moved, moved))
            taker.room -= moved
            order[giver].room += moved
            if moved < size:
                order[giver].pieces.append((doc, start, size - moved))
            elif not order[giver].pieces:
                giver -= 1
    return order[: giver + 1]


def powers_of_two(window: Window, length: int) -> list[Window]:
    """The window's pieces as windows whose lengths are powers of two."""
    out, rest = [], list(reversed(window.pieces))
    left = length - window.room
    while left:
        part = Window(1 << (left.bit_length() - 1))
        left -= part.room
        while part.room:
            doc, start, size = rest.pop()
            taken = min(size, part.room)
            part.pieces.append((doc, start, taken))
            part.room -= taken
            if taken < size:
                rest.append((doc, start + taken, size - taken))
        out.append(part)
    return out


def pack_group(sizes: list[int], length: int = LENGTH, min_gap: int = MIN_GAP) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document's number, start, length), for documents of these sizes."""
    full = [[(doc, start, length)] for doc, size in enumerate(sizes) for start in range(0, size - length + 1, length)]
    windows = best_fit_decreasing([(doc, size - size % length, size % length) for doc, size in enumerate(sizes) if size % length], length)
    windows = fill_gaps(windows, min_gap)
    if windows and windows[-1].room >= min_gap:
        windows = windows[:-1] + powers_of_two(windows[-1], length)
    return full + [w.pieces for w in windows if w.pieces]


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.

    tokenizer: the path of a word-level vocabulary, as public_tokenizers.path("word_bpe_49k.json") gives it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = fast_tokens.load("word", tokenizer)
        next_id = TaskContext.get().partitionId() << 32
        doc_ids, ids, n_tokens = [], [], 0
        for batch in batches:
            doc_ids += batch.column(0).to_pylist()
            for x in encoder.encode(batch.column(1).to_pylist()):
                ids.append(np.append(x, np.uint32(end_id)).astype(np.uint16 if len(x) == 0 or x.max() < 65536 else np.uint32))
                n_tokens += len(x) + 1
            if n_tokens >= group_tokens:
                next_id = yield from _pieces(doc_ids, ids, next_id, length)
                doc_ids, ids, n_tokens = [], [], 0
        yield from _pieces(doc_ids, ids, next_id, length)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def _pieces(doc_ids: list, ids: list[np.ndarray], next_id: int, length: int):
    """Yields the group's pieces in batches; returns the next sequence id."""
    sequences = pack_group([len(x) for x in ids], length)
    for k in range(0, len(sequences), 1000):
        rows = []
        for n, pieces in enumerate(sequences[k : k + 1000], next_id + k):
            offset = 0
            for doc, start, size in pieces:
                rows.append((doc_ids[doc], start, size, ids[doc][start : start + size].astype("<u4").tobytes(), len(ids[doc]), n, offset))
                offset += size
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    return next_id + len(sequences)


def packing_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    return packed(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
