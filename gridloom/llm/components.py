"""Connected components over an edge table, by alternating large-star and small-star steps.

Every partition first replaces its own edges by stars of their components (a union-find over PART_ROWS edges, about), so
that long paths don't cost rounds. Every further step is a grouped minimum and an equi-join; each round's edges are written
to the shared folder, so lineage stays short. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import publish


#: Edges of a table's partition; a table of so few rows is not worth hundreds of files a round.
PART_ROWS = 500_000


def parts_for(n_rows: int) -> int:
    return n_rows // PART_ROWS + 1


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (bigint). A row (node, root) for each node of an edge; root is the smallest node reachable."""
    edges = publish(_directed(edges), "edges")
    edges = publish(_stars(edges.coalesce(parts_for(edges.count()))), "stars")
    state = _state(edges)
    while True:
        n = parts_for(2 * state[0])
        edges = publish(_small_star(publish(_large_star(edges, n), "large-star", n), n), "small-star", n)
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node u to the smaller node v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """The edges of each partition, replaced by one from each of their nodes to the smallest that it reaches by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        nodes, place = np.unique(np.concatenate([c.to_numpy() for c in table.columns]), return_inverse=True)
        a, b = np.split(place, 2)
        least = np.arange(len(nodes))
        while True:  # each end takes the smaller of both ends' least, then the least of that one
            before = least.copy()
            low = np.minimum(least[a], least[b])
            for end in (a, b):
                np.minimum.at(least, least[end], low)
                np.minimum.at(least, end, low)
            least = least[least]
            if np.array_equal(before, least):
                break
        others = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[others]), pa.array(nodes[least[others]])], names=["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link the larger neighbours of each node to the smallest node among the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = publish(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", n)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these."""
    least = publish(edges.groupBy("u").agg(F.min("v").alias("m")), "least", n)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
