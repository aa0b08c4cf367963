"""Merkle manifest of a dataset: a root over all rows, and for each row the path that proves it.

A row's leaf is the SHA-256 of its fields. Leaves of a language stand in order of doc_id; every ARITY consecutive
nodes become the digest of their digests, until one is left, the language's subroot. The subroots, ordered by
language (null first), form one more tree, whose root stands for the table.

Leaves are numbered by a range sort and dealt to aligned blocks of BLOCK leaves, so any language, however large, is many
blocks. A block's own levels are climbed in one task. The levels above it, of which there is a row per BLOCK leaves and
fewer, are grouped aggregates of Spark, level by level, and give every block its upper proof. Then each block is traversed once more,
leaf by leaf, by `Fractal`: its tree is cut into bands of subtrees BAND levels high; each band keeps the subtree that
holds the current leaf (existing) and builds the one to its right (desired) a leaf at a time, so that it is complete when the
traversal gets there. Digests in memory are two subtrees a band, besides the block's leaves.

Defined results: a null field counts as "-"; a null language is a tree of its own, the first; a null doc_id stands first in its
language and is never tampered with; rows that repeat doc_id are leaves of their own, ordered by their digests (equal rows
have equal leaves, so which is which doesn't matter); an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import publish
from gridloom.operators.rounds import numbered, running

ARITY = 8
#: Levels of a block's tree, and of the subtrees that a traversal keeps.
LEVELS, BAND = 4, 2
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Hex digits of a digest.
_HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column | str = "text") -> Column:
    """The SHA-256 of a row's fields: each with its length in bytes before it, so that no two rows run together."""
    values = [F.col(c) if c != "text" else F.col(text) if isinstance(text, str) else text for c in FIELDS]
    return F.sha2(F.concat(*map(_field, values)), 256)


def lower_cased() -> Column:
    """The text with A-Z in lower case."""
    return F.translate("text", _UPPER, _LOWER)


# The traversal of one block.


class Subtree:
    """Digests of `height` levels above some nodes, given one after another: `levels[0]` are these nodes."""

    def __init__(self, height: int):
        self.levels: list[list[str]] = [[] for _ in range(height + 1)]

    def add(self, node: str) -> None:
        self.levels[0].append(node)
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            if len(below) % ARITY or len(below) // ARITY == len(above):
                break
            above.append(digest(*below[-ARITY:]))

    def close(self) -> None:
        """No more nodes: runs that are not full become digests too."""
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            if -(-len(below) // ARITY) > len(above):
                above.append(digest(*below[ARITY * len(above) :]))


class Climb:
    """Nodes `height` levels above leaves that are given one after another; only the open run of each level is kept."""

    def __init__(self, height: int):
        self.open: list[list[str]] = [[] for _ in range(height)]

    def add(self, node: str, level: int = 0) -> str | None:
        """The finished node above, if this one finishes it."""
        if level == len(self.open):
            return node
        self.open[level].append(node)
        if len(self.open[level]) < ARITY:
            return None
        node, self.open[level] = digest(*self.open[level]), []
        return self.add(node, level + 1)

    def close(self) -> str | None:
        """The last node above, of runs that are not full; none if there are no leaves left for it."""
        carry = None
        for run in self.open:
            if carry is not None:
                run.append(carry)
            carry = digest(*run) if run else None
            run.clear()
        return carry


class Band:
    """The existing subtree of a band and the desired one to its right, which grows while the existing one is used up."""

    def __init__(self, low: int, height: int, leaves: list[str]):
        self.low, self.height, self.leaves = low, height, leaves
        self.span = ARITY ** (low + height)  # leaves under a subtree
        self.next = 0  # the next leaf that the desired subtree takes
        self.desired, self.climb = Subtree(height), Climb(low)
        for _ in range(self.span):
            self.step()
        self.shift()

    def step(self) -> None:
        """One leaf more for the desired subtree."""
        if self.next >= len(self.leaves):
            return
        node = self.climb.add(self.leaves[self.next])
        self.next += 1
        if node is None and self.next == len(self.leaves):
            node = self.climb.close()
        if node is not None:
            self.desired.add(node)

    def shift(self) -> None:
        """The existing subtree is used up: the desired one takes its place."""
        self.desired.close()
        self.existing, self.desired = self.desired, Subtree(self.height)

    def run(self, leaf: int, level: int) -> tuple[list[str], int]:
        """The run of nodes at a level of the block that holds the leaf's, and its place there."""
        at = leaf // ARITY**level
        nodes = self.existing.levels[level - self.low]
        mine = at - leaf // self.span * ARITY ** (self.low + self.height - level)
        first = mine - mine % ARITY
        return nodes[first : first + ARITY], at % ARITY


class Fractal:
    """Authentication paths of the leaves of a block, one after another from the left.

    `height`: levels of the block's tree. Iterating gives, for each leaf, its runs from the bottom up: (nodes, place of the own one).
    """

    def __init__(self, leaves: list[str], height: int, band: int = BAND):
        self.leaves, self.height = leaves, height
        self.bands = [Band(low, min(band, height - low), leaves) for low in range(0, height, band)]

    def __iter__(self) -> Iterator[list[tuple[list[str], int]]]:
        for k in range(len(self.leaves)):
            path = []
            for b in self.bands:
                if k and k % b.span == 0:
                    b.shift()
                path += [b.run(k, level) for level in range(b.low, b.low + b.height)]
            yield path
            for b in self.bands:
                b.step()


def block_root(leaves: list[str], height: int) -> str:
    tree = Climb(height)
    root = None
    for x in leaves:
        root = tree.add(x)
    return root or tree.close()


def fold(node: str, path: list[tuple[list[str], int]]) -> str:
    """The root that a node and the runs above it (whose own place it takes) give."""
    for run, place in path:
        node = digest(*run[:place], node, *run[place + 1 :])
    return node


def siblings(path: list[tuple[list[str], int]]) -> list[str]:
    return [x for run, place in path for x in (*run[:place], *run[place + 1 :])]


def height_of(n: Column) -> Column:
    """Levels of a tree of n leaves, LEVELS at most: those within a block."""
    out = F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        out = F.when(n <= ARITY**level, F.lit(level)).otherwise(out)
    return out


# The whole table.


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """A row per row of docs: doc_id, lang, leaf, other (the leaf with the text `tampered`; null where that is null), at (place in its language from 0)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf().alias("leaf"), (F.lit(None).cast("string") if tampered is None else tampered).alias("other"))
    rows = publish(rows, "digests")  # texts are hashed once, not again to find the ranges
    placed = numbered(rows, ["lang"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "at")
    return placed.withColumn("at", F.col("at") - 1)


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, where keys agree; null keys agree too."""
    right = right.select(*(F.col(c).alias(f"{c}_r_") if c in keys else F.col(c) for c in right.columns))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_r_"))
    return left.join(right, same, how).drop(*(f"{c}_r_" for c in keys))


def _block_roots(rows: DataFrame) -> DataFrame:
    """rows: lang, block, at, leaf, height. A row per block: lang, at (the block's), digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block, group in _groups(batches):
            yield _batch([[lang], [block], [block_root([r["leaf"] for r in group], group[0]["height"])]], _ROOT)

    return _by_block(rows.select("lang", "block", "at", "leaf", "height")).mapInArrow(run, "lang string, at bigint, digest string")


_ROOT = pa.schema([("lang", pa.string()), ("at", pa.int64()), ("digest", pa.string())])
_PROVED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("path", pa.string()), ("places", pa.list_(pa.int32())), ("runs", pa.list_(pa.int32())), ("proof_sha256", pa.string()), ("folded_root", pa.string())])
_PROVED_SQL = "doc_id bigint, lang string, at bigint, leaf string, subroot string, root string, path string, places array<int>, runs array<int>, proof_sha256 string, folded_root string"


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _by_block(rows: DataFrame) -> DataFrame:
    """Blocks whole and in order; none has more than BLOCK rows."""
    return rows.repartition("lang", "block").sortWithinPartitions("lang", "block", "at")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, list[dict]]]:
    """Sorted rows as (lang, block, its rows)."""
    key, group = None, []
    for b in batches:
        for row in b.to_pylist():
            mine = (row["lang"], row["block"])
            if group and mine != key:
                yield *key, group
                group = []
            key = mine
            group.append(row)
    if group:
        yield *key, group


def _upper(nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes: keys, at, digest. (their proofs: keys, at, root, path; the roots: keys, root).

    Level by level, eight nodes make one, in trees that are higher still; a level is a grouped aggregate over rows that get
    fewer by eight. path holds a run (nodes, place) for each level, from the bottom up.
    """
    nodes = publish(nodes, "nodes")
    sizes = publish(nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes")
    most, levels = sizes.agg(F.max("n")).first()[0] or 0, 0
    while ARITY**levels < most:
        levels += 1
    height = F.lit(levels)
    for level in reversed(range(levels)):
        height = F.when(F.col("n") <= ARITY**level, F.lit(level)).otherwise(height)
    below = _on(nodes, sizes.select(*keys, height.alias("height")), keys)
    roots, runs = [below.where("height = 0")], []
    for level in range(levels):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        grouped = below.where(F.col("height") > level).groupBy(*keys, "height", F.floor(F.col("at") / ARITY).alias("above"))
        runs.append(publish(grouped.agg(ordered.alias("run")), "runs"))
        below = runs[-1].select(*keys, "height", F.col("above").alias("at"), F.sha2(F.array_join("run", ""), 256).alias("digest"))
        roots.append(below.where(F.col("height") == level + 1))
    none = F.array().cast("array<struct<run:array<string>,place:int>>")
    proofs = nodes.select(*keys, "at", F.col("at").alias("above"), none.alias("path"))
    for run in runs:
        proofs = proofs.withColumns({"place": (F.col("above") % ARITY).cast("int"), "above": F.floor(F.col("above") / ARITY)})
        proofs = _on(proofs, run.drop("height"), [*keys, "above"], "left")
        step = F.when(F.col("run").isNull(), F.col("path")).otherwise(F.array_append("path", F.struct("run", "place")))
        proofs = proofs.withColumn("path", step).drop("run", "place")
    found = publish(reduce(DataFrame.unionByName, (r.select(*keys, F.col("digest").alias("root")) for r in roots)), "roots")
    return publish(_on(proofs.drop("above"), found, keys), "proofs"), found


def proved(docs: DataFrame, tampered: Column | None = None, paths: bool = True) -> DataFrame:
    """The manifest: a row per row of docs.

    doc_id, lang, at (its place in the language), leaf, subroot, root, path (the siblings' digests joined, from the bottom up),
    places and runs (per level the own place among how many), proof_sha256 (of path) and folded_root (what the leaf, or where
    there is one the `tampered` leaf, folds to). Without paths, path is null: a path has some 450 characters a level.
    """
    rows = publish(leaves(docs, tampered).withColumn("block", F.floor(F.col("at") / BLOCK)), "leaves")
    sizes = publish(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    rows = _on(rows, sizes.select("lang", height_of(F.col("n")).alias("height")), ["lang"])
    blocks, subroots = _upper(_block_roots(rows), ["lang"])
    ordered = running(subroots, [F.col("lang").asc_nulls_first()], "at")
    tops = publish(ordered.select("lang", "at", F.col("root").alias("digest")), "subroots")
    top_proofs, _ = _upper(tops.select(F.lit(0).alias("tree"), "at", "digest"), ["tree"])
    tops = _on(tops, top_proofs.select("at", F.col("root"), F.col("path").alias("top")), ["at"])
    blocks = _on(blocks.withColumnsRenamed({"root": "subroot"}), tops.select("lang", "root", "top"), ["lang"])
    uppers = blocks.select("lang", F.col("at").alias("block"), "subroot", "root", F.concat("path", "top").alias("upper"))
    return _traversed(rows, publish(uppers, "upper-proofs"), paths)


def _traversed(rows: DataFrame, uppers: DataFrame, paths: bool) -> DataFrame:
    """Every block's paths, with the block's upper proof (which its first row carries) behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, group in _groups(batches):
            first = group[0]
            upper = [(x["run"], x["place"]) for x in first["upper"]]
            tail = siblings(upper)
            out: list[tuple] = []
            for row, path in zip(group, Fractal([r["leaf"] for r in group], first["height"]), strict=True):
                joined = "".join(siblings(path) + tail)
                whole = path + upper
                folded = fold(row["leaf"] if row["other"] is None else row["other"], whole)
                shape = ([p for _, p in whole], [len(r) for r, _ in whole]) if paths else (None, None)
                out.append((row["doc_id"], lang, row["at"], row["leaf"], first["subroot"], first["root"], joined if paths else None, *shape, digest(joined), folded))
                if len(out) == 1000:
                    yield _batch(list(zip(*out, strict=True)), _PROVED)
                    out = []
            if out:
                yield _batch(list(zip(*out, strict=True)), _PROVED)

    starts = rows.where(F.col("at") % BLOCK == 0).select("lang", "block", "at")
    uppers = _on(starts, uppers, ["lang", "block"]).select("lang", "at", "subroot", "root", "upper")
    joined = _on(rows, publish(uppers, "upper-proofs"), ["lang", "at"], "left")
    return _by_block(joined.select("lang", "block", "at", "doc_id", "leaf", "other", "height", "subroot", "root", "upper")).mapInArrow(run, _PROVED_SQL)


def folded(node: Column, path: Column, places: Column, runs: Column) -> Column:
    """The root that a leaf and a path of `proved` give: what a holder of one row and its proof computes."""
    levels = F.arrays_zip(places.alias("place"), runs.alias("run"))

    def step(acc: Column, level: Column) -> Column:
        before, after = level["place"] * _HEX, (level["run"] - 1 - level["place"]) * _HEX
        start = acc["used"] + 1
        joined = F.concat(F.substring(path, start, before), acc["node"], F.substring(path, start + before, after))
        return F.struct(F.sha2(joined, 256).alias("node"), (acc["used"] + before + after).alias("used"))

    return F.aggregate(levels, F.struct(node.alias("node"), F.lit(0).alias("used")), step, lambda acc: acc["node"])


def manifest_report(docs: DataFrame) -> DataFrame:
    """Proofs of every row, those whose crc32 (of doc_id) 3 divides with a text in lower case: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    chosen = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(chosen & F.col("text").isNotNull(), leaf(lower_cased()))
    out = proved(docs, tampered, paths=False)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS BIGINT)), 4294967295)"
#: The same for DuckDB: trees by recursion over levels, then each leaf folded up level by level.
SQL = f"""
    WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS text, source, n_chars FROM documents),
         l AS (SELECT doc_id, lang, leaf, {_LEAF} AS other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
         t AS (SELECT lang, 0 AS level, pos, leaf AS node FROM l
               UNION ALL
               SELECT lang, level + 1, pos // {ARITY}, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM t) WHERE n > 1 GROUP BY lang, level, pos // {ARITY}),
         s AS (SELECT lang, max_by(node, level) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, max(level) AS height FROM t GROUP BY lang),
         u AS (SELECT 0 AS level, pos, subroot AS node FROM s
               UNION ALL
               SELECT level + 1, pos // {ARITY}, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY level, pos // {ARITY}),
         r AS (SELECT node AS root, level AS top FROM u ORDER BY level DESC LIMIT 1),
         a AS (SELECT s.lang, t.level, t.pos, t.node, s.subroot, s.height, s.pos AS tree FROM t JOIN s ON t.lang IS NOT DISTINCT FROM s.lang),
         g AS (SELECT lang, level, pos // {ARITY} AS above, list(node ORDER BY pos) AS run FROM a WHERE level < height GROUP BY ALL),
         h AS (SELECT level, pos // {ARITY} AS above, list(node ORDER BY pos) AS run FROM u, r WHERE level < top GROUP BY ALL),
         f AS (SELECT l.doc_id, l.lang, l.leaf, s.subroot, s.height, s.pos AS tree, l.pos AS place, 0 AS level, l.other AS node, '' AS proof FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang
               UNION ALL
               SELECT doc_id, lang, leaf, subroot, height, tree, above, level + 1, sha256(array_to_string(run[:k], '') || node || array_to_string(run[k + 2:], '')), proof || array_to_string(run[:k], '') || array_to_string(run[k + 2:], '')
               FROM (SELECT f.*, coalesce(g.above, h.above) AS above, coalesce(g.run, h.run) AS run, (CASE WHEN f.level = f.height THEN tree ELSE place END) % {ARITY} AS k
                     FROM f LEFT JOIN g ON f.level < f.height AND f.lang IS NOT DISTINCT FROM g.lang AND f.level = g.level AND f.place // {ARITY} = g.above
                            LEFT JOIN h ON f.level >= f.height AND f.level - f.height = h.level AND (CASE WHEN f.level = f.height THEN tree ELSE place END) // {ARITY} = h.above)
               WHERE run IS NOT NULL)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM f, r WHERE level = height + top"""
