"""SimHash near-duplicates, linked by pigeonring filtering.

A document's words (ASCII case folded) give shingles; a fingerprint bit is 1 if it is set in over half of the
shingles' XXH64 values (seed 42). Equal texts or fingerprints collapse first, so that copies cost nothing further.

`near_duplicates` links fingerprints of 64 bits that differ in at most max_diff of them. The bits are cut into
max_diff + EXACT segments: two fingerprints within max_diff agree in at least EXACT of these, so every choice of
EXACT segments is a key, and only fingerprints that share a key meet. EXACT grows with the number of fingerprints,
so that a key's members stay few on average.

`near_copies` links texts whose sets of shingles have a Jaccard similarity of SIMILARITY or more. Bits of such
fingerprints differ with a probability of arccos(2 s / (1 + s)) / pi at most; further bits of the same hash values are
cut into segments of a width that grows with the number of rows, so many of them that RECALL of the pairs at exactly
SIMILARITY agree in one (of more similar pairs, more). Texts that share a segment meet if their numbers of shingles
allow that similarity; 128 more bits are their fingerprint, with the radius that all but 2 in 1,000 of those pairs are
within. What passes is a candidate. Components of candidates are cut down to those that links of sets of shingles that are
as similar as that make.

Pairs that meet must pass the pigeonring: from some segment of the fingerprint on, the differences of each chain of
l consecutive segments (round the ring) sum to at most l * max_diff / segments. What remains gets the full Hamming
check. Members of a key yield a spanning forest of their links, never all pairs; connected components join these.

A key of more than BOUND members is cut into blocks that meet on their own first. Once components are known, the
blocks meet in pairs, but for the members of the key's largest component, whose links among each other can add nothing:
so the copies of one template, however many, are not paired with each other.

Defined results: a null or blank text has the fingerprint zero and no shingles, and such texts link like any others;
fewer words than a shingle: the whole sequence is the one shingle; a null doc_id is never the smallest unless its
whole component has none; rows that repeat doc_id and text share one verdict and one of them stays; an empty
table gives an empty result; columns besides doc_id and text don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import connected_components, parts_for
from gridloom.llm.shared import publish, text_of

#: Jaccard similarity of the sets of shingles, at least, of near copies.
SIMILARITY = 0.8
#: Share of the pairs at exactly that similarity that meet under a key.
RECALL = 0.98
#: Members that a key has on average, at most, as far as fingerprints are even.
BUCKET = 16
#: Members of a key that one task compares with each other.
BOUND = 8192
#: Members of a component of candidates that one task holds with their sets of shingles, and shingles of these, about.
GROUP_BOUND, GROUP_SHINGLES = 512, 1 << 22
#: Texts whose bits are held at once.
_TEXTS_AT_ONCE = 256
#: Bits of the fingerprint that near copies are held against each other by, as 64-bit words.
CHECK_WORDS = 2
#: Rows of whole keys that a task holds at once, about.
_ROWS_AT_ONCE = 1 << 17
_CHUNK = 1 << 13
_CHOICE_BITS = 16


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """A row per hash value: itself and other 64 bits of it for each further word (the finisher of splitmix64)."""
    if words == 1:
        return h[:, None]
    out = h[:, None] + np.array([w * 0x9E3779B97F4A7C15 & 2**64 - 1 for w in range(words)], np.uint64)
    out = (out ^ out >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ out >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    out[:, 0] = h
    return out


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 values of a text's shingles; none of a blank text."""
    parts = text.lower().split()  # bytes: only A-Z fold, only ASCII white space splits
    if not parts:
        return np.zeros(0, "<u8")
    joined = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts]) - 1
    firsts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(parts) - shingle + 1)].tolist()
    lasts = (ends[shingle - 1 :] if len(parts) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(firsts, lasts, strict=True)], "<u8")


def simhash(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The bits of a fingerprint of so many 64-bit words; the first is made of the hash values themselves."""
    ones = np.zeros(64 * words, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(_mixed(hashes[k : k + _CHUNK], words).view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # so many bits fit a byte
            ones += bits[at : at + 255].sum(0, dtype=np.uint8)
    return 2 * ones > len(hashes)


def _as_words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<i8")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The different XXH64 values of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle))


def _texts(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """A row per row of docs: doc_id, text_hash, node (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [_as_words(simhash(shingle_hashes(t.as_buffer().to_pybytes(), shingle)))[0] for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.int64())], names=["doc_id", "text_hash", "node"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint")


def key_plan(n_rows: int, similarity: float) -> tuple[int, int]:
    """Width and number of the segments that near copies among so many rows meet by."""
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = max(4, math.ceil(math.log2(max(1, n_rows) / BUCKET)))
    return width, math.ceil(math.log(1 - RECALL) / math.log(1 - same**width))


def check_radius(similarity: float) -> int:
    """Bits of the check words that all but 2 in 1,000 of the pairs at this similarity are within."""
    n, p = 64 * CHECK_WORDS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= 0.998:
            return k
    return n


def sketches(docs: DataFrame, shingle: int, width: int, n_keys: int) -> DataFrame:
    """A row per row of docs: doc_id, text_hash, node (a hash of its words as the shingles see them), size (shingles), w0, w1, keys."""
    n_words = CHECK_WORDS + -(-width * n_keys // 64)
    powers, numbers = 1 << np.arange(width, dtype=np.int64), np.arange(n_keys, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, _TEXTS_AT_ONCE) for x in batches for k in range(0, x.num_rows, _TEXTS_AT_ONCE)):
            texts = [t.as_buffer().to_pybytes() for t in b.column(2)]
            sets = [shingle_set(t, shingle) for t in texts]
            bits = np.array([simhash(s, n_words) for s in sets]).reshape(-1, 64 * n_words)
            checks = _as_words(bits[:, : 64 * CHECK_WORDS])
            segments = bits[:, 64 * CHECK_WORDS : 64 * CHECK_WORDS + width * n_keys].reshape(-1, n_keys, width) @ powers
            nodes = np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split())) for t in texts], np.uint64).view(np.int64)
            keys = pa.FixedSizeListArray.from_arrays(pa.array((segments << _CHOICE_BITS | numbers).ravel()), n_keys).cast(pa.list_(pa.int64()))
            columns = [b.column(0), b.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(checks[:, 0]), pa.array(checks[:, 1]), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "size", "w0", "w1", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint, size bigint, w0 bigint, w1 bigint, keys array<bigint>")


def _segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of each of n segments of 64 bits."""
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def exact_for(n_rows: int, max_diff: int) -> int:
    """Segments that a key holds, so that keys of so many fingerprints have BUCKET members or fewer on average; eight are enough for 10^13."""
    exact = 2
    while exact < 8 and n_rows > BUCKET << exact * (64 // (max_diff + exact)):
        exact += 1
    return exact


def _choice_keys(fp: Column, max_diff: int, exact: int) -> Column:
    """A key per choice of segments: the choice's number and a hash of their bits (the bits themselves, up to 48)."""
    keys = []
    for k, chosen in enumerate(combinations(_segments(max_diff + exact), exact)):
        key = F.lit(0).cast("bigint")
        for shift, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(F.shiftleft(key, _CHOICE_BITS).bitwiseOR(F.lit(k).cast("bigint")))
    return F.array(*keys)


def _own_key(differing: np.ndarray, keys: np.ndarray, n_segments: int, exact: int) -> np.ndarray:
    """Is this key the pair's own, the one of its first equal segments? The pair meets under others too."""
    equal = np.stack([(differing >> np.uint64(s)) & np.uint64((1 << w) - 1) == 0 for s, w in _segments(n_segments)])
    last = np.array([chosen[-1] for chosen in combinations(range(n_segments), exact)])
    choice = keys & ((1 << _CHOICE_BITS) - 1)
    return np.cumsum(equal, axis=0)[last[choice], np.arange(len(keys))] == exact


def pigeonring(differing: np.ndarray, max_diff: int, n_segments: int) -> np.ndarray:
    """Which of the XORed fingerprints (a row per word) have a chain, begun at some segment, within its budget at every length."""
    differing = np.atleast_2d(differing)
    cuts = _segments(n_segments // len(differing))
    parts = np.concatenate([np.stack([np.bitwise_count((word >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in cuts]) for word in differing])
    sums, open_chains, at = parts, parts <= max_diff // n_segments, np.arange(differing.shape[1])
    for length in range(2, n_segments + 1):
        some = open_chains.any(axis=0)
        parts, sums, open_chains, at = parts[:, some], sums[:, some], open_chains[:, some], at[some]
        sums = sums + np.roll(parts, 1 - length, axis=0)
        open_chains &= sums <= length * max_diff // n_segments
    passes = np.zeros(differing.shape[1], bool)
    passes[at[open_chains.any(axis=0)]] = True
    return passes


class Rule:
    """When members of a key are near each other."""

    def __init__(self, words: int, max_diff: int, n_segments: int, exact: int = 0, similarity: float = 0.0):
        self.words, self.max_diff, self.n_segments, self.exact, self.similarity = words, max_diff, n_segments, exact, similarity

    def passes(self, differing: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of the pairs (XORed words, their key) that are within the radius."""
        at = np.flatnonzero(pigeonring(differing, self.max_diff, self.n_segments))
        at = at[np.bitwise_count(differing[:, at]).sum(0) <= self.max_diff]
        return at[_own_key(differing[0, at], keys[at], self.n_segments, self.exact)] if self.exact else at


def _forest(keys: np.ndarray, sizes: np.ndarray, words: np.ndarray, nodes: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of links that join all near members of equal key; equal nodes are joined already. Rows are sorted by key and size."""
    _, group = np.unique(nodes, return_inverse=True)
    above = np.arange(group.max(initial=-1) + 1)
    parent = group

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    at, apart = np.arange(len(keys)), 0
    while True:
        apart += 1
        at = at[at + apart < len(keys)]
        at = at[(keys[at] == keys[at + apart]) & (sizes[at] >= rule.similarity * sizes[at + apart])]
        if not len(at):
            return
        a = at[parent[at] != parent[at + apart]]
        new = []
        for x in a[rule.passes(words[:, a] ^ words[:, a + apart], keys[a])].tolist():
            p, q = root(group[x]), root(group[x + apart])
            if p != q:
                above[max(p, q)] = min(p, q)
                new.append(x)
        if new:
            while not np.array_equal(above, flat := above[above]):
                above[:] = flat
            parent = above[group]
            yield np.array(new), np.array(new) + apart


def _whole_groups(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.Table]:
    """Rows sorted by their first two columns, at least so many at once, and no group of these cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < at_once:
            continue
        table = pa.Table.from_batches(held)
        first, second = (table.column(k).to_numpy() for k in (0, 1))
        last = np.flatnonzero((first != first[-1]) | (second != second[-1]))
        if len(last):
            yield table.slice(0, int(last[-1]) + 1)
            held = table.slice(int(last[-1]) + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _met(keyed: DataFrame, rule: Rule, known: str = "node") -> DataFrame:
    """Edges (u, v) among the members of each key and block of keyed: key, block, node, size, w0 ...; members of equal `known` are joined already."""
    columns = ["key", "block", "node", "size", *(f"w{k}" for k in range(rule.words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, _ROWS_AT_ONCE):
            key, block, nodes, sizes, *words, known = (c.to_numpy() for c in table.columns)
            place = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
            keys = place << _CHOICE_BITS | key & ((1 << _CHOICE_BITS) - 1)
            for left, right in _forest(keys, sizes, np.stack([w.view(np.uint64) for w in words]), known, rule):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[left]), pa.array(nodes[right])], names=["u", "v"])

    rows = keyed.select(*columns, F.col(known).alias("known")).repartition("key", "block").sortWithinPartitions("key", "block", "size", "node")
    return _distinct_pairs(rows.mapInArrow(run, "u bigint, v bigint"))


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _hot_keys(keyed: DataFrame, n_nodes: int, bound: int) -> DataFrame | None:
    """Keys of more than bound members, with their number; None if there are none."""
    if n_nodes <= bound:
        return None
    hot = publish(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > bound), "hot-keys")
    return None if hot.isEmpty() else hot


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1).cast("bigint")))


def _blocks(keyed: DataFrame, hot: DataFrame | None, bound: int) -> DataFrame:
    """keyed with block: members of a hot key are dealt to blocks of bound members or fewer, about."""
    if hot is None:
        return keyed.withColumn("block", F.lit(0).cast("bigint"))
    n = F.ceil(F.coalesce("members", F.lit(1)) / (bound // 2)).cast("bigint")
    return keyed.join(hot, "key", "left").withColumn("block", F.when(F.col("members").isNull(), F.lit(0)).otherwise(_block(n)).cast("bigint")).drop("members")


def _block_pairs(keyed: DataFrame, bound: int, shingles: int | None = None) -> DataFrame:
    """keyed (key, node, size, label ...) with block: blocks of members of all labels but the key's largest meet each other and those of the largest.

    A pair of blocks has about half of bound members, and if shingles is given, half of so many shingles (or a single longer text).
    """
    counts = publish(keyed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("mass")), "key-labels")
    largest = counts.groupBy("key").agg(F.max(F.struct("n", "label", "mass")).alias("top"), F.sum("n").alias("all"), F.sum("mass").alias("mass"))
    part = bound // 4
    least = lambda mass: mass / (shingles // 4) if shingles else F.lit(0.0)
    # no more blocks than members
    blocks = lambda n, mass: F.ceil(F.greatest(n / part, F.least(least(mass), n.cast("double")))).cast("bigint")
    top, rest = blocks(F.col("top.n"), F.col("top.mass")), blocks(F.col("all") - F.col("top.n"), F.col("mass") - F.col("top.mass"))
    sizes = largest.select("key", F.col("top.label").alias("top"), top.alias("tops"), rest.alias("others"))
    rows = keyed.join(publish(sizes.where("others > 0"), "key-blocks"), "key")
    is_top = F.col("label") == F.col("top")
    # a pair of blocks is named by its smaller and larger number; blocks of the largest label have the larger numbers
    mine = F.when(is_top, F.col("others") + _block(F.col("tops"))).otherwise(_block(F.col("others")))
    met = F.sequence(F.lit(0).cast("bigint"), F.when(is_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1)
    rows = rows.withColumn("mine", mine).withColumn("met", F.explode(met))
    name = F.least("mine", "met") * (F.col("others") + F.col("tops")) + F.greatest("mine", "met")
    return rows.withColumn("block", name).drop("mine", "met", "top", "tops", "others")


def _labels(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """node, label of every node: the smallest node that it is linked to."""
    roots = publish(connected_components(edges), "roots", n)
    return publish(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels", n)


def _candidates(nodes: DataFrame, keyed: DataFrame, rule: Rule, bound: int) -> tuple[DataFrame, DataFrame]:
    """(edges (u, v) that join all that meet and are near; the labels that they give). keyed: key, node, size, w0, ..."""
    n_nodes = nodes.count()
    n = parts_for(n_nodes)
    hot = _hot_keys(keyed, n_nodes, bound)
    edges = publish(_met(_blocks(keyed, hot, bound), rule), "met", n)
    labels = _labels(nodes, edges, n)
    if hot is None:
        return edges, labels
    members = keyed.join(hot.select("key"), "key", "left_semi").join(labels, "node")
    edges = publish(edges.unionByName(_met(_block_pairs(members, bound), rule, "label")), "met", n)
    return edges, _labels(nodes, edges, n)


def _shingle_sets(wanted: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """node, shingles of the wanted (node, least); only their texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_buffer().to_pybytes(), shingle).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    wanted = publish(wanted.select("node", F.col("least.doc_id").alias("doc_id_"), F.col("least.text_hash").alias("text_hash_")), "wanted")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    met = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.xxhash64("text") == F.col("text_hash_")))
    met = met.select("node", F.col("text").cast("binary").alias("text")).dropDuplicates(["node"])
    return publish(met.mapInArrow(run, "node bigint, shingles array<bigint>"), "shingles")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets of shingles have at least this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    total, common = F.size("a") + F.size("b"), F.size(F.array_intersect("a", "b"))
    return both.where(common >= similarity * (total - common)).select("u", "v")


def _joined(words: np.ndarray, sizes: np.ndarray, labels: np.ndarray, shingles: pa.ListArray, rule: Rule) -> Iterator[tuple[int, int]]:
    """Places of links whose sets of shingles are similar enough and that join all such members; equal labels are joined already."""
    _, root = np.unique(labels, return_inverse=True)
    names, ids = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
    ends = np.cumsum(sizes)
    starts, mine = ends - sizes, np.zeros(len(names), bool)
    for i in range(len(root) - 1):
        j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        j = j[(np.minimum(sizes[i], sizes[j]) >= rule.similarity * np.maximum(sizes[i], sizes[j]))]
        j = j[rule.passes(words[:, j] ^ words[:, i : i + 1], np.zeros(len(j), np.int64))]
        if not len(j):
            continue
        mine[ids[starts[i] : ends[i]]] = True
        hits = np.concatenate([[0], np.cumsum(mine[np.concatenate([ids[starts[k] : ends[k]] for k in j])])])
        upto = np.concatenate([[0], np.cumsum(sizes[j])])
        common = hits[upto[1:]] - hits[upto[:-1]]
        mine[ids[starts[i] : ends[i]]] = False
        j = j[common >= rule.similarity * (sizes[i] + sizes[j] - common)]
        others, first = np.unique(root[j], return_index=True)
        yield from ((i, int(k)) for k in j[first])
        root[np.isin(root, others)] = root[i]


def _linked(grouped: DataFrame, rule: Rule) -> DataFrame:
    """Edges (u, v) that hold and join all such members of each key and block of grouped: key, block, node, size, w0 ..., label, shingles."""
    columns = ["key", "block", "node", "size", "label", "shingles", *(f"w{k}" for k in range(rule.words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 1):
            table = table.combine_chunks()
            key, block, nodes, sizes, labels = (table.column(k).to_numpy() for k in range(5))
            words = np.stack([table.column(k).to_numpy().view(np.uint64) for k in range(6, 6 + rule.words)])
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                sets = table.column(5).chunk(0).slice(a, b - a)
                pairs = list(_joined(words[:, a:b], sizes[a:b], labels[a:b], sets, rule))
                yield pa.RecordBatch.from_arrays([pa.array([nodes[a + x[k]] for x in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    rows = grouped.select(*columns).repartition("key", "block").sortWithinPartitions("key", "block", "node")
    return _distinct_pairs(rows.mapInArrow(run, "u bigint, v bigint"))


def _verified(nodes: DataFrame, edges: DataFrame, loose: DataFrame, sets: DataFrame, rule: Rule, bound: int) -> DataFrame:
    """The labels that links of similar sets give: node, label.

    One candidate of each node is tried first. Where that doesn't join all of a component of candidates, its members meet
    again, with their sets: in one group if they are few, else those that share a key, blocks of these in pairs.
    """
    n = parts_for(nodes.count())
    good = publish(_alike(edges.groupBy("u").agg(F.min("v").alias("v")), sets, rule.similarity), "alike")
    labels = _labels(nodes, good, n)
    both = labels.join(loose.withColumnRenamed("label", "loose"), "node")
    parts = both.groupBy("loose").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("members")).where("a <> b")
    parts = publish(parts.select("loose", "members"), "open", n)
    if parts.isEmpty():
        return labels
    members = publish(both.join(parts, "loose").join(nodes.drop("least"), "node"), "open-members")
    own = F.when(F.col("members") <= bound, F.array("loose")).otherwise(F.transform("keys", lambda k: F.xxhash64(k, "loose")))
    keyed = members.select("node", "size", "label", *(f"w{k}" for k in range(rule.words)), F.explode(own).alias("key"))
    more = publish(_linked(_block_pairs(keyed, GROUP_BOUND, GROUP_SHINGLES).join(sets, "node"), rule), "linked")
    return _labels(nodes, good.unionByName(more), n)


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")


def _classes(rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with head, the place of the first row of their component."""
    n = parts_for(nodes.count())
    linked = publish(nodes.select("node", "least").join(labels, "node"), "linked", n)
    heads = publish(linked.groupBy("label").agg(F.min("least").alias("head")), "heads", n)
    classes = publish(linked.join(heads, "label").select("node", "head"), "classes", n)
    return rows.join(classes, "node")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_diff: int = 4, exact: int | None = None, bound: int = BOUND) -> DataFrame:
    """A row per row of docs: doc_id, text_hash, fingerprint (16 hex digits), component_id, first (of its component)."""
    rows = publish(fingerprints(docs, shingle), "fingerprints")
    nodes = publish(rows.groupBy("node").agg(F.min(_place()).alias("least")), "nodes")
    exact = exact or exact_for(nodes.count(), max_diff)
    keyed = nodes.select(F.explode(_choice_keys(F.col("node"), max_diff, exact)).alias("key"), "node", F.lit(1).cast("bigint").alias("size"), F.col("node").alias("w0"))
    _, labels = _candidates(nodes, keyed, Rule(1, max_diff, max_diff + exact, exact), bound)
    return _classes(rows, nodes, labels).select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), F.col("head.doc_id").alias("component_id"),
        (_place() == F.col("head")).alias("first"),
    )


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, bound: int = BOUND) -> DataFrame:
    """A row per row of docs: doc_id, text_hash, component_id, first (of its component); texts link by the similarity of their sets of shingles."""
    rows = publish(sketches(docs, shingle, *key_plan(docs.count(), similarity)), "sketches")
    nodes = publish(rows.groupBy("node").agg(F.min(_place()).alias("least"), F.min("size").alias("size"), F.min("w0").alias("w0"), F.min("w1").alias("w1"), F.min("keys").alias("keys")), "nodes")
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "size", "w0", "w1")
    rule = Rule(CHECK_WORDS, check_radius(similarity), 4 * CHECK_WORDS, similarity=similarity)
    edges, loose = _candidates(nodes, keyed, rule, bound)
    ends = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = _shingle_sets(nodes.join(ends, "node"), docs, shingle)
    labels = _verified(nodes, edges, loose, sets, rule, bound)
    return _classes(rows.select("doc_id", "text_hash", "node"), nodes, labels).select(
        "doc_id", "text_hash", F.col("head.doc_id").alias("component_id"), (_place() == F.col("head")).alias("first")
    )


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, bound: int = BOUND) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; the columns of docs."""
    copies = near_copies(docs, shingle, similarity, bound)
    copies = publish(copies.select(F.col("doc_id").alias("copy_id_"), F.col("text_hash").alias("copy_hash_"), "first"), "copies")
    kept = copies.where("first")
    repeated = kept.count() - kept.distinct().count()
    dropped = publish(copies.where("not first").drop("first").distinct(), "dropped").hint("shuffle_hash")
    text_hash = F.xxhash64(text_of(docs["text"]))
    out = docs.join(dropped, docs["doc_id"].cast("bigint").eqNullSafe(dropped["copy_id_"]) & (text_hash == dropped["copy_hash_"]), "left_anti")
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
