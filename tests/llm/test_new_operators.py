"""Byte-pair encoding, the Merkle manifest and hard negatives, against the library or brute force."""

from __future__ import annotations

import base64
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridloom.llm import byte_pairs, hard_negatives, merkle
from tests.llm import cases

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def rows(spark):
    return cases.awkward_rows() + cases.driver_rows(spark)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def ids_of(library, text) -> bytes:
    return np.array(library.encode_ordinary(text or ""), "<u4").tobytes()


def test_byte_pairs(library, rows, docs, empty):
    want = Counter((r[0], len(x := ids_of(library, r[1])) // 4, sha256(x).hexdigest(), sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter(map(tuple, byte_pairs.byte_pair_report(docs, RANKS).collect())) == want
    assert byte_pairs.byte_pair_report(empty, RANKS).count() == 0


def test_byte_pairs_round_trip(library, rows, docs):
    encoded = byte_pairs.encoded(docs, RANKS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((r[0], tuple(library.encode_ordinary(r[1] or ""))) for r in rows)
    back = byte_pairs.decoded(encoded, RANKS)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == Counter((r[0], (r[1] or "").encode()) for r in rows)


def test_words_of_all_scripts(library, monkeypatch):
    """Random texts of every kind of character, and each code point beside letters and digits, in small slices and few rounds."""
    monkeypatch.setattr(byte_pairs, "SLICE", 300)
    monkeypatch.setattr(byte_pairs, "BYTES", 100)
    monkeypatch.setattr(byte_pairs, "ROWS", 300)
    monkeypatch.setattr(byte_pairs, "TOKENS", 50)
    monkeypatch.setattr(byte_pairs, "MEMORY", 500)
    rng = random.Random(1)
    letters = "a b'sstredvlm\n\t 1½é–!?'’中 \x1c\x0b 　👍xX  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["", "'s", "it's we'll they're I'd 'sx 'Ss ''s", "   ", "\n\n a", "x" * 300, "ab" * 100, " ".join("".join(rng.choice("abcdefg é") for _ in range(9)) for _ in range(200))]
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 37 == 0)]
    texts += ["".join(f"a{c}1 {c}{c}" for c in some[k : k + 100]) for k in range(0, len(some), 100)]
    vocabulary = byte_pairs.BytePairs(RANKS)
    got = [[b"", b""] for _ in texts]
    for part in vocabulary.encode(texts):
        for k, ids, decoded in part:
            got[k][0] += ids
            got[k][1] += decoded
    assert [(a, b) for a, b in got] == [(ids_of(library, t), t.encode()) for t in texts]
    with pytest.raises(ValueError, match="vocabulary"):
        vocabulary.decode_ids([np.array([60_000], "<i4").tobytes()])


def digest(*parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def climb(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels: list[list[str]], k: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for nodes in levels[:-1]:
        a = k - k % 8
        out.append((nodes[a:k], nodes[k + 1 : a + 8]))
        k //= 8
    return out


def plain_manifest(rows) -> Counter:
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*map(shown, (r[0], r[3], r[2], r[4], r[1])))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in order])
    out: Counter = Counter()
    for n, g in enumerate(order):
        for k, r in enumerate(groups[g]):
            path = path_of(trees[g], k) + path_of(top, n)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            node = leaf((r[0], r[1].translate(lower), *r[2:])) if tampered else leaf(r)
            for left, right in path:
                node = digest(*left, node, *right)
            out[r[0], leaf(r), trees[g][-1][0], top[-1][0], digest(*(x for a, b in path for x in a + b)), node, node == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("levels", [2])
def test_merkle_manifest(spark, rows, empty, monkeypatch, levels):
    """In blocks of 64 leaves, so that upper proofs have several levels."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    mixed = [(*r[:2], None if k % 11 == 0 else "xy" if k % 13 == 0 else r[2], *r[3:]) for k, r in enumerate(rows)] + [(1, "one of its kind", "zz", None, None, *[None] * 6)]
    docs = spark.createDataFrame(mixed, cases.SCHEMA).repartition(3)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, merkle.manifest_report(docs).select(*columns).collect())) == plain_manifest(mixed)
    assert merkle.manifest_report(empty).count() == 0


def test_a_proof_proves_its_row_only(spark, docs):
    manifest = merkle.proved(docs)
    back = manifest.select("root", merkle.folded(F.col("leaf"), F.col("path"), F.col("places"), F.col("runs")).alias("mine"), merkle.folded(F.sha2("leaf", 256), F.col("path"), F.col("places"), F.col("runs")).alias("other"))
    assert back.where("mine <> root or other = root").count() == 0 and back.count() == docs.count()
    assert manifest.where(F.sha2("path", 256) != F.col("proof_sha256")).count() == 0


@pytest.mark.parametrize(("n", "band"), [(1, 2), (7, 1), (8, 2), (9, 2), (64, 1), (65, 2), (513, 2), (600, 3), (4096, 2), (4000, 1)])
def test_fractal_traversal_keeps_few_digests(n, band):
    """The paths are those of the whole tree; a band holds no more than its existing and its desired subtree."""
    leaves = [digest(str(k)) for k in range(n)]
    levels = climb(leaves)
    height = len(levels) - 1
    tree = merkle.Fractal(leaves, height, band)
    for k, path in enumerate(tree):
        assert [(run[:p], run[p + 1 :]) for run, p in path] == path_of(levels, k) and merkle.fold(leaves[k], path) == levels[-1][0]
        for b in tree.bands:
            held = sum(map(len, b.existing.levels)) + sum(map(len, b.desired.levels)) + sum(map(len, b.climb.open))
            assert held <= 2 * sum(8**j for j in range(b.height + 1)) + 8 * b.low
    assert merkle.block_root(leaves, height) == levels[-1][0]


def plain_negatives(rows) -> Counter:
    good = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(256 * float(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out: Counter = Counter()
    for a, x, label in good:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, y, other in good if i != a)  # noqa: B905
        for score, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score][:5]
            out.update((a, p, rank, i, -score, -s) for rank, (s, i, _) in enumerate(fits, 1))
    return out


@pytest.mark.parametrize("block", [400])
def test_hard_negatives(spark, monkeypatch, block):
    """Ties, copies of one vector, negative scores, odd lengths, huge components, in many small blocks."""
    monkeypatch.setattr(hard_negatives, "_BLOCK_ROWS", 16)
    rng = random.Random(3)
    rows = [(k, [rng.choice([-0.5, 0.1, 0.25, 0.3, 0.9]) for _ in range(4)], rng.randrange(3)) for k in range(400)]
    rows += [(k, [0.5, 0.5, 0.5, 0.5], k % 4) for k in range(1000, 1120)]  # copies
    rows += [(700, [-0.1] * 4, 1), (701, None, 1), (702, [0.1, None, 0.2, 0.3], 1), (703, [float("nan")] * 4, 1), (704, [float("inf")] * 4, 1), (705, [0.3] * 4, None), (800, [0.9, 0.2], 2), (801, [], 2)]
    rows += [(900, [3e6, 1.0, 0.0, 0.0], 5), (901, [2e6 + 1 / 256, 5.0, 0.0, 0.0], 5), (902, [2e6, 5.0, 0.0, 0.0], 6)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(frame, label, F.col("id") % 100 == 0, block_values=block)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows)
    assert hard_negatives.mining_report(frame.where("false")).count() == 0 and hard_negatives.mining_report(frame.where("vec_id = 701")).count() == 0


def test_hard_negatives_of_repeated_rows(spark):
    """Equal rows are one; a row of the anchor's id is neither positive nor negative; a null id comes last."""
    rows = [(0, [1.0], 1)] * 2 + [(0, [1.0], 2), (3, [1.0], 1), (None, [1.0], 1), (5, [0.9], 2), (None, [0.9], 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id) for r in hard_negatives.hard_negatives(frame, F.col("label"), F.col("id") % 100 == 0).collect()}
    assert {x for x in got if x[1] in (3, None)} >= {(0, 3, 1, 5), (0, 3, 2, None), (0, None, 1, 5), (0, None, 2, None)}
    assert all(n != 0 and p != 0 for _, p, _, n in got)
