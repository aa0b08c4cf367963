"""Toxicity scores from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Fit: at most MAX_EXAMPLES labelled rows of either class (the smallest by a hash) are the examples, near copies
of an earlier one left out; the class totals over all labels weigh their votes. Terms are lower-cased words and
4- and 5-letter word beginnings, each with levels of its count and of its share of the text's words. The vocabulary is
a choice among the examples' terms: all that occur in more toxic than clean examples by a clear ratio and with enough
evidence. (Cosine over all terms finds texts on the same subject, toxic or not; the README has its figures.) Document
frequencies for the idf weights are counted over all documents. The examples are bounded by the parameter, and by these
the vocabulary, so the index has a proven size and goes to every task.

Score: a document's vector is compared with the examples in blocks of BLOCK. A block's bound is the sum, over the
document's terms, of weight times the block's largest weight; blocks are visited from the highest bound down and
the search ends when no bound exceeds the K-th best cosine, so the K nearest are exact. Each votes for its label
with weight 1 / (1.05 - cosine); the toxic share, smoothed by the share of toxic among all labels, is the score,
and the neighbours are the evidence. A text with no term of the vocabulary has a cosine of 0 with every example; its
score is the share of toxic among the examples that have none either.

Defined results: a null text is the empty text; labels that are null, or of documents that don't exist, are
ignored, repeated labels of a document count once (the larger); without any usable label every score is 0; rows
are scored independently, so null doc_ids, ties and repeated rows don't matter; columns of other names don't either.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import publish, text_of

MAX_EXAMPLES = 4096
MIN_EXAMPLES_OF_TERM = 3
#: Log-likelihood ratio of a term's class counts, at least: about one in 10^5 by chance.
MIN_EVIDENCE = 20.0
#: Counts that a term has features for.
LEVELS = 4
#: Shares of a text's words that a term has features for, if it occurs twice or more.
RATES = (0.005, 0.01, 0.02, 0.04)
#: Times that a term's share of toxic examples exceeds its share of clean ones, at least.
MIN_RATIO = 6.0
BLOCK, K = 64, 15
PRIOR_VOTES = 0.5
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


#: Words whose terms a worker remembers; beyond it the memory is emptied and filled anew.
MEMORY = 1 << 18


def _terms_of(word: str) -> tuple[str, ...]:
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 5 else (word,)


def term_counts(text: str, vocabulary: dict[str, int] | None = None, bases: frozenset[str] | None = None, memory: dict[str, tuple[str, ...]] | None = None) -> Counter:
    """Terms of a text and how often each occurs; only those of the vocabulary (built on bases), if one is given.

    A term that occurs n times also counts as term+ (n - 1 times), term++ (n - 2) and so on, LEVELS in all, so that a
    vector tells a single occurrence from many although its length is 1; and as term%, term%% ... for each of the RATES
    that its share of the words reaches, so that it tells a short text with a few from a long one.
    """
    out: Counter = Counter()
    words = _WORD.findall(text.lower())
    memory = {} if memory is None else memory
    for word, n in Counter(words).items():
        terms = memory.get(word)
        if terms is None:
            if len(memory) >= MEMORY:
                memory.clear()
            terms = memory[word] = tuple(t for t in _terms_of(word) if bases is None or t in bases)
        for term in terms:
            out[term] += n
    for term, n in list(out.items()):
        for k in range(1, min(n, LEVELS)):
            out[term + "+" * k] = n - k
        if n > 1:
            for k, rate in enumerate(RATES, 1):
                if n >= rate * len(words):
                    out[term + "%" * k] = 1
    return out if vocabulary is None else Counter({t: n for t, n in out.items() if t in vocabulary})


def base_terms(vocabulary: dict[str, int]) -> frozenset[str]:
    return frozenset(t.rstrip("+%") for t in vocabulary)


def signatures(text: str) -> list[int]:
    """Four min-hashes of a text's 3-word shingles; near copies share one almost always, other texts hardly ever."""
    words = _WORD.findall(text.lower())
    shingles = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
    return [min(xxhash.xxh32_intdigest(s, seed) for s in shingles) for seed in range(4)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Index:
    """Example vectors as blocks of postings, with each block's largest weight per term."""

    vocabulary: dict[str, int]
    bases: frozenset[str]
    idf: np.ndarray
    bounds: np.ndarray  # terms x blocks
    blocks: list[dict[int, tuple[np.ndarray, np.ndarray]]]  # term -> (places in the block, weights)
    toxic: np.ndarray
    votes: np.ndarray
    ids: np.ndarray
    prior: float
    empty_score: float
    memory: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = term_counts(text, self.vocabulary, self.bases, self.memory)
        terms = np.array([self.vocabulary[t] for t in counts], np.int64)
        weights = np.array([1 + math.log(n) for n in counts.values()]) * self.idf[terms] if len(terms) else np.zeros(0)
        return terms, weights / (np.linalg.norm(weights) or 1.0)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K) -> list[tuple[float, int]]:
        """(cosine, example's number) of the k nearest with a term in common, ties by number."""
        limits = weights @ self.bounds[terms]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-limits, kind="stable").tolist():
            if limits[b] <= 0 or len(best) >= k and limits[b] < best[k - 1][0] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                if t in self.blocks[b]:
                    places, values = self.blocks[b][t]
                    scores[places] += w * values
            some = [(round(float(scores[p]), 12), b * BLOCK + int(p)) for p in np.flatnonzero(scores)]
            best = sorted(best + some, key=lambda x: (-x[0], x[1]))[:k]
        return best

    def score(self, text: str) -> tuple[float, list[int]]:
        terms, weights = self.vector(text)
        near = self.nearest(terms, weights) if len(terms) else []
        if not near:
            return self.empty_score, []
        at = np.array([n for _, n in near])
        votes = self.votes[at] / (1.05 - np.minimum(1.0, [s for s, _ in near]))
        scale = PRIOR_VOTES / (votes.sum() + PRIOR_VOTES)
        share = float((votes * self.toxic[at]).sum() / votes.sum())
        return (1 - scale) * share + scale * self.prior, self.ids[at].tolist()


def build_index(vocabulary: list[str], df: np.ndarray, n_docs: int, examples: list[tuple[int, int, dict[str, int]]], class_votes: tuple[float, float], prior: float) -> Index:
    """examples: (doc_id, label, term counts within the vocabulary)."""
    number = {t: k for k, t in enumerate(vocabulary)}
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    index = Index(number, base_terms(number), idf, np.zeros((len(vocabulary), 0)), [], np.zeros(0), np.zeros(0), np.zeros(0, np.int64), prior, 0.0)
    vectors, empty = [], [0.0, 0.0]
    for doc_id, label, counts in examples:
        if not counts:
            empty[label] += class_votes[label]
            continue
        terms = np.array(sorted(number[t] for t in counts))
        weights = np.array([1 + math.log(counts[vocabulary[t]]) for t in terms]) * idf[terms]
        weights /= np.linalg.norm(weights)
        vectors.append((int(terms[weights.argmax()]), doc_id, label, terms, weights))
    vectors.sort(key=lambda v: v[:3])  # examples of one main term share blocks, which keeps the bounds tight
    n_blocks = -(-len(vectors) // BLOCK)
    index.bounds = np.zeros((len(vocabulary), n_blocks))
    index.blocks = [{} for _ in range(n_blocks)]
    postings: dict[tuple[int, int], list] = {}
    for k, (_, _, _, terms, weights) in enumerate(vectors):
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            postings.setdefault((k // BLOCK, t), []).append((k % BLOCK, w))
    for (b, t), entries in postings.items():
        places, values = np.array([p for p, _ in entries]), np.array([w for _, w in entries])
        index.blocks[b][t] = places, values
        index.bounds[t, b] = values.max()
    index.toxic = np.array([v[2] for v in vectors], float)
    index.votes = np.array([class_votes[v[2]] for v in vectors])
    index.ids = np.array([v[1] for v in vectors], np.int64)
    index.empty_score = empty[1] / sum(empty) if sum(empty) else prior
    return index


def _examples(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most limit rows a class; the number of labels of each class."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = publish(chosen, "examples")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # 2 * limit rows at most
    texts = publish(texts, "example-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signatures(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "signatures"])

    seen: set[tuple[int, int]] = set()
    fresh = []
    rows = texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, signatures array<bigint>").collect()
    for row in sorted(rows, key=lambda r: r["doc_id"]):
        marks = set(enumerate(row["signatures"]))
        if not marks & seen:
            fresh.append((row["doc_id"],))
        seen |= marks
    kept = docs.sparkSession.createDataFrame(fresh, "doc_id bigint")
    return publish(texts.join(F.broadcast(kept), "doc_id"), "fresh-examples"), totals


def _vocabulary(examples: DataFrame) -> list[str]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[label].update(term_counts(text).keys())
                if len(seen[label]) > 1 << 16:
                    yield counted(label, seen[label])
                    seen[label].clear()
        for label in (0, 1):
            yield counted(label, seen[label])

    def counted(label: int, seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([label] * len(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "label", "n"])

    counts = examples.repartition(64, "doc_id").select("label", "text").mapInArrow(run, "term string, label int, n bigint")
    counts = counts.groupBy("term").agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (0, 1)))
    sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}  # two rows at most
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    toxic, clean = (F.col("n1") + 0.5) / (n_toxic + 1), (F.col("n0") + 0.5) / (n_clean + 1)
    expected = (F.col("n0") + F.col("n1")) / max(1, n_toxic + n_clean)
    part = lambda n, size: F.when(n > 0, n * F.log(n / (expected * size))).otherwise(0.0)
    evidence = F.round(2 * (part(F.col("n1"), n_toxic) + part(F.col("n0"), n_clean)), 6)
    useful = counts.where((F.col("n1") >= MIN_EXAMPLES_OF_TERM) & (toxic >= MIN_RATIO * clean)).withColumn("evidence", evidence).where(F.col("evidence") >= MIN_EVIDENCE)
    return [r["term"] for r in useful.orderBy(F.col("evidence").desc(), "term").select("term").collect()]  # terms of the bounded examples


def _frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many documents there are."""
    number = {t: k for k, t in enumerate(vocabulary)}
    shared = docs.sparkSession.sparkContext.broadcast((number, base_terms(number)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n_docs, memory = Counter(), 0, {}
        for b in batches:
            n_docs += b.num_rows
            for text in b.column(0).to_pylist():
                seen.update(term_counts(text, *shared.value, memory).keys())
        terms = [shared.value[0][t] for t in seen]
        yield pa.RecordBatch.from_arrays([pa.array([*terms, -1], pa.int32()), pa.array([*seen.values(), n_docs], pa.int64())], names=["term", "n"])

    counted = docs.select(text_of().alias("text")).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    df, n_docs = np.zeros(len(vocabulary)), 0
    for r in counted.collect():  # a row per term of the vocabulary
        if r["term"] < 0:
            n_docs = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, n_docs


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    examples, totals = _examples(docs, labels, max_examples)
    vocabulary = _vocabulary(examples)
    df, n_docs = _frequencies(docs, vocabulary)
    number = {t: k for k, t in enumerate(vocabulary)}
    shared = docs.sparkSession.sparkContext.broadcast((number, base_terms(number)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [term_counts(t, *shared.value) for t in b.column(2).to_pylist()]
            columns = [pa.array([[f(c, t) for t in c] for c in counts], kind) for f, kind in ((lambda c, t: shared.value[0][t], pa.list_(pa.int32())), (lambda c, t: c[t], pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "label", "terms", "counts"])

    rows = examples.select("doc_id", "label", "text").mapInArrow(run, "doc_id bigint, label int, terms array<int>, counts array<bigint>").collect()  # 2 * max_examples rows at most
    sampled = Counter(r["label"] for r in rows)
    votes = tuple(totals.get(k, 0) / sampled[k] if sampled[k] else 0.0 for k in (0, 1))
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    found = [(r["doc_id"], r["label"], {vocabulary[t]: n for t, n in zip(r["terms"], r["counts"], strict=True)}) for r in rows]
    return build_index(vocabulary, df, n_docs, found, votes, prior)


def score_documents(docs: DataFrame, index: Index) -> DataFrame:
    """A row per row of docs: doc_id, score, neighbours (doc_ids of the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scored = [shared.value.score(t) for t in b.column(1).to_pylist()]
            columns = [pa.array([s for s, _ in scored], pa.float64()), pa.array([n for _, n in scored], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "score", "neighbours"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, neighbours array<bigint>")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.array_join("neighbours", ",").alias("neighbours"),
    )
