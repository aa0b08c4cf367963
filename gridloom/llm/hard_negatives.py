"""Hard-negative mining by a full sort of each anchor's scores.

Vectors become integers, floor(256 x), so scores are exact and ties are real. Anchors and rows are dealt to blocks, and
every block of anchors meets every block of rows (a stated query set against all rows). Where they meet, all scores
of an anchor are computed and sorted, higher scores first, ties by smaller id (`_order`). The first pass reads the
anchor's best rows of its own label. The second one searches in the sorted scores, by bisection, where each
positive's upper limit stands, and reads the first rows of other labels from there down to the lower limit. A
block gives a few rows for each anchor and positive, of which Spark's limited windows keep as many again.

A block holds at most BLOCK_VALUES numbers, whatever the length of vectors, so a task's memory doesn't grow with the
table, the number of rows of a label or the copies of a vector; each row travels once for each block of anchors and
each anchor once for each block of rows.

Defined results: rows with a null label, a null vector, or any null or non-finite component take no part; shorter
vectors count as filled up with zeros (an empty one scores 0); rows that agree in vec_id, label and vector are one; a row
that shares its anchor's vec_id is the anchor itself, so neither its positive nor its negative; a null vec_id is no
anchor, and in ties it comes last; scores beyond 64 bits are an error; no positives, or no rows within the limits: no rows
for that anchor or positive; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import publish

POSITIVES = 5
NEGATIVES = 5
#: A negative's score lies between LOWER / 100 and UPPER / 100 of the positive's.
LOWER, UPPER = 80, 100
SCALE = 256
#: Numbers that a block of vectors holds, about.
BLOCK_VALUES = 1 << 22
#: Blocks that rows are dealt to at the least, so that there is work for many tasks, and rows of a block at the least then.
_BLOCKS, _BLOCK_ROWS = 64, 512
#: Scores that are computed at once.
_AT_ONCE = 1 << 22
#: Stands for a null id, after all others.
_NO_ID = 2**63 - 1


def integer_vectors(rows: DataFrame, label: Column) -> DataFrame:
    """rows that take part: id, label, vector (floor of SCALE times each component, doubles)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = rows.where(label.isNotNull() & F.col("embedding").isNotNull() & ~bad)
    whole = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)
    floors = F.transform(x, lambda v: whole(v * SCALE))
    parts = [F.coalesce(F.col("vec_id").cast("bigint"), F.lit(_NO_ID)).alias("id"), label.cast("bigint").alias("label"), floors.alias("vector")]
    return good.select(*parts).distinct().withColumn("key", F.xxhash64("id", "label", "vector"))


def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of an anchor's scores, higher first, ties by smaller id."""
    return np.lexsort((ids, -scores))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """A row per vector, filled up with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first anchor, exact integer scores of some anchors against all rows)."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, anchors.shape[1])
    if most >= 2**53:  # beyond what doubles hold exactly
        anchors, rows = (np.array([[int(x) for x in v] for v in m], object).reshape(m.shape) for m in (anchors, rows))
    step = max(1, _AT_ONCE // max(1, len(rows)))
    for k in range(0, len(anchors), step):
        yield k, (anchors[k : k + step] @ rows.T).astype(np.int64)


def _meet(anchors: DataFrame, n_anchors: int, rows: DataFrame, n_rows: int, width: int, read: Callable, schema: str) -> DataFrame:
    """read(anchors, place, ids, labels, scores) for each anchor and block of rows; a row per result. n_anchors, n_rows: numbers of blocks."""
    # each anchor goes to every block of rows, each row to every block of anchors
    left = anchors.withColumnRenamed("block", "a").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    right = rows.withColumnRenamed("block", "r").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key: tuple, mine: pa.Table, others: pa.Table) -> pa.Table:
        mine, others = mine.combine_chunks(), others.combine_chunks()
        out: list[tuple] = []
        if mine.num_rows and others.num_rows:
            ids, labels = others.column("id").to_numpy(), others.column("label").to_numpy()
            vectors = [_matrix(t.column("vector").chunk(0), width) for t in (mine, others)]
            for first, scores in _scores(*vectors):
                for k, row in enumerate(scores, first):
                    out += read(mine, k, ids, labels, row)
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[] for _ in names])], names=names)

    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(run, schema)


def _anchor(anchors: pa.Table, k: int) -> tuple[int, int, int]:
    return tuple(anchors.column(c)[k].as_py() for c in ("key", "id", "label"))


def _positives(n: int):
    def read(anchors: pa.Table, k: int, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> list[tuple]:
        key, anchor, label = _anchor(anchors, k)
        order = _order(scores, ids)
        mine = order[(labels[order] == label) & (ids[order] != anchor)][:n]
        return [(key, anchor, int(ids[j]), int(scores[j])) for j in mine]

    return read


def _negatives(n: int, lower: int, upper: int):
    def read(anchors: pa.Table, k: int, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> list[tuple]:
        key, anchor, label = _anchor(anchors, k)
        order = _order(scores, ids)
        falling = -scores[order]
        out = []
        for p in anchors.column("positives")[k].as_py():
            most, least = upper * p["score"] // 100, -(-lower * p["score"] // 100)
            first, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
            at = order[first:end]
            at = at[(labels[at] != label) & (ids[at] != anchor)][:n]
            out += [(key, anchor, p["id"], p["score"], int(ids[j]), int(scores[j])) for j in at]
        return out

    return read


def _first(rows: DataFrame, by: list[str], score: str, tie: str, n: int) -> DataFrame:
    """The first n rows of each group, by score and id, numbered; each task keeps so many before rows are shuffled."""
    window = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def _blocked(df: DataFrame, n_rows: int, per_block: int, least: int) -> tuple[DataFrame, int]:
    """df with block, and the number of blocks."""
    n = max(-(-n_rows // per_block), min(least, -(-n_rows // _BLOCK_ROWS)), 1)
    return df.withColumn("block", F.pmod("key", F.lit(n)).cast("int")), n


def hard_negatives(
    rows: DataFrame, label: Column, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER, block_values: int = BLOCK_VALUES
) -> DataFrame:
    """A row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, embedding and what label needs; is_anchor: a condition on `id`. Rows of one id and different labels or
    vectors are anchors of their own, and their results stand side by side.
    """
    vectors = publish(integer_vectors(rows, label), "vectors")
    n_rows, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    chosen = publish(vectors.where(is_anchor & (F.col("id") != _NO_ID)), "anchors")
    per_block = max(1, block_values // max(1, width))
    dealt, n_dealt = _blocked(vectors, n_rows, per_block, _BLOCKS)
    anchors, n_anchors = _blocked(chosen, chosen.count(), per_block, 1)
    of_anchor = "key bigint, anchor bigint"
    best = _meet(anchors, n_anchors, dealt, n_dealt, width, _positives(positives), f"{of_anchor}, id bigint, score bigint")
    best = publish(_first(best, ["key", "anchor"], "score", "id", positives), "positives")
    own = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    found = _meet(anchors.join(own, "key"), n_anchors, dealt, n_dealt, width, _negatives(negatives, lower, upper), f"{of_anchor}, positive bigint, positive_score bigint, id bigint, score bigint")
    found = _first(found, ["key", "anchor", "positive", "positive_score"], "score", "id", negatives)
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return found.select(
        F.col("anchor").alias("anchor_id"), real("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), real("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def mining_report(embeddings: DataFrame) -> DataFrame:
    """Anchors are ids divisible by 100; the label of ids divisible by 7 is the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, label, F.col("id") % 100 == 0)


#: The same by a join of every anchor with all rows, for DuckDB.
SQL = f"""
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
         p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
         n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                      CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
               FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {LOWER} * p.score <= 100 * s.score AND 100 * s.score <= {UPPER} * p.score)
    SELECT * FROM n WHERE rank <= {NEGATIVES}"""
