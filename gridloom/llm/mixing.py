"""Mixing sources to target weights, with a multivariate-hypergeometric splitting tree over output shards.

Sizes are words. Sources in code point order (null last) weigh 5, 2, 1, repeating. The targets share the total
size by weight; a target stops at 3 times its source's size and the excess is shared by weight among the rest.

How large a source's quota is: whole passes over it, and one part of a further pass. Documents stand in the
order of a seeded hash (those larger than the whole part are left aside); that order is cut where the part ends, found by
descending a tree of hash prefixes (at most 4,096 sums a source and level, two levels, never a source's documents in one
task). What the cut leaves is filled, largest first, with untaken documents that still fit, one of a size, until none does.
If the smallest of the others then comes nearer to the target than nothing, it is taken too. Documents are always taken whole,
so a source misses its target by less than half of one document: by words where it has documents of many sizes, by much
where it has very few.

Where it goes: the first 8 bits of the hash name a source's blocks, so they are a random permutation of its
documents. The tree splits the sources' exact block quotas in two, again and again, drawing each half's
quotas from a multivariate hypergeometric distribution, until every output shard has its own; a shard then
takes disjoint runs of each source's blocks and is shuffled locally by another hash. A document is taken once for each
time that a shard draws its block, up to the cut in the last block.

Defined results: a null text has size 0; null is a source of its own, the last; rows that repeat source, doc_id and text
are numbered and each has a hash of its own (which of them is taken is open, as they can't be told apart by these); with
no words all targets are 0; an empty table gives an empty result; everything is a function of the rows and the seed, so
reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import publish, text_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SHARDS = 256
SEED = 20_260_101
#: Equal rows that are numbered in one task.
ROWS_PER_SALT = 10_000
#: A shard of more words than this is laid out in several parts, each shuffled on its own.
WORDS_PER_PART = 1 << 21
#: The cut is made of so many bits of the hash: less than 2**-24 of a source, or a document, stands beside it.
_LEVELS, _BITS = 2, 12
#: All but ASCII white space; as what it holds, which Java matches many times faster than what it doesn't.
_WORD = r"[\x00-\x08\x0E-\x1F\x21-\x{10FFFF}]+"
_CUT_BITS = _LEVELS * _BITS
_BLOCK_BITS = 8
_BLOCKS = 1 << _BLOCK_BITS


def _size() -> Column:
    return F.regexp_count(text_of(), F.lit(_WORD)).cast("bigint")


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), text_of())


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """sizes: source, size. A row per source: source, source_size, target."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    sources = sources.withColumn("weight", F.array(*(F.lit(w) for w in weights))[place % len(weights)])
    cap = MAX_REPEATS * F.col("source_size")
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    sources = sources.withColumn("ratio", cap / F.col("weight"))
    capped = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    sources = sources.withColumn("share", (total - capped) / rest)
    # rows before the first that fits are capped; from that one on the shares only fall
    share = F.max(F.when(F.col("share") <= F.col("ratio"), F.col("share"))).over(Window.partitionBy())
    return sources.select("source", "source_size", F.least(cap.cast("double"), share * F.col("weight")).alias("target"))


def _on_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("source", "source_r_")
    return left.join(right, left["source"].eqNullSafe(right["source_r_"]), how).drop("source_r_")


def _cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: passes, cut (of the first bits of the hash), fillers (hashes taken beyond the cut)."""
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS))).otherwise(0)
    plan = targets.withColumn("passes", whole.cast("bigint")).withColumn("need", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = publish(plan.withColumns({"cut": F.lit(0).cast("bigint"), "fit": F.col("need")}), "cuts", 1)
    for level in range(_LEVELS):
        prefix = F.lit(0).cast("bigint") if level == 0 else F.shiftrightunsigned("h", 64 - _BITS * level)
        digit = F.shiftrightunsigned("h", 64 - _BITS * (level + 1)).bitwiseAND(F.lit((1 << _BITS) - 1))
        open_rows = _on_source(rows, plan.select("source", "cut", "fit")).where((prefix == F.col("cut")) & (F.col("size") <= F.col("fit")))
        sums = open_rows.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("mass"))
        upto = F.sum("mass").over(Window.partitionBy("source").orderBy("digit"))
        sums = _on_source(sums.withColumn("upto", upto), plan.select("source", "need"))
        first = F.min(F.when(F.col("upto") > F.col("need"), F.struct("upto", "digit", "mass")))
        edges = sums.groupBy("source").agg(first.alias("edge"), F.max("upto").alias("all"))
        below = F.col("edge.upto") - F.col("edge.mass")
        everything = F.lit(1 << _BITS if level == 0 else 0)  # all that may be taken is less than what is needed
        plan = _on_source(plan, edges, "left").select(
            "source", "source_size", "target", "passes", "fit", (F.col("need") - F.coalesce(below, "all", F.lit(0))).alias("need"),
            (F.col("cut") * (1 << _BITS) + F.when(F.col("all").isNull(), F.lit(0)).otherwise(F.coalesce("edge.digit", everything))).alias("cut"),
        )
        plan = publish(plan, "cuts", 1)
    return publish(_filled(rows, plan), "cuts", 1)


def _filled(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with fillers. A source's untaken documents give one row for each size up to what is needed, and one for all above."""
    untaken = _on_source(rows, plan.select("source", "cut", "fit", "need")).where(~_below_cut() & (F.col("size") > 0))
    sizes = untaken.groupBy("source", F.least(F.col("size"), F.floor("need") + 1).alias("class")).agg(F.min(F.struct("size", "h")).alias("doc"))
    sizes = sizes.groupBy("source").agg(F.sort_array(F.collect_list("doc"), asc=False).alias("docs"))
    plan = _on_source(plan, sizes, "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<struct<size:bigint,h:bigint>>")))

    def step(acc: Column, doc: Column) -> Column:
        fits = doc["size"] <= acc["need"]
        return F.struct(
            F.when(fits, acc["need"] - doc["size"]).otherwise(acc["need"]).alias("need"),
            F.when(fits, F.array_append(acc["fillers"], doc["h"])).otherwise(acc["fillers"]).alias("fillers"),
        )

    start = F.struct(F.col("need").alias("need"), F.array().cast("array<bigint>").alias("fillers"))
    plan = plan.withColumn("filled", F.aggregate("docs", start, step))
    left, fillers = F.col("filled.need"), F.col("filled.fillers")
    over = F.array_min(F.filter("docs", lambda d: (d["size"] > left) & ~F.array_contains(fillers, d["h"])))
    nearer = over.isNotNull() & (over["size"] - left < left)
    return plan.select("source", "source_size", "target", "passes", "fit", "cut", F.when(nearer, F.array_append(fillers, over["h"])).otherwise(fillers).alias("fillers"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """quotas: blocks per source. Blocks per (source, shard): rows sum to quotas, columns differ by one at most."""
    if shards == 1:
        return quotas[:, None]
    rng = np.random.default_rng([seed, shards])
    total, left = int(quotas.sum()), shards // 2
    share = total * left // shards
    mine = rng.multivariate_hypergeometric(quotas, share, method="marginals") if total else quotas
    return np.concatenate([split_quotas(mine, left, 2 * seed), split_quotas(quotas - mine, shards - left, 2 * seed + 1)], axis=1)


def _cut_block() -> Column:
    return F.least(F.shiftrightunsigned("cut", _CUT_BITS - _BLOCK_BITS), F.lit(_BLOCKS - 1))


def _with_shards(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """plan with bounds: the running sum, over shards, of the source's block quotas."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last").reset_index(drop=True)
        quotas = split_quotas(pdf["blocks"].to_numpy(np.int64), shards, seed)
        return pd.DataFrame({"source": pdf["source"], "bounds": list(np.cumsum(quotas, axis=1))})

    blocks = F.col("passes") * _BLOCKS + _cut_block() + 1
    counted = plan.select("source", blocks.alias("blocks"))  # one row per source
    bounds = counted.groupBy(F.lit(0).alias("tree")).applyInPandas(run, "source string, bounds array<bigint>")
    total = F.sum("source_size").over(Window.partitionBy())
    parts = F.greatest(F.lit(1), F.ceil(total / (shards * WORDS_PER_PART)))
    return publish(_on_source(plan, bounds).withColumn("parts", parts.cast("bigint")), "mix-plan", 1)


def _repeated(rows: DataFrame) -> DataFrame | None:
    """source, h and number of rows that agree in both, None if there are none."""
    counts = rows.groupBy(F.col("source").alias("source_r_"), F.col("h").alias("h_r_")).agg(F.count(F.lit(1)).alias("n_"))
    repeated = publish(counts.where("n_ > 1"), "repeated")
    return None if repeated.isEmpty() else repeated


def _numbered(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """rows (source, h and more) with another h for each further one of those that agree in both.

    Repeated rows are dealt to salts of ROWS_PER_SALT rows, numbered within these, and the salts' counts (a row per salt) offset the numbers.
    """
    if repeated is None:
        return rows
    on = rows["source"].eqNullSafe(F.col("source_r_")) & (rows["h"] == F.col("h_r_"))
    salt = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("n_") / ROWS_PER_SALT))
    dealt = publish(rows.join(repeated, on).drop("source_r_", "h_r_").withColumn("salt_", salt), "repeated-rows")
    counts = dealt.groupBy(F.col("source").alias("source_r_"), F.col("h").alias("h_r_"), F.col("salt_").alias("salt_r_")).agg(F.count(F.lit(1)).alias("in_salt_"))
    before = F.sum("in_salt_").over(Window.partitionBy("source_r_", "h_r_").orderBy("salt_r_")) - F.col("in_salt_")
    offsets = publish(counts.withColumn("before_", before).drop("in_salt_"), "offsets")
    within = F.row_number().over(Window.partitionBy("source", "h", "salt_").orderBy(F.lit(0))) - 1
    same = F.col("source").eqNullSafe(F.col("source_r_")) & (F.col("h") == F.col("h_r_")) & (F.col("salt_") == F.col("salt_r_"))
    dealt = dealt.withColumn("within_", within).join(offsets, same)
    number = F.col("within_") + F.col("before_")
    dealt = dealt.withColumn("h", F.when(number == 0, F.col("h")).otherwise(F.xxhash64("h", number))).select(*rows.columns)
    return rows.join(repeated, on, "left_anti").unionByName(dealt)


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _hash(seed).alias("h"))


def _below_cut() -> Column:
    return (F.shiftrightunsigned("h", 64 - _CUT_BITS) < F.col("cut")) & (F.col("size") <= F.col("fit"))


def _unit(turn: Column) -> Column:
    """The number of a document's block in pass `turn` among all that the shards draw of its source."""
    block = F.least(F.shiftrightunsigned("h", 64 - _BLOCK_BITS), F.when(turn == F.col("passes"), _cut_block()).otherwise(_BLOCKS))
    return turn * _BLOCKS + block


def _turns() -> Column:
    """The passes in which a shard draws the document's block and, in the last one, the document stands before the cut or fills up."""
    drawn = F.element_at("bounds", -1)
    extra = _below_cut() | F.array_contains("fillers", F.col("h"))
    passes = F.sequence(F.lit(0).cast("bigint"), F.col("passes"))
    return F.filter(passes, lambda t: (_unit(t) < drawn) & ((t < F.col("passes")) | extra))


def _shard(turn: Column) -> Column:
    """The shard that draws a document's block in pass `turn`."""
    return F.size(F.filter("bounds", lambda b: b <= _unit(turn)))


def mix_plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows with doc_id, source, size, h; the plan of each source; the repeated rows)."""
    rows = publish(_sized(docs, seed), "sizes")
    repeated = _repeated(rows)
    rows = rows if repeated is None else publish(_numbered(rows, repeated), "sizes")
    return rows, _with_shards(_cuts(rows, source_targets(rows)), shards, seed), repeated


def mix_report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, copies, shard (of its first copy)."""
    rows, plan, _ = mix_plan(docs, shards, seed)
    joined = _on_source(rows, plan).withColumn("turns", _turns()).withColumn("copies", F.size("turns"))
    first = F.when(F.col("copies") > 0, _shard(F.get("turns", F.lit(0))))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("bigint").alias("copies"), first.alias("shard"))


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: a row per copy, whole texts, shard by shard, each shard shuffled; the columns of docs."""
    _, plan, repeated = mix_plan(docs, shards, seed)
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source").cast("string").alias("source"), _hash(seed).alias("h"), _size().alias("size"))
    copies = _on_source(_numbered(keyed, repeated), plan).withColumn("turn", F.explode(_turns()))
    copies = copies.select("doc", _shard(F.col("turn")).alias("shard"), F.xxhash64(F.lit(seed + 1), "h", "turn").alias("order"), "parts")
    copies = copies.withColumn("part", F.pmod("order", "parts"))
    return copies.repartition("shard", "part").sortWithinPartitions("shard", "part", "order").select("doc.*")
