"""Line de-duplication by a distributed suffix array over line IDs, in DataFrame functions only.

The lines with a word are the corpus's symbols. Prefix doubling ranks the suffixes: rank k orders them by
their first 2**k lines, rank k + 1 comes from sorting the pairs (rank k here, rank k 2**k lines further on).
A run counts when it has MIN_WORDS words or more; as a longer common prefix is the union of such runs, suffixes are cut to
the shortest run that has so many, and doubling stops at its length, six levels at most whatever the documents' lengths.
Only lines that occur twice take part, and at each level only what is still shared.

The suffix array is these suffixes in order of their ranks, equal ones by place, sorted in ranges; the longest common prefix of
neighbours follows from the ranks in which they agree. Neighbours that share a whole run are an interval of copies, and the
first of each, by (doc_id, line), stays; overlapping later copies merge into maximal runs and are deleted, blank lines within
them too.

Defined results: a null text has no lines; a null doc_id comes after all others; rows that repeat doc_id and
text are one document and share its outcome; a run that overlaps its own earlier copy leaves the first period;
an empty table gives an empty result; columns besides doc_id and text don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import SPACES, publish, text_of, with_text

#: Words that a repeated run has at least.
MIN_WORDS = 50
_DOC = ["doc_id", "text_hash"]


def _n_words(line: Column) -> Column:
    """Words of a string that has one."""
    return F.size(F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), SPACES))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line with a word: doc_id, text_hash, seq (its place among these), line_no, words, a, b (its ID)."""
    numbered = F.transform(F.split(text_of(), "\n"), lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    lines = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"),
        F.posexplode(F.filter(numbered, lambda x: _has_word(x["line"]))).alias("seq", "x"),
    )
    return lines.select(
        *_DOC, "seq", F.col("x.no").alias("line_no"), _n_words(F.col("x.line")).cast("bigint").alias("words"),
        F.xxhash64("x.line").alias("a"), F.xxhash64(F.lit(1), "x.line").alias("b"),
    )


def _place(seq: str = "seq") -> Column:
    """Orders lines by document, null last, and place."""
    return F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"), F.col(seq))


def _ranks(rows: DataFrame, key: list[str], rank: str) -> DataFrame:
    """The values of key that occur twice or more, with a number that increases in their order."""
    shared = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select(*key)
    return publish(shared.orderBy(*key).withColumn(rank, F.monotonically_increasing_id()), rank)


def _runs(shared: DataFrame, min_words: int) -> DataFrame:
    """shared with island (consecutive lines) and n, last_line: the shortest run from here that has min_words."""
    by_doc = Window.partitionBy(*_DOC).orderBy("seq")
    rows = shared.dropDuplicates([*_DOC, "seq"])  # of rows that repeat doc_id and text, before a document's lines meet in one window
    rows = rows.withColumn("island", F.col("seq") - F.row_number().over(by_doc))
    rows = rows.withColumn("before", F.sum("words").over(by_doc) - F.col("words"))
    ahead = Window.partitionBy(*_DOC, "island").orderBy("before").rangeBetween(0, min_words - 1)
    rows = rows.withColumns({"end_": F.max("seq").over(ahead), "last_line": F.max("line_no").over(ahead), "sum_": F.sum("words").over(ahead)})
    n = F.when(F.col("sum_") >= min_words, F.col("end_") - F.col("seq") + 1)
    return rows.withColumn("n", n).drop("end_", "sum_", "before", "words")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The later copies, merged: doc_id, text_hash, first_line, last_line (line numbers from 0)."""
    lines = publish(_lines(docs), "lines")
    ranks = _ranks(lines, ["a", "b"], "r0")
    rows = publish(_runs(lines.join(ranks, ["a", "b"]).drop("a", "b"), min_words), "suffixes")
    longest = rows.agg(F.max("n")).first()[0] or 0
    level = 0
    while 2 ** (level + 1) <= longest:
        here, further, rank = f"r{level}", f"s{level}", f"r{level + 1}"
        window = Window.partitionBy(*_DOC, "island").orderBy("seq").rangeBetween(2**level, 2**level)
        rows = publish(rows.withColumn(further, F.max(here).over(window)), "suffixes")
        pairs = _ranks(rows.where(F.col(here).isNotNull() & F.col(further).isNotNull()), [here, further], rank)
        rows = publish(rows.join(pairs, [here, further], "left").drop(further), "suffixes")
        level += 1
    return _merged(publish(_later(rows, level), "later-copies"))


def _later(rows: DataFrame, levels: int) -> DataFrame:
    """Runs that an earlier place has too: doc_id, text_hash, line_no, last_line. Read from the suffix array: those that share their n lines with the suffix before."""
    suffixes = publish(_suffix_array(rows, levels), "suffix-array")
    ends = publish(suffixes.groupBy("part").agg(F.max("ranks").alias("ranks")), "suffix-array-ends", 1)  # a row per range
    ends = ends.select("part", F.lag("ranks").over(Window.orderBy("part")).alias("range_before"))
    before = F.lag("ranks").over(Window.partitionBy("part").orderBy("ranks", _place()))
    pairs = suffixes.withColumn("before", before).join(ends, "part").withColumn("before", F.coalesce("before", "range_before"))
    return pairs.where(_common_prefix("before", "ranks") >= F.col("n")).select(*_DOC, "line_no", "last_line")


def _suffix_array(rows: DataFrame, levels: int) -> DataFrame:
    """The suffixes that hold a run of enough words, each cut to that run's n lines, in order: ranks (of the first 1, 2, 4 ... lines, then of the last ones), part (the range).

    Equal ones stand by place. The array is sorted in ranges, so that the copies of a run, however many, are dealt to several tasks.
    """
    ranks = F.array(*(F.col(f"r{k}") for k in range(levels + 1)))
    level = F.length(F.bin(F.col("n").cast("bigint"))) - 1  # floor of the binary logarithm
    starts = rows.where("n is not null").withColumns({"level": level, "head": F.slice(ranks, F.lit(1), level + 1)})
    starts = starts.withColumn("tail", F.col("seq") + F.col("n") - F.pow(F.lit(2), F.col("level")).cast("int")).where(~F.exists("head", lambda r: r.isNull()))
    tails = rows.select(F.col("doc_id").alias("doc_t"), F.col("text_hash").alias("hash_t"), F.col("seq").alias("seq_t"), ranks.alias("ranks_t"))
    same = F.col("doc_id").eqNullSafe(F.col("doc_t")) & (F.col("text_hash") == F.col("hash_t")) & (F.col("tail") == F.col("seq_t"))
    named = starts.join(tails, same).withColumn("last", F.col("ranks_t")[F.col("level")]).where("last is not null")
    named = named.select(*_DOC, "seq", "line_no", "last_line", "n", F.array_append("head", F.col("last")).alias("ranks"))
    order = ["ranks", _place()]
    return named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def _common_prefix(a: str, b: str) -> Column:
    """Lines that two suffixes, given by their ranks, share at the least: all of both if they agree in all ranks, else 2**k if they do in k + 1."""
    heads = (F.slice(c, F.lit(1), F.size(c) - 1) for c in (a, b))  # without the ranks of the last lines
    agree = F.size(F.filter(F.zip_with(*heads, lambda x, y: x.eqNullSafe(y)), lambda x: x))  # ranks of longer prefixes only agree if those of shorter ones do
    return F.when(F.col(a) == F.col(b), F.col("n")).when(agree > 0, F.pow(F.lit(2), agree - 1).cast("int")).otherwise(0)


def _merged(later: DataFrame) -> DataFrame:
    by_doc = Window.partitionBy(*_DOC).orderBy("line_no", "last_line")
    reach = F.max("last_line").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("line_no") > reach + 1, F.lit(True)).cast("int")
    runs = later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by_doc))
    return runs.groupBy(*_DOC, "run").agg(F.min("line_no").alias("first_line"), F.max("last_line").alias("last_line")).drop("run")


def without_later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with runs_ (the deleted line ranges, null if none) and clean_text."""
    runs = repeated_runs(docs, min_words)
    runs = runs.groupBy(*_DOC).agg(F.collect_list(F.struct("first_line", "last_line")).alias("runs_"))  # a document's own runs
    runs = publish(runs, "deleted").select(F.col("doc_id").alias("doc_r_"), F.col("text_hash").alias("hash_r_"), "runs_")
    on = docs["doc_id"].cast("bigint").eqNullSafe(F.col("doc_r_")) & (F.xxhash64(text_of(docs["text"])) == F.col("hash_r_"))
    # by shuffle at every size, with the small side in the hash tables: texts are not sorted
    out = docs.join(runs.hint("shuffle_hash"), on, "left").drop("doc_r_", "hash_r_")
    kept = F.filter(F.split(text_of(), "\n"), lambda x, i: ~F.exists("runs_", lambda r: (r["first_line"] <= i) & (i <= r["last_line"])))
    return out.withColumn("clean_text", F.when(F.col("runs_").isNull(), text_of()).otherwise(F.array_join(kept, "\n")))


def line_dedup_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per document: doc_id, n_lines, n_deleted (lines with a word), n_runs, clean_chars, clean_sha256."""
    n_lines = lambda text: F.size(F.filter(F.split(text, "\n"), _has_word)).cast("bigint")
    out = without_later_copies(docs.select("doc_id", "text"), min_words).withColumn("n_lines", n_lines(text_of()))
    deleted = F.when(F.col("runs_").isNull(), F.lit(0)).otherwise(F.col("n_lines") - n_lines(F.col("clean_text"))).cast("bigint")
    n_runs = F.when(F.col("runs_").isNull(), F.lit(0)).otherwise(F.size("runs_")).cast("bigint")
    return out.select(
        "doc_id", "n_lines", deleted.alias("n_deleted"), n_runs.alias("n_runs"),
        F.length("clean_text").cast("bigint").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"),
    )


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without later copies of repeated runs; a document of which nothing but blanks remains goes too."""
    wrapped = docs.select(F.struct(*docs.columns).alias("doc_"), "doc_id", "text")
    out = without_later_copies(wrapped, min_words).where(F.col("runs_").isNull() | _has_word(F.col("clean_text")))
    changed = F.when(F.col("runs_").isNull(), F.col("text")).otherwise(F.col("clean_text"))
    return out.select(*with_text(docs, F.col("doc_"), changed))
