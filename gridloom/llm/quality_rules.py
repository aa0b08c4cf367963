"""Line-first quality rules, in DataFrame functions only: one pass over the texts, no shuffle.

Every line with a word is held against punctuation, navigation and boilerplate rules. Lines that fail are
removed; a document that loses too large a share of its word characters, or fails the base rule, is rejected.

Base rule: fewer than 50 words, or more than half of the words stand in 3-word windows that occur twice or
more in the text. Equal windows are found by sorting 64-bit keys (36 bits of the window's hash, 28 bits of
its place) and comparing the few neighbours that agree word by word, so that the count is exact.

Defined results: a null text has no words and is rejected; blank lines are never duplicates; rows are
independent, so ties, repeated rows and clashing extra columns don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import SPACES, let, text_of, with_text

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A document is rejected if its failing lines hold more than this share of its word characters.
MAX_LOST = 0.5
#: A line fails the punctuation rules at so many symbols, or exclamation marks, to a word.
SYMBOLS_PER_WORD, SHOUTS_PER_WORD = 0.5, 0.5
#: A line with no closing punctuation fails if it is as short as this (menu entries, buttons).
STUMP_WORDS = 3
#: Separators that navigation bars put between their entries; a line fails at so many to a word.
SEPARATORS, SEPARATORS_PER_WORD = "|»›•·", 0.2
BOILERPLATE_WORDS = 40
BOILERPLATE = (
    r"(?i)\b(all rights reserved|cookie policy|cookies? (to|are|is) |accept (all )?cookies|privacy policy|terms of (use|service)|"
    r"terms and conditions|enable javascript|javascript is (disabled|required)|lorem ipsum|click here|read more|sign (in|up)\b|"
    r"log ?in\b|subscribe (now|to our)|newsletter|share (this|on)|follow us|back to top|skip to (main )?content|powered by|"
    r"copyright (©|\(c\))|page not found|add to cart|advertisement|sponsored content|related articles|leave a (comment|reply))"
)
_BLANKS = " \t\n\x0b\x0c\r"
_INDEX_BITS = 28


def _chars_in(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def _repeat_words(words: Column) -> Column:
    """Words that stand in 3-word windows found twice or more."""
    index_mask = (1 << _INDEX_BITS) - 1

    def window_hash(w: Column, i: Column) -> Column:
        return F.xxhash64(w[i], w[i + 1], w[i + 2])

    def keys(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.sort_array(F.transform(places, lambda i: window_hash(w, i).bitwiseAND(F.lit(~index_mask)).bitwiseOR(i.cast("bigint"))))

    def same_hash(a: Column, b: Column) -> Column:
        return F.shiftright(a, _INDEX_BITS) == F.shiftright(b, _INDEX_BITS)

    def suspects(w: Column) -> Column:
        return let(
            keys(w),
            lambda k: F.filter(
                k,
                lambda x, i: same_hash(x, F.get(k, i + 1)) & F.get(k, i + 1).isNotNull() | same_hash(x, F.get(k, i - 1)) & F.get(k, i - 1).isNotNull(),
            ),
        )

    def window(w: Column, x: Column) -> Column:
        i = x.bitwiseAND(F.lit(index_mask)).cast("int")
        return F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def repeated(w: Column) -> Column:
        return let(
            F.sort_array(F.transform(suspects(w), lambda x: window(w, x))),
            lambda s: F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1))),
        )

    def covered(w: Column) -> Column:
        starts = F.transform(repeated(w), lambda x: x["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(covered(w))).cast("bigint")


def line_fails(line: Column) -> Column:
    """True for a line with a word that a punctuation, navigation or boilerplate rule removes."""
    trimmed = F.btrim(line, F.lit(_BLANKS))
    marks = F.regexp_replace(line, f"[^{SYMBOLS}!]+", "")  # ASCII only: wider classes make Java's matcher slow
    facts = F.struct(trimmed.alias("line"), F.size(F.split(trimmed, SPACES)).alias("n"), marks.alias("marks"))

    def rules(x: Column) -> Column:
        stump = (x["n"] <= STUMP_WORDS) & ~x["line"].rlike(r"[\p{Punct}…»”’。！？]$")
        has_bar = reduce(Column.__or__, (F.contains(x["line"], F.lit(c)) for c in SEPARATORS))
        symbols = _chars_in(x["marks"], SYMBOLS) > SYMBOLS_PER_WORD * x["n"]
        shouts = _chars_in(x["marks"], "!") > F.greatest(F.lit(3.0), SHOUTS_PER_WORD * x["n"])
        bars = has_bar & (_chars_in(x["line"], SEPARATORS) > F.greatest(F.lit(2.0), SEPARATORS_PER_WORD * x["n"]))
        boilerplate = (x["n"] <= BOILERPLATE_WORDS) & x["line"].rlike(BOILERPLATE)
        return (x["line"] != "") & (stump | (x["marks"] != "") & (symbols | shouts) | bars | boilerplate)

    return let(facts, rules)


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACES, "")).cast("bigint")


def quality_columns(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept, clean_text.

    Columns of these names that docs already has are replaced.
    """
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({
        "word_chars": _word_chars(text),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint"),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint"),
        "counts_": let(words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).alias("r"))),
        "clean_text": F.array_join(F.filter(F.split(text, "\n"), lambda x: ~line_fails(x)), "\n"),
    })
    out = out.withColumns({"n_words": F.col("counts_.n"), "n_repeat_words": F.col("counts_.r"), "lost_chars": F.col("word_chars") - _word_chars(F.col("clean_text"))}).drop("counts_")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_chars") <= MAX_LOST * F.col("word_chars")))


def quality_report(docs: DataFrame) -> DataFrame:
    return quality_columns(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, their failing lines removed, with the columns of docs."""
    kept = quality_columns(docs.select(F.struct(*docs.columns).alias("doc_"), "text")).where("kept")
    return kept.select(*with_text(docs, F.col("doc_"), F.col("clean_text")))
