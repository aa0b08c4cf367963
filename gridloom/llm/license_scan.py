"""License scan by ordered signature rules, in DataFrame functions only: one pass over the texts, no shuffle.

Base: places where the words of a phrase stand consecutively. The method: every rule of license_rules whose
keyword occurs in the text is matched, on a copy in which white space and the comment marks of wrapped lines are
one space (places are the copy's); a match must begin and end at word edges. License expressions (`Apache-2.0 OR MIT`, `(MIT AND BSD-3-Clause)`,
`GPL-2.0-only WITH Classpath-exception-2.0`) after a tag, or after "licensed under", are cut into identifiers, each a detection of the best tier
with its own place; only whole identifiers count, and unknown ones, exceptions among them, have no label. Detections are ordered by
start, longest first; one whose interval lies within an earlier one's of the same or a better tier is
suppressed (equal intervals: the better tier, then the earlier rule, wins). A list of strings first decides
whether a text can hold any rule or phrase at all; only for those that pass is anything further computed.

Labels are the base labels and those of the detections kept; the score is the best tier's confidence.

Defined results: a null text has no words; rows are independent, so null doc_ids, ties, repeated rows and
clashing extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.license_rules import EXPRESSIONS, IDENTIFIER, RULES, identifiers
from gridloom.llm.shared import SPACES, let, text_of

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Confidence of a detection, by tier; a base phrase counts as tier 0.
CONFIDENCE = (1.0, 0.9, 0.7)
#: All but ASCII's characters that are no letters and digits; as what it holds, which Java matches many times faster than what it doesn't.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: A line break, with the marks that end a comment's line before it and begin the next one after it.
WRAP = r" ?(\*/|\*|-->)? ?[\r\n] ?((//[/!]?|/?\*+|#+|;+|--+|%+|<!--|>+|rem|dnl|\|)(?=\s))?"
#: Every rule and phrase has one of these in it: plain strings, which are cheap to look for, and two patterns.
GATE_STRINGS = (
    "licens", "licenc", "spdx-", "gpl", "gfdl", "gnu fdl", "cddl", "wtfpl", "cc0", "creative commons", "public domain", "hereby granted",
    "redistribution and use", "rights reserved", "express or implied warranty", "free software", ".org/", "unencumbered", "commercial",
    "unauthorised", "unauthorized", "proprietary and", "software foundation", "terms of use", "terms as perl", "nasa open source agreement",
    "endorse or promote", "advertising materials", "you just do what", "substantial portions", "notice and disclaimer", "nationalarchives",
    "permission is granted", "mit no attribution", "clause bsd", "bsd zero", "clause",
)
GATE_PATTERNS = (r"cc[^a-z]", r"(^|[^a-z])(asl|osl|afl|ofl|mpl|epl|eupl|busl|upl|sspl|odbl)[-, v0-9]")
#: A text that holds a gate string, wrapped or not, has one of these in it: the string's rarest word, which no line break cuts.
GATE_WORDS = (
    "licens", "licenc", "spdx-", "gpl", "gfdl", "fdl", "cddl", "wtfpl", "cc0", "creative", "domain", "hereby", "redistribution", "reserved", "warranty", "software", ".org/", "unencumbered",
    "commercial", "unauthorised", "unauthorized", "proprietary", "terms", "nasa", "endorse", "advertising", "substantial", "disclaimer", "nationalarchives", "permission",
    "attribution", "clause", "bsd", "just",
)
GATE_WORD_PATTERN = r"cc[^a-z]|(?:^|[^a-z])(?:asl|osl|afl|ofl|mpl|epl|eupl|busl|upl|sspl|odbl)[-,\sv0-9]"
#: A match of that pattern has one of these in it.
GATE_NAMES = ("cc", "asl", "osl", "afl", "ofl", "mpl", "epl", "upl", "usl", "spl", "dbl")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "array<struct<label:string,tier:int,keyword:string,pattern:string,rank:int>>"
_HIT = "struct<start:int,back:int,tier:int,rank:int,label:string>"


def _phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    here = lambda i: reduce(Column.__and__, (F.get(words, i + k) == p for k, p in enumerate(parts)))
    places = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, here)


def _matches(text: Column, rule: Column) -> Column:
    """Detections of a rule: text between the matches and the matches themselves give their places."""

    def places(between: Column, found: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(between[i])
            end = start + F.length(found[i])
            edge = lambda at: F.substring(text, at, F.lit(1)).rlike(r"[a-z0-9\x{80}-\x{10FFFF}]")
            inner = lambda at: F.substring(text, at, F.lit(1)).rlike("[a-z0-9]")
            whole = ~((start > 0) & edge(start) & inner(start + 1)) & ~(edge(end + 1) & inner(end))
            hit = F.struct(start.alias("start"), (-end).alias("back"), rule["tier"].alias("tier"), rule["rank"].alias("rank"), rule["label"].alias("label"))
            kept = F.when(whole, F.array(hit)).otherwise(F.array().cast(f"array<{_HIT}>"))
            return F.struct(end.alias("at"), F.concat(acc["hits"], kept).alias("hits"))

        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_HIT}>").alias("hits"))
        order = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(order, first, step, lambda acc: acc["hits"])

    return let(F.split(text, rule["pattern"], -1), lambda between: let(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), lambda found: places(between, found)))


def _identifiers(text: Column) -> Column:
    """Detections of the identifiers in a text's license expressions."""
    label_of = F.create_map(*(F.lit(x) for pair in identifiers().items() for x in pair))
    rule = lambda pattern: F.struct(F.lit("").alias("label"), F.lit(0).alias("tier"), F.lit(pattern).alias("pattern"), F.lit(-1).alias("rank"))
    one = rule(IDENTIFIER)
    part = lambda t, hit: F.substring(t, hit["start"] + 1, -hit["back"] - hit["start"])

    def within(expression: Column, lead: str) -> Column:
        # what leads to the expression is cut off, so that its words are no identifiers
        start, whole = expression["start"], part(text, expression)
        ids = let(F.regexp_replace(whole, f"^{lead}", ""), lambda t: let(start + F.length(whole) - F.length(t), lambda at: F.transform(_matches(t, one), lambda hit: F.struct(
            (at + hit["start"]).alias("start"), (hit["back"] - at).alias("back"), hit["tier"].alias("tier"), hit["rank"].alias("rank"), label_of[part(t, hit)].alias("label")))))
        return F.filter(ids, lambda hit: hit["label"].isNotNull())

    def of(keyword: str, pattern: str, lead: str) -> Column:
        found = F.flatten(F.transform(_matches(text, rule(pattern)), lambda e: within(e, lead)))
        return F.when(F.contains(text, F.lit(keyword)), found).otherwise(F.array().cast(f"array<{_HIT}>"))

    return F.concat(*(of(*x) for x in EXPRESSIONS))


def _kept(hits: Column) -> Column:
    """Detections that no other one of the same or a better tier contains."""
    n = len(CONFIDENCE)

    def step(acc: Column, hit: Column) -> Column:
        reach = reduce(lambda a, k: F.when(hit["tier"] >= k, F.greatest(a, acc[f"m{k}"])).otherwise(a), range(1, n), acc["m0"])
        kept = F.when(-hit["back"] <= reach, F.array().cast(f"array<{_HIT}>")).otherwise(F.array(hit))
        ends = [F.when(hit["tier"] == k, F.greatest(acc[f"m{k}"], -hit["back"])).otherwise(acc[f"m{k}"]).alias(f"m{k}") for k in range(n)]
        return F.struct(*ends, F.concat(acc["hits"], kept).alias("hits"))

    first = F.struct(*(F.lit(-1).alias(f"m{k}") for k in range(n)), F.array().cast(f"array<{_HIT}>").alias("hits"))
    return F.aggregate(F.sort_array(hits), first, step, lambda acc: acc["hits"])


def _folded(text: Column) -> Column:
    """Line breaks with the comment marks around them, then runs of white space, as one space each."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), WRAP, " "), SPACES, " ")


def can_hold(text: Column) -> Column:
    """Can a text with its A-Z in lower case hold a rule or phrase at all?"""
    strings = (F.contains(text, F.lit(x)) for x in GATE_STRINGS)
    return reduce(Column.__or__, (*strings, *(text.rlike(p) for p in GATE_PATTERNS)))


def may_hold(text: Column) -> Column:
    """A cheaper question than `can_hold`, of the text as it is, that all texts pass whose folded copy passes that one."""
    any_of = lambda strings: reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in strings))
    return any_of(GATE_WORDS) | any_of(GATE_NAMES) & text.rlike(GATE_WORD_PATTERN)


def detections(docs: DataFrame) -> DataFrame:
    """docs with n_words, base (label and starts of each phrase) and found (detections kept)."""
    text = text_of()
    rules = F.from_json(F.lit(json.dumps(RULES)), _RULE)
    n_words = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    # lower() folds more than A-Z, so it lets no more than a few other texts through
    gate = let(F.lower(text), lambda low: may_hold(low) & let(_folded(low), can_hold))
    gated = docs.withColumn("n_words", n_words).withColumn("low_", F.when(gate, F.translate(text, _UPPER, _LOWER))).withColumn("flat_", _folded(F.col("low_")))
    words = F.regexp_extract_all(F.col("low_"), F.lit(WORD), F.lit(0))
    base = let(words, lambda w: F.array(*(F.struct(F.lit(label).alias("label"), _phrase_starts(w, phrase).alias("starts")) for phrase, label in PHRASES.items())))
    ruled = lambda t: F.flatten(F.transform(F.filter(rules, lambda r: F.contains(t, r["keyword"])), lambda r: _matches(t, r)))
    found = let(F.col("flat_"), lambda t: _kept(F.concat(ruled(t), _identifiers(t))))
    return gated.withColumns({"base": F.when(F.col("low_").isNotNull(), base), "found": F.when(F.col("low_").isNotNull(), found)}).drop("low_", "flat_")


def license_report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = detections(docs.select("doc_id", "text"))
    rows = rows.withColumns({
        "starts": F.coalesce(F.flatten(F.transform("base", lambda b: b["starts"])), F.array().cast("array<int>")),
        "base_set": F.coalesce(F.transform(F.filter("base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"]), F.array().cast("array<string>")),
        "found": F.coalesce("found", F.array().cast(f"array<{_HIT}>")),
    })
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    confidence = F.array(*(F.lit(c) for c in CONFIDENCE))
    best = F.array_max(F.transform("found", lambda h: confidence[h["tier"]]))
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").cast("bigint").alias("first_word"), F.array_max("starts").cast("bigint").alias("last_word"),
        joined(F.col("base_set")).alias("base_labels"), joined(F.concat("base_set", F.transform("found", lambda h: h["label"]))).alias("labels"),
        F.when(F.size("base_set") > 0, F.lit(CONFIDENCE[0])).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
