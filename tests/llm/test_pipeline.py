"""The pipeline stage by stage and run() as a whole, against plain Python versions of every stage."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import line_dedup, mixing, packing, quality_rules
from gridloom.llm.shared import publish
from tests.llm import cases
from tests.llm.test_operators import WORD, _alike_pairs, _components, _deleted_lines, bag, crc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_BLANKS = " \t\n\x0b\x0c\r"
_CLOSING = re.compile(r"[!-/:-@\[-`{-~…»”’。！？]$")
_BOILERPLATE = re.compile(quality_rules.BOILERPLATE.replace("(?i)", ""), re.I | re.A)


def _line_fails(line: str) -> bool:
    trimmed = line.strip(_BLANKS)
    if not trimmed:
        return False
    n = len(WORD.findall(trimmed))
    symbols, shouts, bars = (sum(c in chars for c in trimmed) for chars in (quality_rules.SYMBOLS, "!", quality_rules.SEPARATORS))
    return bool(
        n <= quality_rules.STUMP_WORDS and not _CLOSING.search(trimmed) or symbols > quality_rules.SYMBOLS_PER_WORD * n or shouts > max(3.0, quality_rules.SHOUTS_PER_WORD * n)
        or bars > max(2.0, quality_rules.SEPARATORS_PER_WORD * n) or n <= quality_rules.BOILERPLATE_WORDS and _BOILERPLATE.search(trimmed)
    )


def _clean(text: str) -> str | None:
    """What the quality rules leave of a text, None if they reject it."""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    clean = "\n".join(x for x in text.split("\n") if not _line_fails(x))
    chars = lambda t: sum(map(len, WORD.findall(t)))
    if len(w) < quality_rules.MIN_WORDS or 100 * len(repeated) > 50 * len(w) or chars(text) - chars(clean) > quality_rules.MAX_LOST * chars(text):
        return None
    return clean


def _texts(df) -> list[tuple]:
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _lines_kept(rows: list[tuple]) -> list[tuple]:
    deleted, out = _deleted_lines(rows, line_dedup.MIN_WORDS), []
    for doc_id, text in rows:
        gone = deleted[doc_id, text]
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        if not gone or WORD.search(left):
            out.append((doc_id, left))
    return out


def _heads(rows: list[tuple]) -> list[tuple]:
    """The row with the smallest doc_id of each component of near copies."""
    roots, best = _components(len(rows), _alike_pairs([t for _, t in rows])), {}
    for k, root in enumerate(roots):
        best.setdefault(root, []).append(rows[k])
    return [min(group, key=lambda r: (r[0] is None, r[0] or 0)) for group in best.values()]


def _check_stages(docs, results) -> None:
    quality, lines, near, mixed, pieces = results
    want = [(i, c) for i, t in _texts(docs) if (c := _clean(t or "")) is not None]
    assert bag(_texts(quality)) == bag(want)
    assert bag(_texts(lines)) == bag(_lines_kept(_texts(quality)))
    assert bag(i for i in map(lambda r: (r[0],), _texts(near))) == bag((i,) for i, _ in _heads(_texts(lines)))
    assert not bag(_texts(near)) - bag(_texts(lines))
    plan = mixing.mix_report(near).select("doc_id", "size", "source_size", "target", "taken").collect()
    taken, largest = defaultdict(int), defaultdict(int)
    for r in plan:
        taken[r.source_size, r.target] += r.taken
        largest[r.source_size, r.target] = max(largest[r.source_size, r.target], r.size)
    assert all(abs(n - s[1]) <= max(1, 0.002 * s[1], largest[s] / 2) for s, n in taken.items())
    words = lambda rows: sum(len(WORD.findall(t)) for _, t in rows)
    assert words(_texts(mixed)) == sum(r.taken for r in plan)
    whole = dict(_texts(near))
    copies = defaultdict(list)
    for i, t in _texts(mixed):
        copies[i].append(t)
    assert all(t == whole[i] for i, ts in copies.items() for t in ts)  # no text is cut
    assert set(copies) <= set(whole) and max(map(len, copies.values())) <= mixing.MAX_REPEATS
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in _texts(mixed))
    got = defaultdict(int)
    for r in pieces.collect():
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == {(i, n): n * times for (i, n), times in lengths.items()}
    for r in pieces.where("start = 0 and length = doc_tokens").limit(50).collect():
        assert any(crc([*library.encode(t, add_special_tokens=False).ids, packing.END_ID]) == r.ids_crc32 for t in copies[r.doc_id])


def test_stages_keep_the_columns_and_equal_plain_versions(spark):
    source = spark.createDataFrame([r[:5] for r in cases.awkward_rows() + cases.driver_rows(spark)], DOCS)
    docs, results = source, []
    for name, stage in corpus_pipeline.STAGES:
        docs = publish(stage(spark, docs, ""), name.replace(" ", "-"))
        results.append(docs)
    assert all(r.columns == source.columns for r in results[:-1])
    assert 0 < results[1].count() <= results[0].count()
    _check_stages(source, results)


def test_run_is_its_stages(spark):
    """run() gives the tokens of the stages that the plain versions were held against."""
    source = docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = publish(stage(spark, docs, cases.SF), "stage")
        results.append(docs)
    _check_stages(source, results)
    total = lambda df: bag(df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect())
    assert total(corpus_pipeline.run(spark, cases.SF)) == total(docs)
    assert corpus_pipeline.ORACLE_SQL is None and np.isfinite(docs.count())


def test_stages_leave_other_columns_alone(spark):
    rows = [r[:5] + ("k", "n", "h", "l", "s", "d") for r in cases.awkward_rows() if r[0] != 10]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    before = {r.doc_id: tuple(r)[2:4] + tuple(r)[5:] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema.names == docs.schema.names and out.count() > 0
        assert all(tuple(r)[2:4] + tuple(r)[5:] == before[r.doc_id] for r in out.collect())
        assert stage(spark, docs.limit(0), "").count() == 0
