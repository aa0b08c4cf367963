"""SQL for the corpus operators that SQL can express (DuckDB dialect)."""

from __future__ import annotations

from gridloom.llm import hard_negatives, line_dedup, merkle
from gridloom.llm import quality_rules as Q

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SPACES = r"[\x20\x09-\x0D]+"


def _count(text: str, chars: str) -> str:
    return f"length(regexp_replace({text}, '[^{chars}]+', '', 'g'))"


EXACT_DEDUP = rf"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g') AS t FROM documents),
         g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
    FROM d JOIN g USING (t)"""

QUALITY = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '{_SPACES}'), lambda w: w <> '') AS words FROM documents),
         w AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3),
         g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM w),
         c AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM g WHERE n > 1) GROUP BY doc_id),
         l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
         t AS (SELECT doc_id, line, trim(line, {_BLANKS}) AS t, len(string_split_regex(trim(line, {_BLANKS}), '{_SPACES}')) AS n,
                      {_count("line", Q.SYMBOLS)} AS symbols, {_count("line", "!")} AS shouts, {_count("line", Q.SEPARATORS)} AS bars FROM l),
         f AS (SELECT doc_id, line, t, t <> '' AND (n <= {Q.STUMP_WORDS} AND NOT regexp_matches(t, '[[:punct:]…»”’。！？]$')
                      OR symbols > {Q.SYMBOLS_PER_WORD} * n OR shouts > greatest(3, {Q.SHOUTS_PER_WORD} * n) OR bars > greatest(2, {Q.SEPARATORS_PER_WORD} * n)
                      OR n <= {Q.BOILERPLATE_WORDS} AND regexp_matches(t, '{Q.BOILERPLATE}')) AS fails FROM t),
         s AS (SELECT doc_id, coalesce(CAST(sum(length(regexp_replace(line, '{_SPACES}', '', 'g'))) FILTER (WHERE fails) AS BIGINT), 0) AS lost_chars,
                      count(line) FILTER (WHERE t <> '') - count(DISTINCT line) FILTER (WHERE t <> '') AS n_dup_lines FROM f GROUP BY doc_id),
         r AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(text, '{_SPACES}', '', 'g')) AS word_chars,
                      {_count("text", Q.SYMBOLS)} AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost_chars
               FROM d JOIN s USING (doc_id) LEFT JOIN c USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= {Q.MAX_LOST} * word_chars AS kept, lost_chars
    FROM r"""

#: By another way than the operator's: every shortest run of enough words, compared as text.
LINE_DEDUP = rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
         f AS (SELECT doc_id, no, line, len(string_split_regex(trim(line, {_BLANKS}), '{_SPACES}')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS seq
               FROM l WHERE trim(line, {_BLANKS}) <> ''),
         c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM f),
         e AS (SELECT a.doc_id, a.seq, a.no, min(b.seq) AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.seq >= a.seq AND b.upto - a.upto + a.words >= {line_dedup.MIN_WORDS} GROUP BY ALL),
         r AS (SELECT e.doc_id, e.seq, e.no, max(f.no) AS last_no, string_agg(f.line, chr(10) ORDER BY f.seq) AS run
               FROM e JOIN f ON e.doc_id = f.doc_id AND f.seq BETWEEN e.seq AND e.last GROUP BY ALL),
         x AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, seq) AS copy FROM r),
         g AS (SELECT DISTINCT doc_id, unnest(range(no, last_no + 1)) AS no FROM x WHERE copy > 1),
         k AS (SELECT l.doc_id, l.no, l.line, g.no IS NOT NULL AS gone, trim(l.line, {_BLANKS}) <> '' AS filled,
                      lag(g.no) OVER (PARTITION BY l.doc_id ORDER BY l.no) IS NOT NULL AS gone_before
               FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.no = g.no),
         s AS (SELECT doc_id, count(*) FILTER (WHERE filled) AS n_lines, count(*) FILTER (WHERE filled AND gone) AS n_deleted, count(*) FILTER (WHERE gone AND NOT gone_before) AS n_runs,
                      coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS clean FROM k GROUP BY doc_id)
    SELECT doc_id, n_lines, n_deleted, n_runs, length(clean) AS clean_chars, sha256(clean) AS clean_sha256 FROM s"""

SQL = {"op3_quality_rules": QUALITY, "op5_exact_dedup": EXACT_DEDUP, "op9_line_dedup": LINE_DEDUP, "op12_merkle_manifest": merkle.SQL, "op13_hard_negatives": hard_negatives.SQL}
