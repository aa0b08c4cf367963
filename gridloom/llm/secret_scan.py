"""Secret scan with multipart credential linking.

Base rules, leftmost and non-overlapping per kind: `assign` (a secret's name, a separator and a value of 12 or
more characters), `access` (AKIA and more, 18 or more characters), `hex` (16 or more lower-case digits).

The method links parts. Access identifiers, weak secrets and endpoints are found on their own; none of them is
evidence enough. Within a scope (a block between blank lines, and SCOPE_CHARS around a part) the parts are
interval-joined: a weak secret is reported (`secret`) only if an identifier or endpoint stands in its
scope, and that partner is reported as `identifier` or `endpoint`. Base spans are always kept; linked spans
are added where no base span covers them.

A document's text first passes a keyword gate inside Spark; only texts that can hold a part are handed to the
Python workers. Spans count code points, end exclusive.

Defined results: a null text has no spans; doc_id is only carried along, so nulls, ties and repeated rows don't
matter; an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import text_of

#: A weak secret and its partner stand at most this far apart, in one block.
SCOPE_CHARS = 400
#: Bits a character that a weak secret's value has at least.
MIN_ENTROPY = 3.0

ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Runs are maximal, so a least length in the pattern drops just the short matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")

IDENTIFIER = re.compile(
    r"""\b(?:client_?id|account_?id|tenant_?id|access_?key_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}|\b(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}""", re.I
)
ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|ftp|ssh)://[^\s"'<>]+|\b(?:host|server|endpoint|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::\d+)?""", re.I)
WEAK = re.compile(r"""\b(?:pass|pwd|pw|key|auth|cred(?:ential)?s?|private_?key|access_?key|client_?secret)["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{6,})|\b([A-Za-z0-9+/_-]{24,})\b""", re.I)
#: A text that matches none of these has nothing to report.
_GATES = (r"(?i:passw|secret|token|api_?key)", r"AKIA", r"[0-9a-f]{16}", r"(?i:\b(?:pass|pwd|pw|key|auth|creds?|credentials?|private_?key|access_?key)[\"']?\x20*[:=])", r"[A-Za-z0-9+/_-]{24}")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def _weak_secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in WEAK.finditer(text):
        value = m[1] or m[2]
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        if mixed and _entropy(value) >= MIN_ENTROPY:
            yield m.span()


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak secrets with a partner in scope, and these partners; nothing that a base span covers."""
    kinds = [[(*m.span(), 4) for m in IDENTIFIER.finditer(text)], [(*m.span(), 5) for m in ENDPOINT.finditer(text)], [(s, e, 4) for s, k, e in base if k == 1]]
    if not any(kinds):
        return []
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t]*\n", text)]
    starts = [[p[0] for p in parts] for parts in kinds]
    found, covered = set(), _Cover(base)
    for s, e in _weak_secrets(text):
        if covered.overlaps(s, e):
            continue
        block, low, high = bisect_right(breaks, s), s - SCOPE_CHARS, e + SCOPE_CHARS
        for parts, begins in zip(kinds, starts, strict=True):
            # parts of one kind don't overlap, so that of those that begin before the scope only the last can reach into it
            for p in parts[max(0, bisect_left(begins, low) - 1) : bisect_right(begins, high)]:
                if p[1] >= low and (p[1] <= s or p[0] >= e) and bisect_right(breaks, p[0]) == block:
                    found.add((s, 3, e))
                    if not covered.overlaps(p[0], p[1]):
                        found.add((p[0], p[2], p[1]))
    return sorted(found)


class _Cover:
    def __init__(self, spans: list[Span]):
        self.starts, self.ends, top = [], [], 0
        for s, _, e in spans:
            top = max(top, e)
            self.starts.append(s)
            self.ends.append(top)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_assign, n_access, n_hex, base_spans, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                spans = sorted(base + linked_spans(text, base)) if text else []
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                for column, value in zip(columns, [*counts, _joined(base), _joined(spans)], strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    text = text_of()
    gate = text.rlike(_GATES[0])
    for pattern in _GATES[1:]:
        gate = gate | text.rlike(pattern)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(gate, text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string")


def secret_report(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
