"""Byte-level BPE encoding and decoding by recursive DuckDB queries, a database in each Python worker.

A rank file names a vocabulary's tokens. Two tokens can join if their bytes, one after the other, are a token too; its
rank is the pair's. A text is split into words (the matches of the vocabulary's pattern), each distinct word is encoded once:
its tokens are rows by position, at first a row per byte. The recursion joins neighbours with the table of pairs and contracts,
round by round, each word's pair of the smallest rank, the leftmost of several, until no word has a pair left.
Decoding joins ids with the vocabulary and aggregates their bytes in order of position.

The split is vectorised: code points have a class (letter, number, white space, other), and words follow from where classes change.
Texts are split in slices of SLICE code points, cut where white space begins, which always begins a word; a slice's distinct words come
from a dictionary, and a worker remembers MEMORY of them.

Memory: a slice, the words remembered and BYTES bytes of new words with ROWS rows of their rounds, whatever the length of texts. A
single word of n bytes takes up to n rounds over n rows, as it does in any contraction one pair at a time.

Defined results: a null text is empty, and has no ids; doc_id is only carried along, so nulls, ties and repeated rows don't
matter; an empty table gives an empty result; other columns don't matter; an id that the vocabulary lacks is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import text_of

#: Distinct words that a worker remembers; beyond it the memory is emptied and filled anew.
MEMORY = 3 << 18
#: Code points that are split at once, about.
SLICE = 1 << 21
#: Bytes of new words that a query encodes at once (a longer word is alone), and rows of all its rounds, about.
BYTES, ROWS = 1 << 17, 1 << 22
#: Tokens that a query decodes at once.
TOKENS = 1 << 17

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
#: Endings that a word begins with after an apostrophe, as the pattern names them.
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
_BLANK_BEGINS = regex.compile(r"(?<=\S)\s")

_ENCODE = """
    WITH RECURSIVE t AS (
        SELECT 0 AS round, word, pos, next_pos, id, next_id FROM start
        UNION ALL
        (WITH p AS (SELECT t.*, pairs.joined FROM t LEFT JOIN pairs ON pairs.pair = (CAST(t.id AS BIGINT) << 32) + t.next_id WHERE t.round < {rounds}),
              least AS (SELECT word, min((CAST(joined AS BIGINT) << 32) + pos) AS best FROM p WHERE joined IS NOT NULL GROUP BY word),
              chosen AS (SELECT p.word, p.pos AS first, p.next_pos AS second, p.joined FROM least JOIN p ON p.word = least.word AND p.pos = (best & 4294967295)),
              after AS (SELECT c.*, p.next_pos, p.next_id FROM chosen c JOIN p ON p.word = c.word AND p.pos = c.second)
         SELECT p.round + 1, p.word, p.pos, CASE WHEN p.pos = a.first THEN a.next_pos ELSE p.next_pos END, CASE WHEN p.pos = a.first THEN a.joined ELSE p.id END,
                CASE WHEN p.pos = a.first THEN a.next_id WHEN p.next_pos = a.first THEN a.joined ELSE p.next_id END
         FROM p JOIN after a ON p.word = a.word WHERE p.pos <> a.second))
    SELECT word, round, id FROM t JOIN (SELECT word, max(round) AS round FROM t GROUP BY word) USING (word, round) ORDER BY word, pos"""

_DECODE = "SELECT unhex(string_agg(hex, '' ORDER BY pos)) AS bytes, count(hex) = count(*) AS known FROM tokens LEFT JOIN vocabulary USING (id) GROUP BY seq ORDER BY seq"


def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(low, high)))
        for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
            for m in regex.finditer(pattern, text):
                out[low + m.start() : low + m.end()] = kind
    return out


def word_starts(points: np.ndarray, classes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Places at which a word starts, among the code points of several texts one after another; text_starts: where texts that aren't empty start."""
    kind = classes[points]
    begins = np.ones(len(points), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[text_starts] = True
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], len(points))
    of_text = np.zeros(len(points) + 1, bool)
    of_text[text_starts] = True
    of_text[len(points)] = True
    run_kind = kind[runs]
    # white space before a word of its text: all but its last character is one word, and a blank as the last one joins the word
    blank = (run_kind == _SPACE) & ~of_text[ends]
    lasts = ends[blank] - 1
    begins[lasts] = True
    joins = points[lasts] == 0x20
    begins[lasts[joins] + 1] = False
    # an apostrophe that starts a word, alone in its run, and an ending: one word
    alone = (run_kind == _OTHER) & (ends - runs == 1) & ~of_text[ends]
    marks = runs[alone]
    marks = marks[(points[marks] == 0x27) & begins[marks]]
    if len(marks):
        padded = np.append(points, [0, 0])
        done = np.zeros(len(marks), bool)
        for ending in _ENDINGS:
            fits = ~done
            for k, c in enumerate(ending, 1):
                fits &= (padded[marks + k] == ord(c)) & ~of_text[np.minimum(marks + k, len(points))]
            begins[marks[fits] + 1] = False
            cut = marks[fits] + 1 + len(ending)
            begins[cut[cut < len(points)]] = True
            done |= fits
    return np.flatnonzero(begins)


class BytePairs:
    """A vocabulary of a rank file (a line per token: base64 and rank) as tables of a DuckDB database in memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        ranks = self.ranks
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._create("pairs", pair=pa.array([p for p, _ in pairs], pa.int64()), joined=pa.array([r for _, r in pairs], pa.int32()))
        self._create("vocabulary", id=pa.array(list(ranks.values()), pa.int32()), hex=pa.array([t.hex() for t in ranks]))
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.classes = _classes()

    def _create(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty), as little-endian unsigned 32 bit."""
        ranks = self.ranks
        out = [ranks[w].to_bytes(4, "little") if w in ranks else b"" for w in words]  # a word that is a token itself has no pairs to join
        group, size = [], 0
        for k, word in enumerate(words):
            if out[k]:
                continue
            if group and size + len(word) > BYTES:
                self._contract(words, group, out)
                group, size = [], 0
            group.append(k)
            size += len(word)
        if group:
            self._contract(words, group, out)
        return out

    def _contract(self, words: list[bytes], group: list[int], out: list[bytes]) -> None:
        """out of the words in group, by rounds of contractions; those that need more than a query's rounds go on from where they are."""
        names, lengths = np.array(group, np.int32), np.array([len(words[k]) for k in group])
        ids = self.byte_ids[np.frombuffer(b"".join([words[k] for k in group]), np.uint8)]
        while len(names):
            ends = np.cumsum(lengths)
            pos = np.arange(len(ids), dtype=np.int32) - np.repeat(ends - lengths, lengths).astype(np.int32)
            next_id, next_pos = np.append(ids[1:], np.int32(-1)), pos + np.int32(1)
            next_id[ends - 1] = next_pos[ends - 1] = -1
            rounds = max(1, min(64, ROWS // len(ids)))
            start = pa.table({"word": np.repeat(names, lengths), "pos": pos, "next_pos": next_pos, "id": ids, "next_id": next_id})
            done = self._query(_ENCODE.format(rounds=rounds), "start", start)
            word, last, ids = (done.column(c).to_numpy() for c in ("word", "round", "id"))
            firsts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            names, is_open, lengths = word[firsts], last[firsts] == rounds, np.diff(np.append(firsts, len(word)))
            buffer, at = ids.astype("<u4").tobytes(), (4 * np.append(firsts, len(word))).tolist()
            for n, (k, again) in enumerate(zip(names.tolist(), is_open.tolist(), strict=True)):
                if not again:
                    out[k] = buffer[at[n] : at[n + 1]]
            ids = ids[np.repeat(is_open, lengths)]
            names, lengths = names[is_open], lengths[is_open]

    def decode_ids(self, lists: list[bytes]) -> list[bytes]:
        """The bytes that each sequence of ids (little-endian unsigned 32 bit) stands for. Long sequences are decoded in parts."""
        parts = [(k, ids[a : a + 4 * TOKENS]) for k, ids in enumerate(lists) for a in range(0, len(ids), 4 * TOKENS)]
        out, at = [b""] * len(lists), 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end][1]) <= 4 * TOKENS):
                size += len(parts[end][1])
                end += 1
            for (k, _), x in zip(parts[at:end], self._decode([ids for _, ids in parts[at:end]]), strict=True):
                out[k] = out[k] + x if out[k] else x
            at = end
        return out

    def _decode(self, lists: list[bytes]) -> list[bytes]:
        lengths = np.array([len(x) // 4 for x in lists])
        seq = np.repeat(np.arange(len(lists), dtype=np.int32), lengths)
        pos = np.arange(len(seq), dtype=np.int32)
        found = self._query(_DECODE, "tokens", pa.table({"seq": seq, "pos": pos, "id": np.frombuffer(b"".join(lists), "<i4")}))
        if not pc.all(found.column("known")).as_py():
            raise ValueError("an id is not in the vocabulary")
        return found.column("bytes").to_pylist()

    def lookup(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32 bit, what these decode to) of each of some distinct words."""
        found = list(map(self.known.get, words))
        missing = [k for k, x in enumerate(found) if x is None]
        if len(self.known) + len(missing) > MEMORY:
            self.known.clear()
        new = [words[k] for k in missing]
        ids = self.encode_words(new)
        for k, word, x, decoded in zip(missing, new, ids, self.decode_ids(ids), strict=True):
            found[k] = self.known[word] = x, word if decoded == word else decoded
        return found

    def encode(self, texts: Iterable[str]) -> Iterator[list[tuple[int, bytes, bytes]]]:
        """Parts of texts, a list per slice: (number of the text, its next ids, what these decode to), in order; a long text has several."""
        held, size = [], 0
        for k, text in enumerate(texts):
            for piece in _pieces(text):
                held.append((k, piece))
                size += len(piece)
                if size >= SLICE:
                    yield self._encode_slice(held)
                    held, size = [], 0
        if held:
            yield self._encode_slice(held)

    def _encode_slice(self, held: list[tuple[int, str]]) -> list[tuple[int, bytes, bytes]]:
        lengths = np.array([len(t) for _, t in held])
        text = "".join(t for _, t in held)
        if not text:
            return [(k, b"", b"") for k, _ in held]
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        text_starts = np.cumsum(lengths) - lengths
        starts = word_starts(points, self.classes, text_starts[lengths > 0])
        encoded = text.encode()
        offsets = np.append(starts, len(points))
        if len(encoded) > len(points):  # places in UTF-8 from those of code points
            widths = (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
            offsets += np.append(0, np.cumsum(widths, dtype=np.int64))[offsets]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(encoded)]).dictionary_encode()
        found = self.lookup(words.dictionary.to_pylist())
        first = np.searchsorted(starts, np.append(text_starts, len(points)))  # each text's first word
        ids, decoded = ((lambda b: (b.buffers()[2], np.frombuffer(b.buffers()[1], np.int64)))(pa.array(x, pa.large_binary()).take(words.indices)) for x in zip(*found, strict=True))
        part = lambda x, n: x[0].slice(int(x[1][first[n]]), int(x[1][first[n + 1]] - x[1][first[n]])).to_pybytes()
        return [(k, part(ids, n), part(decoded, n)) for n, (k, _) in enumerate(held)]


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about SLICE code points, each but the first beginning with white space after something else."""
    at = 0
    while len(text) - at > SLICE:
        m = _BLANK_BEGINS.search(text, at + SLICE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_LOADED: dict[str, BytePairs] = {}


def load(path: str) -> BytePairs:
    """The vocabulary of this worker process, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))


def encoded(docs: DataFrame, ranks: str) -> DataFrame:
    """A row per row of docs: doc_id, ids (array of int). ranks: the path of a rank file, as public_tokenizers.path gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(ranks)
        for b in batches:
            parts: list[list[bytes]] = [[] for _ in range(b.num_rows)]
            for part in vocabulary.encode(b.column(1).to_pylist()):
                for k, ids, _ in part:
                    parts[k].append(ids)
            ids = pa.array([np.frombuffer(b"".join(p), "<i4") for p in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return _documents(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(rows: DataFrame, ranks: str) -> DataFrame:
    """rows: doc_id, ids. A row for each: doc_id, bytes (what the ids stand for; null ids: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(ranks)
        for b in batches:
            found = vocabulary.decode_ids([np.array(x or [], "<i4").tobytes() for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["doc_id", "bytes"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def byte_pair_report(docs: DataFrame, ranks: str) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of the bytes that the ids decode to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(ranks)
        for b in batches:
            n_tokens = [0] * b.num_rows
            hashes = [(sha256(), sha256()) for _ in range(b.num_rows)]
            for part in vocabulary.encode(x.as_py() for x in b.column(1)):
                for k, ids, bytes_ in part:
                    n_tokens[k] += len(ids) // 4
                    hashes[k][0].update(ids)
                    hashes[k][1].update(bytes_)
            shown = [pa.array([h[k].hexdigest() for h in hashes], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64()), *shown], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _documents(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
