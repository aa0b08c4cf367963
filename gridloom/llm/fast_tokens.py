"""Whole texts to token ids with the tokenizers library, each distinct pre-token encoded once.

Both vocabularies split a text into pre-tokens and encode each on its own, so a text's ids are its pre-tokens'
ids in order. For texts of ASCII and Latin-1 letters the split is a plain regular expression and the library
is asked only for pre-tokens not met before. Any other text (other scripts, marks, controls, a special
token's string) goes to the library whole; the tests hold both ways against the library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np

#: Distinct pre-tokens remembered by a worker; beyond it the memory is emptied and filled anew.
MEMORY = 1 << 18
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ÿ]*")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a character as its UTF-8 bytes, a printable letter for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in printable)
    letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


_BYTES = _byte_letters()
_SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>")


class FastTokenizer:
    """encode(texts) gives a numpy array of ids per text."""

    def __init__(self, path: str, split: re.Pattern, prepare: Callable[[str], str]):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.split, self.prepare = split, prepare
        self.known: dict[str, bytes] = {}
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"  # ids are remembered in 2 or 4 bytes

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if _PLAIN.fullmatch(text) and not ("<|" in text and _SPECIAL.search(text)):
                out.append(self._by_parts(self.split.findall(self.prepare(text))))
            else:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
        return out

    def _by_parts(self, parts: list[str]) -> np.ndarray:
        known = self.known
        new = [p for p in dict.fromkeys(parts) if p not in known]
        if new:
            if len(known) + len(new) > MEMORY:
                known.clear()
                new = list(dict.fromkeys(parts))
            bpe = self.library.model.tokenize  # a pre-token needs no more of the library's steps than its byte pair encoding
            known.update((p, array(self.code, [t.id for t in bpe(p.translate(_BYTES))]).tobytes()) for p in new)
        return np.frombuffer(b"".join(map(known.__getitem__, parts)), self.code).astype(np.uint32)


def byte_bpe(path: str) -> FastTokenizer:
    """byte_bpe_50k.json: byte-level, a space joins the pre-token that follows it."""
    split = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9²³¹¼½¾]+| ?[^\s{_LETTERS}0-9²³¹¼½¾]+|\s+(?!\S)|\s+")
    return FastTokenizer(path, split, lambda text: text)


def word_bpe(path: str) -> FastTokenizer:
    """word_bpe_49k.json: lower case, white space dropped, digits one by one."""
    split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9²³¹¼½¾]|[^\s{_LETTERS}0-9²³¹¼½¾]+")
    return FastTokenizer(path, split, str.lower)


_LOADED: dict[tuple[str, str], FastTokenizer] = {}


def load(kind: str, path: str) -> FastTokenizer:
    """The tokenizer of this worker process, loaded once."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = {"byte": byte_bpe, "word": word_bpe}[kind](path)
    return _LOADED[kind, path]
