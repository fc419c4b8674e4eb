"""Token ids of texts by a tokenizers-library vocabulary of word pieces.

The vocabulary splits at white space first, so a text's ids are the ids of its words
in order.  Words are encoded once per worker and kept in a bounded cache; plain words
go straight to the library's merge model, anything else through its whole pipeline.
"""

from __future__ import annotations

import re

import numpy as np

# White space on which every step of the vocabulary's pipeline agrees.
_ASCII_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
# Characters that some of the steps, or Python, see as white space and others do not.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# The vocabulary's own split, on lower-case plain words.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Word to its ids as little-endian unsigned integers; misses are encoded on demand."""

    def __init__(self, path: str, width: int = 4, limit: int = 300_000) -> None:
        """``limit`` bounds one generation of the cache; two are held, so words in use survive a change."""
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = np.dtype(f"<u{width}")
        self.limit = limit
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = {ord(chr(b)): letter for b, letter in byte_letters().items()}

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            shown = piece.encode().decode("latin-1").translate(self.letters)
            known = np.array([t.id for t in self.model.tokenize(shown)], self.kind).tobytes()
            if len(piece) <= 64:
                if len(self.pieces) >= self.limit:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encode(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _encode(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self._piece, _SPLIT.findall(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def of(self, text: str) -> bytes:
        """Ids of a text."""
        words = _ASCII_WORD.findall(text) if _UNSURE.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


_OPEN: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, width: int = 4) -> WordIds:
    """The worker's cache for a vocabulary file."""
    key = (path, width)
    if key not in _OPEN:
        _OPEN[key] = WordIds(path, width)
    return _OPEN[key]
