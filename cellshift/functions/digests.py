"""md5 of many short texts at once: each step of the digest is one numpy operation over a block of texts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

# Texts hashed at once: their state stays in a core's cache, and the calls' own cost is shared by many.
LANES = 1 << 15


class Texts:
    """Texts of one block, grouped by length, to be hashed after any prefix.

    Results are in the order of ``rows``, the places that the texts had.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            raise ValueError("A null text has no digest")
        _, ends, chars = texts.buffers()
        offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(chars or b"", np.uint8)
        lengths = np.diff(offsets)
        self._groups, places = [], [np.zeros(0, np.int64)]
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            columns = np.ascontiguousarray(data[offsets[rows][:, None] + np.arange(length)].T)
            self._groups.append((len(rows), columns, {}))
            places.append(rows)
        self.rows = np.concatenate(places)

    def md5(self, prefix: bytes, whole: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """First and, if ``whole``, last eight bytes of md5(prefix + text); as big-endian numbers they sort as the hex digits do."""
        high = np.empty(len(self.rows), np.uint64)
        low = np.empty(len(self.rows), np.uint64) if whole else None
        done = 0
        for n, columns, known in self._groups:
            align = len(prefix) % 4
            if align not in known:
                known[align] = _placed(columns, align)
            blocks = _blocks(prefix, len(columns), known[align])
            for at in range(0, n, LANES):
                to = min(at + LANES, n)
                a, b, c, d = _digest(blocks, at, to)
                high[done + at : done + to] = _joined(a, b)
                if whole:
                    low[done + at : done + to] = _joined(c, d)
            done += n
        return high, low


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.byteswap().astype(np.uint64) << np.uint64(32)) | second.byteswap()


def _placed(columns: np.ndarray, align: int) -> list[np.ndarray]:
    """Little-endian words over the bytes of the texts, the first of them at byte ``align`` of the first word."""
    length, n = columns.shape
    words = [np.zeros(n, np.uint32) for _ in range((align + length + 3) // 4 if length else 0)]
    for j in range(length):
        words[(align + j) // 4] |= columns[j].astype(np.uint32) << np.uint32(8 * ((align + j) % 4))
    return words


def _blocks(prefix: bytes, length: int, words: list[np.ndarray]) -> list[list[tuple[np.uint32, np.ndarray | None]]]:
    """For each block of 64 bytes and step: what all texts add alike, and the word in which they differ."""
    total = len(prefix) + length
    fixed = bytearray(64 * ((total + 8) // 64 + 1))
    fixed[: len(prefix)] = prefix
    fixed[total] = 0x80
    fixed[-8:] = (8 * total).to_bytes(8, "little")
    alike = np.frombuffer(bytes(fixed), "<u4")
    first = len(prefix) // 4
    differ = dict(enumerate(words, first))
    steps = [[(16 * block + word, sine) for word, sine in zip(_WORDS, _SINES, strict=True)] for block in range(len(fixed) // 64)]
    return [[(np.uint32((int(alike[word]) + sine) & 0xFFFFFFFF), differ.get(word)) for word, sine in block] for block in steps]


def _digest(blocks: list[list[tuple[np.uint32, np.ndarray | None]]], at: int, to: int) -> tuple[np.ndarray, ...]:
    n = to - at
    state = [np.full(n, word, np.uint32) for word in _START]
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for steps in blocks:
        a, b, c, d = (word.copy() for word in state)
        for i, (alike, word) in enumerate(steps):
            if i < 16:
                np.bitwise_xor(c, d, out=t)
                np.bitwise_and(t, b, out=t)
                np.bitwise_xor(t, d, out=t)
            elif i < 32:
                np.bitwise_xor(b, c, out=t)
                np.bitwise_and(t, d, out=t)
                np.bitwise_xor(t, c, out=t)
            elif i < 48:
                np.bitwise_xor(b, c, out=t)
                np.bitwise_xor(t, d, out=t)
            else:
                np.invert(d, out=t)
                np.bitwise_or(t, b, out=t)
                np.bitwise_xor(t, c, out=t)
            np.add(t, a, out=t)
            np.add(t, alike, out=t)
            if word is not None:
                np.add(t, word[at:to], out=t)
            np.left_shift(t, np.uint32(_SHIFTS[i]), out=u)
            np.right_shift(t, np.uint32(32 - _SHIFTS[i]), out=t)
            np.bitwise_or(t, u, out=t)
            np.add(t, b, out=a)
            a, b, c, d = d, a, b, c
        for word, more in zip(state, (a, b, c, d), strict=True):
            np.add(word, more, out=word)
    return tuple(state)
