"""Hashes of any stretches of a byte string, or of its words, by prefix sums of a polynomial."""

from __future__ import annotations

from copy import copy
from functools import cached_property

import numpy as np

from xylem.llm.common import mixed

#: Bases and seeds of two hashes that do not depend on each other; together they have 128 bits.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LETTERS = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed)) for seed in (0xD1B54A32D192ED03, 0xA0761D6478BD642F)]
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]


def powers(n: int, which: int = 0) -> list[np.ndarray]:
    """The first n powers, at least, of a hash's base and of its inverse."""
    if len(_powers[which][0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASES[which], pow(_BASES[which], -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[which][i] = np.cumprod(steps)
    return _powers[which]


class Text:
    """A byte string whose stretches have 64-bit hashes that do not hang on their place. which: of two independent hashes."""

    def __init__(self, data: bytes, which: int = 0):
        self.data, self.which = data, which
        self.values = np.frombuffer(data, np.uint8)
        self.n = len(self.values)

    def _letters(self) -> np.ndarray:
        return np.take(_LETTERS[self.which], self.values)

    @property
    def down(self) -> np.ndarray:
        return powers(self.n + 1, self.which)[1]

    @cached_property
    def sums(self) -> np.ndarray:
        letters, sums = self._letters(), np.zeros(self.n + 1, np.uint64)
        letters *= powers(self.n + 1, self.which)[0][: self.n]
        np.cumsum(letters, out=sums[1:])
        return sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def hashes_of_all(self, low: int, high: int, length: int) -> np.ndarray:
        """Hashes of all stretches of one length that start from low to high."""
        x = self.sums[low + length : high + length] - self.sums[low:high]
        x *= self.down[low:high]
        return mixed(x)

    def twin(self) -> Text:
        """The same text under the other hash."""
        other = copy(self)
        other.which = 1 - self.which
        other.__dict__.pop("sums", None)
        return other

    def heads(self, at: np.ndarray, length: int) -> list[bytes]:
        """The first bytes of the suffixes at the given places."""
        return [self.data[a : a + length] for a in at.tolist()]


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


class Words(Text):
    """The words of a byte string, parted by ASCII white space; places are those of words. begin and end: of each word, in bytes."""

    def __init__(self, data: bytes, which: int = 0):
        self.data, self.which = data, which
        space = np.ones(len(data) + 2, bool)
        np.take(_SPACE, np.frombuffer(data, np.uint8), out=space[1:-1])
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.begin, self.end = edges[::2], edges[1::2]
        self.n = len(self.begin)

    def _letters(self) -> np.ndarray:
        return Text(self.data, self.which).hashes(self.begin, self.end)

    def heads(self, at: np.ndarray, length: int) -> list[bytes]:
        """The first words of the suffixes at the given places, one space between them."""
        words = b" ".join(self.data.split())
        ends = np.cumsum(self.end - self.begin + 1)
        begins = ends - (self.end - self.begin + 1)
        return [words[b:e] for b, e in zip(begins[at].tolist(), (ends[at + length - 1] - 1).tolist(), strict=True)]
