"""Words of many texts at once, as flat arrays.

Tasks receive Arrow batches of texts and work on them in chunks of bounded
length, so a task's memory does not depend on the size of a batch.  A word is a
run of letters and digits; letters count in lower case.  Offsets are code points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Code points handled at a time (a longer text is a chunk of its own).
CHUNK_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point → lower-case code point of a letter or digit, else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalnum():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a finaliser of the splitmix kind)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next chunk."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK_CHARS + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def chunks(texts: Sequence[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``limit`` characters, with the first one's index; null is empty."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > limit:
            yield at, held
            at, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


class Words:
    """All words of a chunk: text number, offsets inside the text, 64-bit hash.

    ``folded`` holds the chunk's folded code points (0 between words); ``base``
    the place of each text in it; ``first`` the index of each text's first word,
    with one more entry at the end.
    """

    def __init__(self, texts: Sequence[str]):
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        self.codes = codes
        self.lengths = lengths
        self.base = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else lengths
        self.folded = fold_table()[codes]
        # a text may hold "\0" itself: every place between texts is a break anyway
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = self.folded != 0
        edge = np.diff(inside)
        self.begin = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        power, self._inverse = _powers(len(codes) + 1)
        self._sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.folded.astype(np.uint64) * power[:-1], out=self._sums[1:])
        self.first = np.append(np.searchsorted(self.begin, self.base), len(self.begin))
        self.counts = np.diff(self.first)
        self.hash = self.span_hash(self.begin, self.end)

    def span_hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the folded code points in each span of the chunk."""
        return mix((self._sums[end] - self._sums[begin]) * self._inverse[begin])

    def text_of(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.lengths)), self.counts)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, across texts; entry i starts at word i."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(_BASE)
        out += hashes[k:k + n]
    return mix(out)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text: flat sorted hashes and each text's first index.

    A text of fewer than ``width`` words, but at least one, has one shingle of
    all its words; a text without words has none.
    """
    n_texts = len(words.lengths)
    number = np.maximum(words.counts - width + 1, 0)
    text = np.repeat(np.arange(n_texts), number)
    start = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(words.first[:-1], number)
    values = shingle_hashes(words.hash, width)[start] if len(text) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        own = [mix(np.array([hash_run(words.hash[words.first[i]:words.first[i + 1]])], np.uint64))[0] for i in short]
        values = np.concatenate((values, np.array(own, np.uint64)))
        text = np.concatenate((text, short))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(n_texts + 1))


def hash_run(hashes: np.ndarray) -> int:
    """One hash of a whole run of words of any length."""
    out = len(hashes)
    for h in hashes.tolist():
        out = (out * _BASE + h) & 0xFFFFFFFFFFFFFFFF
    return out
