"""Words of texts as 64-bit hashes, computed for many texts at once.

A word is a run of ``0-9``, ``A-Z``, ``a-z`` and non-ASCII bytes of the UTF-8 text; A-Z count as small letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Other bytes become blanks, A-Z small letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are hashed together.
CHUNK = 1 << 18
_BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, as differences of running sums of byte powers."""

    def __init__(self) -> None:
        self.size = 0

    def _grow(self, size: int) -> None:
        if size > self.size:
            self.size = max(size, 2 * self.size, CHUNK)
            with np.errstate(over="ignore"):
                step = np.full(self.size, BASE, np.uint64)
                back = np.full(self.size, pow(BASE, -1, 1 << 64), np.uint64)
                step[0] = back[0] = 1
                self.up, self.down = np.cumprod(step), np.cumprod(back)

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        self._grow(len(data))
        folded = np.frombuffer(data.translate(FOLD), np.uint8)
        edges = np.diff(np.concatenate([[0], (folded != 32).view(np.int8), [0]]).astype(np.int8))
        start, end = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(folded * self.up[: len(data)], out=sums[1:])
            return mixed((sums[end] - sums[start]) * self.down[start] + np.uint64(1)), end

    def hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and end of each word of ``data``; a long text goes in pieces that end between words."""
        found, at = [], 0
        while at < len(data) or not found:
            cut = _BETWEEN.search(data, at + CHUNK) if len(data) > at + CHUNK else None
            end = cut.start() if cut else len(data)
            piece, ends = self._piece(data[at:end])
            found.append((piece, ends + at))
            at = max(end, at + 1)
        return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_groups(texts: list[str | None], hasher: WordHasher, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of texts of about ``chunk`` bytes, or one longer: the first text's index, its words' hashes, and offsets of each text's words."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    first = 0
    while first < len(data):
        last, size = first, 0
        while last < len(data) and (last == first or size + len(data[last]) < chunk):
            size += len(data[last]) + 1
            last += 1
        ends = np.cumsum([len(d) + 1 for d in data[first:last]])
        hashes, at = hasher.hashes(b"\n".join(data[first:last]) + b"\n")
        yield first, hashes, np.concatenate([[0], np.searchsorted(at, ends, side="left")])
        first = last
