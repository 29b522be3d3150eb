"""Words and word shingles of whole texts as flat numpy arrays.

A word is a run of bytes other than space and 0x09 to 0x0D; UTF-8 never uses
those bytes inside a character, so the words are those of the code points.
Texts are worked in blocks of about one megabyte; a longer text is cut between
words, so memory follows the number of words, not the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
WHITE = b" \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(size, np.uint64(base & (1 << 64) - 1))
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; a missing one is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def batches(data: Sequence[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes together."""
    start, size = 0, 0
    for i, item in enumerate(data):
        if size and size + len(item) > limit:
            yield start, i
            start, size = i, 0
        size += len(item) + 1
    if start < len(data):
        yield start, len(data)


def _hash_run(raw: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(raw, dtype=np.uint8)
    if lower:
        codes = _LOWER[codes]
    space = _IS_SPACE[codes]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    powers, inverse = _powers(max(2 * BLOCK, 1 << len(codes).bit_length()))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


def _cut(raw: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut after white space; a longer word stays whole."""
    at = 0
    while len(raw) - at > 2 * BLOCK:
        end = max(raw.rfind(bytes([c]), at, at + BLOCK) for c in WHITE)
        if end < 0:
            later = [p for c in WHITE if (p := raw.find(bytes([c]), at + BLOCK)) >= 0]
            if not later:
                break
            end = min(later)
        yield raw[at : end + 1]
        at = end + 1
    yield raw[at:]


def word_hashes(data: Sequence[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the bounds of each text's words (one more than texts)."""
    if len(data) == 1 and len(data[0]) > 2 * BLOCK:
        hashes = np.concatenate([_hash_run(part, lower)[2] for part in _cut(data[0])])
        return hashes, np.array([0, len(hashes)])
    starts, _, hashes = _hash_run(b"\n".join(data), lower)
    at = np.cumsum([0] + [len(x) + 1 for x in data])
    return hashes, np.searchsorted(starts, at)


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` words within a text, and where it starts.

    Positions count through all texts of the block; texts with fewer words have none.
    """
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    last = len(hashes) - width + 1
    total = np.zeros(last, dtype=np.uint64)
    for j in range(width):
        total = total * _STEP + hashes[j : j + last]
    inside = np.ones(last, dtype=bool)
    for b in bounds[1:-1]:
        inside[max(0, b - width + 1) : b] = False
    at = np.flatnonzero(inside)
    return mix(total[at]), at


def shingle_sets(data: Sequence[bytes], width: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer words has its whole word sequence as its one shingle; a
    text without words has none.
    """
    out: list[np.ndarray] = []
    for first, last in batches(data):
        hashes, bounds = word_hashes(data[first:last], lower)
        found, at = windows(hashes, bounds, width)
        cuts = np.searchsorted(at, bounds)
        for i in range(last - first):
            n = int(bounds[i + 1] - bounds[i])
            if n >= width:
                out.append(np.unique(found[cuts[i] : cuts[i + 1]]))
            elif n:
                total = np.uint64(n)
                with np.errstate(over="ignore"):
                    for h in hashes[bounds[i] : bounds[i + 1]]:
                        total = total * _STEP + h
                out.append(mix(np.array([total], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out
