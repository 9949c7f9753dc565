"""Word shingles of whole texts as sorted arrays of 64-bit hashes.

Words are runs of anything but space and the control characters from tab to return, after
lower-casing A-Z. A set holds the distinct runs of ``width`` words; a text with fewer words
has its whole sequence as one shingle; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_S33 = np.uint64(33)


def words(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() touch exactly A-Z and the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _S33)
    x = x * _MIX1
    x = x ^ (x >> _S33)
    x = x * _MIX2
    return x ^ (x >> _S33)


def shingle_hashes(tokens: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The hash of each run of ``width`` words, in order, with repeats."""
    n = len(tokens)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00short\x00" + b" ".join(tokens))], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        # each position has its own odd factor before mixing, so order matters
        total = mixed(total ^ (each[k : n - width + 1 + k] * _PLACE[k % 5] + np.uint64(k)))
    return total


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(words(text), width))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0:
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
