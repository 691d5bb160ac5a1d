"""Words of UTF-8 texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_ODD = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
#: Words are hashed as polynomials in pieces of so many bytes.
_PIECE = 1024


def _powers() -> np.ndarray:
    out, x = [], 1
    for _ in range(_PIECE):
        out.append(x)
        x = x * _ODD & _MASK
    return np.array(out, dtype=np.uint64)


_POWERS = _powers()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z in lower case, parted by ASCII white space), and where each begins in the data."""
    b = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    letters = _LOWER[b[~space]].astype(np.uint64) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    if int(sizes.max()) <= _PIECE:
        return mix64(np.add.reduceat(letters * _POWERS[place], first) + sizes.astype(np.uint64)), starts
    # Longer words are hashed piece by piece; each piece's sum is mixed with its number before the sums are added.
    cut = np.flatnonzero(place % _PIECE == 0)
    sums = mix64(np.add.reduceat(letters * _POWERS[place % _PIECE], cut) + (place[cut] // _PIECE).astype(np.uint64) * np.uint64(_ODD))
    word = np.searchsorted(cut, first)
    one = np.add.reduceat(letters * _POWERS[place % _PIECE], cut)[word]
    total = np.add.reduceat(sums, word)
    return mix64(np.where(sizes <= _PIECE, one, total) + sizes.astype(np.uint64)), starts
