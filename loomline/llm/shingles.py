"""Word shingles of whole texts as sorted 64-bit hashes, a batch of texts at a time.

A-Z are lower-cased; words are runs of anything but blank and the characters 9
to 13. A shingle is five words in a row; a text of fewer words is one shingle,
one without words has none. Equal shingles have equal hashes. Different ones
collide as 64-bit hashes of random tables do: about once in 10**19 pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_random = np.random.Generator(np.random.PCG64(20240611))
BYTE = _random.integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
STEP, INVERSE = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
CHUNK = 1 << 20
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of STEP or its inverse."""
    have = _powers[which]
    if len(have) < n:
        factors = np.full(1 << (n - 1).bit_length(), STEP if which == "up" else INVERSE, np.uint64)
        factors[0] = 1
        _powers[which] = have = np.multiply.accumulate(factors)
    return have[:n]


def forget_powers() -> None:
    """Free the tables of powers; they are made again when needed."""
    _powers.update({which: np.ones(1, np.uint64) for which in _powers})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, cuts: np.ndarray, lower: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts laid end to end, each followed by a blank, and the number of words of each text."""
    blank = BLANK[data]
    edge = np.diff(blank.astype(np.int8), prepend=1, append=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[lower[data]] * _power("up", len(data)), out=sums[1:])
    words = mix((sums[end] - sums[begin]) * _power("down", len(data))[begin] + (end - begin).astype(np.uint64))
    return words, np.diff(np.searchsorted(begin, cuts), prepend=0)


def shingle_sets(texts: Sequence[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct hashes end to end, and the number of each text."""
    values, counts = [], []
    at = 0
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    while at < len(encoded):
        end, size = at, 0
        while end < len(encoded) and (end == at or size + len(encoded[end]) < CHUNK):
            size += len(encoded[end]) + 1
            end += 1
        v, c = _sets(encoded[at:end], width)
        values.append(v)
        counts.append(c)
        at = end
    return (np.concatenate(values), np.concatenate(counts)) if values else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _sets(encoded: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
    words, n = _word_hashes(data, np.cumsum(lengths))
    first = np.cumsum(n) - n
    per = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), per)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + first[doc]
    whole = n[doc] >= width
    h = np.full(len(doc), 0x243F6A8885A308D3, np.uint64)
    padded = np.r_[words, np.zeros(width, np.uint64)]
    for k in range(width):
        inside = whole | (k < n[doc])
        h = np.where(inside, mix((h ^ padded[start + k]) * STEP + np.uint64(k + 1)), h)
    ends = np.cumsum(per).tolist()
    for begin, end in zip([0, *ends[:-1]], ends, strict=True):
        h[begin:end].sort()
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.empty(0, bool)
    return h[new], np.bincount(doc[new], minlength=len(n))
