"""Words of a text as numpy arrays: their places and 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of words that white space (space and \t to \r) sets apart.
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Bytes of words of a-z, 0-9 and anything beyond ASCII.
LETTERS = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit values spread evenly; one-to-one for each salt."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD to the powers 0..n-1, and its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            table = np.full(2 * n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def places(raw: bytes, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = kept[np.frombuffer(raw, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def places_within(raw: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """places() in texts laid end to end, where bounds has the start of each and the end of the last: no run goes on over a bound."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = kept[raw]
    start, end = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = bounds[inside[bounds] & inside[bounds + 1]]
    start[cut] = end[cut] = True
    return np.flatnonzero(start), np.flatnonzero(end)


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial of each run of 64-bit values: one over all of them, cut and shifted back to each run's start."""
    power, inverse = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mixed(spans(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), starts, ends))


def rolled(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(_ODD) + h[k : n + k]
    return mixed(out, salt)
