"""Vectorised tokenising and hashing of UTF-8 bytes.

A token is a longest run of word bytes (letters, digits, ``_``, any byte of a
non-ASCII character) or of symbol bytes; bytes up to the space separate.
Every token gets a 64-bit polynomial hash, so no string objects are made and
memory follows the chunk, never the vocabulary.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
REPEAT = np.uint64(0x5851F42D4C957F2D)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

CLASSES = np.full(256, 2, np.uint8)
CLASSES[:33] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (95, 96), (128, 256)):
    CLASSES[_a:_b] = 1

_VALUES = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 64)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE), np.full(size, _INV)
            up[0] = down[0] = 1
            _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the tokens of a byte array."""
    kinds = CLASSES[data]
    change = np.flatnonzero(np.diff(kinds)) + 1
    edges = np.concatenate(([0], change, [len(data)])) if len(data) else np.zeros(1, np.int64)
    starts, ends = edges[:-1], edges[1:]
    keep = kinds[starts] != 0
    starts, ends = starts[keep], ends[keep]
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * down[starts]
    return starts, ends, mix(hashes + (ends - starts).astype(np.uint64))


def pieces(raw: bytes, limit: int = CHUNK):
    """``raw`` cut behind white space into parts of about ``limit`` bytes."""
    at = 0
    while len(raw) - at > limit:
        cut = max(raw.rfind(b" ", at, at + limit), raw.rfind(b"\n", at, at + limit)) + 1
        cut = cut if cut > at else at + limit
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring tokens, in order; a token that repeats the last one gives the same hash whatever it is."""
    with np.errstate(over="ignore"):
        return np.where(hashes[:-1] == hashes[1:], REPEAT, mix(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:]))
