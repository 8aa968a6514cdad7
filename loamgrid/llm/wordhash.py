"""Hashes of words and word sequences, computed for whole texts with array operations.

Words are maximal runs of bytes that are not ASCII white space, which is what ``bytes.split`` finds.
A word's hash is a polynomial over a table of random byte values, modulo 2**64, mixed at the end; the
hash of a sequence is a polynomial over its words' hashes. Both have 64 bits.
"""

import numpy as np

_DRAW = np.random.Generator(np.random.PCG64(7206313))
_BYTES = _DRAW.integers(0, 1 << 64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 5)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_POWERS[0]) < n:
        have = len(_POWERS[0])
        for k, base in enumerate((_STEP, _BACK)):
            jump = np.uint64(pow(int(base), have, 1 << 64))
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * jump])
    return _POWERS[0][:n], _POWERS[1]


def normalise(text: str | None) -> bytes:
    """The words joined by one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split()) if text else b""


def bounds(norm: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a normalised text."""
    if not norm:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(norm)]])


def word_hashes(norm: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, back = _powers(len(norm))
    sums = np.zeros(len(norm) + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(norm, np.uint8)] * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words; fewer words than n give none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    last = len(words) - n + 1
    out = words[:last].copy()
    for k in range(1, n):
        out = out * _GRAM + words[k : k + last]
    return mix(out + np.uint64(n))
