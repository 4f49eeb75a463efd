"""Hashes of many byte ranges at once, with numpy: each is a polynomial of the range's bytes modulo 2**64."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n random-looking odd 64-bit numbers, the same ones every time."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        up, down = np.full(n, base, dtype=_U), np.full(n, pow(base, -1, 1 << 64), dtype=_U)
        up[0] = down[0] = 1
        _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[base]


#: Bytes that are hashed at once, and the length from which a range's hash is a digest of its bytes.
PIECE = 1 << 20


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    table = numbers(256, seed)
    base = int(numbers(1, seed + 77)[0])
    up, down = _powers(base, 1 << max(16, int(len(data)).bit_length()))
    prefix = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(table[data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of data[start:end] for each range, starts ascending; equal contents have equal hashes wherever they lie. data:
    uint8, of any length: beyond PIECE it is gone through piece by piece."""
    if len(data) <= PIECE:
        return _hashes(data, starts, ends, seed)
    out = np.empty(len(starts), dtype=_U)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(starts, a + PIECE))
        own, until = starts[i:j], ends[i:j]
        long = until - own > PIECE
        if not long.all():
            b = int(until[~long].max())
            out[i:j][~long] = _hashes(data[a:b], own[~long] - a, until[~long] - a, seed)
        for k in np.flatnonzero(long).tolist():
            digest = hashlib.blake2b(data[own[k] : until[k]], digest_size=8, salt=seed.to_bytes(16, "little")).digest()
            out[i + k] = int.from_bytes(digest, "little")
        i = j
    return out
