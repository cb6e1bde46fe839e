"""Sorted hashes and small numbers in few bytes, for what tasks send each other."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_U = np.uint64


def sorted_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits, sorted, and where each of them was."""
    wide = max(1, len(keys)).bit_length()
    if bits + wide > 64:
        order = np.argsort(keys)
        return keys[order], order
    both = np.sort((keys << _U(wide)) | np.arange(len(keys), dtype=_U))  # a plain sort is many times as fast
    return both >> _U(wide), (both & _U((1 << wide) - 1)).astype(np.int64)


def planes(v: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each number, bit by bit."""
    return b"".join(np.packbits(((v >> _U(w)) & _U(1)).astype(np.uint8)).tobytes() for w in range(width))


def from_planes(b: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    out, step = np.zeros(n, dtype=_U), (n + 7) // 8
    for w in range(width):
        out |= np.unpackbits(np.frombuffer(b, dtype=np.uint8, count=step, offset=at + w * step), count=n).astype(_U) << _U(w)
    return out


def squeezed(s: np.ndarray, base: int) -> bytes:
    """Sorted hashes from base up, as differences in as many bits as all but the largest few need; those are added whole."""
    n = len(s)
    if not n:
        return b""
    d = np.diff(s, prepend=_U(base))
    width = int(np.partition(d, (n - 1) * 199 // 200)[(n - 1) * 199 // 200]).bit_length()
    large = np.flatnonzero(d >> _U(width)) if width < 64 else np.empty(0, dtype=np.int64)
    return struct.pack("<BII", width, n, len(large)) + planes(d, width) + large.astype("<u4").tobytes() + d[large].astype("<u8").tobytes()


def stretched(b: bytes | None, base: int) -> np.ndarray:
    if not b:
        return np.empty(0, dtype=_U)
    width, n, k = struct.unpack_from("<BII", b)
    d = from_planes(b, n, width, 9)
    at = 9 + width * ((n + 7) // 8)
    large = np.frombuffer(b, dtype="<u4", count=k, offset=at)
    d[large] = np.frombuffer(b, dtype="<u8", count=k, offset=at + 4 * k)
    return np.cumsum(d, dtype=_U) + _U(base)


def packed(v: np.ndarray, kind: str = "<u1") -> bytes:
    """Whole numbers, most of them small: in `kind` each, with those that are negative or too large added whole."""
    v = np.asarray(v, dtype=np.int64)
    most = np.iinfo(kind).max
    large = np.flatnonzero((v < 0) | (v >= most))
    small = v.copy()
    small[large] = most
    return zlib.compress(small.astype(kind).tobytes() + v[large].astype("<i8").tobytes() + struct.pack("<I", len(large)), 1)


def unpacked(b: bytes | None, kind: str = "<u1") -> np.ndarray:
    if not b:
        return np.empty(0, dtype=np.int64)
    raw = zlib.decompress(b)
    k = struct.unpack_from("<I", raw, len(raw) - 4)[0]
    out = np.frombuffer(raw[: len(raw) - 4 - 8 * k], dtype=kind).astype(np.int64)
    out[out == np.iinfo(kind).max] = np.frombuffer(raw, dtype="<i8", count=k, offset=len(raw) - 4 - 8 * k)
    return out
