"""Stored sizes: closed forms where there are any, measured where there are none."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa

from ..functions.domain import Ceil, Fixed, fraction_bits, precision_of

HEADER_BITS = 72  # base (or first value) of 64 bits and the width


def _width(x: np.ndarray) -> int:
    return int(x.max()).bit_length() if len(x) else 0


def bit_packed(codes: np.ndarray) -> int:
    """Bytes of frame-of-reference packing."""
    return -(-(HEADER_BITS + len(codes) * _width(codes - codes.min() if len(codes) else codes)) // 8)


def delta_packed(codes: np.ndarray) -> int:
    """Bytes of zigzag differences at their greatest width."""
    d = np.diff(codes)
    return -(-(HEADER_BITS + len(codes) * _width((d << 1) ^ (d >> 63))) // 8)


def sprintz(x: np.ndarray, scale: int) -> int:
    return delta_packed(np.ceil(x * Ceil(scale).scale).astype(np.int64))


def fixed_point(x: np.ndarray, scale: int) -> int:
    """Bytes of byte-sliced fixed point: whole byte planes."""
    bits = Fixed(fraction_bits(precision_of(scale))).bits
    c = (np.sign(x) * np.floor(np.abs(x) * 2.0**bits)).astype(np.int64)
    return 20 + len(c) * -(-_width(c - c.min() if len(c) else c) // 8)


def gorilla(x: np.ndarray) -> int:
    """Bytes of XOR coding with leading and trailing zero blocks (values only).

    A repeat takes one bit; a value inside the block before it two and the
    block's bits; any other two, 5 for the zeros, 6 for the length, and its bits.
    """
    bits, lead, trail = 64, 65, 0
    words = np.asarray(x, np.float64).view(np.uint64).tolist()
    for a, b in zip(words, words[1:], strict=False):
        v = a ^ b
        if not v:
            bits += 1
            continue
        zl, zt = min(31, 64 - v.bit_length()), (v & -v).bit_length() - 1
        if lead <= 64 and zl >= lead and zt >= trail:
            bits += 2 + 64 - lead - trail
        else:
            lead, trail = zl, zt
            bits += 13 + 64 - zl - zt
    return -(-bits // 8) if len(words) else 0


def byte_codec(x: np.ndarray, name: str, level: int | None = None) -> int:
    """Bytes after a general compressor: snappy, gzip, zlib or deflate."""
    raw = np.asarray(x, "<f8").tobytes()
    if name == "snappy":
        return pa.compress(raw, codec="snappy", asbytes=True).__len__()
    if name == "gzip":
        return len(gzip.compress(raw, 6 if level is None else level))
    if name == "zlib":
        return len(zlib.compress(raw, 6 if level is None else level))
    if name == "deflate":
        z = zlib.compressobj(6 if level is None else level, zlib.DEFLATED, -15)
        return len(z.compress(raw) + z.flush())
    raise ValueError(f"no byte codec {name}")


def raw_size(n: int) -> int:
    return 8 * n


def segment_bytes(x: np.ndarray) -> bytes:
    """A length and the values, little-endian."""
    return struct.pack("<Q", len(x)) + np.asarray(x, "<f8").tobytes()


def segment_values(raw: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", raw)
    return np.frombuffer(raw, "<f8", n, 8)


#: Lossless methods by name, each a function of values and scale.
LOSSLESS = {
    "buff": fixed_point,
    "sprintz": sprintz,
    "snappy": lambda x, scale: byte_codec(x, "snappy"),
    "gorilla": lambda x, scale: gorilla(x),
    "gzip": lambda x, scale: byte_codec(x, "gzip"),
    **{f"zlib{n}": (lambda x, scale, n=n: byte_codec(x, "zlib", n)) for n in (1, 2, 5, 7, 9)},
}
