"""Bit streams of the lossless methods: bytes that decode to the same values.

Sizes without a stream are in ``size``; these agree with them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa


def xor_encode(x: np.ndarray) -> bytes:
    """A count and the values, each xor the one before it.

    One bit for a repeat; ``10`` and the block's bits where they fit the block of
    zeros before; ``11``, 5 bits of leading zeros, 6 of the length less one, and
    the bits otherwise.
    """
    words = np.asarray(x, np.float64).view(np.uint64).tolist()
    out = [f"{words[0]:064b}"] if words else []
    lead, trail = 65, 0
    for a, b in zip(words, words[1:], strict=False):
        v = a ^ b
        if not v:
            out.append("0")
            continue
        zl, zt = min(31, 64 - v.bit_length()), (v & -v).bit_length() - 1
        if lead <= 64 and zl >= lead and zt >= trail:
            out.append(f"10{v >> trail:0{64 - lead - trail}b}")
        else:
            lead, trail = zl, zt
            out.append(f"11{zl:05b}{63 - zl - zt:06b}{v >> zt:0{64 - zl - zt}b}")
    bits = "".join(out)
    bits += "0" * (-len(bits) % 8)
    return struct.pack("<I", len(words)) + (int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b"")


def xor_decode(raw: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", raw)
    if not n:
        return np.zeros(0)
    bits = bin(int.from_bytes(b"\x01" + raw[4:], "big"))[3:]
    words, at, lead, width = [int(bits[:64], 2)], 64, 0, 64
    while len(words) < n:
        if bits[at] == "0":
            words.append(words[-1])
            at += 1
            continue
        fresh, at = bits[at + 1] == "1", at + 2
        if fresh:
            lead, width, at = int(bits[at : at + 5], 2), int(bits[at + 5 : at + 11], 2) + 1, at + 11
        words.append(words[-1] ^ int(bits[at : at + width], 2) << (64 - lead - width))
        at += width
    return np.array(words, np.uint64).view(np.float64)


def pack(offsets: np.ndarray, base: int) -> bytes:
    """A base, a width, and non-negative numbers of that many bits each."""
    width = int(offsets.max()).bit_length() if len(offsets) else 0
    planes = (offsets.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return struct.pack("<qB", base, width) + np.packbits(planes.astype(np.uint8).ravel()).tobytes()


def unpack(raw: bytes, n: int) -> tuple[np.ndarray, int]:
    base, width = struct.unpack_from("<qB", raw)
    if not width:
        return np.zeros(n, np.int64), base
    planes = np.unpackbits(np.frombuffer(raw, np.uint8, offset=9), count=n * width).reshape(n, width)
    return (planes.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64), base


def frame_encode(codes: np.ndarray) -> bytes:
    """Offsets from the least code."""
    low = int(codes.min()) if len(codes) else 0
    return pack(codes - low, low)


def frame_decode(raw: bytes, n: int) -> np.ndarray:
    offsets, base = unpack(raw, n)
    return offsets + base


def delta_encode(codes: np.ndarray) -> bytes:
    """Zigzag differences; the first code is the base."""
    d = np.diff(codes, prepend=codes[:1])
    return pack((d << 1) ^ (d >> 63), int(codes[0]) if len(codes) else 0)


def delta_decode(raw: bytes, n: int) -> np.ndarray:
    z, base = unpack(raw, n)
    return base + np.cumsum((z >> 1) ^ -(z & 1))


def byte_round_trip(x: np.ndarray, name: str) -> np.ndarray:
    """Values after a general compressor and back."""
    raw = np.asarray(x, "<f8").tobytes()
    if name in ("snappy", "gzip"):
        back = pa.decompress(pa.compress(raw, codec=name, asbytes=True), len(raw), codec=name, asbytes=True) if raw else raw
    elif name in ("zlib", "deflate"):
        z = zlib.compressobj(6, zlib.DEFLATED, 15 if name == "zlib" else -15)
        back = zlib.decompress(z.compress(raw) + z.flush(), 15 if name == "zlib" else -15)
    else:
        raise ValueError(f"no byte codec {name}")
    return np.frombuffer(back, "<f8")


def round_trip(x: np.ndarray, name: str, scale: int) -> np.ndarray:
    """What a method's stream gives back: values, or codes scaled back."""
    if name == "gorilla":
        return xor_decode(xor_encode(x))
    if name in ("bp", "deltabp"):
        codes = np.ceil(x * scale).astype(np.int64)
        back = frame_decode(frame_encode(codes), len(x)) if name == "bp" else delta_decode(delta_encode(codes), len(x))
        return back / scale
    return byte_round_trip(x, name)
