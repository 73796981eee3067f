"""Value domains: what a column's values become under a codec.

A domain has an integer code per value, so that predicates are encoded once and
compared in the codes, and a decoded value. All are column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fractional bits for 1 to 11 decimals.
PRECISION_BITS = (5, 8, 11, 15, 18, 21, 25, 28, 31, 35, 38)


def fraction_bits(precision: int) -> int:
    """Fractional bits of a number of decimals; more than 11 are not representable."""
    if not 1 <= precision <= len(PRECISION_BITS):
        raise ValueError(f"precision must be 1 to {len(PRECISION_BITS)}, not {precision}")
    return PRECISION_BITS[precision - 1]


def precision_of(scale: int) -> int:
    """Decimals of a power of ten."""
    p = round(math.log10(scale)) if scale > 0 else 0
    if p < 1 or 10**p != scale:
        raise ValueError(f"scale must be a power of ten from 10 up, not {scale}")
    return p


def precision_bound(precision: int) -> float:
    """Greatest error that leaves this many decimals intact, e.g. 0.000049 for 4."""
    return float("0." + "0" * precision + "49")


@dataclass(frozen=True)
class Raw:
    """Lossless storage: values are what they were."""

    def code(self, x: Column) -> Column:
        return x

    def decode(self, x: Column) -> Column:
        return x


@dataclass(frozen=True)
class Fixed:
    """Binary fixed point: magnitudes truncated to the fractional bits."""

    bits: int

    @classmethod
    def of(cls, precision: int) -> Fixed:
        return cls(fraction_bits(precision))

    @classmethod
    def partial(cls, precision: int, of: int, whole_bytes: bool = False) -> Fixed:
        """Only as many bits as ``precision`` of ``of`` decimals need; 0 keeps integers.

        With ``whole_bytes`` the bits are rounded up to byte planes.
        """
        bits = fraction_bits(precision) if precision else 0
        if whole_bytes:
            bits = -(-bits // 8) * 8
        return cls(min(bits, fraction_bits(of)))

    def code(self, x: Column) -> Column:
        return (F.signum(x) * F.floor(F.abs(x) * float(2**self.bits))).cast("long")

    def decode(self, x: Column) -> Column:
        return F.signum(x) * F.floor(F.abs(x) * float(2**self.bits)) / float(2**self.bits)


@dataclass(frozen=True)
class Ceil:
    """Decimal scaling rounded up; predicates are rounded up as well."""

    scale: int

    def code(self, x: Column) -> Column:
        return F.ceil(x * float(self.scale)).cast("long")

    def decode(self, x: Column) -> Column:
        return F.ceil(x * float(self.scale)) / float(self.scale)


@dataclass(frozen=True)
class Truncated:
    """The top ``bits`` of fixed-point offsets from the column's minimum.

    ``base`` and ``length`` (in fixed-point units and bits) come from the column;
    below 8 bits the first value stands for all, see ``codecs.transforms.first_value``.
    """

    fixed: Fixed
    base: int
    length: int
    bits: int

    def code(self, x: Column) -> Column:
        drop = max(0, self.length - self.bits)
        return F.shiftleft(F.shiftright(self.fixed.code(x) - F.lit(self.base), drop), drop) + F.lit(self.base)

    def decode(self, x: Column) -> Column:
        return self.code(x) / float(2**self.fixed.bits)


Domain = Raw | Fixed | Ceil | Truncated


def unsigned_code(x: Column, scale: float) -> Column:
    return F.abs(F.ceil(x * F.lit(scale))).cast("long")


def signed_code(x: Column, scale: float) -> Column:
    return F.ceil(x.cast("float").cast("double") * F.lit(scale)).cast("int")


def truncate_mantissa(values: np.ndarray, precision: int) -> np.ndarray:
    """Values with low mantissa bits cut while the error stays below the bound."""
    return cut_mantissas(values, precision, 0)[0]


def cut_mantissas(values: np.ndarray, precision: int, at: int) -> tuple[np.ndarray, int]:
    """The same from bit ``at`` on, and where the last value's cut ended.

    The cut starts where the value before it ended, so order matters. At a cut
    the lowest kept bit is set.
    """
    bound = precision_bound(precision)
    bits = np.asarray(values, np.float64).view(np.uint64)
    out = np.empty(len(bits), np.uint64)
    full = (1 << 64) - 1

    def cut(word: int, pos: int) -> int:
        return word & (full << pos & full) | 1 << pos

    def off(word: int, other: int) -> float:
        pair = np.array([word, other], np.uint64).view(np.float64)
        return abs(float(pair[0] - pair[1]))

    for i, word in enumerate(bits.tolist()):
        best = cut(word, at)
        if off(word, best) < bound:
            while at < 52:
                at += 1
                further = cut(word, at)
                if not off(word, further) < bound:
                    break
                best = further
        else:
            while at > 0:
                at -= 1
                nearer = cut(word, at)
                if off(word, nearer) < bound:
                    best = nearer
                    break
        out[i] = best
    return out.view(np.float64), at


def mantissa_truncated(df, value: str, order: str, by: list[str], precision: int):
    """``value`` after mantissa truncation, series by series in order.

    A series is cut in sequence by one task, in Arrow batches: it is not held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b.column(c).to_pylist() for c in by), strict=True))
            x, out = b.column(value).to_numpy(zero_copy_only=False).astype(float), []
            cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if keys[lo] != last:
                    last, at = keys[lo], 0
                part, at = cut_mantissas(x[lo:hi], precision, at)
                out.append(part)
            yield b.set_column(b.schema.get_field_index(value), value, pa.array(np.concatenate(out)))

    return df.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, df.schema)
