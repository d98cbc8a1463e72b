"""Scalar functions as column expressions, and the few that need Python."""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def byte_at(hex_id: Column, k: int) -> Column:
    """The value of byte ``k`` (from 0) of an id in hex."""
    return F.conv(F.substring(hex_id, 2 * k + 1, 2), 16, 10).cast("int")


def write_partition(hex_id: Column, parts: int = 64) -> Column:
    """The partition that an id is written to: its first byte, masked."""
    return byte_at(hex_id, 0).bitwiseAND(F.lit(parts - 1))


def has_any(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits)) != 0


def has_all(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits)) == bits


def quantised(component: Column) -> Column:
    """A component of -1..1 as an unsigned 32-bit number."""
    return F.least(F.greatest(F.floor((component + 1) * (2**31)), F.lit(0)), F.lit(2**32 - 1)).cast("bigint")


def placement(k: Column, n: Column) -> list[Column]:
    """Point ``k`` of ``n`` of the super-Fibonacci spiral on the unit 3-sphere: x, y, z, w."""
    phi = math.sqrt(2)
    psi = 1.533751168755204288118041  # fixed value: the positive root of psi ** 4 = psi + 4
    t = (k + 0.5) / n
    r, big = F.sqrt(t), F.sqrt(1 - t)
    a, b = 2 * math.pi * (k + 0.5) / phi, 2 * math.pi * (k + 0.5) / psi
    return [r * F.sin(a), r * F.cos(a), big * F.sin(b), big * F.cos(b)]


@F.pandas_udf(T.LongType())
def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(a.to_numpy(np.int64), b.to_numpy(np.int64)))


def reduced(numerator: Column, denominator: Column) -> Column:
    """Whether a fraction is in lowest terms; zero is 0/1."""
    return (denominator > 0) & (gcd(numerator, denominator) == 1)


@F.pandas_udf(T.StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    """Canonical decomposition (NFD), by the Unicode version of the Python that runs it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


def hilbert_index(point: list[int], bits: int) -> int:
    """The position of a point of unsigned ``bits``-bit coordinates on the Hilbert curve (Skilling's transform)."""
    x, n = list(point), len(point)
    q = 1 << bits - 1
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fold, q = 0, 1 << bits - 1
    while q > 1:
        if x[n - 1] & q:
            fold ^= q - 1
        q >>= 1
    out = 0
    for b in reversed(range(bits)):
        for v in x:
            out = out << 1 | (v ^ fold) >> b & 1
    return out


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """``hilbert_index`` of many points (a row of unsigned numbers each) of four dimensions: 16 bytes in hex, which sort as they do."""
    x = [column.astype(np.uint64) for column in points.T]
    for b in reversed(range(1, bits)):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(4):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, 4):
        x[i] = x[i] ^ x[i - 1]
    fold = np.zeros(len(points), np.uint64)
    for b in reversed(range(1, bits)):
        fold = np.where((x[3] >> np.uint64(b)) & np.uint64(1) != 0, fold ^ np.uint64((1 << b) - 1), fold)
    halves = np.zeros((len(points), 2), np.uint64)  # 64 bits each: the upper and the lower half of the bits
    for b in reversed(range(bits)):
        half = 0 if 4 * b >= 64 else 1
        for v in x:
            halves[:, half] = halves[:, half] << np.uint64(1) | ((v ^ fold) >> np.uint64(b)) & np.uint64(1)
    raw = halves.astype(">u8").tobytes()
    return np.array([raw[k : k + 16].hex() for k in range(0, len(raw), 16)], object)


def hilbert4(bits: int = 32):
    """A UDF from four quantised components (32-bit) to a sort key over their top ``bits`` bits, in numpy over whole columns."""

    @F.pandas_udf(T.StringType())
    def key(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hilbert_keys(np.column_stack([s.to_numpy(np.int64) >> 32 - bits for s in (a, b, c, d)]), bits))

    return key
