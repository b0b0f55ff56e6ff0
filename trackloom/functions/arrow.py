"""What has no built-in expression: truncating half floats and zstd, as Arrow-batched functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


def half_bits(x: np.ndarray) -> np.ndarray:
    """float32 to half by truncation: tiny values lose bits by a shift, large ones become infinite, the mantissa is cut."""
    f = np.ascontiguousarray(x, np.float32).view(np.int32)
    sign, exp, frac = (f >> 31) & 1, (f >> 23) & 0xFF, f & 0x7FFFFF
    tiny = (exp > 0) & (exp < 113)
    small = np.where(tiny, (frac | 0x800000) >> np.minimum(113 - np.minimum(exp, 113), 31), frac)
    new_exp = np.where(exp < 113, 0, np.where(exp < 142, exp - 112, 31))
    new_frac = np.where(tiny, small, np.where(exp >= 142, 0, frac))
    return ((sign << 15) | (new_exp << 10) | (new_frac >> 13)).astype(np.int64)


def half_value(h: np.ndarray) -> np.ndarray:
    return np.asarray(h, np.uint16).view(np.float16).astype(np.float64)


@F.pandas_udf(LongType())
def pack_half(x: pd.Series, y: pd.Series) -> pd.Series:
    """Two halves in one 32-bit word, the first in the low bits."""
    return pd.Series(half_bits(x.to_numpy(np.float32)) | half_bits(y.to_numpy(np.float32)) << 16)


@F.pandas_udf(DoubleType())
def unpack_low(word: pd.Series) -> pd.Series:
    return pd.Series(half_value(word.to_numpy(np.int64) & 0xFFFF))


@F.pandas_udf(DoubleType())
def unpack_high(word: pd.Series) -> pd.Series:
    return pd.Series(half_value(word.to_numpy(np.int64) >> 16 & 0xFFFF))


def zstd_level(level: int, size: int) -> int:
    """Level 0 chooses by size."""
    return level or (13 if size > 8 << 20 else 19)


def compress(data: bytes, level: int) -> bytes:
    return zstandard.ZstdCompressor(level=zstd_level(level, len(data))).compress(data)


def decompress(data: bytes, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=max(size, 1))


def planes(symbols: np.ndarray, width: int) -> bytes:
    """All low bytes, then all next bytes, and so on."""
    return np.ascontiguousarray(symbols.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def plane_entropy(data: bytes) -> float:
    """Bytes that an order-0 coder of the pooled planes would need."""
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    c = c[c > 0]
    return float(-(c * np.log2(c / c.sum())).sum() / 8) if len(c) else 0.0


def zz(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 2 * x, -2 * x - 1)


def unzz(z: np.ndarray) -> np.ndarray:
    return np.where(z % 2 == 0, z // 2, -(z + 1) // 2)
