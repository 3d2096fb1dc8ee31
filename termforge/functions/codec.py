"""Posting block codecs: variable-byte and raw, sizes in JVM expressions, bytes in Arrow UDFs.

Variable-byte: 7-bit groups, least significant first, the high bit set on the last byte of a
number. Raw: unsigned 32-bit little-endian.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def varbyte_encode(numbers) -> bytes:
    x = np.asarray(numbers, np.int64)
    if (x < 0).any():
        raise ValueError("negative number")
    if not len(x):
        return b""
    width = np.maximum(1, np.ceil(np.array([int(v).bit_length() for v in x]) / 7)).astype(np.int64)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]), np.uint8)
    starts = ends - width
    for k in range(int(width.max())):
        some = width > k
        out[starts[some] + k] = (x[some] >> (7 * k)) & 0x7F
    out[ends - 1] |= 0x80
    return out.tobytes()


def varbyte_decode(data: bytes) -> np.ndarray:
    """All complete numbers; a tail without a final byte is ignored."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(raw & 0x80)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    raw = raw[: ends[-1] + 1]
    number = np.repeat(np.arange(len(ends)), ends - starts + 1)
    place = np.arange(len(raw)) - starts[number]
    return np.add.reduceat((raw & 0x7F) << (7 * place), starts)


def docid_gaps(docids, base: int = 0) -> np.ndarray:
    x = np.diff(np.concatenate([[base], np.asarray(docids, np.int64)]))
    if (x < 0).any():
        raise ValueError("docids descend")
    return x


def docids_of(gaps, base: int = 0) -> np.ndarray:
    return np.cumsum(np.asarray(gaps, np.int64)) + base


def raw_encode(numbers) -> bytes:
    x = np.asarray(numbers, np.int64)
    if ((x < 0) | (x > 0xFFFFFFFF)).any():
        raise ValueError("not an unsigned 32-bit number")
    return x.astype("<u4").tobytes()


def raw_decode(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


@F.pandas_udf(T.BinaryType())
def varbyte(numbers: pd.Series) -> pd.Series:
    """array<bigint> -> bytes."""
    return numbers.map(varbyte_encode, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.LongType()))
def unvarbyte(data: pd.Series) -> pd.Series:
    """bytes -> array<bigint>."""
    return data.map(varbyte_decode, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.LongType()))
def block_docids(data: pd.Series, first: pd.Series) -> pd.Series:
    """Bytes of a block's gaps, and its first docid -> its docids."""
    gaps = data.map(varbyte_decode, na_action="ignore")
    return pd.Series([None if g is None else np.concatenate([[f], docids_of(g[1:], f)]) for g, f in zip(gaps, first, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def raw(numbers: pd.Series) -> pd.Series:
    """array<bigint> -> bytes, four a number."""
    return numbers.map(raw_encode, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.LongType()))
def unraw(data: pd.Series) -> pd.Series:
    """bytes -> array<bigint>."""
    return data.map(raw_decode, na_action="ignore")


def varbyte_size(x: Column) -> Column:
    """Bytes one non-negative number takes."""
    size = F.lit(1)
    for k in range(1, 9):
        size = size + F.when(x >= F.lit(1 << (7 * k)), 1).otherwise(0)
    return size
