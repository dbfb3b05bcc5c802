"""Scalar functions of ranking: BM25, token weights in a byte, position decay, and the variable-byte code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
MAX_POSITION = 65535
MAX_WEIGHT = 8.0


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.when(n_docs <= 0, F.lit(0.0)).otherwise(F.log((n_docs - df + 0.5) / (df + 0.5) + 1))


def bm25_score(idf: Column, tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    ratio = F.when(average <= 0, F.lit(1.0)).otherwise(length / average)
    return F.when(tf <= 0, F.lit(0.0)).otherwise(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio)))


def term_score(idf: Column, tf: Column, k1: float = K1) -> Column:
    """Of a matching leaf in search, where a document's length counts as the field's average."""
    return idf * tf * (k1 + 1) / (tf + k1)


def idf(n_docs: int, df: int) -> float:
    return math.log((n_docs - df + 0.5) / (df + 0.5) + 1) if n_docs > 0 else 0.0


def quantize_weight(w: Column) -> Column:
    w = w.cast("double")
    return F.when(w.isNull() | (w <= 0), F.lit(0)).when(w >= MAX_WEIGHT, F.lit(255)).otherwise(F.floor(w * 255 / MAX_WEIGHT + 0.5)).cast("smallint")


def dequantize_weight(q: Column) -> Column:
    return (q * F.lit(MAX_WEIGHT) / 255).cast("float")


def position_decay(decay: Column, position: Column, average: Column) -> Column:
    """exp(-decay * position / average), null unless both decay and average are above 0."""
    return F.when((decay > 0) & (average > 0), F.exp(-decay * position / average))


def varbyte_encode(value: int) -> bytes:
    """Seven bits a byte, the low ones first; the high bit marks that more follow."""
    if value < 0:
        raise ValueError("negative")
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def varbyte_decode(data: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """(value, next place). Raises ValueError on a value that breaks off or doesn't fit."""
    value = shift = 0
    for i in range(at, len(data)):
        value |= (data[i] & 127) << shift
        if value >> bits:
            raise ValueError("the value doesn't fit")
        if data[i] < 128:
            return value, i + 1
        shift += 7
        if shift >= bits:
            raise ValueError("the value doesn't fit")
    raise ValueError("the value breaks off")
