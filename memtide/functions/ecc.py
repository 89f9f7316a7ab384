"""Page error correction: three bytes for each 128 bytes, in numpy for images and in SQL for tables of bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 128
# What the three bytes start from, and the bits of a byte that each column parity covers.
SEEDS = (0x77, 0x7F, 0x7F)
MASKS = (0x55, 0x33, 0x0F, 0x00, 0xAA, 0xCC, 0xF0)

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)
_PARITY = (_BITS & 1).astype(np.uint8)
_COLUMN = sum((_PARITY[np.arange(256) & m].astype(np.uint8) << k for k, m in enumerate(MASKS)), np.zeros(256, np.uint8)).astype(np.uint8)
_INDEX = np.arange(CHUNK, dtype=np.uint8)


def calculate(chunks: np.ndarray) -> np.ndarray:
    """(n, 3) codes of (n, 128) bytes."""
    odd = _PARITY[chunks].astype(bool)
    up = np.bitwise_xor.reduce(np.where(odd, _INDEX, 0).astype(np.uint8), axis=1)
    down = np.bitwise_xor.reduce(np.where(odd, ~_INDEX, 0).astype(np.uint8), axis=1)
    column = np.bitwise_xor.reduce(_COLUMN[chunks], axis=1)
    return np.column_stack([SEEDS[0] ^ column, (SEEDS[1] ^ down) & 0x7F, SEEDS[2] ^ up]).astype(np.uint8)


OK, DATA_FIXED, CODE_WRONG, FAILED = 0, 1, 2, 3


def correct(chunks: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corrected chunks, state of each): one flipped bit of data is put right, one of the code ignored, more is a failure."""
    want = calculate(chunks)
    c, d, u = ((want[:, k] ^ codes[:, k]) & m for k, m in enumerate((0x77, 0x7F, 0x7F)))
    state = np.full(len(chunks), FAILED, np.uint8)
    out = chunks.copy()
    same = (want == codes).all(1)
    flip = ~same & ((d ^ u) == 0x7F) & (((c >> 4) ^ (c & 7)) == 7)
    rows = np.flatnonzero(flip)
    out[rows, u[rows]] ^= (1 << (c[rows] >> 4)).astype(np.uint8)
    lone = ~same & ~flip & ((_BITS[c] + _BITS[d] + _BITS[u] == 0) | (_BITS[c] + _BITS[d] + _BITS[u] == 1))
    state[lone], state[flip], state[same] = CODE_WRONG, DATA_FIXED, OK
    return out, state


def column_parity(byte: Column) -> Column:
    out = F.lit(0)
    for k, m in enumerate(MASKS):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(byte.bitwiseAND(F.lit(m))).cast("int") % 2, k))
    return out


def codes(bytes_: DataFrame, *keys: str, index: str = "i", byte: str = "b") -> DataFrame:
    """(keys, cp, l0, l1): codes of 128-byte chunks given as rows (keys, index 0-127, byte), by XOR aggregates.

    XOR is associative, so the aggregate is partial before the shuffle and a chunk crosses it as one row.
    """
    odd = F.bit_count(F.col(byte)) % 2 == 1
    return bytes_.groupBy(*keys).agg(
        F.lit(SEEDS[0]).bitwiseXOR(F.bit_xor(column_parity(F.col(byte)))).alias("cp"),
        F.lit(SEEDS[1]).bitwiseXOR(F.bit_xor(F.when(odd, F.bitwise_not(F.col(index))).otherwise(0))).bitwiseAND(F.lit(0x7F)).alias("l0"),
        F.lit(SEEDS[2]).bitwiseXOR(F.bit_xor(F.when(odd, F.col(index)).otherwise(0))).bitwiseAND(F.lit(0xFF)).alias("l1"),
    )
