"""Hashed terms of texts as counted buckets, a row per text: the same buckets as `vector.hashed_terms`, without a row per term.

Spark lower-cases a text and makes what is no letter, digit or underscore a space, so words are what its regular
expressions say; the rest is done for a megabyte of text at a time, MD5 included. Nothing is shuffled."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.lexicons import STOP_WORDS
from quillmark.runtime import ship_package

#: Bytes of text of one step, and spans that MD5 takes at a time.
STEP, SPANS = 1 << 20, 8192

_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_SHIFT = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in four]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_MASK = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_PAD = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)


def _unaligned(data: np.ndarray, kind: type) -> np.ndarray:
    """The number that begins at each byte; zeros follow the last one."""
    width = np.dtype(kind).itemsize
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    return np.ndarray((len(padded) - width + 1,), kind, padded, 0, (1,))


_STOP = np.sort(np.array([int.from_bytes(w.encode(), "little") for w in STOP_WORDS], np.uint64))
assert all(len(w.encode()) <= 8 for w in STOP_WORDS)


def _md5_block(at: np.ndarray, start: np.ndarray, length: np.ndarray, words: int) -> np.ndarray:
    """The first 32 bits of the MD5 of spans of less than 4 * words bytes, 55 at most."""
    m: list = [None] * 16
    for k in range(words):
        left = np.clip(length - 4 * k, -1, 4) + 1
        m[k] = (at[start + 4 * k] & _MASK[left]) | _PAD[left]
    m[14] = (length * 8).astype(np.uint32)
    n = len(start)
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three rounds make other words of the digest
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, _K[i], out=a)
        if m[_WORD[i]] is not None:
            np.add(a, m[_WORD[i]], out=a)
        np.left_shift(a, np.uint32(_SHIFT[i]), out=t)
        np.right_shift(a, np.uint32(32 - _SHIFT[i]), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


def md5_heads(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The number that the first eight hexadecimal digits of the MD5 of each span of bytes make."""
    out = np.zeros(len(start), np.uint32)
    at = _unaligned(data, np.uint32)
    for low, words in ((0, 3), (12, 6), (24, 14)):
        own = np.flatnonzero((length >= low) & (length < 4 * words))
        for k in range(0, len(own), SPANS):
            i = own[k : k + SPANS]
            out[i] = _md5_block(at, start[i], length[i], words)
    for i in np.flatnonzero(length > 55):
        out[i] = int.from_bytes(hashlib.md5(data[start[i] : start[i] + length[i]].tobytes()).digest()[:4], "big")
    return out


def counted(data: np.ndarray, offsets: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in a row, whose words are apart by spaces: row, bucket and count of each bucket, in this order."""
    from quillmark.llm.textvec import word_spans

    start, end, row = word_spans(data, offsets, data != 32)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = end - start
    packed = _unaligned(data, np.uint64)[start] & ((np.uint64(1) << (8 * np.minimum(length, 7)).astype(np.uint64)) - np.uint64(1) | np.where(length >= 8, np.uint64(0xFF << 56), np.uint64(0)))
    stop = (length <= 8) & (_STOP[np.minimum(np.searchsorted(_STOP, packed), len(_STOP) - 1)] == packed)
    keep = (points[end] - points[start] >= 2) & ~stop
    start, length, row = start[keep], length[keep], row[keep]
    # the words that stay, each with a space behind it, so that two neighbours are one span
    first = np.concatenate([[0], np.cumsum(length + 1)])
    own = np.concatenate([data, [np.uint8(32)]])[np.repeat(start - first[:-1], length + 1) + np.arange(first[-1])]
    own[first[1:] - 1] = 32
    pair = np.flatnonzero(row[1:] == row[:-1])
    at, size = np.concatenate([first[:-1], first[pair]]), np.concatenate([length, length[pair] + 1 + length[pair + 1]])
    key = np.concatenate([row, row[pair]]) * dim + md5_heads(own, at, size).astype(np.int64) % dim
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[new] // dim, key[new] % dim, np.diff(np.append(new, len(key)))


def spaced(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")


def dense(spark: SparkSession, text: Column, dim: int) -> Column:
    """Counts of hashed terms scaled to length one, as `dim` floats; zeros where there are no terms."""
    ship_package(spark)

    @F.arrow_udf("array<float>")
    def make(texts: pa.Array) -> pa.Array:
        from quillmark.llm.textvec import steps, take_rows, text_bytes

        data, offsets = text_bytes(texts)
        out = np.zeros((len(texts), dim), np.float32)
        for a, b in steps(offsets, STEP):
            row, bucket, n = counted(*take_rows(data, offsets, a, b), dim)
            out[a + row, bucket] = n / np.sqrt(np.bincount(row, n * n, minlength=b - a))[row]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))

    return make(spaced(text))
