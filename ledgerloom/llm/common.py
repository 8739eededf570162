"""Helpers shared by the training-data operators: words of Arrow texts as numpy spans, and their hashes."""

from __future__ import annotations

import contextlib
import ctypes
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, materialize, table  # noqa: F401  used by the operators


U64 = np.uint64
#: Bytes for which the numpy helpers hold 8-byte arrays at a time.
PIECE = 1 << 20


# --- rows whose columns may have any name ---------------------------------------------


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``docs`` with its own columns in one struct ``row``, so that no helper column can clash with them."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), *columns)


def unpacked(rows: DataFrame, names: list[str], *columns: Column) -> DataFrame:
    """The named fields of ``row`` as columns again, and more columns."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names], *columns)


# --- texts as bytes -------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data uint8, offsets int64) of a string array without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    body = body[offsets[0] : offsets[-1]]
    return body, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = PIECE):
    """Ranges of rows of at most ``most`` bytes each; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def byte_class(excluded) -> np.ndarray:
    """Table of 256 booleans: True where a byte belongs to a word."""
    t = np.ones(256, bool)
    t[list(excluded)] = False
    return t


SPACES = [0x20, *range(0x09, 0x0E)]
NOT_SPACE = byte_class(SPACES)
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(starts, ends, first) of the words; words of row i are first[i]:first[i + 1]."""
    mask = is_word[data]
    n = len(mask)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = mask[:-1], mask[1:]
        begin = offsets[:-1]
        before[begin[begin < n]] = False
        ending = offsets[1:]
        after[ending[ending > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def give_back() -> None:
    """Free memory goes back to the system. A Python worker serves one stage after another and would keep the most that any of them held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


# --- hashes -----------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = U64(0x9E3779B97F4A7C15)
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def secret() -> int:
    """A seed for one run: nobody can write words beforehand that it hashes alike."""
    return secrets.randbits(63)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word from its length and its bytes, 8 at a time; those of two seeds are independent."""
    size = ends - starts
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)

    def eight(at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return rows[at].view("<u8")[:, 0] & _LOWEST[np.minimum(count, 8)]

    out = mix(mix(size.astype(np.uint64) * _BASE + U64(seed)) ^ eight(starts, size))
    left, at = np.flatnonzero(size > 8), 8
    long = left[size[left] > LONG_WORD]
    left = left[size[left] <= LONG_WORD]
    while len(left):
        out[left] = mix(out[left] * _BASE ^ eight(starts[left] + at, size[left] - at))
        at += 8
        left = left[size[left] > at]
    for k in long.tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    return mix(a * U64(0xD6E8FEB86659FD93) + (b ^ U64(0xA5A5A5A5F00DFACE)))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes, built by doubling; one fewer row per extra word."""
    parts, have, done = [], words, 1
    at, left = 0, size
    while left:
        if left & 1:
            parts.append((at, have))
            at += done
        left >>= 1
        if left:
            m = max(len(words) - 2 * done + 1, 0)
            have = joined(have[:m], have[done : done + m])
            done *= 2
    m = max(len(words) - size + 1, 0)
    out = parts[0][1][parts[0][0] : parts[0][0] + m]
    for offset, x in parts[1:]:
        out = joined(out, x[offset : offset + m])
    return out
