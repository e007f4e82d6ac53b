"""Array helpers that the text operators share inside tasks.

Spark deals rows to tasks and hands each task Arrow batches; these functions look at the UTF-8 bytes of such a batch
without making a Python object per row or word.  Nothing here knows about Spark, and nothing keeps state.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one step looks at; a single longer text makes a step of its own.
STEP_BYTES = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

#: Byte classes.
SPACE, LETTER, DIGIT, MARK = 0, 1, 2, 3


def _classes() -> np.ndarray:
    table = np.full(256, MARK, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    for low, high, kind in ((65, 90, LETTER), (97, 122, LETTER), (128, 255, LETTER), (48, 57, DIGIT)):
        table[low : high + 1] = kind
    return table


CLASS = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def steps(column: pa.Array | pa.ChunkedArray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; null texts are empty.

    ``offsets`` has one entry more than there are rows and starts at 0 within ``bytes``.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    ends = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        size = np.diff(ends) * ~np.asarray(column.is_null())
        raw = np.concatenate([raw[a : a + s] for a, s in zip(ends[:-1], size, strict=True)]) if size.sum() else raw[:0]
        ends = np.concatenate([[0], np.cumsum(size)])
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, last, raw[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
        row = last


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give back what freed batches and arrays have left with the allocators: a reused worker would keep it for other stages."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one memory is given back."""
    for batch in batches:
        yield batch
        batch = None
    release()


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte letters U+00C0 to U+00DE; other bytes as they are."""
    low = LOWER[raw]
    if len(raw) > 1 and (raw >= 0x80).any():
        second = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        low[second] += 32
    return low


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one non-space class; a run never crosses a row of ``offsets``."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.empty(len(kind), bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut[offsets[:-1][offsets[:-1] < len(kind)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(kind))
    keep = kind[starts] != SPACE
    return starts[keep], ends[keep]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes, eight bytes at a time; spans of eight bytes or less cost one step."""
    sizes = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(raw) + 1,), (1,))
    out = mix(sizes.astype(np.uint64) * _ODD + np.uint64(seed))
    live = np.arange(len(starts))
    done = 0
    while len(live):
        left = sizes[live] - done
        part = eight[starts[live] + done]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[live] = mix(out[live] * _ODD ^ part)
        done += 8
        live = live[left > 8]
    return out


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of ``offsets`` that each start lies in."""
    return np.searchsorted(offsets, starts, "right") - 1


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i]+1, ... (sizes[i] of them) for all i, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) - np.repeat(ends - sizes - first, sizes)
