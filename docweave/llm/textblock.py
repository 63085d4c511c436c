"""Vectorised word and line work on Arrow string buffers.

A block is the concatenated UTF-8 of a few rows with their offsets. Words, lines and hashes are
computed for all its rows at once with numpy; no Python string is made per word.
Hashes are 64-bit tabulation hashes, the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
HASH_BYTES = 1 << 16  # of spans hashed at a time; the arrays for it take some seventy times as much
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(0, 2**64, size=(64, 256), dtype=np.uint64)
_FLAT = _TABLE.reshape(-1)
_FAR = _rng.integers(0, 2**64, size=4096, dtype=np.uint64) | U(1)
_STEP = U(0x9E3779B97F4A7C15)


def lut_is_space() -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[[0x20, *range(0x09, 0x0E)]] = True
    return lut


def lut_lower() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


def trim() -> None:
    """Return freed memory to the system: workers live on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with about ``size`` bytes of text; a longer row is alone."""
    n = batch.num_rows
    if not n:
        return
    offsets = _offsets(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end
    trim()


def _offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if not len(arr):
        return np.zeros(1, np.int64)
    return np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


class Block:
    """Rows' text as bytes. ``doc`` arrays below number rows within the block; null reads as empty."""

    def __init__(self, arr: pa.Array):
        if arr.null_count:
            arr = arr.fill_null("")
        off = _offsets(arr)
        self.n = len(arr)
        raw = arr.buffers()[2] if self.n else None
        self.data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.offsets = off - off[0]

    def spans(self, is_sep: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the maximal runs of bytes that aren't separators."""
        data = self.data if data is None else data
        word = np.zeros(len(data) + 1, bool)
        np.logical_not(is_sep[data], out=word[:-1])
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = self.offsets[1:-1]
        inner = inner[inner < len(data)]
        first[inner] = word[inner]  # a run that crosses a row boundary is two
        last = word[:-1] & ~word[1:]
        cut = inner[inner > 0] - 1
        last[cut] = word[cut]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def line_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of lines split at a newline, as str.split does; empty lines count."""
        breaks = np.flatnonzero(self.data == 10)
        rows = np.searchsorted(self.offsets, breaks, side="right") - 1
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([self.offsets[1:], breaks])
        row = np.concatenate([np.arange(self.n), rows])
        order = np.lexsort((starts, row))
        starts, row = starts[order], row[order]
        ends = ends[np.lexsort((ends, np.concatenate([np.arange(self.n), rows])))]
        return starts, ends, row


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes. Spans ascend and don't overlap."""
    out, at = np.zeros(len(starts), np.uint64), 0
    before = np.cumsum(ends - starts)
    while at < len(starts):
        end = int(np.searchsorted(before, (before[at - 1] if at else 0) + HASH_BYTES, side="right"))
        end = max(end, at + 1)
        out[at:end] = _span_hash(data, starts[at:end], ends[at:end], seed)
        at = end
    return out


def _span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    lens = ends - starts
    total = int(lens.sum())
    out = np.full(len(starts), U(seed), np.uint64)
    if total:
        shift = np.cumsum(lens) - lens
        pos = np.arange(total, dtype=np.int64)
        pos -= np.repeat(shift, lens)
        at = pos + np.repeat(starts, lens)
        key = ((pos & 63) << 8) | data[at]
        val = _FLAT[key]
        if int(lens.max()) > 64:
            far = pos >> 6
            val = np.where(far > 0, val * _FAR[far & 4095] + (far >> 12).astype(np.uint64) * val, val)
        full = lens > 0
        out[full] += np.add.reduceat(val, shift[full])
    return mix(out + lens.astype(np.uint64) * _STEP)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a copy."""
    h = h.copy()
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def window_hash(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k successive entries, by doubling; empty if there are fewer than k."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, cur, width, bits = None, 0, word, 1, k
    while bits:
        if bits & 1:
            out = cur[:n].copy() if out is None else out * U(pow(int(_STEP), width, 1 << 64)) + cur[have : have + n]
            have += width
        bits >>= 1
        if bits:
            m = len(cur) - width
            cur = cur[:m] * U(pow(int(_STEP), width, 1 << 64)) + cur[width : width + m]
            width *= 2
    return mix(out)


def in_one_row(row: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k successive spans lie in one row."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1 : k - 1 + n] if n > 0 else np.zeros(0, bool)


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places lie in any [s, s+k)."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + k, n), minlength=n + 1)
    return np.cumsum(d[:n]) > 0
