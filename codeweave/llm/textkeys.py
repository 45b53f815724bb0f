"""Hashes of words and shingles, computed on the bytes of Arrow string columns.

A word is a maximal run of bytes other than space and 09-0D (which never occur inside a multi-byte UTF-8
character); A-Z count as a-z. All hashes are 64 bits. Work is done in slices of about SLICE_BYTES, so that the
temporary arrays stay small; one document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        run = np.full(size, base, dtype=np.uint64)
        run[0] = 1
        have = np.cumprod(run, dtype=np.uint64)
        if size <= 8 * SLICE_BYTES:
            _powers[name] = have
    return have


@dataclass
class Slice:
    """Words of rows ``lo`` to ``hi`` of a batch: ``first[i]:first[i+1]`` are those of row ``lo + i``, whose bytes are
    ``data[bounds[i]:bounds[i+1]]``."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of a string column; null rows have no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + slice_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield _words(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def _words(lo: int, hi: int, data: np.ndarray, bounds: np.ndarray) -> Slice:
    n = len(data)
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~gap
    begin = word.copy()
    begin[1:] &= gap[:-1]
    stop = word.copy()
    stop[:-1] &= gap[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin[inner] |= word[inner]
    stop[inner - 1] |= word[inner - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * _power(_P, "p", n + 1)[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_P_INV, "q", n + 1)[starts]) if len(starts) else np.zeros(0, np.uint64)
    return Slice(lo, hi, data, bounds, starts, ends, hashes, np.searchsorted(starts, bounds))


def windows(s: Slice, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row (from 0 in the slice) and first word of every run of ``k`` words.

    With ``short``, a row of one to k-1 words gives its whole sequence as one run.
    """
    n = len(s.hashes)
    doc = s.doc_of()
    if n == 0:
        return s.hashes, doc, np.zeros(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            total[: n - j] += s.hashes[j:] * power
            power = power * _Q
    last = s.first[1:][doc]
    at = np.flatnonzero(np.arange(n) + k <= last)
    out, rows = mix(total[at]), doc[at]
    if short:
        counts = np.diff(s.first)
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            extra = np.empty(len(few), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for i, r in enumerate(few):
                    power, h = np.uint64(1), np.uint64(0x51ED270B)
                    for x in s.hashes[s.first[r] : s.first[r + 1]]:
                        h = h + x * power
                        power = power * _Q
                    extra[i] = h
            out, rows, at = np.concatenate([out, mix(mix(extra))]), np.concatenate([rows, few]), np.concatenate([at, s.first[few]])
            order = np.argsort(rows, kind="stable")
            out, rows, at = out[order], rows[order], at[order]
    return out, rows, at


def distinct_windows(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct run hashes of each row, one row after the other, and the rows' bounds in them."""
    h, rows, _ = windows(s, k, short=True)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rows = h[new], rows[new]
    return h, np.searchsorted(rows, np.arange(s.hi - s.lo + 1))
