"""Texts of an Arrow batch as one byte array, with words and hashes found by whole-array steps.

Everything here works on slices of a few megabytes, so memory is bounded by the slice (or by one
document, where a document is longer) and not by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES, LONG_BYTES = 1 << 19, 128

#: Bytes of white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: First bytes of code points (all but UTF-8 continuation bytes).
LEAD = (np.arange(256) & 0xC0) != 0x80

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; kept for later calls."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def majority_bits(h: np.ndarray) -> int:
    """The number whose bits are set in more than half of h (uint64); 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = the polynomial of data[i:j] times base**i."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), equal for equal strings wherever they stand."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64))


def string_hashes(data: np.ndarray, p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hashes() of data with prefix sums p, but XXH64 for spans of LONG_BYTES and more.

    Polynomials modulo a power of two give certain regular strings of about 1,000 bytes (a Thue-Morse word and its complement) one value.
    """
    out = span_hashes(p, start, end)
    for i in np.flatnonzero(end - start >= LONG_BYTES).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].data, 7)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together and len + 1 offsets into them; null counts as empty."""
    column = (column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces of at most `most` text bytes each, or of one row."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; no run crosses an offset in `at`."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(mask) + 1, bool)
    border[at] = True
    left = np.empty(len(mask), bool)
    left[0], left[1:] = True, ~mask[:-1]
    right = np.empty(len(mask), bool)
    right[-1], right[:-1] = True, ~mask[1:]
    return np.flatnonzero(mask & (left | border[:-1])), np.flatnonzero(mask & (right | border[1:])) + 1


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def owners(start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The index of the text that each start lies in (starts ascend)."""
    return np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))
