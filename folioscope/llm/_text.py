"""Vectorised text primitives over Arrow string columns.

Everything works on UTF-8 bytes in numpy: the separators and the letters A-Z are ASCII, so byte
positions are safe to cut at.  A text that is null counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import _spark

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
_spark.forgets(_powers.clear)


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            with np.errstate(over="ignore"):
                have[done : done + step] = have[:step] * np.uint64(pow(base, done, 2**64))
            done += step
        _powers[base] = have
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    n = len(data)
    out = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((BYTE_LOWER if lower else BYTE)[data] * _power(_P, n)[:n], out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; depends on its content alone."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[begin]) * _power(_PINV, len(sums))[begin] + (end - begin).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_string_view(column.type) or pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, offsets: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``target`` bytes: first row, last row + 1, bytes, offsets."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word ``[^\\x20\\x09-\\x0D]+``, and each text's first word (with a closing total)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~SPACE[data]
    gap = np.empty(n + 1, bool)
    gap[0] = gap[n] = True
    gap[1:n] = edge[1:n]
    before = gap[:n].copy()
    before[1:] |= ~solid[:-1]
    after = gap[1:].copy()
    after[:-1] |= ~solid[1:]
    begin = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    return begin, end, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and each text's first word."""
    begin, end, first = words(data, offsets)
    return span_hash(prefix_sums(data, lower), begin, end), first


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and which key stands where."""
    order = np.argsort(keys)
    in_order = keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(in_order[1:], in_order[:-1], out=fresh[1:])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return in_order[fresh], order[fresh], which


_SHINGLE = np.array([pow(0xD6E8FEB86659FD93, k, 2**64) for k in range(64)], np.uint64)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word windows text by text, and each text's first window.

    A text with fewer words than ``width`` gives its whole sequence as one; one without words gives none.
    """
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(1, count - width + 1))
    starts = np.zeros(len(first), np.int64)
    np.cumsum(n, out=starts[1:])
    total = int(starts[-1])
    if not total:
        return np.zeros(0, np.uint64), starts
    at = np.arange(total) - np.repeat(starts[:-1], n) + np.repeat(first[:-1], n)
    room = np.repeat(np.minimum(count, width), n)
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(width):
            out += np.where(k < room, padded[at + k] * _SHINGLE[k], np.uint64(0))
        out += room.astype(np.uint64)
    return mix(out), starts


def distinct_by_text(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text begins."""
    n = len(starts) - 1
    out = np.zeros(n + 1, np.int64)
    found = []
    for k in range(n):
        v = np.sort(values[starts[k] : starts[k + 1]])
        if len(v) > 1:
            keep = np.empty(len(v), bool)
            keep[0] = True
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            v = v[keep]
        found.append(v)
        out[k + 1] = out[k] + len(v)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), out
