"""Helpers that several operators share: UTF-8 buffers of Arrow columns, words and their hashes.

Everything here works on pieces of a column of about a megabyte, so that the temporary arrays stay
small however large an Arrow batch is. A single text longer than that makes a piece of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_RADIX = 0xD1342543DE82EF95


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(keep) -> np.ndarray:
    """A table of 256 booleans, true where keep(byte) is."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Words are runs of anything but blanks (space and the controls 9 to 13).
NOT_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of digits, lower-case letters and all bytes of characters beyond ASCII.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd radix and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(PIECE + 64, n)
        for name, base in (("up", _RADIX), ("down", pow(_RADIX, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, their offsets) for runs of rows of about limit bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands memory that is no longer used back to the system: workers live on between tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def batch_pieces(batch, column: str, limit: int = PIECE):
    """Slices of an Arrow batch or table whose texts take about limit bytes."""
    _, offsets = utf8(batch.column(column))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield batch.slice(i, j - i)
        i = j
    give_back()


def word_bounds(low: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes for which inside is true; runs end with their row."""
    m = inside[low]
    if not len(m):
        return (np.zeros(0, np.int64),) * 3
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    edge = np.unique(offsets)
    at = edge[edge < len(m)]
    first[at] = m[at]
    at = edge[edge > 0] - 1
    last[at] = m[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Spans of more bytes are hashed by a digest: a running sum modulo 2**64 takes long words of a regular build for one another.
SUMMED = 16


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: of short ones from one running sum over all bytes, of others a digest."""
    up, down = powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(BYTE_CODES[low] * up[: len(low)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = mix(h ^ (ends - starts).astype(np.uint64) * _GOLD)
    long = np.flatnonzero(ends - starts > SUMMED)
    if len(long):
        h[long] = np.frombuffer(byte_digests(low, starts[long], ends[long], 8), np.uint64)
    return h


def byte_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> bytes:
    """Digests of byte spans, of size bytes each, end to end."""
    view, digest = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    return b"".join([digest(view[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes (at every start that has n words after it)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for j in range(n):
        h += words[j : j + count]
        h *= np.uint64(_RADIX)
        h ^= h >> np.uint64(29)
    return mix(h)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of width values, in log2(width) passes."""
    have, m = 1, v
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


#: How many places one pass of rightmost_least tells apart; the other bits of a value are compared.
PLACE_BITS = 22


def rightmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values the place of the least, the rightmost of equals.

    Always the same leading bits of the values are compared, in windows of any place of an array of any length, so
    equal windows choose equal places.
    """
    low = (np.uint64(1) << np.uint64(PLACE_BITS)) - np.uint64(1)
    most, out = (1 << PLACE_BITS) - width, []
    for i in range(0, max(1, len(values) - width + 1), most):
        v = values[i : i + most + width - 1]
        v = (v & ~low) | (low - np.arange(len(v), dtype=np.uint64))
        out.append((low - (sliding_min(v, width) & low)).astype(np.int64) + i)
    return out[0] if len(out) == 1 else np.concatenate(out)


def starts_of(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(groups):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
