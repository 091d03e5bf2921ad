"""Vectorised text primitives over Arrow string columns (numpy, one pass per byte).

Words are maximal runs of bytes outside ``{0x20, 0x09..0x0D}``; in UTF-8 these bytes never occur inside a
multi-byte character, so working on bytes equals working on code points. ``span_hash`` takes spans eight bytes at a
time through a mixer that is linear in nothing; long spans go to xxhash. ``slide_hash`` is a running polynomial
(mod 2^64), whose collisions can be built: it picks and proposes, and never decides that two spans are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multiplier of the running polynomial.
P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text worked on at once; bounds a worker's memory (about 60 times this).
CHUNK = 1 << 20
#: The first bytes of eight, by their number; spans beyond LONG bytes go to xxhash.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
LONG, SEED = 64, 0x5EED

_pw = np.ones(1, U)
_ipw = np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i < n, kept between calls."""
    global _pw, _ipw
    if len(_pw) < n:
        a, b = np.full(n, P, U), np.full(n, P_INV, U)
        a[0] = b[0] = 1
        _pw, _ipw = np.cumprod(a), np.cumprod(b)
    return _pw, _ipw


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher (murmur3's)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * P^k for i <= k < j."""
    h = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data) + 1)[0][: len(data)], out=h[1:])
    return h


def slide_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Position-independent hashes of data[s:e]; h from prefix_hash."""
    return mix((h[e] - h[s]) * powers(len(h))[1][s])


def blocks_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the bytes data[s:e]."""
    import xxhash

    n, w = e - s, blocks_of(data)
    out = mix(n.astype(U) * U(P))
    long_ = n > LONG
    at, k = np.flatnonzero(~long_), 0
    while len(at):
        out[at] = mix((out[at] ^ (w[s[at] + k] & LOW[np.minimum(n[at] - k, 8)])) * U(P) + U(k + 1))
        k += 8
        at = at[n[at] > k]
    if long_.any():
        raw = memoryview(np.ascontiguousarray(data))
        out[long_] = [xxhash.xxh3_64_intdigest(raw[a:b], SEED) for a, b in zip(s[long_].tolist(), e[long_].tolist(), strict=True)]
    return out


def equal_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether data[s:e] has the bytes that start at t."""
    n, w = e - s, blocks_of(data)
    out = np.ones(len(s), bool)
    at, k = np.flatnonzero((n > 0) & (s != t)), 0
    while len(at):
        low = LOW[np.minimum(n[at] - k, 8)]
        same = w[s[at] + k] & low == w[np.minimum(t[at] + k, len(data))] & low
        out[at[~same]] = False
        k += 8
        at = at[same & (n[at] > k)]
    return out


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def release() -> None:
    """Gives freed memory back to the system: workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def blocks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; a longer text is whole, alone."""
    data, offs = strings(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    release()


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and for each text the index of its first word (one more entry than texts)."""
    ns = np.empty(len(data) + 1, bool)
    ns[:-1] = ~SPACE[data]
    ns[-1] = False
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[1:] = True, ~ns[:-1]
    edge[offs] = True
    starts = np.flatnonzero(ns & edge)
    edge[-1] = True
    ends = np.flatnonzero(ns[:-1] & (edge[1:] | ~ns[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def ngrams(wh: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, the i-th starting at word i."""
    if len(wh) < n:
        return np.zeros(0, U)
    out = np.full(len(wh) - n + 1, n, U)
    for k in range(n):
        out = (out ^ wh[k : len(wh) - n + 1 + k]) * U(P) + U(0x632BE59BD9B4E019)
        out ^= out >> U(29)
    return mix(out)


def pack(sorted_values: np.ndarray) -> bytes:
    """A sorted uint64 array as zstd over the byte planes of its differences."""
    import zstandard

    d = np.diff(sorted_values, prepend=U(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    d = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(d, dtype=U)
