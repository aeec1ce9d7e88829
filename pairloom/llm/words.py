"""Words of texts as NumPy arrays over Arrow's buffers: no Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as a run of characters other
than those six.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK_BYTES = 1 << 18


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(raw: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first and last index, bytes, offsets. One longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values (multiply and shift twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: What is left of eight bytes, read as a little-endian number, when a word has 0 to 8 of them.
MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 64


def words(raw: np.ndarray, offsets: np.ndarray, seed: int = 0, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and n + 1 offsets of the texts in them.

    A word's bytes go eight at a time through `mix`, which is a bijection and not linear: words of up to eight bytes and
    of equal length never share a hash, others do by chance (about 2^-64 a pair). Words of more than LONG bytes are
    hashed by BLAKE2b.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SPACE[raw]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[0] = after[-1] = True
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    inside = ~space
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after)
    data = np.zeros(n + 8, np.uint8)
    data[:n] = LOWER[raw] if lower else raw
    eight = np.ndarray((n + 1,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    length = ends - starts + 1
    key = np.uint64(0x9E3779B97F4A7C15)
    h = mix(length.astype(np.uint64) * key + np.uint64(seed)) ^ (eight[starts] & MASK[np.minimum(length, 8)])
    h = mix(h)
    for at in range(8, LONG, 8):
        some = np.flatnonzero((length > at) & (length <= LONG))
        if not len(some):
            break
        h[some] = mix((h[some] + key) ^ (eight[starts[some] + at] & MASK[np.minimum(length[some] - at, 8)]))
    for i in np.flatnonzero(length > LONG):
        digest = hashlib.blake2b(data[starts[i] : ends[i] + 1], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    return h, np.searchsorted(starts, offsets)
