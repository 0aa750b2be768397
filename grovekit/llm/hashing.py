"""64-bit hashes of words and runs of words, for whole Arrow batches at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are hashed together, about.
BLOCK_BYTES = 1 << 20
#: Words of more bytes are hashed one by one: of a polynomial modulo 2^64 two long words can be made to agree.
LONG_WORD = 128

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_code = mix(_lower.astype(np.uint64) + np.uint64(1))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 65536)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space, A-Z in lower case) of texts that lie end to end in `data`
    (bytes) between `edges`; and the number of the first word of each text, with the total at the end."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    inside = ~_space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = edges[(edges > 0) & (edges < n)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = np.empty(n, bool)
    last[:-1] = ~inside[1:]
    last[-1] = True
    last[cuts - 1] = True
    ends = np.flatnonzero(last & inside) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_code[data] * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(_lower[data[starts[i] : ends[i]]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(starts, edges)


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, edges) for runs of texts of about BLOCK_BYTES. Nulls are empty texts."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    if column.null_count:
        filled = column.fill_null(b"")
        yield from blocks(filled)
        return
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "left"))
        j = min(max(j, i + 1), len(column))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text, and where each text's begin. A text of fewer words, but not
    none, has one run: all of it."""
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(counts)), n)
    at = first[:-1][text] + (np.arange(begin[-1]) - begin[:-1][text])
    short = counts[text] < size
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        use = at + j < first[1:][text]
        w = np.where(use, words[np.minimum(at + j, max(len(words) - 1, 0))], np.uint64(0)) if short.any() else words[at + j]
        h = mix(h * np.uint64(_BASE) + w + np.uint64(j + 1))
    return h, begin
