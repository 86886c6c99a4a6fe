"""Words and shingles of Arrow text columns as 64-bit hashes, computed with numpy inside Spark tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one numpy step takes together; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20
LONG_WORD = 1024

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_M = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _S)
    x = x * _M
    x = x ^ (x >> _S)
    x = x * _M
    return x ^ (x >> _S)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes with a blank after each text, start of each text); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        # piece by piece: filled nulls would copy all texts
        part = pc.fill_null(texts.slice(i, j - i), "").cast(pa.large_string())
        _, offsets, data = part.buffers()
        off = np.frombuffer(offsets, np.int64, j - i + 1, part.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        d = np.insert(raw[off[0] : off[-1]], off[1:] - off[0], 0x20)
        yield i, j, d, off[:-1] - off[0] + np.arange(j - i)
        i = j


def lower(d: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[d]


def word_spans(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes that end with a break."""
    b = _BREAK[d]
    edge = np.flatnonzero(b[1:] != b[:-1]) + 1
    if not b[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def core_spans(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words that hold a letter or digit, then of their part from the first such to the last."""
    s, e = word_spans(d)
    places = np.flatnonzero(_CORE[d])
    a, b = np.searchsorted(places, s), np.searchsorted(places, e)
    has = b > a
    s, e, a, b = s[has], e[has], a[has], b[has]
    return (s, e, places[a], places[b - 1] + 1) if len(s) else (s, e, s, e)


def hash_spans(d: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    padded = np.concatenate([d, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(d) + 1,), "<u8", padded, 0, (1,))
    n = end - start
    h = mix64(n.astype(np.uint64) + _M)
    todo = np.flatnonzero((n > 0) & (n <= LONG_WORD))
    at = 0
    while todo.size:
        left = n[todo] - at
        h[todo] = mix64(h[todo] ^ (eight[start[todo] + at] & _MASK[np.minimum(left, 8)]))
        at += 8
        todo = todo[left > 8]
    for k in np.flatnonzero(n > LONG_WORD):
        h[k] = int.from_bytes(hashlib.blake2b(d[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = mix64(h[:n])
    for k in range(1, size):
        x = mix64(x * np.uint64(3) + h[k : k + n])
    return x


#: Buckets in which words are counted.
WORD_BUCKETS = 1 << 14


def word_buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int64)


def shingle_sets(texts: pa.Array, size: int, levels: np.ndarray | None = None, count: np.ndarray | None = None):
    """(row, sorted distinct shingle hashes, their levels): a shorter text is one shingle, no words give none.

    levels: a level for each word bucket; a shingle's level is the sum over its words (None without levels).
    count: gets the number of words in each bucket added.
    """
    for i, j, d, starts in pieces(texts):
        d = lower(d)
        s, e = word_spans(d)
        h = hash_spans(d, s, e)
        if count is not None:
            count += np.bincount(word_buckets(h), minlength=WORD_BUCKETS)
        w = windows(h, size)
        if levels is not None and len(w):
            level = levels[word_buckets(h)]
            level = sum(level[k : k + len(w)] for k in range(size))
        first = np.searchsorted(s, starts)
        for row, a, b in zip(range(i, j), first, np.append(first[1:], len(s)), strict=True):
            if b - a >= size:
                mine = w[a : b - size + 1]
                if levels is None:
                    yield row, np.unique(mine), None
                else:
                    mine, at = np.unique(mine, return_index=True)
                    yield row, mine, level[a : b - size + 1][at]
            elif b > a:
                yield row, mix64(windows(h[a:b], b - a) + np.uint64(b - a)), np.zeros(1, np.int64)
            else:
                yield row, np.zeros(0, np.uint64), np.zeros(0, np.int64)
