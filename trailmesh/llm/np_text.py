"""Vectorised text primitives on Arrow string buffers, for Arrow-batched operators.

All functions work on the UTF-8 bytes of whole texts. Memory is bounded: a batch is
walked in segments of about ``SEGMENT`` bytes, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 2_000_000
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, letters and all bytes of code points from U+0080 on.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SEGMENT + 4096)
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        have = _powers[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _segments(buf: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the buffer that fall between words or at the start of a text."""
    at, starts = 0, set(bounds.tolist())
    while at < len(buf):
        end = min(at + SEGMENT, len(buf))
        while end < len(buf) and IS_WORD[buf[end]] and IS_WORD[buf[end - 1]] and end not in starts:
            end += 1
        yield at, end
        at = end


def word_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and 64-bit hashes of all (lower-cased) words, in order."""
    out = []
    for a, b in _segments(buf, bounds):
        seg = LOWER[buf[a:b]]
        word = IS_WORD[seg]
        first = np.zeros(b - a + 1, bool)
        cut = bounds[(bounds >= a) & (bounds < b)] - a
        first[cut] = True
        edge = np.empty(b - a + 1, bool)
        edge[0], edge[-1] = word[0], word[-1]
        edge[1:-1] = word[1:] != word[:-1]
        both = np.flatnonzero(first[1 : b - a] & word[1:] & word[:-1]) + 1  # a text starts inside a run
        pos = np.flatnonzero(edge)
        starts, ends = pos[0::2], pos[1::2]
        if len(both):
            starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(seg.astype(np.uint64) * up[:-1], out=sums[1:])
        out.append((starts + a, ends + a, mix((sums[ends] - sums[starts]) * down[starts])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def words_per_text(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index of the first word of every text, and the number of words at the end."""
    return np.searchsorted(starts, bounds)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def parts(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, or a single row."""
    sizes = np.diff(buffer_of(batch.column(column))[1])
    a = 0
    while a < len(batch):
        b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), most, "right")))
        yield batch.slice(a, b - a)
        a = b
