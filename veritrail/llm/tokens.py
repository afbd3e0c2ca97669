"""Words, word hashes and shingles of whole UTF-8 texts, vectorised over Arrow batches.

Texts are handled as bytes. A batch is cut into chunks of whole documents of about CHUNK bytes, and hashes
are taken over pieces of about PIECE bytes, so that memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK, PIECE = 2 << 20, 1 << 20

_BYTES = np.arange(256)
#: A-Z lower-cased, all other bytes as they are.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: 0-9, a-z and all of multi-byte characters.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public murmur3 constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        made = []
        for base in (_ODD, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = made[0], made[1]
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Chunk:
    """Whole documents of one batch: rows [first, first + n) of it, their lower-cased bytes and where each begins."""

    batch: pa.RecordBatch
    first: int
    low: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name).slice(self.first, self.n)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of all rows; a null text is an empty one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            raw = data[offsets[first] : offsets[last]]
            yield Chunk(batch, first, LOWER[raw], raw, offsets[first : last + 1] - offsets[first])
            first = last


@dataclass
class Words:
    """Words of a chunk in order: byte spans, and of each document the first word (``of`` has n + 1 entries)."""

    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.of)


def words(chunk: Chunk, kind: np.ndarray = ALNUM) -> Words:
    inside = kind[chunk.low]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        bounds = chunk.offsets[1:-1]
        before[bounds[bounds < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
        bounds = chunk.offsets[1:-1] - 1
        after[bounds[bounds >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.offsets, "left"))


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: equal bytes, equal hashes, in any document and batch. Both bounds ascend."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        base = starts[i]
        piece = low[base : ends[j - 1]]
        up, down = powers(len(piece))
        x = (piece.astype(np.uint64) + np.uint64(1)) * up
        total = np.cumsum(x)
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e - 1] - total[s] + x[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(chunk: Chunk, w: Words) -> np.ndarray:
    return span_hashes(chunk.low, w.starts, w.ends)


def shingles(hashes: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of each document, and of each document the first (n + 1 entries)."""
    counts = np.maximum(np.diff(of) - (k - 1), 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    at = np.arange(first[-1]) + np.repeat(of[:-1] - first[:-1], counts)
    out = hashes[at]
    for j in range(1, k):
        out = mix(out * _ODD + hashes[at + j])
    return out, first
