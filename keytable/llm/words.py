"""Words as numbers, vectorised over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A byte table: A-Z lower-cased, ASCII letters and digits and all bytes from 0x80 on
#: stand for themselves, the rest becomes a space.
ALNUM = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
#: A-Z lower-cased, only ASCII white space (0x09-0x0D and 0x20) becomes a space.
BLANK = bytes((c + 32 if 65 <= c <= 90 else c) if c not in (9, 10, 11, 12, 13, 32) else 32 for c in range(256))


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def split(text: bytes, table: bytes) -> list[bytes]:
    return text.translate(table).split()


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield batch.slice(a, b - a)
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_BLOCK = 1 << 16
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_R, _BLOCK), _powers(_R_INV, _BLOCK)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` (bytes in which a space parts words, and
    which end with one), and where each word starts.

    A word's hash is a polynomial in random byte values, taken from prefix sums; the
    powers repeat every 65536 bytes, so longer words are hashed by their pieces."""
    space = data == 32
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    values = _BYTES[data]
    values *= np.resize(_UP, len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values, out=sums[1:])
    # pieces of a word that crosses a border of the powers are hashed and combined
    found = (sums[end] - sums[start]) * _DOWN[start % _BLOCK]
    crossing = np.flatnonzero(start // _BLOCK != (end - 1) // _BLOCK)
    for i in crossing.tolist():
        total, scale = 0, 1
        for c in data[start[i] : end[i]].tolist():
            total = (total + int(_BYTES[c]) * scale) & (1 << 64) - 1
            scale = scale * _R & (1 << 64) - 1
        found[i] = total
    return mix(found + (end - start).astype(np.uint64)), start
