"""Word positions and word hashes of whole Arrow columns, without a loop over rows.

An Arrow string column is one byte buffer with offsets, so a batch of texts is
split and hashed with a handful of array operations. Hashes are 64-bit
polynomials over table values of the bytes; they do not depend on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same six characters as one-character strings, for ``str`` methods.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text that are worked on at once; bounds the arrays a task holds.
CHUNK_BYTES = 2 << 20

_SPLITMIX_1, _SPLITMIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15
BYTE_RADIX = 0x2545F4914F6CDD1D
WORD_RADIX = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * _SPLITMIX_1
    x = (x ^ (x >> np.uint64(27))) * _SPLITMIX_2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt * 1009)) * np.uint64(_GOLDEN))


@lru_cache(maxsize=8)
def _powers(radix: int, bits: int) -> np.ndarray:
    p = np.full(1 << bits, radix, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def powers(radix: int, n: int) -> np.ndarray:
    return _powers(radix, max(10, int(n).bit_length()))[:n]


def _table(word_byte, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return np.array([bool(word_byte(b)) for b in range(256)]), fold, seeds(256)[fold]


#: Words between ASCII white space; the same lower-cased in A-Z; letters, digits and all non-ASCII, lower-cased.
SPACED = _table(lambda b: b not in SPACES, lower=False)
SPACED_LOWER = _table(lambda b: b not in SPACES, lower=True)
ALNUM_LOWER = _table(lambda b: b >= 128 or chr(b).isalnum(), lower=True)


@dataclass
class Words:
    """The words of some texts: byte range and hash of each, and the first word of each text (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text (a longer text stands alone)."""
    offsets = text_buffers(batch.column(column))[1]
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """A string column in runs with about ``limit`` bytes of text."""
    for part in slices(pa.record_batch([column], ["text"]), "text", limit):
        yield part.column(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, table=SPACED) -> Words:
    is_word_byte, _, value = table
    data, offsets = text_buffers(column)
    inside = is_word_byte[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets[:-1]] = False  # a word never spans two texts
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    length = end - start
    begin = np.cumsum(length) - length
    if len(start):
        within = np.arange(int(length.sum())) - np.repeat(begin, length)
        h = value[data[np.flatnonzero(inside)]] * powers(BYTE_RADIX, int(length.max()))[within]
        h = mix(np.add.reduceat(h, begin))
    else:
        h = np.zeros(0, np.uint64)
    return Words(data, start, end, h, np.searchsorted(start, offsets))


def gram_hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every n consecutive values (also across texts: mask those with :func:`gram_starts`)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    radix = np.uint64(WORD_RADIX)
    for k in range(n):
        out = out * radix + h[k : k + m]
    return mix(out + np.uint64(salt * 7919 + n))


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Whether n words from each position stay in one text."""
    total = int(first[-1])
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))[:m]
    return np.arange(m) + n <= last


def window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive values, in log n passes."""
    return _window(x, n, np.minimum)


def window_max(x: np.ndarray, n: int) -> np.ndarray:
    return _window(x, n, np.maximum)


def _window(x: np.ndarray, n: int, pick) -> np.ndarray:
    m = len(x) - n + 1
    if m <= 0:
        return x[:0]
    width = 1
    while width * 2 <= n:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[:m], x[n - width : n - width + m])
