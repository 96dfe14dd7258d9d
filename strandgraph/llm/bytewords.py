"""Words of whole Arrow text batches as NumPy arrays over their UTF-8 bytes.

Nothing here loops over words or characters in Python: a batch's byte buffer is cut into words with masks and its
words are hashed with one gather, one multiply and one segmented sum. Work proceeds in chunks of about a megabyte, so
that memory is bounded by the chunk or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Bytes that separate words under the two word rules of the operators. The second is stated for lower-cased text, so
#: that A-Z, which its class leaves out, are letters here.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers, so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers of a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


@cache
def powers(n: int, base: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; n is rounded up by the caller so that few tables are kept."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers_for(n: int) -> np.ndarray:
    return powers(1 << max(6, int(n - 1).bit_length()) if n > 1 else 64)


@dataclass
class Texts:
    """Consecutive rows of a batch: their bytes, and the offsets at which rows begin and end."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array | pa.ChunkedArray, target: int = CHUNK_BYTES, most: int = 1 << 30) -> Iterator[Texts]:
    """The rows of a string column in chunks of at most target bytes, or one longer row, and at most `most` rows; null counts as
    empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary()).fill_null(b"")
    else:
        column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1)
        hi = min(hi, n, lo + most)
        yield Texts(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@cache
def _class_table(separators: bytes) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


@cache
def _letters(seed: int) -> np.ndarray:
    """A 64-bit value for each byte, the same for a letter A-Z and its lower case."""
    out = stream(256, seed)
    out[0x41:0x5B] = out[0x61:0x7B]
    return out


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    #: For each row, where its words begin among all words; one more entry at the end.
    rows: np.ndarray


def words(texts: Texts, separators: bytes) -> Words:
    """Word bounds: maximal runs of non-separators, broken at row bounds."""
    inside = _class_table(separators)[texts.data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(texts.offsets), np.int64))
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[texts.offsets] = True
    before = np.empty(len(inside), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.empty(len(inside), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets))


def word_hashes(texts: Texts, found: Words, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased: a polynomial in its bytes' values, then mixed with its length."""
    if not len(found.starts):
        return np.zeros(0, np.uint64)
    sizes = found.ends - found.starts
    total = np.concatenate(([0], np.cumsum(sizes)))
    small = np.int32 if len(texts.data) < 1 << 31 else np.int64
    place = np.arange(total[-1], dtype=small)
    place -= np.repeat(total[:-1].astype(small), sizes)
    at = place + np.repeat(found.starts.astype(small), sizes)
    values = _letters(seed)[texts.data[at]]
    del at
    values *= powers_for(int(sizes.max()))[place]
    return mix(np.add.reduceat(values, total[:-1]) + sizes.astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and the row of each; a row of fewer words, but not none, has its whole sequence."""
    weights = stream(k, 77) | np.uint64(1)
    counts = np.diff(rows)
    windows = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), windows)
    if not len(row):
        return np.zeros(0, np.uint64), row
    first = np.repeat(rows[:-1], windows) + np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    out = np.zeros(len(row), np.uint64)
    left = counts[row]
    for j in range(k):
        out += np.where(j < left, padded[first + j], np.uint64(0)) * weights[j]
    return mix(out + np.minimum(left, k).astype(np.uint64)), row
