"""Word shingles of whole Arrow batches of texts as numpy arrays: no loop over words.

Words are what is left between ASCII white space after lower-casing. A shingle is five words in a row; a text of one to
four words has one shingle, all its words. Words and shingles are 64-bit hashes of their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

N = 5
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, N, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: np.uint64 = _R) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of a batch: byte spans in ``data``, hashes, and for text i the words ``first[i]:first[i + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each begins; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]] if len(at) else data[:0], at - at[0]


def words(texts: pa.Array, fold: bool = True) -> Words:
    """``fold``: in lower case."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    data, at = utf8(pc.utf8_lower(texts) if fold else texts)
    none = np.zeros(0, np.int64)
    if not len(data):
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(at), np.int64))
    gap = _SPACE[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    cuts = at[1:-1][at[1:-1] < len(data)]
    begins[cuts] |= ~gap[cuts]
    start = np.flatnonzero(begins)
    if not len(start):
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(at), np.int64))
    kept = np.flatnonzero(~gap)
    word = np.cumsum(begins)[kept] - 1
    size = np.bincount(word, minlength=len(start))
    place = kept - start[word]
    value = _BYTE[data[kept]] * powers(int(size.max()))[place]
    head = np.concatenate(([0], np.cumsum(size)[:-1]))
    return Words(data, start, start + size, mix(np.add.reduceat(value, head)), np.searchsorted(start, at))


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, the text each is from, and the word each begins at."""
    n = w.count
    owner = np.repeat(np.arange(len(n)), n)
    if not len(owner):
        return w.hash, owner, owner
    left = w.first[1:][owner] - np.arange(len(owner))
    at = np.flatnonzero((left >= N) | ((n[owner] < N) & (left == n[owner])))
    padded = np.concatenate((w.hash, np.zeros(N, np.uint64)))
    out = np.zeros(len(at), np.uint64)
    for k in range(N):
        out += np.where(left[at] > k, padded[at + k], np.uint64(0)) * _PLACE[k]
    return mix(out), owner[at], at


def slices(batch: pa.RecordBatch, column: str, most: int = 1_500_000):
    """Runs of rows of about ``most`` bytes of text at most (a longer text alone), so that arrays stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)
