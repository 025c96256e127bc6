"""Words and word shingles as 64-bit hashes, for use inside Arrow tasks.

A word is a maximal run of bytes other than space and the control characters 9 to 13, after A-Z are
lower-cased; other letters keep their case.  ``bytes.lower`` and ``bytes.split`` do exactly that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
#: Distinct words that a task remembers; the table starts afresh beyond, which only costs time.
REMEMBERED = 1 << 18

_MASK = (1 << 64) - 1


def _odd(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    return np.array([xxhash.xxh3_64_intdigest(b"%d" % i, seed=seed) | 1 for i in range(n)], dtype=np.uint64)


class WordHashes(dict):
    """word -> 64-bit hash, filled on first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers after which all bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_PLACES = _odd(11, 64)


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive words, in order of position."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += words[i : i + n] * _PLACES[i]
    return mixed(total)


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingles; with fewer than `width` words the whole sequence is one, without words there is none."""
    n = len(words)
    if n >= width:
        return np.unique(grams(words, width))
    if not n:
        return np.empty(0, np.uint64)
    return mixed((words * _PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
