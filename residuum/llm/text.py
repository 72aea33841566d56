"""Words, word hashes and shingle sets of whole texts, for use inside tasks.

Words are the runs of bytes other than space and \\x09-\\x0D after A-Z are lower-cased:
``bytes.lower().split()`` does exactly that on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Word hashes a Python worker remembers before it starts anew.
CACHE_WORDS = 500_000
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """64-bit hash of each word, remembered; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, in text order; none if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return hashes[:0]
    total = np.full(count, n, dtype=np.uint64)
    for i in range(n):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return total


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingles; a shorter text is one shingle, no word none."""
    if not len(hashes):
        return hashes
    return np.unique(gram_hashes(hashes, min(n, len(hashes))))


def hashes_of(tokens: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text of a column, one at a time."""
    column = column.cast(pa.large_binary())
    for value in column:
        yield value.as_py()


def long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))
