"""Words, shingles and their hashes, as the text operators share them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` folds A-Z alone. Null has none.

    ``bytes.split`` and ``bytes.lower`` follow exactly these ASCII rules.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` word hashes, in order; empty for fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out = mix(out * M1 + hashes[k : k + count])
    return out


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Hashes of the ``n``-word shingles; of the whole sequence where it is shorter."""
    hashes = hash_words(words)
    if 0 < len(words) < n:
        return grams(hashes, len(words)) ^ np.uint64(len(words))
    return grams(hashes, n)


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """128 bits of an array's content as two signed 64-bit integers."""
    h = xxh3_128_intdigest(values.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def list_array(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow list<int64> column from numpy arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64, copy=False)))


def rows_array(matrix: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column from the rows of a matrix."""
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.ravel().astype(np.int64, copy=False)))


def release() -> None:
    """Give memory that the allocators keep back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, so that what a worker derives from them stays small.

    Python workers outlive their tasks and share the executor's memory with the JVM, so
    what is free goes back when the task ends.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        del batch
    release()
