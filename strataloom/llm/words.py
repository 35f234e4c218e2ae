"""Word and shingle hashing of whole texts, vectorised over chunks of documents."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

_U = np.uint64
BLOCK_BYTES = 250_000
_SPACE = frozenset((32, *range(9, 14)))
_SEED = 20_11  # of a word's hash
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _hash_block(raw: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = [np.zeros(0, dtype=np.uint64)], []
    for r in raw:
        words = (r.lower() if lower else r).split()
        hashes.append(np.fromiter(map(xxh3_64_intdigest, words, repeat(_SEED)), np.uint64, len(words)))
        counts.append(len(words))
    return np.concatenate(hashes), np.asarray(counts, dtype=np.int64)


def _pieces(raw: bytes) -> list[bytes]:
    """A long text in pieces of about a block, cut at white space."""
    out, at = [], 0
    while len(raw) - at > 2 * BLOCK_BYTES:
        end = at + BLOCK_BYTES
        while end < len(raw) and raw[end] not in _SPACE:
            end += 1
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Stable 64-bit hash of every word (bytes between ASCII white space) of all texts in turn, and the number of words of each.

    The hash (XXH3 with a seed) is not linear in a word's bytes, so no family of words collides by its form; with ``lower``
    A to Z count as a to z.
    """
    hashes, counts, first, block, size = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [], [], 0
    done = 0
    for t in texts:
        first.append(done)
        for piece in _pieces((t or "").encode("utf-8", "surrogatepass")):
            block.append(piece)
            done += 1
            size += len(piece)
            if size >= BLOCK_BYTES:
                for out, v in zip((hashes, counts), _hash_block(block, lower)):
                    out.append(v)
                block, size = [], 0
    if block:
        for out, v in zip((hashes, counts), _hash_block(block, lower)):
            out.append(v)
    return np.concatenate(hashes), np.add.reduceat(np.concatenate(counts), first) if first else np.zeros(0, dtype=np.int64)


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (``len(h) - k + 1`` values, none if there are fewer words)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        acc = (acc ^ (acc >> _U(29))) * _U(_STEP) + h[i : i + n]
    return mix(acc + _U(k))


def give_back() -> None:
    """Return this worker's freed memory to the system, where its C library can: workers are used again by the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches, columns: int, most_chars: int) -> Iterator[list[list]]:
    """Rows of Arrow batches as lists per column, in chunks of about ``most_chars`` characters of the last column."""
    rows: list[list] = [[] for _ in range(columns)]
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns))):
            for c, v in zip(rows, row):
                c.append(v)
            size += len(row[-1] or "") + 64
            if size >= most_chars:
                yield rows
                rows, size = [[] for _ in range(columns)], 0
                pa.default_memory_pool().release_unused()
    if rows[0]:
        yield rows
    give_back()
