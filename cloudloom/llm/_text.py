"""Vectorised text primitives for Arrow batches: words, 64-bit hashes, sets of shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None
U = np.uint64


def trim() -> None:
    """Gives freed memory back to the system: two workers share an executor's allowance with its JVM."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes.astype(np.int64)), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            # a copy: kernels such as ascii_lower garble arrays whose first offset isn't 0
            yield batch if to - at == batch.num_rows else batch.take(pa.array(np.arange(at, to)))
            at = to
        if batch.nbytes > 1 << 20:
            trim()


def gathered(batches, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Small batches put together up to about ``limit`` bytes: words that recur are then met once."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    return texts if not len(texts) or first_offset(texts) == 0 else texts.take(pa.array(np.arange(len(texts))))


def first_offset(texts: pa.Array) -> int:
    return int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words (runs of other than ASCII white space) of all texts, and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else lists.values
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)]).astype(np.int64)
    return before[offsets], (flat if full.all() else flat.filter(pa.array(full)))


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's place in the list of distinct words, and that list."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hashes(strings: pa.Array, seed: int = 0) -> np.ndarray:
    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(s, seed) for s in strings.to_pylist()), dtype=U, count=len(strings))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = x ^ (x >> U(31))
    x = x * U(0x9FB21C651E98DF25)
    x = x ^ (x >> U(28))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def multiplier(i: int) -> np.uint64:
    return U(xxhash.xxh3_64_intdigest(b"place", i) | 1)


def window_hashes(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows inside texts, and the text of each. Shorter texts have none."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    acc = np.zeros(n, U)
    for i in range(width):
        acc += h[i : i + n] * multiplier(i)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:n] == doc[width - 1 :]
    return mixed(acc[inside]), doc[:n][inside]


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: sorted 64-bit hashes, and where each text's begin and end.

    Words are lower-cased in A-Z. A text of fewer than ``width`` words has its whole sequence as the one shingle;
    a text without words has none.
    """
    offsets, words = split_words(pc.ascii_lower(texts))
    codes, vocabulary = coded(words)
    h = hashes(vocabulary)[codes] if len(words) else np.empty(0, U)
    shingles, doc = window_hashes(h, offsets, width)
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.empty(len(short), U)
        with np.errstate(over="ignore"):
            for k, i in enumerate(short):
                acc = U(counts[i])
                for j, x in enumerate(h[offsets[i] : offsets[i + 1]]):
                    acc = acc + x * multiplier(100 + j)
                extra[k] = acc
        shingles, doc = np.concatenate([shingles, mixed(extra)]), np.concatenate([doc, short])
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    shingles, doc = shingles[new], doc[new]
    return shingles, np.searchsorted(doc, np.arange(len(texts) + 1))
