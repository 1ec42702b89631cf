"""Whole texts cut into words, a bounded slice of an Arrow batch at a time.

Used inside Spark tasks.  Everything is linear in the bytes of the slice, and a slice holds ``max_bytes`` of text or
one single longer document, so memory does not depend on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with at most ``max_bytes`` of ``column`` each; a longer text is alone."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def whole_texts(column: pa.Array) -> pa.Array:
    """Null becomes the empty text; offsets are 64 bits wide.

    A slice is copied first: Arrow's string kernels read slices of wide strings from the wrong place.
    """
    if column.offset:
        column = column.take(pa.array(np.arange(len(column))))
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(column: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    r"""Words ``[^\x20\x09-\x0D]+`` of each text, A-Z lower-cased if asked for.

    Returns the distinct words, the code of every word in text order, and the offsets of the texts in the codes
    (one more than there are texts).  A null or blank text has no words.
    """
    texts = whole_texts(column)
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word, the same in every task."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))
