"""Small helpers for Arrow batches of texts: bounded slices, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Characters that separate words, as the contracts state them.
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SLICE_BYTES = 4 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of text each
    (one row at least, however long it is), so that what a worker holds
    beside the batch does not depend on the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield batch.slice(int(lo), int(hi - lo))


def whole_texts(texts: pa.Array) -> pa.Array:
    """The texts of a slice as an array of its own, nulls as empty texts.
    (Some Arrow kernels mistake the offsets of sliced and cast arrays.)"""
    own = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(own, "")


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one flat array, and the
    number of words of each text (null: none). ``lower`` maps A-Z only."""
    texts = whole_texts(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)
    mask = real.to_numpy(zero_copy_only=False)
    offsets = parts.offsets.to_numpy()
    before = np.r_[0, np.cumsum(mask, dtype=np.int64)]
    at = before[offsets - offsets[0]]
    return flat.filter(real), np.diff(at)


def word_table(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct words (equal in every process), and the
    place of each word among them."""
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; equal in every process."""
    table, places = word_table(words)
    return table[places] if len(table) else np.empty(0, np.uint64)


def word_ids(words: pa.Array) -> np.ndarray:
    """A number for each word, equal for equal words of this array only."""
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
