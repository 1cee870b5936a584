"""Packed numbers for shuffles: sorted blocks per bucket of a hash space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    kind = np.dtype(kind)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which of equal parts of the hash space each key is in (sorted keys give
    sorted buckets)."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cut_points(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal values."""
    if not len(sorted_values):
        return []
    cuts = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    return list(zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(sorted_values)].tolist()))


def record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of a schema like ``"bucket long, keys binary"``."""
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[kind])
                                       for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])
