"""A cuckoo filter over 64-bit hashes, filled and asked in whole arrays."""

from __future__ import annotations

import numpy as np

from themeflow.llm.arrowtext import mix64

SLOTS = 4
_LOAD = 0.8
_MOST_ROUNDS = 5000


class CuckooFilter:
    """16-bit fingerprints in buckets of four; zero marks an empty slot. No
    false negatives; entries can be removed again."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets
        self.mask = np.uint64(len(buckets) - 1)

    @classmethod
    def sized_for(cls, n: int) -> "CuckooFilter":
        need = max(1, int(np.ceil(n / (SLOTS * _LOAD))))
        return cls(np.zeros((1 << (need - 1).bit_length(), SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, blob: bytes) -> "CuckooFilter":
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.buckets.tobytes()

    def _places(self, hashes: np.ndarray):
        fp = (hashes >> np.uint64(48)).astype(np.uint16)
        fp = np.where(fp == 0, np.uint16(1), fp)
        one = mix64(hashes) & self.mask
        return fp, one, self._other(one, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(fp.astype(np.uint64)) & self.mask)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(hashes)
        return ((self.buckets[one] == fp[:, None]) | (self.buckets[two] == fp[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray) -> None:
        """One entry for each hash (size the filter for all of them)."""
        fp, at, other = self._places(hashes)
        fp, at = self._fill(fp, at)[0], other[self._left]
        rng = np.random.default_rng(len(hashes))
        for _ in range(_MOST_ROUNDS):
            fp, at = self._fill(fp, at)
            if not len(fp):
                return
            # each full bucket gives up one entry for one that waits at it
            _, head = np.unique(at, return_index=True)
            slot = rng.integers(0, SLOTS, len(head))
            out = self.buckets[at[head], slot]
            self.buckets[at[head], slot] = fp[head]
            fp[head], at[head] = out, self._other(at[head], out)
        raise RuntimeError("cuckoo filter is too small for its entries")

    def _fill(self, fp: np.ndarray, at: np.ndarray):
        """Put what fits into free slots; returns the rest (in order)."""
        order = np.argsort(at, kind="stable")
        here = at[order]
        first = np.r_[True, here[1:] != here[:-1]] if len(here) else np.empty(0, bool)
        turn = np.arange(len(here)) - np.maximum.accumulate(np.where(first, np.arange(len(here)), 0))
        free = self.buckets[here] == 0
        fits = turn < free.sum(axis=1)
        rank = np.cumsum(free, axis=1)
        slot = np.argmax((rank == (turn + 1)[:, None]) & free, axis=1)
        self.buckets[here[fits], slot[fits]] = fp[order][fits]
        self._left = np.sort(order[~fits])
        return fp[self._left], at[self._left]

    def remove(self, hashes: np.ndarray) -> None:
        """Take out one entry for each hash; each must have been inserted."""
        fp, one, two = self._places(hashes)
        for f, a, b in zip(fp.tolist(), one.tolist(), two.tolist()):
            for bucket in (a, b):
                slot = np.flatnonzero(self.buckets[bucket] == f)
                if len(slot):
                    self.buckets[bucket, slot[0]] = 0
                    break
