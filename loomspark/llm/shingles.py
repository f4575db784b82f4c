"""Words and word shingles as 64-bit hashes, computed from the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of texts that are hashed together.
_TOGETHER = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


#: A number for each byte value.
_BYTES = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _A)


class Hasher:
    """Hashes of words and shingles: a word's is a polynomial over its bytes, so a batch of texts takes a few passes over arrays."""

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)

    def _reach(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            self.powers = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(max(n, 64) - 1, _BASE, np.uint64))))
        return self.powers

    def _of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and where each text's begin and end. Only [\\x20\\x09-\\x0D] part words."""
        b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        inner = np.flatnonzero(~_SPACE[b])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        if not len(inner):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        first = np.flatnonzero(np.diff(inner, prepend=-2) > 1)
        sizes = np.diff(first, append=len(inner))
        at = np.arange(len(inner)) - np.repeat(first, sizes)
        h = np.add.reduceat(_BYTES[b[inner]] * self._reach(int(sizes.max()))[at], first)
        return _mix(h ^ sizes.astype(np.uint64) * _C), np.r_[0, np.searchsorted(inner[first], ends)]

    def words(self, text: bytes) -> np.ndarray:
        return self._of([text])[0]

    def each(self, texts: list[bytes], lower: bool = True) -> Iterator[np.ndarray]:
        """The words of each text; lower() acts on A-Z alone."""
        k = 0
        while k < len(texts):
            size, j = len(texts[k]), k + 1
            while j < len(texts) and size + len(texts[j]) <= _TOGETHER:
                size += len(texts[j])
                j += 1
            some = [t.lower() for t in texts[k:j]] if lower else texts[k:j]
            w, edge = self._of(some)
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                yield w[a:z]
            k = j

    def shingles(self, texts: list[bytes], width: int = 3) -> Iterator[np.ndarray]:
        """Sorted distinct hashes of each text's word n-grams; of the whole sequence if it is shorter; empty without words."""
        for w in self.each(texts):
            if len(w):
                h = np.sort(self.ngrams(w, min(width, len(w))))
                w = h[np.r_[True, h[1:] != h[:-1]]]
            yield w

    @staticmethod
    def ngrams(w: np.ndarray, width: int) -> np.ndarray:
        n = len(w) - width + 1
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = (h ^ w[k : k + n]) * (_A, _B, _C)[k % 3]
            h ^= h >> np.uint64(29)
        return _mix(h)


def set_id(hashes: np.ndarray) -> bytes:
    """96 bits that name a set of hashes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=12).digest()


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
